"""Retrieval and extraction metrics, gates, samples and corpus tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X


def recall_at(retrieved: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """k, hit, recall, mrr, ndcg: means over the queries of relevant. retrieved: qid, doc_id, rank; relevant: qid, doc_id."""
    relevant = relevant.select("qid", "doc_id").distinct()
    n = relevant.groupBy("qid").agg(F.count("*").alias("n_rel"))
    cut = n.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    found = retrieved.join(relevant, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.collect_list("rank").alias("ranks"))
    ranks = F.filter(F.coalesce("ranks", F.array().cast("array<int>")), lambda r: r <= F.col("k"))
    dcg = F.aggregate(F.array_sort(F.col("r")), F.lit(0.0), lambda s, x: s + 1 / F.log2(x + F.lit(1.0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("k", "n_rel").cast("int")), F.lit(0.0), lambda s, x: s + 1 / F.log2(x + F.lit(1.0)))
    rows = cut.join(found, "qid", "left").withColumn("r", ranks)
    per = rows.select("k", (F.size("r") > 0).cast("double").alias("hit"), (F.size("r") / F.col("n_rel")).alias("recall"), F.coalesce(1 / F.array_min("r"), F.lit(0.0)).alias("mrr"), (dcg / ideal).alias("ndcg"))
    return per.groupBy("k").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "mrr", "ndcg")), F.count("*").alias("n_queries"))


def breakdown(per_query: DataFrame, by: str, metrics: list[str], order: list[str] | None = None) -> DataFrame:
    """Means by a column; missing values are 'unknown', listed in the given order."""
    key = F.coalesce(by, F.lit("unknown"))
    out = per_query.groupBy(key.alias(by)).agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))
    return out.withColumn("position", F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(by)), F.lit(0)).cast("int")) if order else out


def confusion(pairs: DataFrame) -> DataFrame:
    """expected, predicted, n; a missing label is 'none'."""
    return pairs.groupBy(F.coalesce("expected", F.lit("none")).alias("expected"), F.coalesce("predicted", F.lit("none")).alias("predicted")).agg(F.count("*").alias("n"))


def macro_f1(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """accuracy and macro_f1 over all labels, also those that do not occur (F1 0)."""
    wanted = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    p = pairs.select(F.coalesce("expected", F.lit("none")).alias("expected"), F.coalesce("predicted", F.lit("none")).alias("predicted"))
    both = p.select(F.explode(F.array(F.struct(F.col("expected").alias("label"), F.lit(1).alias("e"), F.lit(0).alias("p"), (F.col("expected") == F.col("predicted")).cast("int").alias("t")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("e"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x")).select("x.*")
    sums = both.groupBy("label").agg(F.sum("e").alias("e"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    f1 = wanted.join(sums, "label", "left").select(F.when(F.coalesce("t", F.lit(0)) > 0, 2 * F.col("t") / (F.col("e") + F.col("p"))).otherwise(0.0).alias("f1"))
    accuracy = p.agg(F.round(F.avg((F.col("expected") == F.col("predicted")).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))
    return accuracy.crossJoin(f1.agg(F.round(F.avg("f1"), 6).alias("macro_f1")))


def micro_prf(sets: DataFrame) -> DataFrame:
    """precision, recall, f1 over arrays expected and predicted; 1 where nothing was expected or predicted."""
    t, p, e = F.sum(F.size(F.array_intersect("expected", "predicted"))), F.sum(F.size(F.array_distinct("predicted"))), F.sum(F.size(F.array_distinct("expected")))
    out = sets.agg(t.alias("t"), p.alias("p"), e.alias("e"))
    precision, recall = F.when(F.col("p") > 0, F.col("t") / F.col("p")).otherwise(1.0), F.when(F.col("e") > 0, F.col("t") / F.col("e")).otherwise(1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return out.select(F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def latency(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, min, max, p50 and p95 as elements of the sorted finite values (index n // 2 and int(.95 n))."""
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) != float("inf")))
    w = Window.partitionBy(*(by or [])).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*(by or [])))
    rows = ok.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n)
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col(value)))
    p50, p95 = F.least(F.col("_n") - 1, F.floor(F.col("_n") / 2)), F.least(F.col("_n") - 1, F.floor(0.95 * F.col("_n")))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), at(p50).alias("p50"), at(p95).alias("p95"))


def upper_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return rows.where(F.col("_i") == F.floor(F.col("_n") / 2)).select(*by, F.col(value).alias("median"), F.col("_n").alias("n"))


def taxonomy_deltas(cases: DataFrame, epsilon: float = 1e-7) -> DataFrame:
    """Per failure tag: n, mean change, and how many improved, worsened or stayed. cases: tags, baseline, expanded."""
    rows = cases.select(F.explode("tags").alias("tag"), (F.col("expanded") - F.col("baseline")).alias("d"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_delta"), F.sum((F.col("d") > epsilon).cast("int")).alias("improved"), F.sum((F.col("d") < -epsilon).cast("int")).alias("worsened"), F.sum((F.abs("d") <= epsilon).cast("int")).alias("flat"))


def gate(candidate: DataFrame, baseline: DataFrame, threshold: float = 0.02, latency_threshold: float = 0.15) -> DataFrame:
    """Per metric of the baseline: delta and whether it passes; a metric that is missing fails. Columns: run, metric, value; a metric named latency* may grow by a share."""
    rows = baseline.withColumnRenamed("value", "base").join(candidate.withColumnRenamed("value", "now"), ["run", "metric"], "left")
    ok = F.when(F.startswith("metric", F.lit("latency")), F.col("now") <= F.col("base") * (1 + latency_threshold)).otherwise(F.col("now") >= F.col("base") - threshold)
    return rows.select("run", "metric", "base", "now", F.round(F.col("now") - F.col("base"), 6).alias("delta"), F.coalesce(ok, F.lit(False)).alias("passed"))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(refs: DataFrame, key: str, targets: DataFrame, target: str) -> DataFrame:
    """References to ids that do not exist."""
    return refs.join(targets.select(F.col(target).alias(key)), key, "left_anti")


def class_weights(df: DataFrame, label: str, power: float = 1.0) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    both = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))))  # one row
    return both.select(label, "n", F.round(F.pow(F.col("total") / (F.col("classes") * F.col("n")), F.lit(power)), 6).alias("weight"))


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 6).alias("weighted_mean"), F.round(F.percentile(value, 0.95), 6).alias("p95"))


def stratified_sample(df: DataFrame, stratum: str, key: Column, n: int) -> DataFrame:
    """n rows, one of each stratum in turn, in the order of the SHA-1 of the key."""
    rows = df.withColumn("_key", F.sha1(key.cast("string"))).withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy("_key")))
    return rows.orderBy("turn", stratum).limit(n).drop("_key")


def stratified_split(df: DataFrame, stratum: str, key: Column, share: float) -> DataFrame:
    """split: 'test' for the given share of each stratum (at least one row), else 'train'."""
    w = Window.partitionBy(stratum)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(F.sha1(key.cast("string"))))).withColumn("_n", F.count("*").over(w))
    return rows.withColumn("split", F.when(F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share)), "test").otherwise("train")).drop("_i", "_n")


def merged_corpora(corpora: list[DataFrame], text: str = "text") -> DataFrame:
    """corpus, old_id, new_corpus, new_id: of equal texts (but for outer white space and case), the first one's id is that of all."""
    rows = None
    for i, c in enumerate(corpora):
        one = c.select(F.lit(i).alias("corpus"), F.col("id").alias("old_id"), F.md5(F.lower(F.trim(F.coalesce(text, F.lit(""))))).alias("key"))
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy("key").agg(F.min(F.struct("corpus", "old_id")).alias("f"))
    return rows.join(first, "key").select("corpus", "old_id", F.col("f.corpus").alias("new_corpus"), F.col("f.old_id").alias("new_id"))


def kendall_tau(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Kendall's tau of two rankings of the items of each group: (concordant - discordant) / pairs."""
    left, right = pairs.select(by, F.col(a).alias("a1"), F.col(b).alias("b1")), pairs.select(by, F.col(a).alias("a2"), F.col(b).alias("b2"))
    sign = F.signum((F.col("a1") - F.col("a2")).cast("double")) * F.signum((F.col("b1") - F.col("b2")).cast("double"))
    return left.join(right, by).where("a1 < a2").groupBy(by).agg(F.round(F.avg(sign), 6).alias("tau"), F.count("*").alias("n_pairs"))


def mean_ndcg_retrieved(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """nDCG whose ideal only counts the relevant documents that were retrieved."""
    hits = retrieved.where(F.col("rank") <= k).join(relevant.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.sum(1 / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg"), F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, x: s + 1 / F.log2(x + F.lit(1.0)))
    return relevant.select("qid").distinct().join(hits.select("qid", (F.col("dcg") / ideal).alias("v")), "qid", "left").agg(F.round(F.avg(F.coalesce("v", F.lit(0.0))), 6).alias("ndcg"))


# text tools of dataset builders ------------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Words of three letters that are no stop words, with repeats."""
    return F.filter(X.words(text), lambda w: (F.length(w) >= 3) & ~w.isin(X.QUERY_STOP_WORDS))


def phrase_candidates(text: Column, most: int = 6) -> Column:
    """The first phrases of three, then of two different tokens."""
    phrases = lambda n: F.transform(F.filter(X.windows(tokens(text), n), lambda w: F.size(F.array_distinct(w)) == n), lambda w: F.array_join(w, " "))
    return F.slice(F.array_distinct(F.concat(phrases(3), phrases(2))), 1, most)


def lexical_similarity(query: Column, document: Column, relevant: Column) -> Column:
    """Of arrays of tokens: overlaps of the document with the query and with relevant texts, by the root of its size."""
    q, d, r = (F.array_distinct(c) for c in (query, document, relevant))
    score = (3.0 * F.size(F.array_intersect(q, d)) + 0.25 * F.size(F.array_intersect(r, d))) / F.sqrt(F.greatest(F.lit(1), F.size(d)))
    return F.when((F.size(q) > 0) & (F.size(d) > 0), score).otherwise(0.0)


def best_sentence(text: Column, query: Column, limit: int = 120) -> Column:
    """The first of the sentences that share most tokens with the query, cut at a word's end."""
    sentences = F.filter(F.transform(F.split(X.spaced(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")  # F.trim itself would get the place as the characters to trim
    scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(query, F.array_distinct(tokens(s)))).alias("n"), (-i).alias("i"), s.alias("s")))
    best = F.coalesce(F.array_max(scored)["s"], F.lit(""))
    return F.when(F.length(best) <= limit, best).otherwise(F.regexp_replace(F.substring(best, 1, limit), " [^ ]*$", ""))
