"""Queries over the sample tables, one or more per operator, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import chunking, vector
from quarry.functions import text as X
from quarry.operators import consolidation, evaluation, extraction, fusion, lexical, schema, store, vectors
from quarry.streaming import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2024-12-31 00:00:00"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.corpus(table(spark, sf_dir, "documents"))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# SQL pieces ------------------------------------------------------------------------------------------------------

_W = r"list_filter(string_split_regex(lower(coalesce({t}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
words_sql = lambda t: _W.format(t=t)
ordered = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_CORPUS = "SELECT doc_id AS chunk_id, source || '/' || doc_id || '.md' AS path, text AS content, source FROM documents"
_TITLE = r"nullif(trim(regexp_replace(trim(regexp_extract(content, '(?m)^[ \t]*#[^\n]*')), '^#+', '')), '')"


def _terms_cte() -> str:
    return rf"""qw AS (SELECT item_id AS qid, text AS qtext, {words_sql("text")} AS w FROM benchmark),
qt AS (SELECT qid, qtext, list_filter(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: length(x) >= 2 OR regexp_matches(x, '\p{{N}}')) AS tk FROM qw),
qa AS (SELECT qid, qtext, tk, list_filter(tk, lambda x: regexp_matches(x, '\p{{N}}') OR x IN ({_quoted(X.SHORT_TERMS)}) OR (length(x) >= 3 AND x NOT IN ({_quoted(X.LEXICAL_STOP_WORDS)}))) AS an FROM qt)"""


def _bm25_cte(scope: str = "") -> str:
    return rf"""{_terms_cte()},
cw AS (SELECT doc_id AS chunk_id, {words_sql("text")} AS w FROM documents {scope}),
lens AS (SELECT chunk_id, len(w) AS doc_len FROM cw),
post AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM cw) GROUP BY ALL),
stats AS (SELECT count(*) AS n_docs, avg(doc_len) AS avgdl FROM lens),
terms AS (SELECT qid, 's' AS m, unnest(an[1:6]) AS prefix FROM qa UNION ALL SELECT qid, 'r', unnest(CASE WHEN len(an) > 0 THEN an[1:12] ELSE tk[1:12] END) FROM qa),
nt AS (SELECT qid, m, count(*) AS n_terms FROM terms GROUP BY ALL),
mt AS (SELECT term, prefix FROM (SELECT DISTINCT term FROM post) JOIN (SELECT DISTINCT prefix FROM terms) ON starts_with(term, prefix)),
hits AS (SELECT prefix, chunk_id, sum(tf) AS tf FROM post JOIN mt USING (term) GROUP BY ALL),
dfs AS (SELECT prefix, count(*) AS df FROM hits GROUP BY prefix),
pw AS (SELECT prefix, chunk_id, greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl)) AS w FROM hits JOIN dfs USING (prefix) JOIN lens USING (chunk_id), stats),
sc AS (SELECT qid, m, chunk_id, sum(w) AS rs, count(*) AS nh FROM terms JOIN pw USING (prefix) GROUP BY ALL),
ok AS (SELECT qid, m, chunk_id, rs, rs / (1 + rs) AS score FROM sc JOIN nt USING (qid, m) WHERE m = 'r' OR nh = n_terms)"""


def _merged_cte(probe: int, strict: float, limit: int, scope: str = "") -> str:
    return rf"""{_bm25_cte(scope)},
rk AS (SELECT *, row_number() OVER (PARTITION BY qid, m ORDER BY round(score, 9) DESC, chunk_id) AS r FROM ok),
mg AS (SELECT qid, chunk_id, sum(CASE WHEN m = 's' THEN {strict} ELSE 1.0 END * score) AS score FROM rk WHERE r <= {probe} GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM mg)
"""


# Lexical --------------------------------------------------------------------------------------------------


@query(f"WITH {_terms_cte()} SELECT qid, array_to_string(tk, ' ') AS tokens, array_to_string(an[1:16], ' ') AS anchors, array_to_string(an[1:6], ' ') AS strict, array_to_string(CASE WHEN len(an) > 0 THEN an[1:12] ELSE tk[1:12] END, ' ') AS relaxed FROM qa")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    joined = lambda c: F.array_join(c, " ")
    return _benchmark(spark, sf_dir).select("qid", joined(X.tokens(t)).alias("tokens"), joined(X.anchors(t)).alias("anchors"), joined(X.strict_terms(t)).alias("strict"), joined(X.relaxed_terms(t)).alias("relaxed"))


@query(f"WITH {_bm25_cte()}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rs, 9) DESC, chunk_id) AS rank FROM ok WHERE m = 'r') SELECT qid, chunk_id, round(rs, 6) AS rank_score, round(score, 6) AS score, rank FROM r WHERE rank <= 20")
def bm25_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical.bm25(lexical.index(_chunks(spark, sf_dir)), _benchmark(spark, sf_dir), X.relaxed_terms(F.col("text")), need_all=False, limit=20)
    return hits.select("qid", "chunk_id", F.round("rank_score", 6).alias("rank_score"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_merged_cte(20, 1.2, 20)} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM sr WHERE rank <= 20")
def bm25_strict_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(_chunks(spark, sf_dir)), _benchmark(spark, sf_dir), 20).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_merged_cte(20, 1.2, 20, 'WHERE source = ' + chr(39) + 'src3' + chr(39))} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM sr WHERE rank <= 20")
def bm25_scoped_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = store.below(_chunks(spark, sf_dir), "src3")
    return lexical.search(lexical.index(scope), _benchmark(spark, sf_dir), 20).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    rf"""WITH {_merged_cte(240, 1.15, 240)}, ch AS (SELECT chunk_id, source AS path, {words_sql(f"concat_ws(' ', {_TITLE}, content)")} AS cw FROM ({_CORPUS})),
an16 AS (SELECT qid, an[1:16] AS an FROM qa),
hh AS (SELECT sr.qid, path, chunk_id, score, an, list_filter(an, lambda a: len(list_filter(cw, lambda t: (length(t) >= 2 OR regexp_matches(t, '\p{{N}}')) AND (starts_with(t, a) OR starts_with(a, t)))) > 0) AS hit FROM sr JOIN ch USING (chunk_id) JOIN an16 ON an16.qid = sr.qid WHERE rank <= 240),
g AS (SELECT qid, path, max(score) AS best, sum(score) AS mass, count(*) AS n, len(list_distinct(flatten(list(hit)))) AS cov, any_value(len(an)) AS na FROM hh GROUP BY ALL),
rep AS (SELECT qid, path, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY len(hit) DESC, round(score, 9) DESC, chunk_id) AS k FROM hh) WHERE k = 1),
s AS (SELECT qid, path, chunk_id, best + 0.24 * CASE WHEN na > 0 THEN cov / na ELSE 0 END + least(0.20, 0.035 * sqrt(n)) + least(0.12, 0.035 * mass) AS score FROM g JOIN rep USING (qid, path)),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s)
SELECT qid, path, chunk_id, round(score, 6) AS score, rank FROM f WHERE rank <= 20"""
)
def lex_doc_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of many chunks: the sources, with their rows as chunks."""
    chunks = _chunks(spark, sf_dir).withColumn("path", F.col("source"))
    return lexical.document_search(lexical.index(chunks), _benchmark(spark, sf_dir), chunks, 20).select("qid", "path", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    rf"""WITH w AS (SELECT doc_id AS chunk_id, list_filter({words_sql("text")}, lambda x: length(x) >= 2) AS w FROM documents),
lens AS (SELECT chunk_id, len(w) AS doc_len FROM w), post AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM w) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term), stats AS (SELECT count(*) AS n_docs, avg(doc_len) AS avgdl FROM lens),
q AS (SELECT DISTINCT item_id AS qid, unnest(list_filter({words_sql("text")}, lambda x: length(x) >= 2)) AS term FROM benchmark),
s AS (SELECT qid, chunk_id, sum(greatest(0.0, (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl))) AS score FROM q JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (chunk_id), stats GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s WHERE score > 0)
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20"""
)
def bm25_miner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.miner(_chunks(spark, sf_dir), _benchmark(spark, sf_dir), 20).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


# G11-G13, G29, L: vectors -----------------------------------------------------------------------------------------


def _knn_sql(distance: str) -> str:
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id AS qid, b.vec_id, round({distance}, 6) AS distance FROM e a, e b),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM d) SELECT qid, vec_id, distance, rank FROM r WHERE rank <= 10"""


def _knn(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vectors.knn(e, e.select(F.col("vec_id").alias("qid"), "embedding"), 10, metric)


@query(_knn_sql("1 - list_cosine_similarity(a.v, b.v)"))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "cosine").withColumn("distance", F.abs("distance"))


ORACLE_SQL["knn_cosine"] = _knn_sql("abs(1 - list_cosine_similarity(a.v, b.v))")


@query(_knn_sql("list_distance(a.v, b.v)"))
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "l2")


@query(_knn_sql("list_sum(list_transform(range(1, len(a.v) + 1), lambda i: abs(a.v[i] - b.v[i])))"))
def knn_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "l1")


@query(_knn_sql("-list_dot_product(a.v, b.v)"))
def dense_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "dot")


@query(
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT label, v AS c FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM e) WHERE k = 1)
SELECT vec_id, len(v) AS dim, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(abs(1 - list_cosine_similarity(v, c)), 6) AS cosine, round(list_distance(v, c), 6) AS l2, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - c[i]))), 6) AS l1,
len(list_filter(range(1, len(v) + 1), lambda i: (v[i] > 0) <> (c[i] > 0))) AS hamming, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] + c[i])), 6) AS added, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] - c[i])), 6) AS subtracted,
round(list_sum(v[3:6]), 6) AS part, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS unit, CAST(list_sum(list_transform(v, lambda x: greatest(-128, least(127, CAST(trunc((x + 1) / (2.0 / 255) - 128) AS INT))))) AS BIGINT) AS int8, CAST(list_sum(list_transform(v, lambda x: CAST(x > 0 AS INT))) AS BIGINT) AS bits
FROM e JOIN c USING (label)"""
)
def vec_scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar function of vectors, against the first vector with the same label."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", vector.doubles(F.col("embedding")))
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("c"))
    v, c = F.col("v"), F.col("c")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    count = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)
    r = lambda x: F.round(x, 6)
    return e.join(first, "label").select(
        "vec_id", F.size(v).cast("long").alias("dim"), r(vector.l2_norm(v)).alias("norm"), r(F.abs(vector.cosine_distance(v, c))).alias("cosine"), r(vector.l2_distance(v, c)).alias("l2"), r(vector.l1_distance(v, c)).alias("l1"),
        vector.hamming_distance(vector.quantized_binary(v), vector.quantized_binary(c)).cast("long").alias("hamming"), r(total(vector.add(v, c))).alias("added"), r(total(vector.subtract(v, c))).alias("subtracted"),
        r(total(vector.part(v, 2, 6))).alias("part"), r(total(vector.normalized(v))).alias("unit"), count(vector.quantized_int8(v)).alias("int8"), count(vector.quantized_binary(v)).alias("bits"),
    )


@query("SELECT vec_id, unnest(range(0, len(embedding))) AS position, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings")
def vec_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("position", "value")).select("vec_id", F.col("position").cast("long").alias("position"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query(
    """WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), p AS (SELECT label, i, avg(x) AS m, max(x) AS t FROM e GROUP BY ALL)
SELECT label, round(sqrt(sum(m * m)), 6) AS mean_norm, round(sum(t), 6) AS max_sum FROM p GROUP BY label"""
)
def vec_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode(vector.doubles(F.col("embedding"))).alias("i", "x"))
    pooled = e.groupBy("label", "i").agg(F.avg("x").alias("m"), F.max("x").alias("t"))
    return pooled.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("mean_norm"), F.round(F.sum("t"), 6).alias("max_sum"))


_EMBED = "list_transform(range(0, 64), lambda b: CAST(len(list_filter(bk, lambda x: x = b)) AS DOUBLE))"


def _embedded_cte() -> str:
    bucket = lambda t: f"list_transform({words_sql(t)}, lambda x: CAST('0x' || substr(sha256(x), 1, 2) AS INT) % 64)"
    return f"""db AS (SELECT doc_id AS chunk_id, {bucket("text")} AS bk FROM documents), de AS (SELECT chunk_id, {_EMBED} AS v FROM db),
qb AS (SELECT item_id AS qid, {bucket("text")} AS bk FROM benchmark), qe AS (SELECT qid, {_EMBED} AS v FROM qb),
sd AS (SELECT qid, chunk_id, round(1 - list_cosine_similarity(qe.v, de.v), 6) AS distance FROM qe, de WHERE list_sum(de.v) > 0 AND list_sum(qe.v) > 0),
sk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, chunk_id) AS rank FROM sd)"""


def _semantic(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    embed = lambda c: vector.hashed_embedding(F.col(c))
    docs = _chunks(spark, sf_dir).select(F.col("chunk_id").alias("vec_id"), embed("content").alias("embedding"))
    found = vectors.knn(docs, _benchmark(spark, sf_dir).select("qid", embed("text").alias("embedding")), k)
    return found.select("qid", F.col("vec_id").alias("chunk_id"), "distance", "rank")


@query(f"WITH {_embedded_cte()} SELECT qid, chunk_id, distance, rank FROM sk WHERE rank <= 20")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semantic(spark, sf_dir)


# Tags ----------------------------------------------------------------------------------------------------


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = lambda w, i: F.struct(w.alias("name"), F.greatest(F.lit(0.2), 1 - 0.08 * i).alias("confidence"))
    return _chunks(spark, sf_dir).withColumn("tags", F.transform(X.tags(F.col("content")), weight))


_TAGS = rf"""tw AS (SELECT doc_id AS chunk_id, list_filter({words_sql("text")}, lambda x: length(x) >= 4 AND x NOT IN ({_quoted(X.QUERY_STOP_WORDS)})) AS w FROM documents),
tg AS (SELECT chunk_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:6] AS t FROM tw)"""


@query(f"WITH {_TAGS}, u AS (SELECT chunk_id, unnest(t) AS name, unnest(range(0, len(t))) AS i FROM tg), n AS (SELECT name, count(*) AS chunks, round(sum(greatest(0.2, 1 - 0.08 * i)), 6) AS score FROM u GROUP BY name) SELECT name, chunks, score FROM n")
def tag_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _tagged(spark, sf_dir).select("chunk_id", F.explode("tags").alias("t"))
    return tags.groupBy(F.col("t.name").alias("name")).agg(F.count("*").alias("chunks"), F.round(F.sum("t.confidence"), 6).alias("score"))


@query(f"WITH {_TAGS}, u AS (SELECT chunk_id, unnest(t) AS name, unnest(range(0, len(t))) AS i FROM tg) SELECT chunk_id, round(sum(greatest(0.2, 1 - 0.08 * i)), 6) AS score FROM u WHERE name IN ('that', 'with', 'oder', 'elle', 'the', 'ciudad', 'tion') GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 50")
def tag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.tag_search(_tagged(spark, sf_dir), ["That", "with ", "oder", "elle", "the", "ciudad", "tion"], 50)


# H: fusion --------------------------------------------------------------------------------------------------------

_LEX = _merged_cte(20, 1.2, 20)


def _lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(_chunks(spark, sf_dir)), _benchmark(spark, sf_dir), 20)


@query(f"WITH {_LEX}, {_embedded_cte()}, h AS (SELECT qid, chunk_id, rank, 2.0 AS w FROM sr WHERE rank <= 20 UNION ALL SELECT qid, chunk_id, rank, 1.0 FROM sk WHERE rank <= 20) SELECT qid, chunk_id, round(sum(w / (60 + rank) + w * CASE WHEN rank = 1 THEN 0.0025 WHEN rank <= 3 THEN 0.001 ELSE 0 END), 6) AS score FROM h GROUP BY ALL")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _lexical_hits(spark, sf_dir).select("qid", "chunk_id", "rank", F.lit(2.0).alias("w")).unionByName(_semantic(spark, sf_dir).select("qid", "chunk_id", "rank", F.lit(1.0).alias("w")))
    return fusion.rrf(both, F.col("w")).withColumn("score", F.round("score", 6))


@query(f"WITH {_LEX} SELECT qid, chunk_id, round(sum(2.0 * (0.75 + 0.5 * least(1.0, greatest(0.0, score))) / (60 + rank) + CASE WHEN rank = 1 THEN 0.003 ELSE 0 END), 6) AS score FROM sr WHERE rank <= 20 GROUP BY ALL")
def scored_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.scored_rrf(_lexical_hits(spark, sf_dir), 2.0).withColumn("score", F.round("score", 6))


_CUES = "|".join(w.replace("'", "''") for w in fusion.TIME_WORDS)
_ANCHORED = lambda t: rf"(regexp_matches(lower({t}), '{_CUES}') OR regexp_matches(lower({t}), '\b(19|20)\d{{2}}\b') OR regexp_matches(lower({t}), '\b\d{{1,2}}[/-]\d{{1,2}}\b'))"
_AGGREGATE = lambda t: rf"({_ANCHORED(t)} OR regexp_matches(lower({t}), '{'|'.join(fusion.AGGREGATE_CUES)}'))"


@query(f"WITH {_LEX} SELECT sr.qid, chunk_id, round(2.0 * CASE WHEN {_AGGREGATE('text')} THEN 0.36 ELSE 0.05 END / sqrt(rank), 6) AS score FROM sr JOIN benchmark ON item_id = sr.qid WHERE rank <= 10")
def preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _lexical_hits(spark, sf_dir).join(_benchmark(spark, sf_dir), "qid")
    return fusion.preservation(hits, fusion.preservation_base(F.col("text"), semantic=False)).withColumn("score", F.round("score", 6))


_OVERLAP = lambda a, b: f"len(list_intersect(list_distinct({words_sql(a)}), {words_sql(b)})) / len(list_distinct({words_sql(a)}))"


@query(
    rf"""WITH {_LEX}, n AS (SELECT qid, qtext, an, lead(an, 1, an) OVER (ORDER BY qid) AS other FROM qa), e AS (SELECT qid, qtext, array_to_string(unnest([an[1:3], other[1:3]]), ' ') AS x FROM n),
h AS (SELECT sr.qid, chunk_id, rank, {_AGGREGATE("qtext")} AS temporal, len({words_sql("x")}) <= 5 AND {_OVERLAP("x", "qtext")} <= 0.35 AS concise FROM sr JOIN e ON e.qid = sr.qid WHERE rank <= 20)
SELECT qid, chunk_id, round(max(CASE WHEN concise THEN 0.75 ELSE 0.24 END / sqrt(rank)), 6) AS score FROM h WHERE (concise OR temporal) AND rank <= CASE WHEN temporal THEN 2 ELSE 1 END GROUP BY ALL"""
)
def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two expansions: the query's own first anchors, which overlap it wholly, and those of the next item."""
    rows = _benchmark(spark, sf_dir).withColumn("an", X.anchors(F.col("text"), 1 << 20))
    other = F.lead("an", 1).over(Window.orderBy("qid"))  # the items of a benchmark are few
    expanded = rows.withColumn("other", F.coalesce(other, F.col("an"))).select("qid", F.explode(F.array("an", "other")).alias("x"), F.col("text").alias("primary")).select("qid", F.array_join(F.slice("x", 1, 3), " ").alias("text"), "primary")
    return fusion.promotion(_lexical_hits(spark, sf_dir).join(expanded, "qid")).withColumn("score", F.round("score", 6))


_AGE = "greatest(0.0, (epoch(TIMESTAMP '2024-12-31') - epoch(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 AS INT)))) / 86400.0)"
_FUSED = rf"""{_LEX}, {_embedded_cte()},
lx AS (SELECT qid, chunk_id, 2.0 / (60 + rank) + 2.0 * CASE WHEN rank = 1 THEN 0.0025 WHEN rank <= 3 THEN 0.001 ELSE 0 END AS lexical FROM sr WHERE rank <= 20),
sx AS (SELECT qid, chunk_id, 2.0 / (60 + rank) + 2.0 * CASE WHEN rank = 1 THEN 0.0025 WHEN rank <= 3 THEN 0.001 ELSE 0 END AS semantic FROM sk WHERE rank <= 20),
cd AS (SELECT coalesce(lx.qid, sx.qid) AS qid, coalesce(lx.chunk_id, sx.chunk_id) AS chunk_id, coalesce(lexical, 0) AS lexical, coalesce(semantic, 0) AS semantic FROM lx FULL JOIN sx ON lx.qid = sx.qid AND lx.chunk_id = sx.chunk_id),
qr AS (SELECT item_id AS qid, text AS qtext, list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2) AS raw FROM benchmark),
q1 AS (SELECT qid, qtext, list_transform(list_filter(raw, lambda x: regexp_matches(x, '\p{{N}}') OR (regexp_matches(x, '^\p{{Lu}}') AND length(x) >= 3)), lambda x: lower(x)) AS f, list_filter(list_transform(raw, lambda x: lower(x)), lambda x: length(x) >= 5 AND x NOT IN ({_quoted(X.QUERY_STOP_WORDS)})) AS g FROM qr),
q2 AS (SELECT qid, qtext, CASE WHEN len(f) > 0 THEN list_filter(f, lambda x, i: list_position(f, x) = i)[1:4] ELSE list_filter(g, lambda x, i: list_position(g, x) = i)[1:3] END AS an FROM q1),
fz AS (SELECT cd.*, qtext, text AS content, {_AGE} AS age, {_ANCHORED("qtext")} AS anchored, CASE WHEN len(q2.an) > 0 THEN 0.003 * len(list_filter(q2.an, lambda a: contains(lower(' ' || text[1:2000]), a))) / len(q2.an) ELSE 0 END AS anchor FROM cd JOIN q2 ON q2.qid = cd.qid JOIN documents ON doc_id = chunk_id),
fs AS (SELECT qid, chunk_id, qtext, content, semantic, lexical, exp(-age / 30.0) AS recency, anchor, CASE WHEN anchored THEN 0.64 ELSE 0.62 END * semantic + CASE WHEN anchored THEN 0.35 ELSE 0.33 END * lexical + CASE WHEN anchored THEN 0.01 ELSE 0.05 END * exp(-age / 30.0) + anchor AS fused FROM fz),
fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, chunk_id) AS rank FROM fs)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = fusion.rrf(_lexical_hits(spark, sf_dir), 2.0).withColumnRenamed("score", "lexical")
    sem = fusion.rrf(_semantic(spark, sf_dir), 2.0).withColumnRenamed("score", "semantic")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 365 as int))").alias("modified_at"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "source")
    ids = lex.join(sem, ["qid", "chunk_id"], "full").na.fill(0.0)
    rows = ids.join(chunks, "chunk_id").join(_benchmark(spark, sf_dir).withColumnRenamed("text", "query"), "qid")
    return fusion.by_rank(fusion.fused(rows, NOW), "fused")


@query(f"WITH {_FUSED} SELECT qid, chunk_id, round(semantic, 6) AS semantic, round(lexical, 6) AS lexical, round(recency, 6) AS recency, round(anchor, 6) AS anchor, round(fused, 6) AS fused, rank FROM fr WHERE rank <= 20")
def hybrid_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _fused(spark, sf_dir).where("rank <= 20").select("qid", "chunk_id", r("semantic"), r("lexical"), r("recency"), r("anchor"), r("fused"), "rank")


_OWN = lambda t: f"list_filter(list_distinct(list_filter({words_sql(t)}, lambda x: length(x) >= 2 OR regexp_matches(x, '[0-9]'))), lambda x: length(x) >= 3 AND x NOT IN ({_quoted(X.QUERY_STOP_WORDS)}))"


@query(
    rf"""WITH {_FUSED}, o AS (SELECT *, {_OWN("qtext")} AS q, {_OWN("content[1:300] || ' ' || content[1:240]")} AS c, contains(lower(content[1:300] || ' ' || content[1:240]), lower(qtext)) AS ph FROM fr WHERE rank <= 20),
s AS (SELECT *, CASE WHEN len(q) > 0 THEN least(1.0, len(list_intersect(q, c)) / len(q) + CASE WHEN ph THEN 0.2 ELSE 0 END) ELSE 0 END AS rerank, fused / max(fused) OVER (PARTITION BY qid) AS norm FROM o),
b AS (SELECT *, CASE WHEN rank <= 10 THEN CASE WHEN rank <= 3 THEN 0.75 ELSE 0.60 END * norm + (1 - CASE WHEN rank <= 3 THEN 0.75 ELSE 0.60 END) * rerank ELSE fused END AS blended FROM s)
SELECT qid, chunk_id, round(rerank, 6) AS rerank, round(blended, 6) AS blended, row_number() OVER (PARTITION BY qid ORDER BY round(blended, 9) DESC, round(fused, 9) DESC, chunk_id) AS final_rank FROM b"""
)
def rerank_overlap_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fused(spark, sf_dir).where("rank <= 20").withColumn("rerank", fusion.overlap_rerank(F.col("query"), F.col("title"), F.col("content")))
    return fusion.blended(rows, 10).select("qid", "chunk_id", F.round("rerank", 6).alias("rerank"), F.round("blended", 6).alias("blended"), "final_rank")


@query()
def primary_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without SQL, as the swaps depend on those before; tests/test_fusion.py has them by definition."""
    hits = lambda h, semantic: fusion.preservation(h.join(_benchmark(spark, sf_dir), "qid"), fusion.preservation_base(F.col("text"), semantic))
    primary = hits(_lexical_hits(spark, sf_dir), False).unionByName(hits(_semantic(spark, sf_dir), True)).groupBy("qid", "chunk_id").agg(F.sum("score").alias("primary"))
    rows = fusion.blended(_fused(spark, sf_dir).withColumn("rerank", F.lit(None).cast("double")), 10)
    return fusion.protected(rows.join(primary, ["qid", "chunk_id"], "left").na.fill(0.0, ["primary"]), 10).select("qid", "chunk_id", "path", "final_rank")


@query()
def multi_evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without SQL, as the order depends on what was chosen before; tests/test_fusion.py has it by definition."""
    rows = _fused(spark, sf_dir).withColumn("support", fusion.support(F.col("lexical"), F.col("semantic"), F.lit(0.0), F.col("rank")))
    rows = rows.withColumn("path", F.concat(F.lit("notes/"), F.col("source"), F.lit("_of_"), F.col("source"), F.lit("_"), F.col("chunk_id").cast("string"), F.lit(".md"))).withColumn("query", F.concat("query", F.lit(" in total")))
    return fusion.multi_evidence(rows.withColumnRenamed("rank", "final_rank"), 10).withColumn("support", F.round("support", 6))


@query(f"WITH {_FUSED}, d AS (SELECT qid, chunk_id, source, rank, row_number() OVER (PARTITION BY qid, source ORDER BY rank, chunk_id) AS k FROM fr JOIN documents ON doc_id = chunk_id) SELECT qid, source AS path, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY rank, chunk_id) AS doc_rank FROM d WHERE k = 1")
def dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.one_per_document(_fused(spark, sf_dir).withColumn("path", F.col("source"))).select("qid", "path", "chunk_id", "doc_rank")


@query(f"WITH {_merged_cte(20, 1.2, 20)}, t AS (SELECT sr.qid, max(CASE WHEN rank = 1 THEN score END) AS top, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS nxt, any_value(len(tk)) AS n FROM sr JOIN qa ON qa.qid = sr.qid GROUP BY ALL) SELECT qid, round(top, 6) AS top, round(nxt, 6) AS next, n <= 12 AND top >= 0.10 AND top - nxt >= 0.05 AS strong FROM t")
def strong_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _lexical_hits(spark, sf_dir).join(_benchmark(spark, sf_dir).select("qid", F.size(X.tokens(F.col("text"))).alias("n")), "qid")
    return fusion.strong_signal(hits, F.col("n")).select("qid", F.round("top", 6).alias("top"), F.round("next", 6).alias("next"), "strong")


# F, B, C, G22-G26: listings, scopes, joins, stores -----------------------------------------------------------------

_MEM = "SELECT event_id AS id, ts AS created_at, CASE event_type WHEN 'click' THEN 'fact' WHEN 'view' THEN 'episode' WHEN 'purchase' THEN 'decision' WHEN 'signup' THEN 'profile' ELSE 'commitment' END AS kind, CASE WHEN event_id % 5 = 0 THEN 'superseded' WHEN event_id % 7 = 0 THEN 'resolved' ELSE 'active' END AS status, least(1.0, value / 100) AS importance, user_id FROM events"


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shape of memories."""
    kind = F.when(F.col("event_type") == "click", "fact").when(F.col("event_type") == "view", "episode").when(F.col("event_type") == "purchase", "decision").when(F.col("event_type") == "signup", "profile").otherwise("commitment")
    state = F.when(F.col("event_id") % 5 == 0, "superseded").when(F.col("event_id") % 7 == 0, "resolved").otherwise("active")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), kind.alias("kind"), state.alias("status"), F.least(F.lit(1.0), F.col("value") / 100).alias("importance"), "user_id")


@query(f"SELECT id, kind, status FROM ({_MEM}) WHERE kind IN ('fact', 'decision') AND status = 'active' ORDER BY created_at DESC, id DESC LIMIT 50")
def recency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.listed(_memories(spark, sf_dir), "recent", 50, ["fact", "decision"], ["active"]).select("id", "kind", "status")


@query(f"SELECT id, round(importance, 6) AS importance FROM ({_MEM}) ORDER BY importance DESC, created_at DESC, id DESC LIMIT 50")
def importance_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.listed(_memories(spark, sf_dir), "importance", 50).select("id", F.round("importance", 6).alias("importance"))


@query(f"WITH a AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id) SELECT id, n AS access_count FROM ({_MEM}) m LEFT JOIN a USING (user_id) ORDER BY coalesce(n, 0) DESC, last DESC, created_at DESC, id DESC LIMIT 50")
def most_accessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = store.accessed(table(spark, sf_dir, "events").select(F.col("user_id").alias("chunk_id"), F.col("ts").alias("at"))).withColumnRenamed("chunk_id", "user_id")
    return store.listed(_memories(spark, sf_dir).join(log, "user_id", "left"), "most_accessed", 50).select("id", "access_count")


@query("SELECT user_id AS chunk_id, count(*) AS access_count, max(ts) AS last_accessed_at FROM events GROUP BY user_id")
def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.accessed(table(spark, sf_dir, "events").select(F.col("user_id").alias("chunk_id"), F.col("ts").alias("at")))


@query(f"SELECT chunk_id, path FROM ({_CORPUS}) WHERE path = 'src1' OR starts_with(path, 'src1/')")
def prefix_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.below(_chunks(spark, sf_dir), " src1/ ").select("chunk_id", "path")


@query(f"SELECT chunk_id, path FROM ({_CORPUS}) WHERE regexp_matches(path, '^src1[0-9]/.*1.\\.md$')")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).where(X.glob(F.col("path"), "src1?/*1?.md")).select("chunk_id", "path")


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def context_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("context_id"), F.col("doc_id").alias("chunk_id"))
    return store.in_context(_chunks(spark, sf_dir), members, "good").select("chunk_id")


@query(f"SELECT id FROM ({_MEM}) WHERE status = 'active'")
def visible_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.visible(_memories(spark, sf_dir)).select("id")


@query("SELECT c_custkey AS memory_id, o_orderkey AS document_id, o_orderpriority AS path, l_quantity AS access_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber = 1) ON l_orderkey = o_orderkey")
def memory_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memories left join documents left join their first chunk, on customers, orders and their first line."""
    memories = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("memory_id"))
    documents = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("memory_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("path"))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") - 1).alias("ordinal"), F.lit(0).alias("chunk_id"), F.col("l_quantity").alias("access_count"))
    return store.with_documents(memories, documents, chunks).select("memory_id", "document_id", "path", "access_count")


@query(f"SELECT kind, user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY kind, user_id ORDER BY created_at DESC, id DESC) AS n FROM ({_MEM}) WHERE status = 'active') WHERE n = 1")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(store.of_kind(_memories(spark, sf_dir), statuses=["active"]), ["kind", "user_id"], "created_at").select("kind", "user_id", "id")


@query("SELECT doc_id AS id, source AS path, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM documents WHERE doc_id % 10 <> 9")
def upsert_and_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.lit("old").alias("version"))
    merged = store.upserted(old, old.where("id % 3 = 0").withColumn("version", F.lit("new")), "id")
    return store.removed(merged, old.where("id % 10 = 9"), "id")


@query(f"SELECT doc_id, {_TITLE.replace('content', 'text')} AS title, sha256(text) AS checksum, len(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS n_lines, array_to_string(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))[2:3], chr(10)) AS second FROM documents")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.title(t).alias("title"), X.checksum(t).alias("checksum"), F.size(X.lines(t)).cast("long").alias("n_lines"), X.line_range(t, 3, 2).alias("second"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return chunking.chunked(docs).select("document_id", "ordinal", "token_count", F.sha1("content").alias("digest"))


# J: extraction and consolidation -----------------------------------------------------------------------------------


def _any(t: str, needles: list[str]) -> str:
    import re

    return f"regexp_matches({t}, '" + "|".join(re.escape(n).replace("\\ ", " ").replace("\\'", "'").replace("'", "''") for n in needles) + "')"


_SEGMENTS = r"""sg AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '([\p{L}\p{N}])\.([\p{L}\p{N}])', '\1' || chr(1) || '\2', 'g'), '([\p{L}\p{N}])\.([\p{L}\p{N}])', '\1' || chr(1) || '\2', 'g'), '[\n!?.]'), lambda s: replace(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(1), '.')), lambda s: s <> '') AS s FROM conversations),
se AS (SELECT conv_id, turn, role, unnest(s) AS segment, unnest(range(0, len(s))) AS seq FROM sg)"""
_KIND = "CASE " + " ".join(f"WHEN {_any('lower(segment)', cues)} THEN '{name}'" for name, cues in extraction.KIND_CUES.items()) + " ELSE 'fact' END"
_FOLDED = f"translate(lower(segment), '{X._ACCENTED}', '{X._PLAIN}')"
_LOW = "lower(trim(segment))"
_QUESTION = f"(regexp_matches({_LOW}, '^({'|'.join(extraction._OPENERS)})') OR (starts_with({_LOW}, 'if ') AND {_any(_LOW, extraction._CONDITIONAL)}) OR {_any(_LOW, extraction._HYPOTHETICAL)})"
_GOOD = f"""(NOT (coalesce(role, '') = 'assistant' AND {_any(_LOW, extraction._ACKS)}) AND NOT ({_QUESTION} AND NOT {_any(_LOW, extraction._DURABLE)}) AND NOT ({_any(_LOW, extraction._CHAT)} AND NOT {_any(_LOW, extraction._DURABLE)})
 AND (kind <> 'fact' OR {_any(f"' ' || {_LOW} || ' '", extraction._FACT_VERBS)}))"""
_SPANS = rf"""{_SEGMENTS}, sk AS (SELECT *, length(segment) >= 18 AS long, array_to_string(list_filter(string_split_regex({_FOLDED}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), ' ') AS key, {_KIND} AS kind FROM se),
sn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, long, key ORDER BY turn, seq) AS nth, CASE WHEN kind = 'commitment' AND {_any("lower(segment)", extraction._DONE)} THEN 'resolved' ELSE 'active' END AS status FROM sk),
sp AS (SELECT *, CASE WHEN NOT long THEN 'too_short' WHEN nth > 1 THEN 'duplicate_span' WHEN NOT {_GOOD} THEN 'not_memory_worthy' END AS reason FROM sn)"""


@query(f"WITH {_SPANS} SELECT conv_id, turn, seq, segment, kind, status, reason FROM sp")
def extract_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.spans(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), "segment", "kind", "status", "reason")


@query(f"WITH {_SPANS} SELECT kind, status, coalesce(reason, 'kept') AS outcome, count(*) AS n FROM sp GROUP BY ALL")
def extract_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.spans(table(spark, sf_dir, "conversations")).groupBy("kind", "status", F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_SPANS} SELECT conv_id, turn, seq, kind, CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in extraction.IMPORTANCE.items())} END AS importance, CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in extraction.CONFIDENCE.items())} END AS confidence,
CASE WHEN kind = 'episode' THEN 'append_episode' WHEN kind = 'commitment' AND status <> 'active' THEN 'merge_status' WHEN kind = 'profile' THEN 'replace_active' WHEN kind = 'decision' THEN 'supersede' ELSE 'create' END AS action FROM sp WHERE reason IS NULL"""
)
def extract_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.candidates(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), "kind", F.col("importance").cast("double").alias("importance"), F.col("confidence").cast("double").alias("confidence"), "action")


def _phrases(env: str, phrases: list[str]) -> str:
    return f"regexp_matches({env}, ' ({'|'.join(phrases)}) ')"


def _label(env: str, label: str) -> str:
    found = [schema._key(p) for p, _, of, _ in schema.GAZETTEER if of == label]
    return _phrases(env, found) if found else "false"


def _facet_rules() -> dict[str, str]:
    rules = {name: _phrases("env", cues) for name, cues in schema.CUES.items()}
    text = lambda p: f"regexp_matches(segment, '{p.replace(chr(39), chr(39) * 2)}')"
    rules["preference"] += f" OR (kind = 'profile' AND {_phrases('env', ['avoid'])})"
    rules["project"] += f" OR ({_label('env', 'project')} AND (kind = 'decision' OR {_phrases('env', schema.PROJECT_CONTEXT)}))"
    rules["tool"] += f" OR {_label('env', 'tool')}"
    rules["location"] += f" OR {_label('env', 'location')}"
    rules["time_sensitive"] += f" OR (kind = 'commitment' AND {_phrases('env', ['need to', 'todo'])} AND ({_phrases('env', schema.DUE)} OR {text(schema.DUE_PATTERN)}))"
    rules["constraint"] += f" OR (kind = 'decision' AND ({_phrases('env', ['hot path', 'skip'])} OR ({_phrases('env', ['apple intelligence'])} AND {_phrases('env', ['experimental flag'])})))"
    rules["relationship"] = f"(kind IN ('profile', 'episode', 'handoff') AND ({_phrases('env', ['closely with'])} OR {text(schema.WITH_PATTERN)}))"
    rules["person"] = f"{rules['relationship']} OR (kind = 'handoff' AND {_phrases('env', ['next person'])}) OR (kind = 'episode' AND ({_label('env', 'person')} OR {text(schema.MET_PATTERN)} OR {text(schema.SAID_PATTERN)}))"
    return rules


_FACETS = "[" + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _facet_rules().items()) + ", CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in schema.KIND_FACETS.items()) + " END]"
_EDGE = r"[\s.,:;!?()\[\]{}\"''`]+"
_TOPIC_KEY = lambda t: rf"array_to_string(list_filter(string_split_regex(lower(regexp_replace({t}, '^{_EDGE}|{_EDGE}$', '', 'g')), '\s+'), lambda w: w <> '')[1:4], ' ')"
_GRAMS = lambda n: f"list_filter(list_transform(range(1, len(tw) - {n - 2}), lambda i: {_TOPIC_KEY(f'array_to_string(tw[i:i + {n - 1}], chr(32))')}), lambda t: t NOT IN ({_quoted(schema.GENERIC_TOPICS)}))"
_KNOWN_TOPICS = "list_filter([" + ", ".join("CASE WHEN " + " AND ".join(f"contains(env, ' {schema._key(p)} ')" for p in phrases) + f" THEN '{topic}' END" for topic, phrases in schema.TOPICS) + "], lambda t: t IS NOT NULL)"
_ONE = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_PARTS = lambda t: rf"list_filter(string_split_regex(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_SCHEMA = rf"""c0 AS (SELECT conv_id, turn, seq, segment, kind, ' ' || array_to_string(list_filter(string_split_regex({_FOLDED}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ' AS env,
list_filter(string_split_regex(lower(segment), '[^\p{{L}}\p{{N}}+./-]+'), lambda w: length(w) >= 3 AND w NOT IN ({_quoted(X.QUERY_STOP_WORDS)})) AS tw, list_filter({words_sql("segment")}, lambda w: length(w) >= 4 AND w NOT IN ({_quoted(X.QUERY_STOP_WORDS)})) AS sw FROM sp WHERE reason IS NULL),
c1 AS (SELECT *, {_ONE("sw")}[1:6] AS tags, list_filter(list_concat({_KNOWN_TOPICS}, {_GRAMS(2)}, {_GRAMS(4)}, {_GRAMS(3)}), lambda t: t <> '') AS tp FROM c0),
c2 AS (SELECT *, list_concat(tp, list_filter(list_transform(tags, lambda t: {_TOPIC_KEY("t")}), lambda t: t <> '')) AS ta FROM c1),
c3 AS (SELECT *, {_ONE("ta")}[1:16] AS topics, list_sort(list_distinct(list_filter({_FACETS}, lambda f: f IS NOT NULL))) AS facets FROM c2),
c4 AS (SELECT *, list_filter(topics, lambda v: len(list_filter({_PARTS("v")}, lambda w: w NOT IN ({_quoted(schema.GENERIC_SIGNALS + X.QUERY_STOP_WORDS)}))) > 0) AS specific FROM c3),
c5 AS (SELECT *, list_filter(CASE WHEN len(specific) > 0 THEN flatten(list_transform(specific, lambda v: {_PARTS("v")})) ELSE {_PARTS("segment")} END, lambda w: length(w) >= 3 AND w NOT IN ({_quoted(X.QUERY_STOP_WORDS + schema.KEY_NOISE)})) AS inf FROM c4),
c6 AS (SELECT *, CASE WHEN len(inf) > 0 THEN array_to_string({_ONE("inf")}[1:6], '-') END AS seed, CASE {" ".join(f"WHEN contains(lower(segment), '{needle}') THEN '{name}'" for needle, name in schema.ATTRIBUTES)} END AS attribute FROM c5),
c7 AS (SELECT *, CASE kind WHEN 'profile' THEN CASE WHEN attribute IN ('preference', 'favorite') THEN 'profile:' || attribute || coalesce(':' || seed, '') ELSE 'profile:' || coalesce(attribute, seed) END WHEN 'handoff' THEN 'handoff:primary' WHEN 'decision' THEN 'decision:' || seed WHEN 'commitment' THEN 'commitment:' || seed WHEN 'procedure' THEN 'procedure:' || seed END AS canonical_key FROM c6)"""


@query(f"WITH {_SPANS}, {_SCHEMA} SELECT conv_id, turn, seq, array_to_string(facets, ',') AS facets, array_to_string(topics, ',') AS topics, canonical_key FROM c7")
def extract_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets, topics and canonical keys (without entities) of the candidates."""
    found = extraction.candidates(table(spark, sf_dir, "conversations"))
    t, k = F.col("segment"), F.col("kind")
    found = found.withColumn("t", schema.topics(t, F.col("tags")))
    key = schema.canonical_key(k, t, topic_values=F.col("t"))
    return found.select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), F.array_join(schema.facets(t, k), ",").alias("facets"), F.array_join("t", ",").alias("topics"), key.alias("canonical_key"))


@query()
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the candidates, one row each. Without SQL: runs of names need a walk through the text; tests/test_schema.py has expected ones."""
    found = extraction.described(extraction.candidates(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "turn", "seq", F.posexplode("entities").alias("place", "e")).select("conv_id", "turn", "seq", "place", "e.label", "e.value", "e.normalized_value", "e.confidence")


@query()
def consolidate_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.candidates(table(spark, sf_dir, "conversations"))
    return consolidation.consolidated(extraction.described(found))


# D, P, Q: evaluation -----------------------------------------------------------------------------------------------


@query(
    f"""WITH {_LEX}, rel AS (SELECT DISTINCT item_id AS qid, doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text)), n AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
ks AS (SELECT unnest([1, 5, 10, 20]) AS k), h AS (SELECT sr.qid, rank FROM sr JOIN rel ON rel.qid = sr.qid AND doc_id = chunk_id WHERE rank <= 20),
p AS (SELECT n.qid, k, n, count(rank) AS hits, min(rank) AS best, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM n CROSS JOIN ks LEFT JOIN h ON h.qid = n.qid AND rank <= k GROUP BY ALL)
SELECT k, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit, round(avg(hits / n), 6) AS recall, round(avg(coalesce(1.0 / best, 0)), 6) AS mrr, round(avg(dcg / list_sum(list_transform(range(1, least(k, n) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg, count(*) AS n_queries FROM p GROUP BY k"""
)
def recall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval of the documents that hold a benchmark item word by word."""
    relevant = lexical.containing(table(spark, sf_dir, "documents"), _benchmark(spark, sf_dir).withColumnRenamed("qid", "phrase_id")).withColumnRenamed("phrase_id", "qid")
    found = _lexical_hits(spark, sf_dir).select("qid", F.col("chunk_id").alias("doc_id"), "rank")
    return evaluation.recall_at(found, relevant, [1, 5, 10, 20])


_PAIRS = "SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS expected, CASE WHEN n_chars > 400 THEN 'good' WHEN n_chars > 200 THEN 'bad' END AS predicted FROM labels JOIN documents USING (doc_id)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("expected"), F.when(F.col("n_chars") > 400, "good").when(F.col("n_chars") > 200, "bad").alias("predicted"))


@query(
    f"""WITH p AS (SELECT expected, coalesce(predicted, 'none') AS predicted FROM ({_PAIRS})), l AS (SELECT unnest(['good', 'bad', 'none', 'absent']) AS label),
f AS (SELECT label, (SELECT count(*) FROM p WHERE expected = label AND predicted = label) AS t, (SELECT count(*) FROM p WHERE expected = label) AS e, (SELECT count(*) FROM p WHERE predicted = label) AS q FROM l)
SELECT (SELECT round(avg(CASE WHEN expected = predicted THEN 1.0 ELSE 0.0 END), 6) FROM p) AS accuracy, (SELECT count(*) FROM p) AS n, round(avg(CASE WHEN t > 0 THEN 2.0 * t / (e + q) ELSE 0 END), 6) AS macro_f1 FROM f"""
)
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.macro_f1(_pairs(spark, sf_dir), ["good", "bad", "none", "absent"])


@query(f"SELECT expected, coalesce(predicted, 'none') AS predicted, count(*) AS n FROM ({_PAIRS}) GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_pairs(spark, sf_dir))


@query(
    f"""WITH {_TAGS}, g AS (SELECT t, list_filter(t, lambda x: length(x) >= 6) AS p FROM tg), s AS (SELECT sum(len(list_intersect(t, p))) AS m, sum(len(p)) AS p, sum(len(t)) AS e FROM g)
SELECT round(m / p, 6) AS precision, round(m / e, 6) AS recall, round(2 * (m / p) * (m / e) / (m / p + m / e), 6) AS f1 FROM s"""
)
def micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _chunks(spark, sf_dir).select(X.tags(F.col("content")).alias("expected"))
    return evaluation.micro_prf(tags.withColumn("predicted", F.filter("expected", lambda t: F.length(t) >= 6)))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, max(CASE WHEN i = least(n - 1, n // 2) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) THEN value END) AS p95 FROM r GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, value AS median, n FROM r WHERE i = n // 2")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.upper_median(table(spark, sf_dir, "events"), "value", ["user_id"])


@query("WITH c AS (SELECT unnest([event_type, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END]) AS tag, round(value, 0) - round(value, 2) AS d FROM events) SELECT tag, count(*) AS n, round(avg(d), 6) AS mean_delta, CAST(sum(CASE WHEN d > 1e-7 THEN 1 ELSE 0 END) AS BIGINT) AS improved, CAST(sum(CASE WHEN d < -1e-7 THEN 1 ELSE 0 END) AS BIGINT) AS worsened, CAST(sum(CASE WHEN abs(d) <= 1e-7 THEN 1 ELSE 0 END) AS BIGINT) AS flat FROM c GROUP BY tag")
def taxonomy_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.array("event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")).alias("tags"), F.round("value", 2).alias("baseline"), F.round("value", 0).alias("expanded"))
    return evaluation.taxonomy_deltas(e)


@query(
    """WITH b AS (SELECT event_type AS run, 'metric' AS metric, round(avg(value), 6) AS base FROM events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT event_type, 'latency', max(value) FROM events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT 'absent', 'metric', 1.0),
c AS (SELECT event_type AS run, 'metric' AS metric, round(avg(value), 6) AS now FROM events WHERE event_id % 2 = 1 GROUP BY 1 UNION ALL SELECT event_type, 'latency', max(value) FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT run, metric, base, now, round(now - base, 6) AS delta, coalesce(CASE WHEN metric = 'latency' THEN now <= base * 1.15 ELSE now >= base - 0.02 END, false) AS passed FROM b LEFT JOIN c USING (run, metric)"""
)
def gate_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")

    def report(rows: DataFrame) -> DataFrame:
        by = rows.groupBy(F.col("event_type").alias("run"))
        return by.agg(F.round(F.avg("value"), 6).alias("value")).select("run", F.lit("metric").alias("metric"), "value").unionByName(by.agg(F.max("value").alias("value")).select("run", F.lit("latency").alias("metric"), "value"))

    absent = spark.createDataFrame([("absent", "metric", 1.0)], "run string, metric string, value double")
    return evaluation.gate(report(e.where("event_id % 2 = 1")), report(e.where("event_id % 2 = 0")).unionByName(absent))


@query("SELECT 'dangling' AS problem, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey > 3) UNION ALL SELECT 'duplicate', c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def validate_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    lost = evaluation.dangling(orders, "o_custkey", customers.where("c_nationkey > 3"), "c_custkey").select(F.lit("dangling").alias("problem"), F.col("o_orderkey").alias("id"))
    return lost.unionByName(evaluation.duplicate_ids(customers, "c_nationkey").select(F.lit("duplicate").alias("problem"), F.col("c_nationkey").cast("long").alias("id")))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1(CAST(doc_id AS VARCHAR))) AS turn FROM documents) SELECT doc_id, source, turn FROM r ORDER BY turn, source LIMIT 100")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", F.col("doc_id"), 100)




@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1(CAST(doc_id AS VARCHAR))) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN i <= greatest(1, floor(n * 0.2)) THEN 'test' ELSE 'train' END AS split FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", F.col("doc_id"), 0.2)


@query(
    """WITH r AS (SELECT 0 AS corpus, doc_id AS old_id, md5(lower(trim(coalesce(text, ''), ' '))) AS key FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 1, doc_id, md5(lower(trim(coalesce(text, ''), ' '))) FROM documents WHERE doc_id % 2 = 1)
SELECT corpus, old_id, first_value(corpus) OVER w AS new_corpus, first_value(old_id) OVER w AS new_id FROM r WINDOW w AS (PARTITION BY key ORDER BY corpus, old_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def corpus_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return evaluation.merged_corpora([docs.where("id % 2 = 0"), docs.where("id % 2 = 1")])


@query("WITH p AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings) SELECT x.label, round(avg(sign(x.a - y.a) * sign(x.b - y.b)), 6) AS tau, count(*) AS n_pairs FROM p x JOIN p y ON x.label = y.label AND x.a < y.a GROUP BY x.label")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"))
    return evaluation.kendall_tau(e, "label", "a", "b")


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n, round(pow((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 0.5), 6) AS weight FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_weights(table(spark, sf_dir, "documents"), "lang", 0.5)


@query("SELECT round(sum(value * (user_id % 5)) / sum(user_id % 5), 6) AS weighted_mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def weighted_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.weighted_mean(table(spark, sf_dir, "events").withColumn("w", F.col("user_id") % 5), "value", "w")


@query("SELECT CASE lang WHEN 'en' THEN 'easy' WHEN 'de' THEN 'medium' WHEN 'fr' THEN 'hard' ELSE 'unknown' END AS difficulty, count(*) AS n, round(avg(n_chars), 6) AS n_chars FROM documents GROUP BY 1")
def metric_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("lang") == "en", "easy").when(F.col("lang") == "de", "medium").when(F.col("lang") == "fr", "hard")
    return evaluation.breakdown(table(spark, sf_dir, "documents").withColumn("difficulty", level), "difficulty", ["n_chars"], ["easy", "medium", "hard", "unknown"]).drop("position")


# N: windows over events (the batch twin of the stream) ---------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.windows(table(spark, sf_dir, "events"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.sessions(table(spark, sf_dir, "events"))
