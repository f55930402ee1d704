"""Evaluation suites: agent memory, span coverage, branch diagnosis and its classes, rescue slices, training examples, composite scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X

# agent memory ---------------------------------------------------------------------------------------------------------


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(empty), 6)


def agent_metrics(scenarios: DataFrame) -> DataFrame:
    """One row of ratios over scenarios.

    scenarios: no_write (nothing should be written) and false_write, expected_writes and matched_writes, active_ok and
    update_ok (null where nothing is expected), recall_ranks (an array: the rank of the first fitting memory of each
    recall query, null for a miss).
    """
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n = lambda c: F.count(F.when(c, 1))
    hits = F.filter("recall_ranks", lambda r: r.isNotNull())
    gained = F.aggregate(hits, F.lit(0.0), lambda t, r: t + 1.0 / r)
    out = scenarios.agg(
        F.count("*").alias("scenarios"), n(F.col("no_write")).alias("silent"), n(F.col("no_write") & F.col("false_write")).alias("wrong"), s("expected_writes").alias("expected"), s("matched_writes").alias("matched"),
        n(F.col("active_ok").isNotNull()).alias("active"), n(F.col("active_ok")).alias("active_right"), n(F.col("update_ok").isNotNull()).alias("updates"), n(F.col("update_ok")).alias("updates_right"), s(F.size("recall_ranks")).alias("asked"), s(F.size(hits)).alias("hit"), F.coalesce(F.sum(gained), F.lit(0.0)).alias("gained"),
    )
    c = F.col
    return out.select(
        "scenarios", ratio(c("wrong"), c("silent"), 0.0).alias("false_write_rate"), ratio(c("matched"), c("expected"), 1.0).alias("write_recall"), ratio(c("active_right"), c("active"), 1.0).alias("active_state_accuracy"),
        ratio(c("updates_right"), c("updates"), 1.0).alias("update_accuracy"), ratio(c("hit"), c("asked"), 1.0).alias("recall_hit_rate"), ratio(c("gained"), c("asked"), 1.0).alias("recall_mrr"),
    )


EXPECTED = "scenario long, exp_id long, kind string, status string, canonical_key string, text_contains array<string>, facets array<string>, entities array<string>, topics array<string>"


def fits(expected: DataFrame, records: DataFrame) -> DataFrame:
    """All pairs of an expected memory (EXPECTED; null: anything) and a record of the same scenario that it describes: scenario, exp_id, rec_id, status of both.

    records: scenario, rec_id, kind, status, canonical_key, text, facets, entities, topics.
    """
    e = expected.select("scenario", "exp_id", *(F.col(x).alias(f"e_{x}") for x in ("kind", "status", "canonical_key", "text_contains", "facets", "entities", "topics")))
    key = X.match_key
    ok = F.lit(True)
    for c in ("kind", "status", "canonical_key"):
        ok = ok & (F.col(f"e_{c}").isNull() | (key(F.col(f"e_{c}")) == key(F.col(c))))
    ok = ok & F.forall(F.coalesce("e_text_contains", F.array().cast("array<string>")), lambda t: F.contains(key(F.col("text")), key(t)))
    for c in ("facets", "entities", "topics"):
        own = F.transform(F.coalesce(c, F.array().cast("array<string>")), key)
        ok = ok & (F.size(F.array_except(F.transform(F.coalesce(f"e_{c}", F.array().cast("array<string>")), key), own)) == 0)
    return e.join(records, "scenario").where(ok).select("scenario", "exp_id", "rec_id", F.col("e_status").alias("expected_status"), "status")


def matched_writes(expected: DataFrame, records: DataFrame) -> DataFrame:
    """scenario, expected_writes, matched_writes: each expected memory takes the first record that fits and isn't taken, in order."""
    import pandas as pd

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        for ids in rows.sort_values("exp_id").recs:
            free = next((i for i in sorted(ids) if i not in used), None)
            if free is not None:
                used.add(free)
        return pd.DataFrame({"scenario": [rows.scenario.iloc[0]], "matched_writes": [len(used)]})

    pairs = fits(expected, records).groupBy("scenario", "exp_id").agg(F.collect_list("rec_id").alias("recs"))
    counts = pairs.groupBy("scenario").applyInPandas(take, "scenario long, matched_writes long")
    return expected.groupBy("scenario").agg(F.count("*").alias("expected_writes")).join(counts, "scenario", "left").na.fill(0, ["matched_writes"])


def active_states(expected: DataFrame, records: DataFrame) -> DataFrame:
    """scenario, active_ok: whether each expectation with a status has a record that fits and has it; scenarios without such expectations are left out."""
    wanted = expected.where("status IS NOT NULL").select("scenario", "exp_id")
    found = fits(expected, records).where("status = expected_status").select("scenario", "exp_id").distinct().withColumn("ok", F.lit(True))
    return wanted.join(found, ["scenario", "exp_id"], "left").groupBy("scenario").agg(F.every(F.coalesce("ok", F.lit(False))).alias("active_ok"))


# storage -----------------------------------------------------------------------------------------------------------------


def span_coverage(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """case_id, n_spans, covered, coverage: the required spans (case_id, span) that one of the case's chunks (case_id, content) has as a whole, in comparison form."""
    wanted = spans.select("case_id", "span", X.comparison_key(F.col("span")).alias("k"))
    hit = wanted.join(chunks.select("case_id", X.comparison_key(F.col("content")).alias("c")), "case_id").where(F.contains("c", "k")).select("case_id", "span").distinct()
    n = wanted.groupBy("case_id").agg(F.count_distinct("span").alias("n_spans"))
    out = n.join(hit.groupBy("case_id").agg(F.count("*").alias("covered")), "case_id", "left").na.fill(0, ["covered"])
    return out.withColumn("coverage", F.round(F.col("covered") / F.col("n_spans"), 6))


def majority_label(chunks: DataFrame) -> DataFrame:
    """A document's label from its chunks' (case_id, label, confidence): the largest sum of confidences, of equals the first by name."""
    sums = chunks.groupBy("case_id", "label").agg(F.sum("confidence").alias("s"))
    w = Window.partitionBy("case_id").orderBy(F.desc(F.round("s", 9)), "label")
    return sums.withColumn("n", F.row_number().over(w)).where("n = 1").select("case_id", "label")


# diagnosis ------------------------------------------------------------------------------------------------------------------


def branch_ranks(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """qid, branch, best_rank (null: none found), found, found_at_k of each query of relevant (qid, doc_id) in each branch of hits (branch, qid, doc_id, rank)."""
    ok = hits.join(relevant.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi")
    found = ok.groupBy("qid", "branch").agg(F.min("rank").alias("best_rank"), F.count("*").alias("found"), F.count(F.when(F.col("rank") <= k, 1)).alias("found_at_k"))
    names = hits.select("branch").distinct()
    return relevant.select("qid").distinct().crossJoin(F.broadcast(names)).join(found, ["qid", "branch"], "left").na.fill(0, ["found", "found_at_k"])  # a handful of branches


def diagnosed(ranks: DataFrame, original: DataFrame, k: int) -> DataFrame:
    """qid, classification of each query: why it was missed. ranks: branch_ranks() of current_wide, no_expansion_wide, lexical_wide and semantic_wide; original: qid, hit, recall, n_relevant."""
    best = ranks.groupBy("qid").pivot("branch", ["current_wide", "no_expansion_wide", "lexical_wide", "semantic_wide"]).agg(F.min("best_rank").alias("best"), F.sum("found").alias("found"), F.sum("found_at_k").alias("at_k"))
    rows, c = original.join(best, "qid", "left"), F.col
    top, plain = F.coalesce(c("current_wide_best") <= k, F.lit(False)), F.coalesce(c("no_expansion_wide_best") <= k, F.lit(False))
    some = c("current_wide_best").isNotNull()
    any_ = F.coalesce("current_wide_best", "no_expansion_wide_best", "lexical_wide_best", "semantic_wide_best").isNotNull()
    kind = (
        F.when(~c("hit") & top, "fixed_by_current_code")
        .when(c("hit") & (c("recall") < 1) & (c("n_relevant") > 1), F.when(F.coalesce("current_wide_found", F.lit(0)) > F.coalesce("current_wide_at_k", F.lit(0)), "multi_evidence_preservation").otherwise("partial_multi_evidence"))
        .when(plain & ~top, "expansion_regression").when(some & ~top, "ranking_or_pool_depth").when(~some & (c("lexical_wide_best").isNotNull() | c("semantic_wide_best").isNotNull()), "fusion_filtering")
        .when(~any_, "candidate_generation").when(top, "covered").otherwise("candidate_generation")
    )
    return rows.select("qid", kind.alias("classification"))


TEMPORAL_CUES = "after|before|currently|date|day|during|how many|last|month|now|past|since|typical week|week|what time|when|which day|year"
SEVERAL_CUES = " and |across|all the|between|combined|from |total"
CONTEXT_CUES = " it |previous chat|previous conversation|remind me|that |this |those "
NAME_PATTERN = r"\b[A-Z][A-Za-z0-9_-]{2,}\b"
#: An edge of a word of ASCII letters, digits and _: what \b is in the SQL's engine. To Java, letters like é belong to words.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def taxonomy(query: Column, n_relevant: Column, types: Column) -> Column:
    """What makes a query hard; types: memory types that it is labelled with."""
    low, has = F.lower(query), lambda t: F.array_contains(F.transform(types, F.lower), t)
    temporal = has("temporal") | low.rlike(TEMPORAL_CUES)
    labels = F.array_compact(F.array(
        F.when(temporal, "temporal/count"), F.when((n_relevant > 1) | low.rlike(SEVERAL_CUES), "multi-evidence"), F.when(low.rlike(CONTEXT_CUES), "contextual-ellipsis"),
        F.when(query.rlike("['\"]") | query.rlike(NAME_PATTERN.replace(r"\b", _EDGE)) | has("entity"), "entity/alias"), F.when(has("episodic") & ~temporal, "episodic/contextual"),
    ))
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("lexical/semantic-mismatch")))


def surface(n_retrieved: Column, hit: Column, recall: Column, hit_at_1: Column, n_relevant: Column) -> Column:
    """What a result looks like from outside."""
    return F.when(n_retrieved == 0, "empty-retrieval").when(~hit, "no-relevant-in-top-k").when((recall < 1) & (n_relevant > 1), "partial-multi-evidence-recall").when(~hit_at_1, "rank-headroom").otherwise("covered")


PRIORITY = {"relevant": -2, "original": -1, "current_top_k": 0, "current_wide": 1, "no_expansion_wide": 2, "lexical_wide": 3, "semantic_wide": 4}


def rescue_documents(hits: DataFrame, relevant: DataFrame, per_branch: int, most: int) -> DataFrame:
    """qid, doc_id, place: the documents of a rescue case: all relevant ones, then those of the branches (branch, qid, doc_id, rank) in their order, per_branch of each and `most` in all (or as many as are relevant)."""
    order = F.coalesce(F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))[F.col("branch")], F.lit(99))
    lists = hits.where((F.col("rank") <= per_branch) | F.col("branch").isin("relevant", "original")).select("qid", "doc_id", order.alias("o"), "rank")
    rows = relevant.select("qid", "doc_id", F.lit(-2).alias("o"), F.row_number().over(Window.partitionBy("qid").orderBy("doc_id")).alias("rank")).unionByName(lists)
    first = rows.groupBy("qid", "doc_id").agg(F.min(F.struct("o", "rank")).alias("at"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("at", "doc_id")))
    return placed.where((F.col("place") <= most) | (F.col("at.o") == -2)).select("qid", "doc_id", "place")


def training_examples(mined: DataFrame, relevant: DataFrame, negatives: int = 8) -> DataFrame:
    """qid, positive, hard_negatives: each relevant document with the best lexical hits (qid, chunk_id, rank) of its query that aren't relevant, in order."""
    relevant = relevant.select("qid", "doc_id").distinct()
    hard = mined.where(F.col("rank") <= negatives).select("qid", F.col("chunk_id").alias("doc_id"), "rank").join(relevant, ["qid", "doc_id"], "left_anti")
    hard = hard.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("hard_negatives"))
    return relevant.join(hard, "qid", "left").select("qid", F.col("doc_id").alias("positive"), F.coalesce("hard_negatives", F.array().cast("array<long>")).alias("hard_negatives"))


# composite scores -------------------------------------------------------------------------------------------------------------

STORAGE_WEIGHTS = {"type_accuracy": 0.5, "macro_f1": 0.3, "span_coverage": 0.2}
RECALL_WEIGHTS = {"mrr": 0.45, "ndcg": 0.3, "recall": 0.15, "hit_rate": 0.1}
#: Of a component: weights of storage and recall, most megabytes, most milliseconds.
COMPONENTS = {"embedding": (0.2, 0.8, 35.0, 50.0), "reranker": (0.2, 0.8, 25.0, 150.0), "typing": (0.7, 0.3, 10.0, 25.0)}
LEAST_GAIN, TIE = 0.003, 0.001


def scored(runs: DataFrame) -> DataFrame:
    """runs (component, the metrics, model_mb, latency_ms) with storage_score, recall_score, memory_score and gate_passed."""
    total = lambda weights: sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    of = lambda i: F.create_map(*(F.lit(x) for name, v in COMPONENTS.items() for x in (name, v[i])))[F.col("component")]
    rows = runs.withColumn("storage_score", total(STORAGE_WEIGHTS)).withColumn("recall_score", total(RECALL_WEIGHTS))
    return rows.withColumn("memory_score", of(0) * F.col("storage_score") + of(1) * F.col("recall_score")).withColumn("gate_passed", (F.col("model_mb") <= of(2)) & (F.col("latency_ms") <= of(3)))


def kept(candidates: DataFrame, baselines: DataFrame) -> DataFrame:
    """candidates (scored(), with run) with keep: past the gate, and without a baseline of the component, or clearly better, or as good and smaller or faster."""
    old = baselines.select("component", F.col("memory_score").alias("b_score"), F.col("model_mb").alias("b_mb"), F.col("latency_ms").alias("b_ms"))
    rows = candidates.join(old, "component", "left")
    gain = F.col("memory_score") - F.col("b_score")
    better = (gain >= LEAST_GAIN) | ((F.abs(gain) <= TIE) & ((F.col("model_mb") < F.col("b_mb")) | (F.col("latency_ms") < F.col("b_ms"))))
    return rows.withColumn("keep", F.col("gate_passed") & (F.col("b_score").isNull() | better)).drop("b_score", "b_mb", "b_ms")


# datasets ----------------------------------------------------------------------------------------------------------------------


def conversation_documents(messages: DataFrame) -> DataFrame:
    """id, text of a document for each conversation (conv_id, turn, role, text): a line for each turn that says something."""
    line = F.concat(F.coalesce("role", F.lit("unknown")), F.lit(": "), X.spaced(F.coalesce("text", F.lit(""))))
    rows = messages.where(X.spaced(F.coalesce("text", F.lit(""))) != "").select("conv_id", F.struct("turn", line.alias("line")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("id"), F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("text"))


def workspace_key(*parts: Column) -> Column:
    """The name of an index in the cache: 24 hexadecimal digits of what it depends on."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 24)


def merged_triage(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Audited items (id) with the verdict of the most sure reviewer (id, reviewer, verdict, confidence), whether reviewers differ, and a priority: differing ones first, then unsure, then rejected ones."""
    best = verdicts.groupBy("id").agg(F.max(F.struct("confidence", "reviewer", "verdict")).alias("b"), F.count_distinct("verdict").alias("n"))
    rows = items.join(best, "id", "left")
    place = F.when(F.col("n") > 1, 0).when(F.coalesce("b.confidence", F.lit(0.0)) < 0.5, 1).when(F.col("b.verdict") == "reject", 2).otherwise(3)
    return rows.select("id", F.coalesce("b.verdict", F.lit("open")).alias("verdict"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("disputed"), place.alias("priority"))
