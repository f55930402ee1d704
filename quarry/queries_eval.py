"""Queries of the evaluation suites and dataset tools, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X
from quarry.operators import lexical, suites
from quarry.plans.search import cut
from quarry.queries import _LEX, ORACLE_SQL, _benchmark, _chunks, _embedded_cte, _lexical_hits, _semantic, query, table, words_sql
from quarry.queries_store import _KEY

# Agent memory ---------------------------------------------------------------------------------------------------

_SCENARIOS = "SELECT user_id AS scenario, user_id % 4 = 0 AS no_write, bool_or(value > 90) AS false_write, count_if(event_type = 'purchase') AS expected_writes, count_if(event_type = 'purchase' AND value > 20) AS matched_writes, CASE WHEN user_id % 3 = 0 THEN max(value) > 50 END AS active_ok, CASE WHEN user_id % 5 = 0 THEN min(value) < 10 END AS update_ok, list(CASE WHEN event_type = 'click' AND event_id % 3 <> 0 THEN 1 + event_id % 5 END) FILTER (event_type = 'click') AS recall_ranks FROM events GROUP BY user_id"


@query(
    f"""WITH s AS ({_SCENARIOS}), r AS (SELECT unnest(recall_ranks) AS r FROM s)
SELECT count(*) AS scenarios, round(coalesce(count_if(no_write AND false_write) / nullif(count_if(no_write), 0), 0), 6) AS false_write_rate, round(coalesce(sum(matched_writes) / nullif(sum(expected_writes), 0), 1), 6) AS write_recall, round(coalesce(count_if(active_ok) / nullif(count(active_ok), 0), 1), 6) AS active_state_accuracy,
round(coalesce(count_if(update_ok) / nullif(count(update_ok), 0), 1), 6) AS update_accuracy, (SELECT round(coalesce(count(r) / nullif(count(*), 0), 1), 6) FROM r) AS recall_hit_rate, (SELECT round(coalesce(sum(1.0 / r) / nullif(count(*), 0), 1), 6) FROM r) AS recall_mrr FROM s"""
)
def agent_memory_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, t, v = F.col("user_id"), F.col("event_type"), F.col("value")
    rows = table(spark, sf_dir, "events").withColumn("rank", F.struct(F.when(F.col("event_id") % 3 != 0, 1 + F.col("event_id") % 5).alias("r")))
    scenarios = rows.groupBy(u.alias("scenario")).agg(
        F.bool_or(v > 90).alias("false_write"), F.count_if(t == "purchase").alias("expected_writes"), F.count_if((t == "purchase") & (v > 20)).alias("matched_writes"), F.max(v).alias("most"), F.min(v).alias("least"), F.transform(F.collect_list(F.when(t == "click", F.col("rank"))), lambda x: x["r"]).alias("recall_ranks")
    )
    s = F.col("scenario")
    scenarios = scenarios.withColumns({"no_write": s % 4 == 0, "active_ok": F.when(s % 3 == 0, F.col("most") > 50), "update_ok": F.when(s % 5 == 0, F.col("least") < 10)})
    return suites.agent_metrics(scenarios)


_REC = "SELECT doc_id % 50 AS scenario, doc_id AS rec_id, CASE WHEN doc_id % 2 = 0 THEN 'fact' ELSE 'profile' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'resolved' ELSE 'active' END AS status, source AS canonical_key, text, lang FROM documents"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select((d % 50).alias("scenario"), d.alias("rec_id"), F.when(d % 2 == 0, "fact").otherwise("profile").alias("kind"), F.when(d % 3 == 0, "resolved").otherwise("active").alias("status"), F.col("source").alias("canonical_key"), "text", F.array(F.upper("lang")).alias("facets"), F.array("source").alias("entities"), F.array().cast("array<string>").alias("topics"))


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the records of the first ten rows of each scenario would be described by, loosely."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").where("doc_id < 500")
    none = F.lit(None).cast("string")
    return rows.select((d % 50).alias("scenario"), d.alias("exp_id"), F.when(d % 2 == 0, "Fact").alias("kind"), F.when(d % 4 == 1, "ACTIVE").alias("status"), F.when(d % 5 == 0, F.col("source")).otherwise(none).alias("canonical_key"), F.array(F.upper(F.substring("lang", 1, 1))).alias("text_contains"), F.array("lang").alias("facets"), F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("topics"))


_EXP = "SELECT doc_id % 50 AS scenario, doc_id AS exp_id, CASE WHEN doc_id % 2 = 0 THEN 'fact' END AS kind, CASE WHEN doc_id % 4 = 1 THEN 'active' END AS status, CASE WHEN doc_id % 5 = 0 THEN source END AS canonical_key, substr(lang, 1, 1) AS piece, lang FROM documents WHERE doc_id < 500"


@query(f"SELECT e.scenario, exp_id, rec_id FROM ({_EXP}) e JOIN ({_REC}) r ON r.scenario = e.scenario AND (e.kind IS NULL OR e.kind = r.kind) AND (e.status IS NULL OR e.status = r.status) AND (e.canonical_key IS NULL OR e.canonical_key = r.canonical_key) AND contains(lower(coalesce(r.text, '')), e.piece) AND e.lang = r.lang")
def expected_memory_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suites.fits(_expected(spark, sf_dir), _records(spark, sf_dir)).select("scenario", "exp_id", "rec_id")


@query(f"WITH f AS (SELECT DISTINCT e.scenario, exp_id FROM ({_EXP}) e JOIN ({_REC}) r ON r.scenario = e.scenario AND (e.kind IS NULL OR e.kind = r.kind) AND e.status = r.status AND (e.canonical_key IS NULL OR e.canonical_key = r.canonical_key) AND contains(lower(coalesce(r.text, '')), e.piece) AND e.lang = r.lang) SELECT scenario, bool_and(f.exp_id IS NOT NULL) AS active_ok FROM ({_EXP}) e LEFT JOIN f USING (scenario, exp_id) WHERE e.status IS NOT NULL GROUP BY scenario")
def agent_active_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = _expected(spark, sf_dir)
    records = _records(spark, sf_dir).withColumn("status", F.upper("status"))  # statuses are compared as they are stored
    return suites.active_states(expected, records)


@query()
def agent_matched_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without SQL, as records are taken one after the other; tests/test_suites.py has them by definition."""
    return suites.matched_writes(_expected(spark, sf_dir), _records(spark, sf_dir))


# Storage ----------------------------------------------------------------------------------------------------------------


@query(rf"WITH c AS (SELECT doc_id AS case_id, unnest([substr(text, 1, 400), substr(text, 301, 300), substr(text, 700, 500)]) AS content FROM documents), s AS (SELECT DISTINCT doc_id AS case_id, unnest([substr(text, 41, 30), substr(text, 381, 50), substr(text, 690, 20)]) AS span FROM documents), k AS (SELECT case_id, span, {_KEY('span')} AS k FROM s WHERE span IS NOT NULL), h AS (SELECT DISTINCT k.case_id, span FROM k JOIN c ON c.case_id = k.case_id AND contains({_KEY('content')}, k)) SELECT case_id, count(*) AS n_spans, count(h.span) AS covered, round(count(h.span) / count(*), 6) AS coverage FROM k LEFT JOIN h USING (case_id, span) GROUP BY case_id")
def span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, docs = F.col("text"), table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumnRenamed("doc_id", "case_id")
    chunks = docs.select("case_id", F.explode(F.array(F.substring(t, 1, 400), F.substring(t, 301, 300), F.substring(t, 700, 500))).alias("content"))
    spans = docs.select("case_id", F.explode(F.array(F.substring(t, 41, 30), F.substring(t, 381, 50), F.substring(t, 690, 20))).alias("span")).distinct()
    return suites.span_coverage(chunks, spans)


@query("WITH s AS (SELECT user_id AS case_id, event_type AS label, sum(value / 100) AS s FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(s, 9) DESC, label) AS n FROM s) SELECT case_id, label FROM r WHERE n = 1")
def majority_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suites.majority_label(table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("label"), (F.col("value") / 100).alias("confidence")))


# Diagnosis --------------------------------------------------------------------------------------------------

_DIAG = f"""{_LEX}, {_embedded_cte()}, rel AS (SELECT DISTINCT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
hb AS (SELECT 'lexical_wide' AS branch, qid, chunk_id AS doc_id, rank FROM sr WHERE rank <= 20 UNION ALL SELECT 'semantic_wide', qid, chunk_id, rank FROM sk WHERE rank <= 20 UNION ALL SELECT 'current_wide', qid, chunk_id, rank + chunk_id % 7 FROM sr WHERE rank <= 20 AND qid % 3 <> 0 UNION ALL SELECT 'no_expansion_wide', qid, chunk_id, rank FROM sr WHERE rank <= 20 AND qid % 4 = 0),
br AS (SELECT qid, branch, min(h.rank) AS best_rank, count(h.rank) AS found, count(CASE WHEN h.rank <= 5 THEN 1 END) AS found_at_k FROM (SELECT DISTINCT qid FROM rel) CROSS JOIN (SELECT DISTINCT branch FROM hb) LEFT JOIN (SELECT hb.* FROM hb JOIN rel USING (qid, doc_id)) h USING (qid, branch) GROUP BY ALL),
og AS (SELECT qid, min(rank) <= 5 AS hit, min(rank) AS best, count_if(rank <= 5) / any_value(n) AS recall, any_value(n) AS n_relevant, any_value(m) AS n_retrieved FROM (SELECT qid, count(*) AS n FROM rel GROUP BY qid) LEFT JOIN (SELECT sr.qid, rank FROM sr JOIN rel ON rel.qid = sr.qid AND doc_id = chunk_id WHERE rank <= 20) USING (qid) LEFT JOIN (SELECT qid, count(*) AS m FROM sr WHERE rank <= 20 GROUP BY qid) USING (qid) GROUP BY qid)"""


def _diagnosis(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits by branch, relevant documents, and the original results of each query."""
    docs, items = table(spark, sf_dir, "documents"), _benchmark(spark, sf_dir)
    # each a few rows of a query, made once by reading all texts and used many times
    relevant = cut(lexical.containing(docs, items.withColumnRenamed("qid", "phrase_id")).withColumnRenamed("phrase_id", "qid"))
    lex = _lexical_hits(spark, sf_dir).select("qid", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))
    sem = _semantic(spark, sf_dir).select("qid", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))
    lex, sem = cut(lex), cut(sem)
    name = lambda rows, n: rows.select(F.lit(n).alias("branch"), "qid", "doc_id", "rank")
    hits = name(lex, "lexical_wide").unionByName(name(sem, "semantic_wide")).unionByName(name(lex.where("qid % 3 <> 0").withColumn("rank", F.col("rank") + F.col("doc_id") % 7), "current_wide")).unionByName(name(lex.where("qid % 4 = 0"), "no_expansion_wide"))
    n = relevant.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    got = lex.join(relevant, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("best"), F.count(F.when(F.col("rank") <= 5, 1)).alias("at_k"))
    size = lex.groupBy("qid").agg(F.count("*").alias("n_retrieved"))
    original = n.join(got, "qid", "left").join(size, "qid", "left").select("qid", F.coalesce(F.col("best") <= 5, F.lit(False)).alias("hit"), "best", (F.coalesce("at_k", F.lit(0)) / F.col("n_relevant")).alias("recall"), "n_relevant", F.coalesce("n_retrieved", F.lit(0)).alias("n_retrieved"))
    return hits, relevant, original


@query(f"WITH {_DIAG} SELECT * FROM br")
def branch_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, relevant, _ = _diagnosis(spark, sf_dir)
    return suites.branch_ranks(hits, relevant, 5)


@query(
    f"""WITH {_DIAG}, p AS (SELECT qid, {", ".join(f"max(CASE WHEN branch = '{b}' THEN best_rank END) AS {a}, max(CASE WHEN branch = '{b}' THEN found END) AS {a}f, max(CASE WHEN branch = '{b}' THEN found_at_k END) AS {a}k" for a, b in (("c", "current_wide"), ("n", "no_expansion_wide"), ("l", "lexical_wide"), ("s", "semantic_wide")))} FROM br GROUP BY qid),
o AS (SELECT qid, coalesce(hit, false) AS hit, coalesce(recall, 0) AS recall, n_relevant FROM og)
SELECT qid, CASE WHEN NOT hit AND coalesce(c <= 5, false) THEN 'fixed_by_current_code' WHEN hit AND recall < 1 AND n_relevant > 1 THEN CASE WHEN coalesce(cf, 0) > coalesce(ck, 0) THEN 'multi_evidence_preservation' ELSE 'partial_multi_evidence' END
WHEN coalesce(n <= 5, false) AND NOT coalesce(c <= 5, false) THEN 'expansion_regression' WHEN c IS NOT NULL AND c > 5 THEN 'ranking_or_pool_depth' WHEN c IS NULL AND (l IS NOT NULL OR s IS NOT NULL) THEN 'fusion_filtering' WHEN coalesce(c, n, l, s) IS NULL THEN 'candidate_generation' WHEN coalesce(c <= 5, false) THEN 'covered' ELSE 'candidate_generation' END AS classification FROM o JOIN p USING (qid)"""
)
def diagnosed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, relevant, original = _diagnosis(spark, sf_dir)
    return suites.diagnosed(suites.branch_ranks(hits, relevant, 5), original, 5)


@query(
    rf"""WITH {_DIAG}, t AS (SELECT og.*, text, lower(text) AS low, qid % 6 = 0 AS ty, qid % 6 = 1 AS ep FROM og JOIN benchmark ON item_id = qid), l AS (SELECT *, ty OR regexp_matches(low, '{suites.TEMPORAL_CUES}') AS temporal FROM t),
m AS (SELECT *, list_filter([CASE WHEN temporal THEN 'temporal/count' END, CASE WHEN n_relevant > 1 OR regexp_matches(low, '{suites.SEVERAL_CUES}') THEN 'multi-evidence' END, CASE WHEN regexp_matches(low, '{suites.CONTEXT_CUES}') THEN 'contextual-ellipsis' END, CASE WHEN regexp_matches(text, '[''"]') OR regexp_matches(text, '{suites.NAME_PATTERN}') THEN 'entity/alias' END, CASE WHEN ep AND NOT temporal THEN 'episodic/contextual' END], lambda x: x IS NOT NULL) AS labels FROM l)
SELECT qid, CASE WHEN len(labels) > 0 THEN array_to_string(labels, ',') ELSE 'lexical/semantic-mismatch' END AS taxonomy, CASE WHEN coalesce(n_retrieved, 0) = 0 THEN 'empty-retrieval' WHEN NOT coalesce(hit, false) THEN 'no-relevant-in-top-k' WHEN coalesce(recall, 0) < 1 AND n_relevant > 1 THEN 'partial-multi-evidence-recall' WHEN best <> 1 THEN 'rank-headroom' ELSE 'covered' END AS surface FROM m"""
)
def miss_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, original = _diagnosis(spark, sf_dir)
    types = F.when(F.col("qid") % 6 == 0, F.array(F.lit("Temporal"))).when(F.col("qid") % 6 == 1, F.array(F.lit("episodic"))).otherwise(F.array().cast("array<string>"))
    rows = original.join(_benchmark(spark, sf_dir), "qid")
    seen = suites.surface(F.col("n_retrieved"), F.col("hit"), F.col("recall"), F.coalesce(F.col("best") == 1, F.lit(False)), F.col("n_relevant"))
    return rows.select("qid", F.array_join(suites.taxonomy(F.col("text"), F.col("n_relevant"), types), ",").alias("taxonomy"), seen.alias("surface"))


@query(
    f"""WITH {_DIAG}, l AS (SELECT qid, doc_id, CASE branch WHEN 'current_wide' THEN 1 WHEN 'no_expansion_wide' THEN 2 WHEN 'lexical_wide' THEN 3 ELSE 4 END AS o, rank FROM hb WHERE rank <= 6 UNION ALL SELECT qid, doc_id, -2, row_number() OVER (PARTITION BY qid ORDER BY doc_id) FROM rel),
f AS (SELECT qid, doc_id, min((o, rank)) AS t FROM l GROUP BY ALL), p AS (SELECT qid, doc_id, t[1] AS o, row_number() OVER (PARTITION BY qid ORDER BY t, doc_id) AS place FROM f) SELECT qid, doc_id, place FROM p WHERE place <= 12 OR o = -2"""
)
def rescue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, relevant, _ = _diagnosis(spark, sf_dir)
    return suites.rescue_documents(hits, relevant, 6, 12)


@query("WITH m AS (" + ORACLE_SQL["bm25_miner"] + "), rel AS (SELECT DISTINCT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), h AS (SELECT qid, list(chunk_id ORDER BY rank) AS h FROM m WHERE rank <= 8 AND NOT EXISTS (SELECT 1 FROM rel WHERE rel.qid = m.qid AND rel.doc_id = m.chunk_id) GROUP BY qid) SELECT qid, doc_id AS positive, coalesce(array_to_string(h, ','), '') AS hard_negatives FROM rel LEFT JOIN h USING (qid)")
def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _benchmark(spark, sf_dir)
    relevant = cut(lexical.containing(table(spark, sf_dir, "documents"), items.withColumnRenamed("qid", "phrase_id")).withColumnRenamed("phrase_id", "qid"))
    found = suites.training_examples(lexical.miner(_chunks(spark, sf_dir), items, 20), relevant)
    return found.withColumn("hard_negatives", F.array_join(F.col("hard_negatives").cast("array<string>"), ","))


# Q2, Q5, Q7, P10 ------------------------------------------------------------------------------------------------------------------

_RUNS = "SELECT event_type || CAST(u AS VARCHAR) AS run, ['typing', 'embedding', 'reranker'][u % 3 + 1] AS component, a AS type_accuracy, b AS macro_f1, c AS span_coverage, c AS mrr, b AS ndcg, a AS recall, 1 - c AS hit_rate, 5.0 + u * 3 AS model_mb, 20.0 + u * 9 AS latency_ms FROM (SELECT event_type, user_id % 12 AS u, round(avg(value) / 100, 3) AS a, round(min(value) / 10, 3) AS b, round(max(value) / 300, 3) AS c FROM events GROUP BY ALL)"
_SCORED = f"SELECT *, CASE component WHEN 'typing' THEN 0.7 ELSE 0.2 END * storage_score + CASE component WHEN 'typing' THEN 0.3 ELSE 0.8 END * recall_score AS memory_score, model_mb <= CASE component WHEN 'typing' THEN 10 WHEN 'embedding' THEN 35 ELSE 25 END AND latency_ms <= CASE component WHEN 'typing' THEN 25 WHEN 'embedding' THEN 50 ELSE 150 END AS gate_passed FROM (SELECT *, 0.5 * type_accuracy + 0.3 * macro_f1 + 0.2 * span_coverage AS storage_score, 0.45 * mrr + 0.3 * ndcg + 0.15 * recall + 0.1 * hit_rate AS recall_score FROM ({_RUNS}))"


@query(f"WITH s AS ({_SCORED}), b AS (SELECT component, memory_score AS bs, model_mb AS bm, latency_ms AS bl FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY round(memory_score, 9) DESC, run) AS n FROM s) WHERE n = 2 AND component <> 'reranker') SELECT run, component, round(storage_score, 6) AS storage_score, round(recall_score, 6) AS recall_score, round(memory_score, 6) AS memory_score, gate_passed, gate_passed AND (bs IS NULL OR memory_score - bs >= 0.003 OR (abs(memory_score - bs) <= 0.001 AND (model_mb < bm OR latency_ms < bl))) AS keep FROM s LEFT JOIN b USING (component)")
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of made-up runs, and which of them would be kept against the second best of their component."""
    e = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 12).alias("u")).agg(F.round(F.avg("value") / 100, 3).alias("a"), F.round(F.min("value") / 10, 3).alias("b"), F.round(F.max("value") / 300, 3).alias("c"))
    names = F.array(F.lit("typing"), F.lit("embedding"), F.lit("reranker"))
    runs = e.select(F.concat("event_type", F.col("u").cast("string")).alias("run"), F.get(names, (F.col("u") % 3).cast("int")).alias("component"), F.col("a").alias("type_accuracy"), F.col("b").alias("macro_f1"), F.col("c").alias("span_coverage"), F.col("c").alias("mrr"), F.col("b").alias("ndcg"), F.col("a").alias("recall"), (1 - F.col("c")).alias("hit_rate"), (5.0 + F.col("u") * 3).alias("model_mb"), (20.0 + F.col("u") * 9).alias("latency_ms"))
    scored = suites.scored(runs)
    second = scored.withColumn("n", F.row_number().over(Window.partitionBy("component").orderBy(F.desc(F.round("memory_score", 9)), "run"))).where("n = 2 AND component <> 'reranker'")
    r = lambda c: F.round(c, 6).alias(c)
    return suites.kept(scored, second).select("run", "component", r("storage_score"), r("recall_score"), r("memory_score"), "gate_passed", "keep")


@query(r"WITH l AS (SELECT conv_id, turn, coalesce(role, 'unknown') || ': ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM conversations WHERE trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> '') SELECT 'conv_' || conv_id AS id, string_agg(line, chr(10) ORDER BY turn, line) AS text FROM l GROUP BY conv_id")
def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suites.conversation_documents(table(spark, sf_dir, "conversations"))


@query("SELECT doc_id, substr(sha256(source || chr(10) || lang || chr(10) || n_chars), 1, 24) AS key FROM documents")
def workspace_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", suites.workspace_key(F.col("source"), F.col("lang"), F.col("n_chars").cast("string")).alias("key"))


@query("WITH v AS (SELECT l_orderkey AS id, l_linenumber AS reviewer, CASE WHEN l_quantity > 25 THEN 'accept' ELSE 'reject' END AS verdict, CAST(l_discount AS DOUBLE) * 10 AS confidence FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey % 3 <> 0), b AS (SELECT id, arg_max(verdict, (confidence, reviewer, verdict)) AS verdict, max(confidence) AS confidence, count(DISTINCT verdict) AS n FROM v GROUP BY id) SELECT o_orderkey AS id, coalesce(verdict, 'open') AS verdict, coalesce(n > 1, false) AS disputed, CASE WHEN n > 1 THEN 0 WHEN coalesce(confidence, 0) < 0.5 THEN 1 WHEN verdict = 'reject' THEN 2 ELSE 3 END AS priority FROM orders LEFT JOIN b ON b.id = o_orderkey")
def merged_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3 AND l_orderkey % 3 <> 0")
    verdicts = lines.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("reviewer"), F.when(F.col("l_quantity") > 25, "accept").otherwise("reject").alias("verdict"), (F.col("l_discount").cast("double") * 10).alias("confidence"))
    return suites.merged_triage(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), verdicts)
