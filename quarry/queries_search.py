"""Queries of the search path: predicates of queries, plans, gates, preselection, bonuses, the whole search; with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import vector
from quarry.operators import fusion, lexical, store
from quarry.plans import planner, search
from quarry.queries import _AGE, _AGGREGATE, _ANCHORED, _FUSED, _LEX, NOW, _benchmark, _embedded_cte, _fused, _lexical_hits, _quoted, _semantic, query, table, words_sql

_SUPPORT = lambda t: f"(regexp_matches(lower({t}), '{'|'.join(fusion.SUPPORT_CUES)}') OR regexp_matches(lower({t}), '{fusion.SUPPORT_NUMBERS}'))"
_BROAD = lambda t: rf"CASE WHEN len({words_sql(t)}) < 5 THEN regexp_matches(lower({t}), '^(what|when|where|which|who|how) ') ELSE contains(lower({t}), '?') OR regexp_matches(lower({t}), '{'|'.join(fusion.RECALL_CUES)}') OR len({words_sql(t)}) >= 8 END"
_TEXTS = "SELECT conv_id * 1000 + turn AS qid, text FROM conversations WHERE trim(coalesce(text, '')) <> ''"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(F.trim(F.coalesce("text", F.lit(""))) != "").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")


@query(f"SELECT qid, {_ANCHORED('text')} AS time_anchored, {_AGGREGATE('text')} AS temporal_or_aggregate, {_SUPPORT('text')} AS needs_several, {_BROAD('text')} AS broad FROM ({_TEXTS})")
def query_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _texts(spark, sf_dir).select("qid", fusion.time_anchored(t).alias("time_anchored"), fusion.temporal_or_aggregate(t).alias("temporal_or_aggregate"), fusion.needs_several(t).alias("needs_several"), fusion.broad_recall(t).alias("broad"))


_KEYS = f"list_filter({words_sql('trim(text)')}, lambda w: length(w) >= 4 AND w NOT IN ({_quoted(X.QUERY_STOP_WORDS)}))"


@query(
    rf"""WITH t AS (SELECT qid, lower(text) AS low, text, {_KEYS} AS k FROM ({_TEXTS})), i AS (SELECT *, CASE WHEN regexp_matches(low, 'count|total|how many') THEN 'count' WHEN regexp_matches(low, 'last |latest|most recent') THEN 'most_recent' WHEN {_ANCHORED("text")} THEN 'time_anchored' ELSE 'any' END AS intent FROM t)
SELECT qid, intent, CASE WHEN regexp_matches(low, 'old (records|memor(y|ies))|archived|superseded|historical') THEN 'active,archived,resolved,superseded' WHEN regexp_matches(low, '\bwhat happened\s+(with|to)\b') OR regexp_matches(low, '{planner._RESOLVED}') THEN 'active,resolved' END AS statuses,
CASE WHEN intent = 'count' THEN 650 END AS lexical_limit, CASE WHEN intent IN ('count', 'time_anchored') THEN 60 END AS rerank_limit, array_to_string(list_filter(k, lambda x, n: list_position(k, x) = n)[1:6], ' ') AS lexical_query FROM i"""
)
def recall_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    def plans(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for batch in batches:
            made = [planner.recall_plan(t.strip()) for t in batch.text]
            yield pd.DataFrame({
                "qid": batch.qid, "intent": [p.temporal_intent for p in made], "statuses": [",".join(sorted(p.statuses)) if p.statuses else None for p in made],
                "lexical_limit": pd.array([p.lexical_limit for p in made], "Int64"), "rerank_limit": pd.array([p.rerank_limit for p in made], "Int64"), "lexical_query": [" ".join(p.lexical_queries) for p in made],
            })

    return _texts(spark, sf_dir).mapInPandas(plans, "qid long, intent string, statuses string, lexical_limit long, rerank_limit long, lexical_query string")


@query()
def search_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All branches of the benchmark's items. Without SQL: tests/test_search.py has what must hold for them."""
    return search.branches(_benchmark(spark, sf_dir), search.Options()).select("qid", "branch", "kind", "weight", "text", "intent")


# G15, G19, F9, H8-H12 ----------------------------------------------------------------------------------------------------


@query(f"WITH {_LEX}, t AS (SELECT sr.qid, max(CASE WHEN rank = 1 THEN score END) AS top, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS nxt, any_value(len(tk)) AS n, count(*) AS hits FROM sr JOIN qa ON qa.qid = sr.qid WHERE rank <= 20 GROUP BY ALL) SELECT qid, hits, (n <= 12 AND top >= 0.10 AND top - nxt >= 0.05 AND hits >= 8) OR hits >= greatest(8, least(10, qid % 30, 24)) AS skip FROM t")
def semantic_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether vectors can be left out of a search for ten results below a path (scopes of up to 29 chunks)."""
    hits = _lexical_hits(spark, sf_dir)
    strong = fusion.strong_signal(hits.join(_benchmark(spark, sf_dir).select("qid", F.size(X.tokens(F.col("text"))).alias("n")), "qid"), F.col("n")).select("qid", "strong")
    rows = hits.groupBy("qid").agg(F.count("*").alias("hits")).join(strong, "qid")
    return rows.select("qid", "hits", fusion.skip_semantic(F.col("strong"), F.col("hits"), 10, F.col("qid") % 30).alias("skip"))


@query(
    f"""WITH b AS (SELECT qid, unnest([0, 1, 2, 3]) AS branch, text FROM (SELECT item_id AS qid, text FROM benchmark)), c AS (SELECT *, CASE branch WHEN 0 THEN 'original' WHEN 2 THEN 'semantic' ELSE 'lexical' END AS kind, CASE branch WHEN 0 THEN 2.0 ELSE 1.0 END AS weight, (qid + branch) % 20 AS hits, qid % 4 = 0 AS strong FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY branch) AS used FROM c WHERE NOT strong AND hits < 12 AND CASE WHEN branch = 0 THEN {_BROAD("text")} ELSE kind = 'lexical' END)
SELECT qid, branch, CASE WHEN branch = 0 THEN 40 ELSE 30 END AS document_limit, weight * CASE WHEN branch = 0 THEN 0.45 ELSE 0.60 END AS document_weight FROM o WHERE used <= 2"""
)
def document_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _benchmark(spark, sf_dir).select("qid", "text", F.explode(F.array(*map(F.lit, range(4)))).alias("branch"))
    kind = F.when(F.col("branch") == 0, "original").when(F.col("branch") == 2, "semantic").otherwise("lexical")
    rows = rows.withColumns({"kind": kind, "weight": F.when(F.col("branch") == 0, 2.0).otherwise(1.0), "hits": (F.col("qid") + F.col("branch")) % 20, "strong": F.col("qid") % 4 == 0})
    found = fusion.document_branches(rows, 500, 10)
    return found.select("qid", F.col("branch").cast("long").alias("branch"), F.col("document_limit").cast("long").alias("document_limit"), "document_weight")


_SIGNALS = f"""{_LEX}, {_embedded_cte()}, sg AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.score AS lexical, 1 - b.distance AS semantic FROM (SELECT * FROM sr WHERE rank <= 20) a FULL JOIN (SELECT * FROM sk WHERE rank <= 20) b ON a.qid = b.qid AND a.chunk_id = b.chunk_id),
sp AS (SELECT sg.*, text AS qtext, CASE WHEN chunk_id % 3 = 0 THEN 0.1 + chunk_id % 7 / 100.0 END AS promotion, CASE WHEN semantic IS NOT NULL AND chunk_id % 5 = 0 THEN 0.2 END AS primary_semantic, CASE WHEN lexical IS NOT NULL AND chunk_id % 4 = 0 THEN 0.3 END AS primary_lexical FROM sg JOIN benchmark ON item_id = sg.qid)"""
_TURN = " ".join(f"WHEN {s} IS NOT NULL AND n_{s} <= 4 THEN {i * 4} + n_{s}" for i, s in enumerate(fusion.SIGNALS))
_RANKS = ", ".join(f"row_number() OVER (PARTITION BY qid ORDER BY ({s} IS NULL)::INT, round({s}, 9) DESC, chunk_id) AS n_{s}" for s in fusion.SIGNALS)


@query(
    f"""WITH {_SIGNALS}, r AS (SELECT *, CASE WHEN {_ANCHORED("qtext")} THEN 0.64 ELSE 0.62 END * (coalesce(semantic, 0) + coalesce(primary_semantic, 0)) + CASE WHEN {_ANCHORED("qtext")} THEN 0.35 ELSE 0.33 END * (coalesce(lexical, 0) + coalesce(promotion, 0) + coalesce(primary_lexical, 0)) AS preliminary, {_RANKS} FROM sp),
t AS (SELECT *, CASE {_TURN} END AS turn FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY (turn IS NULL)::INT, turn, round(preliminary, 9) DESC, chunk_id) AS place FROM t) SELECT qid, chunk_id, round(preliminary, 6) AS preliminary FROM p WHERE place <= 18"""
)
def preselected(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex, sem = _lexical_hits(spark, sf_dir).select("qid", "chunk_id", F.col("score").alias("lexical")), _semantic(spark, sf_dir).select("qid", "chunk_id", (1 - F.col("distance")).alias("semantic"))
    c = F.col("chunk_id")
    rows = lex.join(sem, ["qid", "chunk_id"], "full").join(_benchmark(spark, sf_dir).withColumnRenamed("text", "query"), "qid")
    rows = rows.withColumns({"promotion": F.when(c % 3 == 0, 0.1 + c % 7 / 100.0), "primary_semantic": F.when(F.col("semantic").isNotNull() & (c % 5 == 0), 0.2), "primary_lexical": F.when(F.col("lexical").isNotNull() & (c % 4 == 0), 0.3)})
    return fusion.preselected(rows, 4, 18).select("qid", "chunk_id", F.round("preliminary", 6).alias("preliminary"))


_FIRST = lambda t: f"list_filter({words_sql(t)}, lambda w: length(w) >= 4 AND w NOT IN ({_quoted(X.QUERY_STOP_WORDS)}))"
_SIX = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)[1:6]"
_SURE = lambda i: f"greatest(0.2, 1 - 0.08 * ({i} - 1))"


@query(
    rf"""WITH {_FUSED}, b0 AS (SELECT fr.*, doc_id, lang, source, {_FIRST("qtext")} AS qw, {_FIRST("content")} AS cw, CASE WHEN doc_id % 5 = 0 THEN 'superseded' WHEN doc_id % 7 = 0 THEN 'resolved' END AS status, {_AGE} AS age FROM fr JOIN documents ON doc_id = chunk_id),
b1 AS (SELECT *, {_SIX("qw")} AS qt, {_SIX("cw")} AS ct FROM b0),
b2 AS (SELECT *, CASE WHEN len(qt) > 0 THEN 0.01 * least(1.0, list_sum(list_transform(range(1, len(qt) + 1), lambda i: CASE WHEN list_position(ct, qt[i]) > 0 THEN least({_SURE("i")}, {_SURE("list_position(ct, qt[i])")}) ELSE 0.0 END)) / list_sum(list_transform(range(1, len(qt) + 1), lambda i: {_SURE("i")}))) ELSE 0 END AS tag,
CASE WHEN lang IN ('en', 'de') THEN 0.03 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 0.015 ELSE 0 END + CASE WHEN source = 'src' || (qid % 20) THEN 0.01 ELSE 0 END AS schema,
CASE WHEN qid % 4 = 0 THEN least(0.05, 0.05 * exp(-age / 14.0)) WHEN qid % 4 = 1 THEN CASE WHEN status = 'superseded' THEN 0.04 ELSE 0 END WHEN qid % 4 = 2 THEN CASE WHEN {_ANCHORED("content")} THEN 0.025 ELSE 0 END ELSE 0 END AS temporal,
CASE WHEN qid % 2 = 0 AND status IS NOT NULL THEN 0.035 ELSE 0 END AS status_bonus FROM b1)
SELECT qid, chunk_id, round(tag, 6) AS tag, round(schema, 6) AS schema, round(temporal, 6) AS temporal, status_bonus, round(fused + tag + schema + temporal + status_bonus, 6) AS fused FROM b2"""
)
def fused_with_bonuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the bonuses for tags, entities, facets, topics, times and statuses."""
    rows = _fused(spark, sf_dir).drop("fused", "rank", "recency", "anchor").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang"), "chunk_id")
    q, c = F.col("qid"), F.col("chunk_id")
    sure = lambda words: F.transform(words, lambda t, i: F.struct(t.alias("name"), F.greatest(F.lit(0.2), 1 - 0.08 * i).alias("confidence")))
    status = F.when(c % 5 == 0, "superseded").when(c % 7 == 0, "resolved")
    names = F.array(F.concat(F.lit("entity:"), "lang"), F.when(c % 3 == 0, "facet:task").otherwise("facet:goal"), F.concat(F.lit("topic:"), "source"))
    intent = F.when(q % 4 == 0, "most_recent").when(q % 4 == 1, "historical").when(q % 4 == 2, "count").otherwise("any")
    text = F.array(F.lit("en"), F.lit("de"))
    rows = rows.withColumns({
        "tag": fusion.tag_bonus(sure(X.tags(F.col("query"))), sure(X.tags(F.col("content")))), "schema": fusion.schema_bonus(text, F.array(F.lit("task")), F.array(F.concat(F.lit("src"), (q % 20).cast("string"))), names),
        "temporal": fusion.temporal_bonus(intent, F.col("modified_at"), F.to_timestamp(F.lit(NOW)), status, F.col("content")), "status_bonus": F.coalesce(fusion.status_bonus(F.when(q % 2 == 0, F.array(F.lit("superseded"), F.lit("resolved"))).otherwise(F.array().cast("array<string>")), status), F.lit(0.0)),
    }).withColumn("bonus", F.col("tag") + F.col("schema") + F.col("temporal") + F.col("status_bonus"))
    r = lambda n: F.round(n, 6).alias(n)
    return fusion.fused(rows, NOW).select("qid", "chunk_id", r("tag"), r("schema"), r("temporal"), "status_bonus", r("fused"))


# The whole search -------------------------------------------------------------------------------------------------------


def _search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    tags = F.transform(X.tags(F.col("text")), lambda t, i: F.struct(t.alias("name"), F.greatest(F.lit(0.2), 1 - 0.08 * i).alias("confidence")))
    status = F.when(F.col("doc_id") % 11 == 0, "superseded").when(F.col("doc_id") % 13 == 0, "active")
    return rows.select(F.col("doc_id").alias("chunk_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), X.title(F.col("text")).alias("title"), F.col("text").alias("content"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 365 as int))").alias("modified_at"), status.alias("status"), tags.alias("tags"))


@query()
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item by the whole search, with the lines of their best chunk. Without SQL: its parts have theirs; of the whole, only that it runs has been seen."""
    chunks = _search_chunks(spark, sf_dir)
    found = search.search(chunks, _benchmark(spark, sf_dir), search.Options(limit=10, semantic=100, lexical=100, rerank=20), NOW)
    lines = search.with_lines(found, chunks.select("path", F.col("content").alias("text")))
    return lines.select("qid", "rank", "path", "chunk_id", F.col("lines.start").alias("first_line"), F.col("lines.end").alias("last_line"), F.round("fused", 6).alias("fused"), F.round("blended", 6).alias("blended"))
