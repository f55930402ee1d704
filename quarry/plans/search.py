"""The whole search of a batch of queries as one plan: branches, hits, preselection, fusion with bonuses, reranking, protection, order, lines.

Queries become branches in Arrow batches; all branches of all queries are looked up in the same joins. The index
(postings, lengths and vectors of the chunks) may be tables that were written before.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import vector
from quarry.operators import fusion, lexical, store, vectors

from . import planner

BRANCHES = "qid long, branch int, kind string, weight double, text string, query string, intent string, statuses array<string>, entities array<string>, topics array<string>, facets array<string>, key_terms array<string>"


@dataclass(frozen=True)
class Options:
    limit: int = 10
    semantic: int = 500
    lexical: int = 500
    rerank: int = 40
    expansion: int = 5
    tags: bool = True
    protection: int | None = None
    dedupe: bool = True
    today: date | None = None

    @property
    def search_limit(self) -> int:
        """How many rows are searched for, so that enough documents are left."""
        broad = min(400, 6 * self.limit)
        return (min(320, broad) if self.limit >= 50 else broad) if self.dedupe else self.limit


def branches(queries: DataFrame, options: Options, prompt: Callable[[str], str] | None = None) -> DataFrame:
    """BRANCHES of queries (qid, text): branch 0 is the query itself, then the plan's and the expansion's. prompt: applied to the texts first, such as a lemmatizer."""
    expand, today, base = options.expansion, options.today, options.lexical

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for qid, text in zip(batch.qid, batch.text):
                query = (text or "").strip()
                if not query:
                    continue
                about, recall = planner.analysis(query), planner.recall_plan(query, base)
                shared = (query, recall.temporal_intent, sorted(recall.statuses) if recall.statuses else None, [e["normalized_value"] for e in about.entities], about.topics[:10], sorted(about.facets)[:6], about.key_terms)
                for i, b in enumerate(planner.branches(query, recall, expand, expand > 0, today, about)):
                    rows.append((qid, i, b.kind, b.weight, prompt(b.text) if prompt else b.text, *shared))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in BRANCHES.split(", ")])

    return queries.select(F.col("qid").cast("long").alias("qid"), "text").mapInPandas(plan, BRANCHES)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir (a temporary one only if none is set, as in tests): what follows is planned and run without what came before."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quarry-"))
    return df.checkpoint()


def _accumulated(hits: list[DataFrame], name: str) -> DataFrame:
    """Sums of rrf() over several lists of hits (qid, chunk_id, rank, weight)."""
    rows = hits[0]
    for more in hits[1:]:
        rows = rows.unionByName(more)
    return fusion.rrf(rows, F.col("weight")).withColumnRenamed("score", name)


def tag_hits(chunks: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """qid, chunk_id, rank of chunks by the sum of confidences of their tags among the names (qid, name)."""
    tags = chunks.select("chunk_id", F.explode("tags").alias("t")).select("chunk_id", F.col("t.name").alias("name"), F.coalesce("t.confidence", F.lit(0.6)).alias("c"))
    scores = tags.join(names.distinct(), "name").groupBy("qid", "chunk_id").agg(F.sum("c").alias("score"))
    return lexical.ranked(scores, limit).select("qid", "chunk_id", "rank")


def search(chunks: DataFrame, queries: DataFrame, options: Options, now: str, index: lexical.Index | None = None, embedded: DataFrame | None = None, embed: Callable[[Column], Column] = vector.hashed_embedding, rerank: Callable[[Column, Column, Column], Column] | None = fusion.overlap_rerank) -> DataFrame:
    """Ranked documents of each query: qid, rank, path, chunk_id, title, content, semantic, lexical, fused, blended.

    chunks: chunk_id, path, title, content, modified_at, status (of a memory, else null), tags (name, confidence).
    queries: qid, text. index and embedded (vec_id, embedding) are made of the chunks if not given.
    """
    index = index or lexical.index(chunks)
    embedded = chunks.select(F.col("chunk_id").alias("vec_id"), embed(F.col("content")).alias("embedding")) if embedded is None else embedded
    wanted = cut(branches(queries, options))  # a few rows of each query, read by every lookup
    first = wanted.where("branch = 0")
    bid = (F.col("qid") * 16 + F.col("branch")).alias("qid")
    of = lambda hits: hits.withColumn("branch", (F.col("qid") % 16).cast("int")).withColumn("qid", F.expr("qid div 16")).join(wanted.select("qid", "branch", "kind", "weight", "text", "query"), ["qid", "branch"])
    lists: list[DataFrame] = []
    hits_of = lambda h: h.select("qid", "chunk_id", "rank", "weight")
    found = cut(of(lexical.search(index, wanted.where("kind NOT IN ('semantic', 'hypothetical_document')").select(bid, "text"), options.lexical))) if options.lexical else None
    near = None
    if options.semantic:
        asked = wanted.where("kind <> 'lexical'").select(bid, embed(F.col("text")).alias("embedding"))
        near = cut(of(vectors.knn(embedded, asked, options.semantic).select("qid", F.col("vec_id").alias("chunk_id"), "rank")))
    if found is not None:
        lists.append(hits_of(found))
        names = first.select("qid", F.posexplode("entities").alias("i", "text"))
        entity = lexical.search(index, names.select((F.col("qid") * 16 + F.col("i")).alias("qid"), "text"), max(1, options.lexical // 2))
        lists.append(hits_of(entity.withColumn("qid", F.expr("qid div 16")).withColumn("weight", F.lit(0.5))))
        if options.tags:
            kinds = (("entities", "entity", 0.60), ("topics", "topic", 0.35), ("facets", "facet", 0.25))
            named = lambda i, kind: lambda n: F.struct(F.lit(i).alias("kind"), F.concat(F.lit(kind + ":"), n).alias("name"))
            names = F.flatten(F.array(*(F.transform(F.coalesce(column, F.array().cast("array<string>")), named(i, kind)) for i, (column, kind, _) in enumerate(kinds))))
            tagged = first.select("qid", F.explode(names).alias("n")).select((F.col("qid") * 4 + F.col("n.kind")).alias("qid"), "n.name")
            weight = F.element_at(F.array(*(F.lit(w) for _, _, w in kinds)), (F.col("qid") % 4 + 1).cast("int"))
            # the tags are made of all texts, once for the three kinds
            lists.append(hits_of(tag_hits(chunks, tagged, max(8, options.lexical // 2)).withColumn("weight", weight).withColumn("qid", F.expr("qid div 4"))))
        strong = fusion.strong_signal(found.where("branch = 0"), F.size(X.tokens(F.col("text")))).select("qid", "strong")
        counts = wanted.join(found.groupBy("qid", "branch").agg(F.count("*").alias("hits")), ["qid", "branch"], "left").join(strong, "qid", "left").na.fill({"hits": 0, "strong": False})
        open_ = fusion.document_branches(counts, options.lexical, options.search_limit)
        documents = lexical.document_search(index, open_.select(bid, "text"), chunks, 96)
        documents = of(documents.select("qid", "chunk_id", "score", "rank")).join(open_.select("qid", "branch", "document_limit", "document_weight"), ["qid", "branch"]).where("rank <= document_limit")
        by_document = fusion.scored_rrf(documents, F.col("document_weight")).withColumnRenamed("score", "by_document")
    # signals of each candidate
    none = lambda: chunks.limit(0).select(F.lit(0).cast("long").alias("qid"), "chunk_id", F.lit(0.0).alias("score"))
    signals: dict[str, DataFrame] = {
        "semantic": _accumulated([hits_of(near)], "score") if near is not None else none(),
        "lexical": _accumulated(lists, "lexical").join(by_document, ["qid", "chunk_id"], "full").select("qid", "chunk_id", (F.coalesce("lexical", F.lit(0.0)) + F.coalesce("by_document", F.lit(0.0))).alias("score")) if lists else none(),
        "promotion": fusion.promotion(found.where("branch > 0 AND kind = 'lexical'").withColumn("primary", F.col("query")), F.col("weight")) if found is not None else none(),
    }
    for name, hits, semantic in (("primary_semantic", near, True), ("primary_lexical", found, False)):
        signals[name] = fusion.preservation(hits.where("branch = 0"), fusion.preservation_base(F.col("query"), semantic), 2.0) if hits is not None and options.expansion else none()
    rows = None
    for name, scores in signals.items():
        one = scores.select("qid", "chunk_id", F.lit(name).alias("signal"), "score")
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.groupBy("qid", "chunk_id").pivot("signal", list(signals)).agg(F.sum("score")).where("semantic IS NOT NULL OR lexical IS NOT NULL")
    rows = cut(rows)
    rows = rows.join(first.select("qid", "query", "intent", "statuses", "entities", "topics", "facets", "key_terms"), "qid")
    pool = planner.pool_limit(options.search_limit, options.rerank)
    hydrated = fusion.hydration_limit(options.search_limit, options.rerank, pool)
    rows = fusion.preselected(rows, fusion.protection_limit(options.search_limit, hydrated), hydrated).join(chunks, "chunk_id")
    # fusion
    tags = F.coalesce("tags", F.array().cast("array<struct<name:string,confidence:double>>"))
    asked_tags = F.transform("key_terms", lambda t, i: F.struct(t.alias("name"), F.greatest(F.lit(0.2), 1 - 0.08 * i).alias("confidence")))
    bonus = {
        "tag": fusion.tag_bonus(asked_tags, tags) if options.tags else F.lit(0.0),
        "schema": fusion.schema_bonus(F.col("entities"), F.col("facets"), F.col("topics"), F.transform(tags, lambda t: t["name"])),
        "temporal": fusion.temporal_bonus(F.col("intent"), F.col("modified_at"), F.to_timestamp(F.lit(now)), F.col("status"), F.col("content")),
        "status_bonus": F.coalesce(fusion.status_bonus(F.col("statuses"), F.col("status")), F.lit(0.0)),
    }
    rows = rows.withColumns(bonus).withColumn("bonus", F.col("tag") + F.col("schema") + F.col("temporal") + F.col("status_bonus"))
    zero = lambda *names: sum((F.coalesce(n, F.lit(0.0)) for n in names), F.lit(0.0))
    rows = rows.withColumns({"lexical": zero("lexical", "promotion", "primary_lexical"), "semantic": zero("semantic", "primary_semantic"), "primary": zero("primary_semantic", "primary_lexical")})
    ranked = fusion.by_rank(fusion.fused(rows, now), "fused", pool)
    score = rerank(F.col("query"), F.col("title"), F.col("content")) if rerank and options.rerank else F.lit(None).cast("double")
    ranked = fusion.blended(ranked.withColumn("rerank", F.when(F.col("rank") <= options.rerank, score)), options.rerank)
    ranked = cut(ranked)
    # order
    limit = options.search_limit
    if options.expansion:
        kept = fusion.protected(ranked, limit, options.protection).select("qid", "chunk_id", F.col("final_rank").alias("place"))
        ranked = ranked.join(kept, ["qid", "chunk_id"]).withColumn("final_rank", F.col("place"))
    else:
        ranked = ranked.where(F.col("final_rank") <= limit)
    ranked = ranked.where(F.col("status").isNull() | (F.col("status") == "active") | F.coalesce(F.array_contains("statuses", F.col("status")), F.lit(False)))
    if not options.dedupe:
        return ranked.where(F.col("final_rank") <= options.limit).select("qid", F.col("final_rank").alias("rank"), "path", "chunk_id", "title", "content", "semantic", "lexical", "fused", "blended")
    single = fusion.one_per_document(ranked.withColumn("doc", X.comparison_key(F.col("path"))), "doc", "final_rank").withColumn("final_rank", F.col("doc_rank"))
    single = single.withColumn("support", fusion.support(F.col("lexical"), F.col("semantic"), F.col("bonus"), F.col("doc_rank")))
    order = fusion.multi_evidence(single, options.limit).select("qid", "chunk_id", F.col("new_rank").alias("rank"))
    return single.drop("rank").join(order, ["qid", "chunk_id"]).where(F.col("rank") <= options.limit).select("qid", "rank", "path", "chunk_id", "title", "content", "semantic", "lexical", "fused", "blended")


def with_lines(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Search results with first and last line of the chunk in its document (path, text)."""
    rows = found.join(documents.select("path", F.col("text").alias("_text")), "path", "left")
    return rows.withColumn("lines", store.line_range(F.col("_text"), F.col("content"), X.snippet(F.col("content"), F.lit("")))).drop("_text")
