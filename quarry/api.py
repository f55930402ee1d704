"""The engine as an object: an index of documents and memories in a folder of tables, with search, recall, extraction and ingest.

Every change writes a new generation of the tables it concerns, next to the old one, and then the pointer to it; readers
see either. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import chunking, vector
from quarry.functions import text as X
from quarry.operators import consolidation, extraction, fusion, lexical, schema, store, vectors
from quarry.plans import planner
from quarry.sources import catalog, files


class EngineError(Exception):
    """Base of the engine's errors."""


class ConfigurationError(EngineError):
    pass


class SearchError(EngineError):
    pass


@dataclass(frozen=True)
class Configuration:
    dim: int = 64
    semantic_limit: int = 500
    lexical_limit: int = 500
    chunk_target: int = chunking.TARGET_TOKENS * chunking.CHARS
    chunk_overlap: int = chunking.OVERLAP_TOKENS * chunking.CHARS
    min_confidence: float = 0.55

    def __post_init__(self) -> None:
        if self.dim < 1 or self.chunk_overlap >= self.chunk_target * 3 // 4:
            raise ConfigurationError("dim must be positive and the overlap less than three quarters of the target")


@dataclass
class Engine:
    spark: SparkSession
    folder: str
    configuration: Configuration = field(default_factory=Configuration)

    def __post_init__(self) -> None:
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        self._pointer = Path(self.folder, "current.json")
        if not self._pointer.exists():
            self._commit({})

    # tables ----------------------------------------------------------------------------------------------------

    def _current(self) -> dict[str, str]:
        return json.loads(self._pointer.read_text())

    def _commit(self, tables: dict[str, DataFrame]) -> None:
        now = self._current() if self._pointer.exists() else {}
        for name, df in tables.items():
            now[name] = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(now[name])
        temporary = self._pointer.with_suffix(".new")
        temporary.write_text(json.dumps(now, sort_keys=True))
        temporary.replace(self._pointer)

    def table(self, name: str) -> DataFrame:
        schemas = {
            "documents": "document_id long, path string, title string, kind string, checksum string, modified_at timestamp, memory_id string, memory_kind string, memory_status string, text string",
            "chunks": "chunk_id long, document_id long, path string, title string, ordinal int, content string, modified_at timestamp, status string, tags array<struct<name:string,confidence:double>>",
            "memories": consolidation.MEMORY,
            "contexts": "context_id string, chunk_id long, added_at timestamp",
            "accesses": "chunk_id long, at timestamp",
        }
        path = self._current().get(name)
        return self.spark.read.schema(schemas[name]).parquet(path) if path else self.spark.createDataFrame([], schemas[name])

    # index ------------------------------------------------------------------------------------------------------

    def _payload(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """documents and chunks with ids made of the path, so that unchanged documents keep theirs."""
        docs = documents.withColumn("document_id", F.xxhash64("path"))
        cut = chunking.chunked(docs.select("document_id", "path", "text"), self.configuration.chunk_target, self.configuration.chunk_overlap)
        tags = F.transform(X.tags(F.col("content")), lambda t, i: F.struct(t.alias("name"), F.greatest(F.lit(0.2), 1 - 0.08 * i).alias("confidence")))
        chunks = cut.join(docs.select("document_id", "path", "title", "modified_at", F.col("memory_status").alias("status")), "document_id")
        chunks = chunks.withColumn("chunk_id", F.xxhash64("path", "ordinal")).withColumn("tags", tags)
        names = self.table("chunks").columns
        return docs.select(*self.table("documents").columns), chunks.select(*names)

    @staticmethod
    def _plain(documents: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        return documents.withColumns({"memory_id": none, "memory_kind": none, "memory_status": none})

    def rebuild(self, roots: list[str]) -> int:
        """Index all files below the roots and the stored memories; contexts lose their members. Returns the number of documents."""
        found = self._plain(files.documents(self.spark, roots)).unionByName(self._memory_documents(self.table("memories")), allowMissingColumns=True)
        docs, chunks = self._payload(found)
        self._commit({"documents": docs, "chunks": chunks, "contexts": self.table("contexts").limit(0)})
        return self.table("documents").count()

    def sync(self, documents: DataFrame) -> None:
        """Put documents (path, title, kind, text, modified_at, checksum) in place of those with the same path; unchanged checksums are skipped."""
        old = self.table("documents")
        changed = self._plain(documents).join(old.select("path", "checksum"), ["path", "checksum"], "left_anti")
        docs, chunks = self._payload(changed)
        self._commit({"documents": store.upserted(old, docs), "chunks": store.removed(self.table("chunks"), docs.select("path")).unionByName(chunks)})

    def remove(self, paths: list[str]) -> None:
        gone = self.spark.createDataFrame([(p,) for p in paths], "path string")
        chunks = store.removed(self.table("chunks"), gone)
        members = self.table("contexts").join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("context_id", "chunk_id", "added_at")
        self._commit({"documents": store.removed(self.table("documents"), gone), "chunks": chunks, "contexts": members})

    def paths(self) -> DataFrame:
        return self.table("documents").select("path").orderBy("path")

    # contexts ---------------------------------------------------------------------------------------------------

    def add_to_context(self, name: str, chunk_ids: list[int]) -> None:
        rows = self.spark.createDataFrame([(name, c, datetime.now(UTC).replace(tzinfo=None)) for c in dict.fromkeys(chunk_ids)], "context_id string, chunk_id long, added_at timestamp")
        self._commit({"contexts": self.table("contexts").join(rows.select("context_id", "chunk_id"), ["context_id", "chunk_id"], "left_anti").select("context_id", "chunk_id", "added_at").unionByName(rows)})

    def clear_context(self, name: str) -> None:
        self._commit({"contexts": self.table("contexts").where(F.col("context_id") != name)})

    # search -----------------------------------------------------------------------------------------------------

    def search(self, query: str, limit: int = 20, mode: str = "hybrid", path_prefix: str | None = None, context: str | None = None, statuses: set[str] | None = None, now: str | None = None) -> DataFrame:
        """Ranked documents: path, chunk_id, title, snippet, fused, blended, rank. An empty query has no results."""
        if mode not in planner.MODES:
            raise SearchError(f"unknown mode {mode}")
        chunks = self.table("chunks")
        if path_prefix:
            chunks = store.below(chunks, path_prefix)
        if context:
            chunks = store.in_context(chunks, self.table("contexts"), context)
        plan = planner.recall_plan(query, self.configuration.lexical_limit)
        allowed = statuses or plan.statuses
        chunks = chunks.where(F.col("status").isin(*allowed)) if allowed else store.visible(chunks)
        if not query.strip():
            return chunks.limit(0).select("path", "chunk_id", "title", F.lit("").alias("snippet"), F.lit(0.0).alias("fused"), F.lit(0.0).alias("blended"), F.lit(0).alias("rank"))
        semantic_limit, lexical_limit, rerank, expand = planner.MODES[mode]
        wanted = planner.branches(query, plan, max(expand, 1), expand > 0)
        branches = self.spark.createDataFrame([(i, b.kind, b.weight, b.text) for i, b in enumerate(wanted)], "qid long, kind string, weight double, text string")
        index = lexical.index(chunks)
        hits = lexical.search(index, branches.where("kind IN ('original', 'lexical')"), lexical_limit).join(branches, "qid").select(F.lit(0).cast("long").alias("qid"), "chunk_id", "rank", "weight")
        embed = lambda c: vector.hashed_embedding(F.col(c), self.configuration.dim)
        near = vectors.knn(chunks.select(F.col("chunk_id").alias("vec_id"), embed("content").alias("embedding")), branches.where("kind <> 'lexical'").select("qid", embed("text").alias("embedding")), semantic_limit)
        near = near.join(branches, "qid").select(F.lit(0).cast("long").alias("qid"), F.col("vec_id").alias("chunk_id"), "rank", "weight")
        lex, sem = fusion.rrf(hits, F.col("weight")).withColumnRenamed("score", "lexical"), fusion.rrf(near, F.col("weight")).withColumnRenamed("score", "semantic")
        rows = lex.join(sem, ["qid", "chunk_id"], "full").na.fill(0.0).join(chunks, "chunk_id").withColumn("query", F.lit(query))
        moment = now or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
        ranked = fusion.by_rank(fusion.fused(rows, moment), "fused", planner.pool_limit(limit, rerank))
        ranked = ranked.withColumn("rerank", fusion.overlap_rerank(F.col("query"), F.col("title"), F.col("content")) if rerank else F.lit(None).cast("double"))
        best = fusion.one_per_document(fusion.blended(ranked, rerank), "path", "final_rank").where(F.col("doc_rank") <= limit)
        return best.select("path", "chunk_id", "title", X.snippet(F.col("content"), F.col("query")).alias("snippet"), "fused", "blended", F.col("doc_rank").alias("rank")).orderBy("rank")

    def record_accesses(self, found: DataFrame) -> None:
        rows = found.select("chunk_id", F.current_timestamp().alias("at"))
        self._commit({"accesses": self.table("accesses").unionByName(rows)})

    def get(self, path: str, start: int = 1, end: int = 1 << 30) -> str:
        """Lines of a document: by its path, or by a suffix of it that only one has."""
        docs = self.table("documents").where((F.col("path") == path) | F.endswith("path", F.lit("/" + path.lstrip("/"))))
        rows = docs.select("path", X.line_range(F.col("text"), start, end).alias("text")).limit(3).collect()
        exact = [r for r in rows if r.path == path] or rows
        if len(exact) != 1:
            raise SearchError(f"{len(exact) or 'no'} documents match {path}")
        return exact[0].text

    # memories ---------------------------------------------------------------------------------------------------

    @staticmethod
    def _memory_documents(memories: DataFrame) -> DataFrame:
        return memories.select(
            F.concat(F.lit("memory://"), "id").alias("path"), F.initcap("kind").alias("title"), F.lit("plain_text").alias("kind"), X.checksum(F.col("text")).alias("checksum"), F.to_timestamp(F.lit("2024-01-01")).alias("modified_at"),
            F.col("id").alias("memory_id"), F.col("kind").alias("memory_kind"), F.col("status").alias("memory_status"), "text",
        )

    def extract(self, messages: DataFrame, limit: int = 1000) -> DataFrame:
        """Candidates from messages (conv_id, turn, role, text), with canonical keys."""
        return extraction.described(extraction.candidates(messages, limit))

    def ingest(self, candidates: DataFrame, explicit: bool = False) -> DataFrame:
        """Consolidate candidates with the stored memories; returns the memories after it. Those not saved explicitly must be sure and informative enough."""
        good = candidates if explicit else candidates.where((F.col("confidence") >= self.configuration.min_confidence) & extraction.worth_saving(F.col("segment"), F.col("kind")))
        old = self.table("memories")
        later = old.groupBy("namespace", "kind").agg(F.max("seq").alias("last"))
        new = good.select(F.col("conv_id").cast("long").alias("namespace"), "kind", "status", "canonical_key", F.col("segment").alias("text"), F.row_number().over(Window.partitionBy("conv_id", "kind").orderBy("turn", "seq")).cast("long").alias("n"))
        new = new.join(later, ["namespace", "kind"], "left").withColumn("seq", F.coalesce("last", F.lit(0)) + F.col("n")).drop("n", "last")
        columns = old.columns
        both = old.withColumn("stored", F.lit(True)).unionByName(new.withColumn("stored", F.lit(False)), allowMissingColumns=True)

        def fold(group):  # noqa: ANN001, ANN202
            import pandas as pd

            rows = group.sort_values("seq").astype(object).where(lambda d: d.notna(), None).to_dict("records")
            state = consolidation.State([{c: r[c] for c in columns} for r in rows if r["stored"]])
            for r in rows:
                if not r["stored"]:
                    state.ingest({c: r[c] for c in ("namespace", "kind", "status", "canonical_key", "text", "seq")})
            return pd.DataFrame(state.rows, columns=columns)

        after = both.groupBy("namespace", "kind").applyInPandas(fold, consolidation.MEMORY)
        self._commit({"memories": after})
        stored = self.table("memories")
        docs, chunks = self._payload(self._memory_documents(stored))
        keep = lambda t: t.where(~F.startswith("path", F.lit("memory://")))
        self._commit({"documents": keep(self.table("documents")).unionByName(docs), "chunks": keep(self.table("chunks")).unionByName(chunks)})
        return self.table("memories")

    def save(self, text: str, kind: str, status: str = "active", namespace: int = 0, canonical_key: str | None = None) -> DataFrame:
        """Write one memory as it is."""
        if kind not in extraction.KINDS or status not in extraction.STATUSES:
            raise ConfigurationError(f"unknown kind or status: {kind}, {status}")
        row = self.spark.createDataFrame([(namespace, 0, 0, text.strip(), kind, status, canonical_key, 1.0)], "conv_id long, turn long, seq int, segment string, kind string, status string, canonical_key string, confidence double")
        key = schema.canonical_key(F.col("kind"), F.col("segment"), explicit=F.col("canonical_key"))
        return self.ingest(row.withColumn("canonical_key", key), explicit=True)

    def recall(self, mode: str, query: str | None = None, limit: int = 20, kinds: set[str] | None = None, statuses: set[str] | None = frozenset({"active"})) -> DataFrame:
        """Memories: found by a query (hybrid), or the latest (recent) of the given kinds."""
        memories = store.of_kind(self.table("memories"), kinds, statuses)
        if mode == "hybrid":
            found = self.search(query or "", limit * 4, path_prefix="memory:/", statuses=set(statuses) if statuses else None)
            ids = found.select(F.substring("path", 10, 64).alias("id"), "rank")
            return memories.join(ids, "id").orderBy("rank").limit(limit)
        if mode != "recent":
            raise SearchError(f"unknown mode {mode}")
        return memories.orderBy(F.desc("seq"), F.desc("id")).limit(limit)


def migrate(spark: SparkSession, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Memories of the first table layout in the present one."""
    return catalog.memories_of_version_1(documents, chunks)
