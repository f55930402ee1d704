"""Tables of documents, chunks and memories: upserts, scopes, listings, lookups. A changed table is a new DataFrame to be written elsewhere."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X

ORDERS: dict[str, list[tuple[str, bool]]] = {
    "recent": [("created_at", True), ("id", True)],
    "importance": [("importance", True), ("created_at", True), ("id", True)],
    "most_accessed": [("access_count", True), ("last_accessed_at", True), ("created_at", True), ("id", True)],
}


def corpus(documents: DataFrame) -> DataFrame:
    """Documents of the sample tables as chunks: chunk_id, path, title, content, source."""
    return documents.select(F.col("doc_id").alias("chunk_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), X.title(F.col("text")).alias("title"), F.col("text").alias("content"), "source")


def listed(rows: DataFrame, order: str, limit: int, kinds: Iterable[str] | None = None, statuses: Iterable[str] | None = None) -> DataFrame:
    """The first rows in one of ORDERS. kinds and statuses: None means all, an empty set none."""
    rows = of_kind(rows, kinds, statuses)
    if order == "most_accessed":
        rows = rows.withColumns({"access_count": F.coalesce("access_count", F.lit(0)), "last_accessed_at": F.coalesce("last_accessed_at", F.timestamp_seconds(F.lit(0)))})
    return rows.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in ORDERS[order])).limit(limit)


def of_kind(rows: DataFrame, kinds: Iterable[str] | None = None, statuses: Iterable[str] | None = None) -> DataFrame:
    for column, values in (("kind", kinds), ("status", statuses)):
        if values is not None:
            rows = rows.where(F.col(column).isin(list(values)) if list(values) else F.lit(False))
    return rows


def with_overlap(rows: DataFrame, **wanted: Iterable[str] | None) -> DataFrame:
    """Rows whose array columns share a value with each given list, in comparison form."""
    for column, values in wanted.items():
        if values is not None:
            keys = [X.comparison_key(F.lit(v)) for v in values]
            rows = rows.where(F.arrays_overlap(F.transform(column, X.comparison_key), F.array(*keys)) if keys else F.lit(False))
    return rows


def visible(rows: DataFrame) -> DataFrame:
    """Plain documents and active memories."""
    return rows.where("status IS NULL OR status = 'active'")


def latest(rows: DataFrame, keys: list[str], by: str = "updated_at", tie: str = "id") -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), F.desc(tie)))).where("_n = 1").drop("_n")


def upserted(current: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """current with the rows of changed in place of those with the same key."""
    return current.join(changed.select(key), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def removed(rows: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def in_context(chunks: DataFrame, context_chunks: DataFrame, context_id: str) -> DataFrame:
    return chunks.join(context_chunks.where(F.col("context_id") == context_id).select("chunk_id"), "chunk_id", "left_semi")


def below(chunks: DataFrame, prefix: str) -> DataFrame:
    return chunks.where(X.path_in(F.col("path"), prefix))


def with_documents(memories: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """memories with their document and its first chunk, if there are any."""
    first = chunks.where("ordinal = 0").select("document_id", "chunk_id", "access_count")
    return memories.join(documents.select("memory_id", "document_id", "path"), "memory_id", "left").join(first, "document_id", "left")


def accessed(log: DataFrame) -> DataFrame:
    """access_count and last_accessed_at of each chunk, from the log of accesses (chunk_id, at)."""
    return log.groupBy("chunk_id").agg(F.count("*").alias("access_count"), F.max("at").alias("last_accessed_at"))


def tag_search(chunks: DataFrame, names: Column | list[str], limit: int) -> DataFrame:
    """chunk_id and score of chunks with the tags (array of name and confidence): sum of confidences, .6 where there is none."""
    names = sorted({n.strip().lower() for n in names if n.strip()})
    hits = chunks.select("chunk_id", F.explode("tags").alias("tag")).where(F.col("tag.name").isin(names))
    return hits.groupBy("chunk_id").agg(F.round(F.sum(F.coalesce("tag.confidence", F.lit(0.6))), 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)


# lookups --------------------------------------------------------------------------------------------------------------


def with_overrides(chunks: DataFrame, documents: DataFrame, embeddings: DataFrame | None = None, types: Iterable[str] | None = None) -> DataFrame:
    """Chunks with their document's path and values: a chunk's own memory_type, type_source, type_confidence and memory_kind before the document's; status is active where only a memory_id is known.

    With embeddings (chunk_id, embedding, norm): those that have one. types: allowed memory types, None for all.
    """
    doc = documents.select("document_id", "path", "memory_id", *(F.col(c).alias(f"_{c}") for c in ("memory_type", "type_source", "type_confidence", "memory_kind", "memory_status")))
    rows = chunks.join(doc, "document_id")
    rows = rows.withColumns({c: F.coalesce(c, f"_{c}") for c in ("memory_type", "type_source", "type_confidence", "memory_kind")}).withColumn("memory_status", F.coalesce("_memory_status", F.when(F.col("memory_id").isNotNull(), "active")))
    rows = rows.drop(*(c for c in rows.columns if c.startswith("_")))
    if types is not None:
        rows = rows.where(F.col("memory_type").isin(list(types)) if list(types) else F.lit(False))
    return rows.join(embeddings, "chunk_id") if embeddings is not None else rows


def of_document(chunks: DataFrame, documents: DataFrame, path: str) -> DataFrame:
    """A document's chunks in order."""
    return chunks.join(documents.where(F.col("path") == path).select("document_id", "path"), "document_id").orderBy("ordinal")


def reference_id(reference: Column) -> Column:
    """The id that '#1f' (hexadecimal) or '31' stands for; null for anything else."""
    bare = F.trim(reference)
    return F.when(bare.rlike("^#[0-9a-fA-F]{1,15}$"), F.conv(F.substring(bare, 2, 64), 16, 10).cast("long")).when(bare.rlike("^[0-9]{1,18}$"), bare.cast("long"))


def restricted(rows: DataFrame, scopes: Iterable[DataFrame | None], key: str = "chunk_id") -> DataFrame:
    """Rows that are in all scopes; None restricts nothing."""
    for scope in scopes:
        if scope is not None:
            rows = rows.join(scope.select(key), key, "left_semi")
    return rows


def excluding(rows: DataFrame, ids: DataFrame | None, key: str = "chunk_id") -> DataFrame:
    return rows if ids is None else rows.join(ids.select(key), key, "left_anti")


def context_listing(chunks: DataFrame, members: DataFrame) -> DataFrame:
    """The chunks of each context with their place, the latest additions first."""
    rows = members.select("context_id", "chunk_id", "added_at").join(chunks, "chunk_id")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("context_id").orderBy(F.desc("added_at"), "chunk_id")))


def post_filtered(results: DataFrame, least: float | None = None, root: str | None = None, files_only: bool = False) -> DataFrame:
    """Ranked results (qid, path, blended, rank) of a score and a place; files_only: each path once. Ranks close up."""
    if least is not None:
        results = results.where(F.col("blended") >= least)
    if root is not None:
        results = results.where(X.path_in(F.col("path"), root))
    if files_only:
        results = results.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "path").orderBy("rank"))).where("_n = 1").drop("_n")
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))


def duplicates(memories: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each candidate (cand_id, kind, text) the latest active memory of its kind with the very same text: cand_id, id."""
    newest = F.max(F.struct("updated_at", "id"))
    latest = memories.where("status = 'active'").groupBy("kind", "text").agg(newest.alias("m")).select("kind", "text", F.col("m.updated_at").alias("updated_at"), F.col("m.id").alias("id"))
    return candidates.join(latest, ["kind", "text"]).groupBy("cand_id").agg(newest.alias("m")).select("cand_id", F.col("m.id").alias("id"))


def with_status(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """memories with new statuses (id, status, updated_at); others stay. One pass and one join."""
    new = changes.select("id", F.col("status").alias("_status"), F.col("updated_at").alias("_at"))
    rows = memories.join(new, "id", "left")
    return rows.withColumns({"status": F.coalesce("_status", "status"), "updated_at": F.coalesce("_at", "updated_at")}).select(memories.columns)


def resolved_paths(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, path, n: which document each name means. The same path; else the first with the same comparison key; else the one whose end it is. n counts the documents that end so; path is null if several do, or none."""
    names = wanted.select("name", F.trim("name").alias("bare")).where("bare <> ''").distinct()
    paths = documents.select("path").distinct()
    exact = names.join(paths, names.bare == paths.path).select("name", "path")
    keyed = names.withColumn("k", X.comparison_key(F.col("bare"))).join(paths.withColumn("k", X.comparison_key(F.col("path"))), "k").groupBy("name").agg(F.min("path").alias("by_key"))
    parts = F.split(F.regexp_replace("path", r"\\", "/"), "/")
    tails = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.lit(1 << 20)), "/"))).alias("tail"))
    ended = names.withColumn("tail", F.regexp_replace(F.regexp_replace("bare", r"\\", "/"), "^(\\./|/)+", "")).join(tails, "tail").groupBy("name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("by_end"))
    rows = names.select("name").join(exact, "name", "left").join(keyed, "name", "left").join(ended, "name", "left")
    return rows.select("name", F.coalesce("path", "by_key", F.when(F.col("n") == 1, F.col("by_end"))).alias("path"), F.coalesce("n", F.lit(0)).alias("n"))


def line_range(document: Column, chunk: Column, snippet: Column) -> Column:
    """Struct of the first and last line of a chunk in its document: of the chunk, its first 180 characters or the snippet, as they are or folded, whichever is found first; shorter than 8 characters none is. Null if none is found."""
    plain = lambda c: F.regexp_replace(c, r"\r\n?", "\n")
    own = plain(document)
    whole = X.stripped(plain(chunk))
    out = F.lit(None).cast("struct<start:int,end:int>")
    for c in reversed([whole, F.substring(whole, 1, 180), X.stripped(plain(snippet))]):
        for text, piece in ((X.fold(own), X.fold(c)), (own, c)):
            at = F.instr(text, piece)
            line = lambda end: F.size(F.split(F.substring(own, F.lit(1), end), "\n"))
            out = F.when((F.length(c) >= 8) & (at > 0), F.struct(line(at - 1).alias("start"), line(at + F.length(c) - 2).alias("end"))).otherwise(out)
    return out
