"""Engine tables: schemas, versions and migrations of earlier layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X

VERSION = 3
TABLES = {
    "documents": "document_id long, path string, title string, modified_at timestamp, checksum string, memory_id string, memory_kind string, memory_status string, created_at timestamp, updated_at timestamp",
    "chunks": "chunk_id long, document_id long, ordinal int, content string, token_count int, memory_kind string, importance double, access_count int, last_accessed_at timestamp, tags array<struct<name:string,confidence:double>>, created_at timestamp",
    "embeddings": "chunk_id long, embedding array<float>, norm double",
    "memories": "id string, kind string, status string, canonical_key string, title string, text string, tags array<string>, facet_tags array<string>, topics array<string>, importance double, confidence double, source string, created_at timestamp, event_at timestamp, updated_at timestamp, supersedes_id string, superseded_by_id string, metadata map<string,string>",
    "contexts": "context_id string, name string, created_at timestamp, updated_at timestamp",
    "context_chunks": "context_id string, chunk_id long, added_at timestamp",
}
#: What the kinds of the first layout became.
OLD_KINDS = {"goal": "commitment", "todo": "commitment", "event": "episode", "preference": "profile", "identity": "profile", "observation": "handoff"}


def create(spark: SparkSession, folder: str) -> None:
    """Empty tables and the version in a new folder."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")
    spark.createDataFrame([(VERSION,)], "version int").write.mode("ignore").parquet(f"{folder}/version")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def new_kind(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in OLD_KINDS.items() for x in pair))
    low = F.lower(F.trim(kind))
    return F.coalesce(known[low], F.when(low.isin("profile", "fact", "decision", "commitment", "episode", "procedure", "handoff"), low), F.lit("fact"))


def migrated_key(kind: Column, text: Column) -> Column:
    """kind:first six words of three letters."""
    return F.concat(kind, F.lit(":"), F.array_join(F.slice(F.filter(X.words(text), lambda w: F.length(w) >= 3), 1, 6), "-"))


def memories_of_version_1(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Memories that the first layout held as documents with a path memory://id."""
    first = chunks.where("ordinal = 0").select("document_id", F.col("content").alias("text"))
    rows = documents.where(F.startswith("path", F.lit("memory://"))).join(first, "document_id")
    kind = new_kind(F.col("memory_kind"))
    return rows.select(F.substring("path", 10, 1 << 20).alias("id"), kind.alias("kind"), F.lit("active").alias("status"), migrated_key(kind, F.col("text")).alias("canonical_key"), "title", "text")
