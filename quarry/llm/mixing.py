"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a keyed random order and their tokens are cut into blocks of equal size. Slot t of
the schedule takes the golden-ratio point t * phi mod 1, looks it up in the cumulative weights, and so belongs to a
source; the k-th slot of a source takes its k-th block. Every prefix of the schedule is close to the target weights.

The schedule ends when each source has had every block. A source that gets there sooner starts over (a new epoch), so
small sources are repeated and nothing is left out.

Defined results
* A document's tokens are its runs of non-white space; a text that is null or has none gets a single, empty place in a block.
* Rows with a null source are a source of their own, "". Rows without doc_id and repeated rows are documents like any
  other; they are ordered by a hash of doc_id and text, then by row number.
* Default weights are tokens ** 0.7 of each source, in whole numbers; given weights are used for the sources they name,
  and sources without a positive weight are left out. An empty table gives an empty schedule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, numbered, numbered_table, own, stable, written

BLOCK_TOKENS = 2048
ALPHA = 0.7
SEED = "mix-1"
#: 2**32 / golden ratio, odd: slot t has the point (t + 1) * GOLDEN mod 2**32.
GOLDEN = 2_654_435_769
_BUCKETS = 4096
_CHUNK = 1 << 16


def placed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """rid, doc_id, source, n_tokens and first: where the document's tokens begin in the order of its source.

    Prefix sums in two levels, so that no task holds a whole source: sums of hash buckets, then sums within a bucket.
    """
    words = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != ""))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), words.alias("n_tokens"), key.alias("key"))
    rows = written(rows.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")), "tokens")
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = sums.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("key", "rid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", within).join(before, ["source", "bucket"]).select("rid", "doc_id", "source", "n_tokens", (F.col("before") + F.col("within")).alias("first"))


def weights_of(totals: dict[str, int], given: dict[str, float] | None) -> dict[str, int]:
    if given is None:
        return {s: max(1, round(float(t) ** ALPHA)) for s, t in totals.items()}
    least = min((w for w in given.values() if w > 0), default=1)
    return {s: max(1, round(given[s] / least * 1_000_000)) for s in totals if given.get(s, 0) > 0}


class Schedule:
    """Which source has slot t, by the golden-ratio point of t and the sources' cumulative whole-number weights."""

    def __init__(self, weights: dict[str, int]) -> None:
        self.sources = sorted(weights)
        self.ends = np.cumsum([weights[s] for s in self.sources])

    def of(self, slots: np.ndarray) -> np.ndarray:
        points = ((slots.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)) & np.uint64(0xFFFFFFFF)
        return np.searchsorted(self.ends, points.astype(np.float64) / 4294967296.0 * float(self.ends[-1]), "right")

    def length(self, blocks: dict[str, int]) -> int:
        """The first slots by which every source has had its number of blocks."""
        need, left, start, size = np.array([blocks[s] for s in self.sources]), np.zeros(len(self.sources), np.int64), 0, 1 << 20
        while True:
            drawn = self.of(np.arange(start, start + size))
            counts = np.bincount(drawn, minlength=len(need))
            if (left + counts >= need).all():
                last = max((int(np.flatnonzero(drawn == s)[need[s] - left[s] - 1]) for s in np.flatnonzero(need > left)), default=-1)
                return start + last + 1
            left, start = left + counts, start + size


def schedule(placed_docs: DataFrame, block_tokens: int = BLOCK_TOKENS, weights: dict[str, float] | None = None) -> DataFrame | None:
    """slot, source, block and epoch of the whole schedule; None if no document has a place in it."""
    spark = placed_docs.sparkSession
    ends = {r.source: r.t for r in placed_docs.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # a row per source
    chosen = weights_of(ends, weights)
    if not chosen:
        return None
    plan, blocks = Schedule(chosen), {s: max(1, -(-t // block_tokens)) for s, t in ends.items() if s in chosen}
    length, names = plan.length(blocks), plan.sources

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column("id").to_pylist():
                slots = np.arange(chunk * _CHUNK, min((chunk + 1) * _CHUNK, length))
                source = plan.of(slots)
                order = np.argsort(source, kind="stable")
                starts = np.searchsorted(source[order], np.arange(len(names)))
                local = np.empty(len(slots), np.int64)
                local[order] = np.arange(len(slots)) - starts[source[order]]
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.full(len(slots), chunk)), pa.array([names[s] for s in source], pa.string()), pa.array(local)], ["slot", "chunk", "source", "local"])

    slots = spark.range(-(-length // _CHUNK)).mapInArrow(draw, "slot long, chunk long, source string, local long")
    counts = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.col("before") + F.col("local")
    size = F.create_map(*(F.lit(x) for s in names for x in (s, blocks[s])))[F.col("source")]
    return slots.join(before, ["source", "chunk"]).select("slot", "source", F.pmod(rank, size).alias("block"), F.floor(rank / size).alias("epoch"))


def mixed(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, weights: dict[str, float] | None = None) -> DataFrame:
    """The training order as an index: slot, source, block, epoch, doc_id and the tokens token_from to token_to (exclusive) of the document that the slot holds, which begin at token in the block.

    A document longer than a block has a row in each of its blocks; one without tokens has a row with none.
    """
    where = written(placed(numbered(stable(docs.select("doc_id", "text", "source"), "sources"))), "placed")
    plan = schedule(where, block_tokens, weights)
    if plan is None:
        return docs.sparkSession.createDataFrame([], "slot long, source string, block long, epoch long, token long, doc_id long, token_from long, token_to long")
    size = F.lit(block_tokens)
    last = F.greatest(F.col("first") + F.col("n_tokens") - 1, F.col("first"))
    totals = where.groupBy("source").agg(F.max(F.col("first") + F.col("n_tokens")).alias("total"))
    held = where.join(totals, "source")
    # an empty document at the very end of a source belongs to the last block
    most = F.greatest(F.floor((F.col("total") - 1) / size), F.lit(0))
    pieces = held.withColumn("block", F.explode(F.sequence(F.least(F.floor(F.col("first") / size), most), F.least(F.floor(last / size), most))))
    start = F.greatest(F.col("first"), F.col("block") * size)
    end = F.least(F.col("first") + F.col("n_tokens"), (F.col("block") + 1) * size)
    pieces = pieces.select("source", "block", "doc_id", "rid", (start - F.col("block") * size).alias("token"), (start - F.col("first")).alias("token_from"), F.greatest(end - F.col("first"), start - F.col("first")).alias("token_to"))
    return plan.join(pieces, ["source", "block"]).select("slot", "source", "block", "epoch", "token", "doc_id", "token_from", "token_to")


def resampled(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, each as often as the schedule has the block in which it begins; sources without weight are left out."""
    rid = fresh(docs, "rid")
    table = numbered_table(docs, rid)
    where = written(placed(table.select(F.col(rid).alias("rid"), "doc_id", "text", "source")), "placed")
    plan = schedule(where, block_tokens, weights)
    if plan is None:
        return docs.limit(0)
    totals = where.groupBy("source").agg(F.max(F.col("first") + F.col("n_tokens")).alias("total"))
    block = F.least(F.floor(F.col("first") / block_tokens), F.greatest(F.floor((F.col("total") - 1) / block_tokens), F.lit(0)))
    times = where.join(totals, "source").select("rid", F.col("source"), block.alias("block")).join(plan.groupBy("source", "block").agg(F.count("*").alias("times")), ["source", "block"]).select("rid", "times")
    rows = table.select(F.col(rid).alias("rid"), F.struct(*own(docs)).alias("row"))  # apart, so that no name can clash
    return rows.join(times, "rid").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f]+'), lambda x: x <> '')) AS n,
  md5('{SEED}' || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, sum(n) OVER (PARTITION BY source) AS total FROM d),
w AS (SELECT source, any_value(total) AS total, greatest(1, CAST(round(pow(CAST(any_value(total) AS DOUBLE), {ALPHA})) AS BIGINT)) AS weight, greatest(1, CAST(ceil(any_value(total) / {BLOCK_TOKENS}) AS BIGINT)) AS blocks FROM p GROUP BY source),
c AS (SELECT *, sum(weight) OVER (ORDER BY source) AS hi, sum(weight) OVER (ORDER BY source) - weight AS lo, sum(weight) OVER () AS whole FROM w),
bound AS (SELECT CAST(max(ceil(blocks * CAST(whole AS DOUBLE) / weight)) AS BIGINT) * 2 + 1000 AS most FROM c),
s AS (SELECT t AS slot, ((t + 1) * {GOLDEN}) % 4294967296 AS x FROM (SELECT unnest(range(0, most)) AS t FROM bound)),
r AS (SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM s JOIN c ON CAST(x AS DOUBLE) / 4294967296.0 * CAST(whole AS DOUBLE) >= lo AND CAST(x AS DOUBLE) / 4294967296.0 * CAST(whole AS DOUBLE) < hi),
e AS (SELECT max(slot) AS last FROM r WHERE k = blocks - 1),
plan AS (SELECT slot, source, k % blocks AS block, k // blocks AS epoch FROM r, e WHERE slot <= last),
q AS (SELECT *, greatest(CAST((total + {BLOCK_TOKENS} - 1) // {BLOCK_TOKENS} AS BIGINT) - 1, 0) AS most FROM p),
f AS (SELECT *, unnest(range(CAST(least(first // {BLOCK_TOKENS}, most) AS BIGINT), CAST(least(greatest(first + n - 1, first) // {BLOCK_TOKENS}, most) AS BIGINT) + 1)) AS block FROM q)
SELECT slot, plan.source, CAST(plan.block AS BIGINT) AS block, CAST(epoch AS BIGINT) AS epoch, CAST(greatest(first, block * {BLOCK_TOKENS}) - block * {BLOCK_TOKENS} AS BIGINT) AS token, doc_id,
  CAST(greatest(first, block * {BLOCK_TOKENS}) - first AS BIGINT) AS token_from, CAST(greatest(least(first + n, (block + 1) * {BLOCK_TOKENS}) - first, greatest(first, block * {BLOCK_TOKENS}) - first) AS BIGINT) AS token_to
FROM plan JOIN f USING (source, block)"""
