"""Uniform shuffle of documents into shards of exact sizes, by a hypergeometric communication matrix.

How many rows partition p sends to shard s is drawn so that the matrix of counts is distributed as under a uniformly
random permutation of all rows: the rows of the matrix are multivariate hypergeometric, given the shards' sizes. Each
partition permutes its own rows to fill its counts, the rows are exchanged once, and each shard is permuted again.

The matrix is never held as a whole. A binary tree over the partitions splits the shards' capacities between its left
and right half at each node, with a generator seeded by the node; a task walks from the root to its own row.

Defined results
* Shard sizes differ by one row at most, the larger ones first; there may be empty shards if there are fewer rows than
  shards. Repeated rows and rows with nulls are rows like any other; an empty table gives no rows.
* All columns are kept. The new columns are named shard and position; columns of these names in the input are replaced.
* The same seed, files and split sizes give the same result; tasks that run again give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, input_bytes, mix, partition_id, stable

SHARD_BYTES = 128 << 20
MIN_SHARDS = 16
SEED = 20_240_601
_NUMPY_LIMIT = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good items among those drawn. Beyond numpy's range: ratio-of-uniforms rejection (Stadlober 1989) with log-gamma."""
    total = good + bad
    if min(good, drawn) == 0:
        return 0
    if bad == 0:
        return drawn
    if total < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    low, high = max(0, drawn - bad), min(good, drawn)
    p = good / total
    mean, variance = drawn * p, drawn * p * (1 - p) * (total - drawn) / (total - 1)
    mode = min(high, max(low, int((drawn + 1) * (good + 1) / (total + 2))))
    log_f = lambda k: -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(drawn - k + 1) + math.lgamma(bad - drawn + k + 1))
    top, width = log_f(mode), 2 * math.sqrt(2 / math.e) * math.sqrt(variance + 0.5) + (3 - 2 * math.sqrt(3 / math.e))
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u) if u > 0 else -1
        if low <= k <= high and 2 * math.log(u) <= log_f(k) - top:
            return k


def split(rng: np.random.Generator, capacities: np.ndarray, drawn: int) -> np.ndarray:
    """How many of `drawn` random items fall into each shard: one multivariate hypergeometric draw."""
    out, rest = np.zeros(len(capacities), np.int64), int(capacities.sum())
    for s, capacity in enumerate(capacities.tolist()):
        if not drawn:
            break
        rest -= capacity
        out[s] = hypergeometric(rng, capacity, rest, drawn)
        drawn -= int(out[s])
    return out


def matrix_row(sizes: np.ndarray, capacities: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row `part` of the communication matrix of partitions with these sizes and shards with these capacities."""
    before = np.r_[0, np.cumsum(sizes)]
    lo, hi, node = 0, len(sizes), 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(np.random.default_rng([seed, node]), capacities, int(before[mid] - before[lo]))
        if part < mid:
            hi, capacities, node = mid, left, 2 * node
        else:
            lo, capacities, node = mid, capacities - left, 2 * node + 1
    return capacities


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def shuffled(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs with the columns shard (0 to shards - 1) and position (0 up within the shard).

    Without a number of shards, there is one for each 128 MB of the tables read, 16 at least.
    """
    docs = stable(docs.drop("shard", "position"), "unsharded")
    shards = shards or max(MIN_SHARDS, -(-input_bytes(docs) // SHARD_BYTES))
    order = fresh(docs, "_order")
    parts = docs.rdd.getNumPartitions()  # of the scan's plan; no rows are read by way of the RDD
    counted = {r.p: r.n for r in docs.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    sizes = np.array([counted.get(p, 0) for p in range(max(parts, 1))], np.int64)
    capacities = shard_sizes(int(sizes.sum()), shards)

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, labels, keys = partition_id(), 0, None, None
        for batch in batches:
            if labels is None:
                row = matrix_row(sizes, capacities, part, seed)
                labels = np.repeat(np.arange(shards, dtype=np.int32), row)
                np.random.default_rng([seed, part, 7]).shuffle(labels)
                keys = mix(np.arange(len(labels), dtype=np.uint64) + mix(np.array([(part << 33) ^ seed], np.uint64))).view(np.int64)
            n = batch.num_rows
            if at + n > len(labels):
                raise RuntimeError(f"partition {part} has more rows than were counted: its input is not stable")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels[at : at + n]), pa.array(keys[at : at + n])], [*batch.schema.names, "shard", order])
            at += n
        if at != sizes[part]:
            raise RuntimeError(f"partition {part} has {at} rows, {sizes[part]} were counted: its input is not stable")

    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField(order, T.LongType())])
    sent = docs.mapInArrow(permute, schema).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", order)
    # a partition is a shard, so the row's number in it is its position
    return sent.withColumn("position", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop(order)
