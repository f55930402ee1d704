"""Helpers that the operators of this subpackage share: tokens, hashes, shared storage, stable scans.

Words are maximal runs of Unicode letters and digits of the lower-cased text.
A text that is null counts as empty.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    letters = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return letters, mix(np.arange(1, 0x110001, dtype=np.uint64))


_LETTER: np.ndarray | None = None
_CODE: np.ndarray | None = None
_POWER = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    global _POWER, _INVERSE
    if len(_POWER) < n:
        n = 1 << int(n).bit_length()
        with np.errstate(over="ignore"):
            _POWER = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE)])
            _INVERSE = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(pow(int(_BASE), -1, 2**64)))])
    return _POWER, _INVERSE


class Tokens(NamedTuple):
    """Words of several texts: hash, first and last character (exclusive, in the lower-cased text) of each, and each text's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def spans(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings from starts to ends: polynomials in the code points, cut out of prefix sums."""
    global _LETTER, _CODE
    if _LETTER is None:
        _LETTER, _CODE = _tables()
    power, inverse = _powers(len(points) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_CODE[points] * power[: len(points)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts])


def tokenize(texts: list[str | None]) -> Tokens:
    """words() of each text at once, as 64-bit hashes: a word's hash is a polynomial in its code points, cut out of prefix sums."""
    global _LETTER, _CODE
    if _LETTER is None:
        _LETTER, _CODE = _tables()
    lowered = [(t or "").lower() for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    points = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32) if lowered else np.zeros(0, np.uint32)
    firsts = np.r_[0, np.cumsum(lengths)]
    inside = _LETTER[points]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    hashes = spans(points, starts, ends)
    bounds = np.searchsorted(starts, firsts)
    shift = np.repeat(firsts[:-1], np.diff(bounds))
    return Tokens(hashes, starts - shift, ends - shift, bounds)


def grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words of each text, and each text's first window; a text with fewer words has one window, with all of them."""
    counts = np.diff(bounds)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    firsts = np.r_[0, np.cumsum(made)]
    at = np.repeat(bounds[:-1] - firsts[:-1], made) + np.arange(firsts[-1])
    last = np.repeat(bounds[1:], made)
    total = np.zeros(len(at), np.uint64)
    padded = np.r_[hashes, np.zeros(n, np.uint64)]
    with np.errstate(over="ignore"):
        for j in range(n):
            total = total * _BASE + np.where(at + j < last, padded[at + j], np.uint64(0))
    return mix(total), firsts


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only if it is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = jdir.get() if jdir.isDefined() else tempfile.mkdtemp(prefix="quarry-")
        if not jdir.isDefined():
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, removed when Python exits."""
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what is read from it survives the loss of executors, and its lineage is cut. Shuffle files of the write go as soon as it ends."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_NARROW = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}


def is_stable_scan(df: DataFrame) -> bool:
    """Whether df only reads, filters and projects files, so each partition holds the same rows in the same order on every run."""
    plan = df._jdf.queryExecution().optimizedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().split(" ")[0] not in _NARROW and node.getClass().getSimpleName() not in _NARROW or not node.deterministic():
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return bool(df.inputFiles())


def stable(df: DataFrame, name: str) -> DataFrame:
    return df if is_stable_scan(df) else written(df, name)


def doc_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """Identity of a document: rows that agree in doc_id and text are one document, others are not."""
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    return F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(-(2**63))), doc_id.isNull(), text.isNull(), F.coalesce(text, F.lit("")))


def texts(batches: Iterable[pa.RecordBatch], key: str, rows: int = 512) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    """(keys, texts) of small slices, so that Python holds few strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(key).to_numpy(zero_copy_only=False), part.column("text").to_pylist()


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


ROW_BITS = 33
#: Most rows whose bitmap is sent to all tasks (64 MB); beyond it, rows are chosen by a join.
MAX_BITMAP_ROWS = 1 << 29


def fresh(df: DataFrame, name: str) -> str:
    """name, longer if df has a column of that name already (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(df: DataFrame) -> list[Column]:
    """All columns of df, also those with dots in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def numbered(docs: DataFrame, name: str = "rid") -> DataFrame:
    """docs with a column (by default rid) that numbers the rows: partition << 33 | place in the partition. Only for one job: another may cut the files otherwise."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def numbered_table(docs: DataFrame, name: str = "rid") -> DataFrame:
    """The same as a table in the shared folder, so that all jobs read the same numbers, whatever executors there are. In a file they go up by one."""
    return written(numbered(docs, name), "numbered")


def input_bytes(df: DataFrame) -> int:
    """Size of the files that a stable scan reads, as the optimizer knows it (of other plans it knows none)."""
    todo, total = [df._jdf.queryExecution().optimizedPlan()], 0
    while todo:
        node = todo.pop()
        children = node.children()
        if children.size() == 0:
            total += int(str(node.stats().sizeInBytes()))
        todo += [children.apply(i) for i in range(children.size())]
    return total


def bitmaps(rows: DataFrame) -> dict[int, np.ndarray]:
    """The rids in rows as one bitmap for each partition: a bit for every row, so a few MB for millions of rows."""

    def pack(table: pa.Table) -> pa.Table:
        rid = table.column("rid").to_numpy()
        bits = np.zeros(int((rid & ((1 << ROW_BITS) - 1)).max()) + 1, bool)
        bits[rid & ((1 << ROW_BITS) - 1)] = True
        return pa.table({"part": pa.array([int(rid[0]) >> ROW_BITS], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    packed = rows.select("rid", F.shiftright("rid", ROW_BITS).alias("part")).groupBy("part").applyInArrow(pack, "part long, bits binary")
    return {r.part: np.frombuffer(bytes(r.bits), np.uint8) for r in packed.collect()}


def listed(batch: pa.RecordBatch, bits: dict[int, np.ndarray], name: str = "rid") -> np.ndarray:
    """Whether the rid of each row is in the bitmaps."""
    rid = batch.column(name).to_numpy()
    parts, out = rid >> ROW_BITS, np.zeros(len(rid), bool)
    for part in np.unique(parts).tolist():
        packed = bits.get(part)
        if packed is not None:
            mine = np.flatnonzero(parts == part)
            at = rid[mine] & ((1 << ROW_BITS) - 1)
            inside = at < len(packed) * 8
            at = np.where(inside, at, 0)
            out[mine] = inside & ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
    return out


class Chooser:
    """Restricts a numbered scan to the rids of a table: by bitmaps while they are small, else by a semi-join."""

    def __init__(self, scan: DataFrame, rows: DataFrame, n_rows: int) -> None:
        small = n_rows <= MAX_BITMAP_ROWS
        self.df = scan if small else scan.join(rows.select("rid"), "rid", "left_semi")
        self._bits = scan.sparkSession.sparkContext.broadcast(bitmaps(rows)) if small else None

    def __getstate__(self) -> dict:
        return {"_bits": self._bits}

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(listed(batch, self._bits.value))) if self._bits else batch


def without(scan: DataFrame, gone: DataFrame, rid: str = "rid") -> DataFrame:
    """The rows of a numbered_table() but those whose number is in gone's rid; rid is the name of its last column, which is left out."""
    docs = scan.drop(rid)
    names = docs.columns
    if scan.count() > MAX_BITMAP_ROWS:
        return scan.join(gone.select(F.col("rid").alias(rid)), rid, "left_anti").select(*own(docs))
    bits = docs.sparkSession.sparkContext.broadcast(bitmaps(gone))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(~listed(batch, bits.value, rid)))
            yield pa.RecordBatch.from_arrays(kept.columns[: len(names)], names)

    return scan.mapInArrow(rest, docs.schema)
