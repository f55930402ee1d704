"""Vector tables: declared columns, checks, filtered nearest neighbours, point lookups, changes.

A declaration is a list of definitions as in "embedding float[384] distance_metric=cosine", "user_id integer partition key",
"id integer primary key", "+body text" (auxiliary: returned, never filtered), "genre text" (metadata: may be filtered),
"chunk_size=1024". Rows are a DataFrame with those columns; a changed table is a new DataFrame to be written elsewhere,
partitioned by its partition keys, so that their predicates prune files.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import vector

from . import vectors

MOST = {"vector": 16, "partition": 4, "auxiliary": 16, "metadata": 16}
MOST_DIMS, MOST_CHUNK, MOST_K = 8192, 4096, 4096
_TYPES = {"integer": "long", "int": "long", "text": "string", "float": "double", "double": "double", "boolean": "boolean", "bool": "boolean", "blob": "binary"}
_OPS = {"=": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


@dataclass(frozen=True)
class VectorColumn:
    name: str
    element: str
    dims: int
    metric: str

    @property
    def type(self) -> str:
        return {"float32": "array<float>", "int8": "array<int>", "bit": "array<int>"}[self.element]


@dataclass(frozen=True)
class Declaration:
    vectors: dict[str, VectorColumn]
    partition: dict[str, str] = field(default_factory=dict)
    auxiliary: dict[str, str] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)
    key: tuple[str, str] = ("rowid", "long")
    chunk_size: int = 1024

    def schema(self) -> str:
        columns = {self.key[0]: self.key[1]} | self.partition | {v.name: v.type for v in self.vectors.values()} | self.metadata | self.auxiliary
        return ", ".join(f"`{n}` {t}" for n, t in columns.items())


def declared(*definitions: str) -> Declaration:
    """Read the definitions; what breaks a rule is an error."""
    vectors_, partition, auxiliary, metadata, key, chunk = {}, {}, {}, {}, ("rowid", "long"), 1024
    for text in map(str.strip, definitions):
        if m := re.fullmatch(r"(\w+)\s*=\s*(\w+)", text):
            if m[1] != "chunk_size" or not m[2].isdigit():
                raise ValueError(f"unknown option: {text}")
            chunk = int(m[2])
            if not 0 < chunk <= MOST_CHUNK or chunk % 8:
                raise ValueError(f"chunk_size must be a multiple of 8 up to {MOST_CHUNK}")
        elif m := re.fullmatch(r"(?i)(\w+)\s+(float|f32|int8|i8|bit)\s*\[\s*(\d+)\s*\](?:\s+distance_metric\s*=\s*(\w+))?", text):
            element = {"f": "float32", "i": "int8", "b": "bit"}[m[2][0].lower()]
            metric = (m[4] or ("hamming" if element == "bit" else "l2")).lower()
            if not 0 < int(m[3]) <= MOST_DIMS or element == "bit" and int(m[3]) % 8:
                raise ValueError(f"bad number of dimensions: {text}")
            if metric not in (("hamming",) if element == "bit" else ("l2", "l1", "cosine")):
                raise ValueError(f"unknown metric: {text}")
            vectors_[m[1]] = VectorColumn(m[1], element, int(m[3]), metric)
        elif m := re.fullmatch(r"(?i)(\w+)\s+(integer|int|text)\s+(partition|primary)\s+key", text):
            if m[3].lower() == "primary":
                key = (m[1], _TYPES[m[2].lower()])
            else:
                partition[m[1]] = _TYPES[m[2].lower()]
        elif m := re.fullmatch(r"(?i)(\+?)\s*(\w+)\s+(integer|int|text|float|double|boolean|bool|blob)", text):
            if not m[1] and m[3].lower() == "blob":
                raise ValueError(f"metadata can't be a blob: {text}")
            (auxiliary if m[1] else metadata)[m[2]] = _TYPES[m[3].lower()]
        else:
            raise ValueError(f"can't read the definition: {text}")
    for what, found in (("vector", vectors_), ("partition", partition), ("auxiliary", auxiliary), ("metadata", metadata)):
        if len(found) > MOST[what]:
            raise ValueError(f"more than {MOST[what]} {what} columns")
    if not vectors_:
        raise ValueError("at least one vector column is needed")
    return Declaration(vectors_, partition, auxiliary, metadata, key, chunk)


def checked(of: Declaration, rows: DataFrame) -> DataFrame:
    """The declared columns of rows, cast; a vector of another size is an error when it is read, a missing column is null."""
    out = []
    for name, type_ in ({of.key[0]: of.key[1]} | of.partition | {v.name: v.type for v in of.vectors.values()} | of.metadata | of.auxiliary).items():
        c = F.col(name).cast(type_) if name in rows.columns else F.lit(None).cast(type_)
        if name in of.vectors:
            dims = of.vectors[name].dims
            wrong = F.raise_error(F.concat(F.lit(f"{name}: expected {dims} dimensions, found "), F.coalesce(F.size(c).cast("string"), F.lit("none")))).cast(type_)
            c = F.when(F.size(c) == dims, c).otherwise(wrong)
        out.append(c.alias(name))
    return rows.select(*out)


def inserted(of: Declaration, table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with rows; a key that is there already keeps its old row."""
    return table.unionByName(checked(of, rows).dropDuplicates([of.key[0]]).join(table.select(of.key[0]), of.key[0], "left_anti"))


def deleted(of: Declaration, table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select(of.key[0]), of.key[0], "left_anti")


def updated(of: Declaration, table: DataFrame, changes: DataFrame) -> DataFrame:
    """table with the columns of changes (the key and what changes) in place of the old values. Keys and partition keys can't change."""
    new = [c for c in changes.columns if c != of.key[0]]
    if bad := [c for c in new if c in of.partition or f"`{c}`" not in of.schema()]:
        raise ValueError(f"can't be updated: {', '.join(bad)}")
    both = table.join(changes.select(of.key[0], F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in new)), of.key[0], "left")
    return checked(of, both.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns)))


def point(of: Declaration, table: DataFrame, key: object) -> DataFrame:
    return table.where(F.col(of.key[0]) == F.lit(key))


def scan(of: Declaration, table: DataFrame) -> DataFrame:
    """All rows by partition and key."""
    return table.orderBy(*of.partition, of.key[0])


def predicate(of: Declaration, column: str, op: str, value: object) -> Column:
    """A condition on a partition key or a metadata column; others can't be filtered."""
    if column not in of.partition and column not in of.metadata:
        raise ValueError(f"{column} can't be filtered")
    kind = of.metadata.get(column)
    if op.upper() == "IN":
        if kind not in ("long", "string"):
            raise ValueError(f"IN isn't for {column}")
        return F.col(column).isin(list(value)) if list(value) else F.lit(False)
    if op not in _OPS or kind == "boolean" and op not in ("=", "!="):
        raise ValueError(f"{op} isn't for {column}")
    left, right = F.col(column), F.lit(value)
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def knn(of: Declaration, table: DataFrame, queries: DataFrame, k: int, column: str | None = None, where: list[tuple[str, str, object]] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """qid, key, distance, rank and the other columns of each query's k nearest rows among those that meet all conditions (and are in keys).

    queries: qid, embedding; one of the wrong size is an error.
    """
    name = column or next(iter(of.vectors))
    if name not in of.vectors:
        raise ValueError(f"no vector column {name}")
    if not 0 <= k <= MOST_K:
        raise ValueError(f"k must be from 0 to {MOST_K}")
    spec, rows = of.vectors[name], table
    for condition in where or []:
        rows = rows.where(predicate(of, *condition))
    if keys is not None:
        rows = rows.join(keys.select(of.key[0]), of.key[0], "left_semi")
    wrong = F.raise_error(F.lit(f"queries of {name} need {spec.dims} dimensions")).cast("array<double>")
    asked = queries.select("qid", F.when(F.size("embedding") == spec.dims, vector.doubles(F.col("embedding"))).otherwise(wrong).alias("embedding"))
    if of.key[1] == "long":
        found = vectors.knn(rows.select(F.col(of.key[0]).alias("vec_id"), F.col(name).alias("embedding")), asked, k, spec.metric)
        return found.withColumnRenamed("vec_id", of.key[0]).join(rows, of.key[0])
    numbers = rows.withColumn("_id", F.xxhash64(of.key[0]))  # keys that are texts are named by their hash, ties go by it
    found = vectors.knn(numbers.select(F.col("_id").alias("vec_id"), F.col(name).alias("embedding")), asked, k, spec.metric)
    return found.withColumnRenamed("vec_id", "_id").join(numbers, "_id").drop("_id")
