"""Vector functions on arrays, in double precision; array functions keep them in the JVM."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for vectors of different size or of norm 0."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when((F.size(a) == F.size(b)) & (norms > 0), 1 - dot(a, b) / norms)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def hamming_distance(a: Column, b: Column) -> Column:
    """Of vectors of 0 and 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def part(v: Column, start: int, end: int) -> Column:
    """Elements start to end (exclusive), from 0."""
    if not 0 <= start < end:
        raise ValueError("start must be at least 0 and less than end")
    return F.slice(v, start + 1, end - start)


def normalized(v: Column) -> Column:
    norm = l2_norm(v)
    return F.when(norm > 0, F.transform(doubles(v), lambda x: x / norm)).otherwise(doubles(v))


def quantized_int8(v: Column) -> Column:
    """From [-1, 1] to -128..127, cut towards zero."""
    return F.transform(doubles(v), lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), ((x + 1) / F.lit(2.0 / 255) - 128).cast("int"))))


def quantized_binary(v: Column) -> Column:
    return F.transform(v, lambda x: (x > 0).cast("int"))


def mean_pooled(vectors: Column, dim: int) -> Column:
    """Element-wise mean of an array of vectors."""
    n = F.size(vectors)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.get(doubles(v), i)) / n)


def max_pooled(vectors: Column, dim: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.array_max(F.transform(vectors, lambda v: F.get(doubles(v), i))))


def max_similarity(query: Column, document: Column) -> Column:
    """Late interaction: mean over the query's vectors of the best dot product, mapped from [-1, 1] to [0, 1]."""
    best = F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d))))
    return (F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(query) + 1) / 2


def _embedding() -> object:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, dims in batches:
            dim, out = dims[0].as_py() if len(dims) else 1, []
            for part in words.pieces(texts):
                row, code, distinct = words.split(texts[part])
                bucket = np.fromiter((hashlib.sha256(w.encode()).digest()[0] % dim for w in distinct.to_pylist()), np.int64, len(distinct))
                out.append(np.bincount(row * dim + bucket[code], minlength=(part.stop - part.start) * dim).astype(float))
            counts = np.concatenate(out) if out else np.empty(0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(counts) + 1, dim), pa.int32()), pa.array(counts))

    return embed


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Counts of words by the first byte of their SHA-256: a deterministic stand-in for an embedding model."""
    return _embedding()(text, F.lit(dim))


# constructors and forms ------------------------------------------------------------------------------------------------

VERSION = "v1"


def from_json(text: Column, element: str = "float32") -> Column:
    """A vector from a JSON array: float32, int8 (from -128 to 127) or bit (0 and 1). Null if the text is none or a value doesn't fit."""
    numbers = F.from_json(text, "array<double>")
    whole = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x))
    if element == "float32":
        return F.when((F.size(numbers) > 0) & whole, numbers.cast("array<float>"))
    low, high = (-128, 127) if element == "int8" else (0, 1)
    return F.when((F.size(numbers) > 0) & whole & F.forall(numbers, lambda x: (x == F.floor(x)) & x.between(low, high)), numbers.cast("array<int>"))


def _bytes(blob: Column) -> Column:
    digits = F.hex(blob)
    n = F.length(digits) / 2
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int")))


def from_blob(blob: Column, element: str = "float32") -> Column:
    """A vector from its bytes: little-endian floats, signed bytes, or bits from the lowest of each byte. Null if the size doesn't fit."""
    octets = _bytes(blob)
    if element == "int8":
        return F.transform(octets, lambda b: F.when(b > 127, b - 256).otherwise(b))
    if element == "bit":
        return F.flatten(F.transform(octets, lambda b: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("shiftright", b, i).bitwiseAND(F.lit(1)))))
    words = F.transform(F.sequence(F.lit(0), (F.size(octets) / 4 - 1).cast("int")), lambda i: F.get(octets, 4 * i) + 256 * F.get(octets, 4 * i + 1) + 65_536 * F.get(octets, 4 * i + 2) + F.lit(16_777_216).cast("long") * F.get(octets, 4 * i + 3))

    def number(w: Column) -> Column:
        sign, power, part = F.when(w >= 2_147_483_648, -1.0).otherwise(1.0), F.call_function("shiftright", w, F.lit(23)).bitwiseAND(F.lit(255)), w.bitwiseAND(F.lit(8_388_607))
        value = F.when(power == 0, part * F.lit(2.0**-149)).otherwise((part + 8_388_608) * F.pow(F.lit(2.0), power - 150))
        return (sign * value).cast("float")

    return F.when((F.size(octets) > 0) & (F.size(octets) % 4 == 0), F.transform(words, number))


def _printing() -> object:
    @F.arrow_udf(T.StringType())
    def printed(vectors: pa.Array) -> pa.Array:
        rows = (None if v is None else ",".join("null" if x is None else f"{x:.6f}" for x in v) for v in vectors.to_pylist())
        return pa.array([None if r is None else f"[{r}]" for r in rows], pa.string())

    return printed


def to_json(v: Column) -> Column:
    """A JSON array with six decimals, as numbers of a fixed form; whole numbers as they are. Rounds the exact value, halves to even, as printf does; the JVM's format rounds halves up, and the shortest digits instead of the value."""
    return _printing()(doubles(v))


def whole_to_json(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def kind_of(data_type: str, packed: bool = False) -> str:
    """The element type of a column of vectors, by its Spark type (packed: of bits)."""
    return "bit" if packed else "float32" if "float" in data_type or "double" in data_type else "int8"


def weighted_mean_pooled(vectors: Column, weights: Column, dim: int) -> Column:
    """Element-wise mean of an array of vectors by weights; the plain mean if they sum to 0."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    mean = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.zip_with(vectors, weights, lambda v, w: F.get(doubles(v), i) * w), F.lit(0.0), lambda s, x: s + x) / total)
    return F.when(total > 0, mean).otherwise(mean_pooled(vectors, dim))
