"""Readers: document trees, JSON lines, .npy vectors; writers of reports."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKDOWN = ["mdx", "markdown", "md"]
EXTENSIONS = sorted([*MARKDOWN, *"zsh yaml yml txt tsx ts toml text swift sql sh scala rst rs rb py php org mm m kt jsx json js java hpp h go css cs cpp c bash".split()])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def document_kind(path: Column) -> Column:
    from quarry.functions.chunking import CODE

    return F.when(extension(path).isin(MARKDOWN), "markdown").when(extension(path).isin(CODE), "code").otherwise("plain_text")


def documents(spark: SparkSession, roots: list[str], hidden: bool = False, extensions: list[str] | None = None, symlinks: bool = False) -> DataFrame:
    """path, title, text, kind, modified_at, checksum of the supported files below the roots, each once, by path; a missing root is an error.

    Hidden files and those in hidden folders are left out, as are symbolic links on a local file system.
    """
    from quarry.functions import text as X

    roots = list(dict.fromkeys(r.rstrip("/") or "/" for r in roots))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = files.select(path.alias("path"), F.col("modificationTime").alias("modified_at"), F.col("content").cast("string").alias("text")).where(extension(F.col("path")).isin(extensions or EXTENSIONS))
    if not hidden:
        rows = rows.where(~F.col("path").rlike(r"/\.[^/]"))
    if not symlinks:
        rows = rows.where(~_is_link(F.col("path"), F.array(*(F.lit(r) for r in roots))))
    return rows.dropDuplicates(["path"]).withColumns({"title": X.title(F.col("text")), "kind": document_kind(F.col("path")), "checksum": X.checksum(F.col("text"))}).orderBy("path")


@F.pandas_udf(T.BooleanType())
def _is_link(paths: pd.Series, roots: pd.Series) -> pd.Series:
    """Whether a local file or a folder between it and its root is a symbolic link."""
    import os

    known: dict[str, bool] = {}

    def linked(path: str, below: list[str]) -> bool:
        if path in below or "/" not in path.strip("/") or "://" in path:
            return False
        if path not in known:
            known[path] = os.path.islink(path) or linked(path.rpartition("/")[0], below)
        return known[path]

    return pd.Series([linked(p, list(r)) for p, r in zip(paths, roots)])


#: File endings by kind, for documents that a dataset holds as text.
KIND_EXTENSIONS = {"markdown": "md", "md": "md", "code": "swift", "plaintext": "txt", "plain_text": "txt", "text": "txt"}


def materialized_path(id_: Column, kind: Column, relative_path: Column) -> Column:
    """Where a dataset's document goes below the folder of documents: its relative path with a supported ending, else its id with the ending of its kind (md without one)."""
    from quarry.functions import text as X

    ending = F.coalesce(F.create_map(*(F.lit(x) for pair in KIND_EXTENSIONS.items() for x in pair))[F.lower(F.trim(kind))], F.lit("md"))
    given = F.trim(relative_path)
    own = F.lower(F.regexp_extract(given, r"\.([^./]+)$", 1))
    named = F.when(own.isin(EXTENSIONS), given).when(own == "", F.concat(given, F.lit("."), ending)).otherwise(F.concat(F.regexp_replace(given, r"\.[^./]+$", "."), ending))
    return F.when(F.coalesce(given, F.lit("")) != "", named).otherwise(F.concat(X.safe_filename(id_), F.lit("."), ending))


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, required: list[str] = ()) -> DataFrame:
    """Rows of a JSON lines file; blank lines and those that begin with '#' are skipped, a bad or incomplete one is an error with its line number.

    Lines are numbered by file and byte order: a file is read by one task if it has a line to complain about, never before.
    """
    lines = spark.read.text(path).where(~F.trim("value").rlike("^(#|$)"))
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    parsed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.from_json("value", T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"}).alias("row"))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    for name in required:
        bad = bad | F.col(f"row.{name}").isNull()
    wrong = parsed.where(bad).select("file", "value").first()
    if wrong:
        whole = spark.read.option("wholetext", True).text(wrong.file).first().value
        number = next((i for i, line in enumerate(whole.splitlines(), 1) if line == wrong.value), 0)
        raise ValueError(f"{wrong.file}, line {number}: bad or incomplete row: {wrong.value[:200]}")
    return parsed.select(*(F.col(f"row.{f.name}").alias(f.name) for f in kind.fields))


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """file, rowid, embedding of two-dimensional float32 .npy files; a file is read by one task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files.path, files.content):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                if array.dtype != np.float32 or array.ndim != 2:
                    raise ValueError(f"{name}: not a matrix of float32")
                for at in range(0, len(array), 4096):
                    part = array[at : at + 4096]
                    yield pd.DataFrame({"file": name, "rowid": range(at, at + len(part)), "embedding": list(part)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(read, "file string, rowid long, embedding array<float>")


def report(rows: DataFrame, json_path: str | None = None) -> str:
    """A small result as Markdown; also as sorted JSON at json_path."""
    data = [r.asDict(recursive=True) for r in rows.collect()]
    if json_path:
        with open(json_path, "w") as out:
            json.dump(data, out, sort_keys=True, indent=2, default=str)
    head = "| " + " | ".join(rows.columns) + " |\n|" + "-|" * len(rows.columns)
    return head + "".join("\n| " + " | ".join(str(r[c]) for c in rows.columns) + " |" for r in data)
