"""Groups of near copies: connected components of the similar pairs, of which one document stays.

Components come from alternating large-star and small-star steps (Kiveris et al. 2014), each a grouping by node of an
edge table in the shared folder; their number grows with the logarithm of a component's size, not with its diameter.

linked() reports the groups: one row per document, with its group and how many documents are similar to it; copies are
counted by their class of equal sets, never expanded into pairs.

Defined results
* linked() has every row of docs, also without doc_id or words; a row that nothing is similar to is a group of its own.
  class_id is the group's least doc_id, null only where no row of it has one. links counts rows: copies of a row with
  the same doc_id are links, too. Ties need no order.
* The row with the least doc_id of a component stays (then the first in the files); rows without doc_id come last.
* Rows equal in n-gram set are one class even if their texts differ in case or punctuation, so one of them stays.
* Rows without words are in no component. Of such rows that are equal in doc_id and text, all stay: nothing tells them
  apart from what the quality rules left in on purpose. All columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, numbered_table, without, written
from .jaccard import GRAMS_SQL, N, THRESHOLD, joined


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on undirected edges u > v, each once."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:  # neighbours above u go to the least of u's neighbourhood
        moved = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its neighbours, all below u, go to the least of them
        moved = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u and v, its component's least node, for every node that is not the least of its component; edges has u > v."""
    edges, state = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        edges = written(_star(written(_star(edges, large=True), "edges"), large=False), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            return edges
        state = now


def one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    rid = fresh(docs, "rid")
    rows = numbered_table(docs, rid)
    members, pairs = joined(docs, n, threshold, rows.select(F.col(rid).alias("rid"), "doc_id", "text"))
    labels = components(pairs.select(F.col("sig_b").alias("u"), F.col("sig_a").alias("v"))).select(F.col("u").alias("sig"), F.col("v").alias("group"))
    grouped = members.join(labels, "sig", "left").select("rid", "doc_id", F.coalesce("group", "sig").alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "rid")
    first = grouped.groupBy("group").agg(F.min(order).alias("first"))
    gone = written(grouped.join(first, "group").where(F.col("rid") != F.col("first.rid")).select("rid"), "gone")
    return without(rows, gone, rid)


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of the documents that it is linked to, directly or by others) and links (how many other documents are at or above the threshold with it)."""
    rows = numbered_table(docs.select("doc_id", "text"))
    members, pairs = joined(docs, n, threshold, rows)
    pairs = written(pairs.select("sig_a", "sig_b"), "pairs")
    copies = members.groupBy("sig").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    both = pairs.select(F.col("sig_a").alias("sig"), F.col("sig_b").alias("other")).unionByName(pairs.select(F.col("sig_b").alias("sig"), F.col("sig_a").alias("other")))
    near = both.join(copies.select(F.col("sig").alias("other"), "n"), "other").groupBy("sig").agg(F.sum("n").alias("near"))
    labels = components(pairs.select(F.col("sig_b").alias("u"), F.col("sig_a").alias("v"))).select(F.col("u").alias("sig"), F.col("v").alias("group"))
    classes = copies.join(near, "sig", "left").join(labels, "sig", "left").select("sig", "least", F.coalesce("group", "sig").alias("group"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    classes = written(classes, "classes")
    least = classes.groupBy("group").agg(F.min("least").alias("class_id"))
    named = classes.join(least, "group").select("sig", "class_id", "links")
    found = members.join(named, "sig").select("doc_id", "class_id", "links")
    alone = without(rows.select("doc_id", "rid"), members.select("rid")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return found.unionByName(alone)


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), {GRAMS_SQL},
o AS (SELECT a.rid AS a, b.rid AS b, count(*) AS overlap FROM g a JOIN g b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
p AS MATERIALIZED (SELECT a, b FROM o JOIN s sa ON sa.rid = a JOIN s sb ON sb.rid = b WHERE CAST(overlap AS DOUBLE) / (sa.n + sb.n - overlap) >= {THRESHOLD}),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b)
SELECT d.doc_id, min(e.doc_id) AS class_id, (SELECT count(*) FROM p WHERE p.a = d.rid) AS links
FROM d JOIN reach ON reach.a = d.rid JOIN d e ON e.rid = reach.b GROUP BY d.rid, d.doc_id"""
