"""Suites without SQL, by definition."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry import queries_eval
from quarry.operators import suites

SF = "/root/testdata/sf0.001"


def test_matched_writes_take_the_first_free_record(spark):
    pairs = queries_eval.expected_memory_fits(spark, SF).collect()
    fits: dict[int, dict[int, list[int]]] = {}
    for r in pairs:
        fits.setdefault(r.scenario, {}).setdefault(r.exp_id, []).append(r.rec_id)
    want = {}
    for scenario, expected in fits.items():
        used: set[int] = set()
        for exp in sorted(expected):
            used |= set([i for i in sorted(expected[exp]) if i not in used][:1])
        want[scenario] = len(used)
    got = {r.scenario: r.matched_writes for r in suites.matched_writes(queries_eval._expected(spark, SF), queries_eval._records(spark, SF)).collect()}
    assert want and {s: n for s, n in got.items() if n} == want


def test_names_end_where_the_sql_ends_them(spark):
    texts = ["De les. Reréeau", "Réeau", "éAbc x", "Abc", "xAbc", "Ab", "A--é", "A--", "A-b", "_Abc", "Abcé-", "èAbcdé", "abc", "ÉAbc_", ""]
    want = [duckdb.execute("SELECT regexp_matches(?, ?)", [t, suites.NAME_PATTERN]).fetchone()[0] for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    labels = suites.taxonomy(F.col("t"), F.lit(1), F.array().cast("array<string>"))
    assert [r.ok for r in rows.select("i", F.array_contains(labels, "entity/alias").alias("ok")).orderBy("i").collect()] == want
    assert want[0] and not want[1]


def test_queries_are_registered():
    assert {"agent_matched_writes", "memory_search", "search_branches"} <= set(entry.queries())
