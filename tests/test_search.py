"""The parts of the search that have no SQL, on small tables."""

from __future__ import annotations

from quarry.plans import search


def test_branches(spark):
    rows = search.branches(spark.createDataFrame([(1, "When did the release planning meeting move to Berlin"), (2, "  "), (3, None)], "qid long, text string"), search.Options()).collect()
    assert {r.qid for r in rows} == {1}
    rows.sort(key=lambda r: r.branch)
    assert [r.branch for r in rows] == list(range(len(rows))) and rows[0].kind == "original" and rows[0].weight == 2.0
    assert len({r.text for r in rows}) == len(rows) > 1 and all(r.weight <= 2.0 for r in rows)


def test_search_limits():
    assert search.Options(limit=10).search_limit == 60 and search.Options(limit=60).search_limit == 320 and search.Options(limit=10, dedupe=False).search_limit == 10
