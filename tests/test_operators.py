"""Operators on rows made by hand."""

from __future__ import annotations

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.api import Engine, SearchError
from quarry.functions import chunking, vector
from quarry.functions import text as X
from quarry.operators import consolidation, evaluation, extraction, fusion, lexical, store, vectors
from quarry.plans import planner
from quarry.sources import catalog, files
from quarry.streaming import flows


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_tokens_and_terms(spark):
    t = F.lit("Hello, HELLO! café_42 the AI of x 7")
    assert one(spark, X.tokens(t)) == ["hello", "café", "42", "the", "ai", "of", "7"]
    assert one(spark, X.strict_terms(t)) == ["hello", "café", "42", "ai", "7"]
    assert one(spark, X.relaxed_terms(F.lit("of the"))) == ["of", "the"]
    assert one(spark, X.anchor_matches(F.array(F.lit("rank"), F.lit("retrieval"), F.lit("zz")), F.lit("Ranking by retr"))) == ["rank", "retrieval"]


def test_normal_forms(spark):
    assert one(spark, X.comparison_key(F.lit("  Über-Größe, né!"))) == "uber große ne"
    assert one(spark, X.semantic_key(F.lit("The repo has tests and a DB"))) == "repository has test a database"
    assert one(spark, X.overlap_ratio(F.lit("a b c d"), F.lit("A, d"))) == 0.5


def test_titles_lines_snippets(spark):
    assert one(spark, X.title(F.lit("x\n#!/bin/sh\n# y"))) == "!/bin/sh"
    assert one(spark, X.title(F.lit("no heading"))) is None
    assert one(spark, X.line_range(F.lit("a\r\nb\nc"), 3, 2)) == "b\nc"
    assert one(spark, X.snippet(F.lit("x" * 400 + "needle" + "y" * 400), F.lit("NEEDLE"))).count("needle") == 1
    assert one(spark, X.glob(F.lit("a/b1.md"), "a/b?.md")) and not one(spark, X.glob(F.lit("a/b1xmd"), "a/b?.md"))


def test_vector_functions(spark):
    a, b = F.array(*map(F.lit, (3.0, 4.0))), F.array(*map(F.lit, (4.0, 3.0)))
    assert one(spark, vector.l2_norm(a)) == 5
    assert math.isclose(one(spark, vector.cosine_distance(a, b)), 0.04)
    assert one(spark, vector.cosine_distance(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, vector.l1_distance(a, b)) == 2
    assert one(spark, vector.quantized_int8(F.array(*map(F.lit, (-1.0, 0.0, 1.0))))) == [-128, 0, 127]
    assert one(spark, vector.normalized(a)) == [0.6, 0.8]
    assert one(spark, vector.max_pooled(F.array(a, b), 2)) == [4, 4] and one(spark, vector.mean_pooled(F.array(a, b), 2)) == [3.5, 3.5]
    assert math.isclose(one(spark, vector.max_similarity(F.array(vector.normalized(a)), F.array(vector.normalized(a), b))), (one(spark, vector.dot(vector.normalized(a), b)) + 1) / 2)
    with pytest.raises(ValueError):
        vector.part(a, 2, 2)


def test_knn_handles_sizes_and_zero_norms(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [0.0, 2.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>")
    assert [(r.vec_id, r.distance) for r in vectors.knn(corpus, q, 5).orderBy("rank").collect()] == [(1, 0.0), (5, 1.0)]
    assert [r.vec_id for r in vectors.knn(corpus, q, 2, "l2").orderBy("rank").collect()] == [1, 2]
    assert vectors.knn(corpus, q.limit(0), 5).count() == 0


def test_documents_beat_single_chunks(spark):
    rows = [(i, "target.md", None, w) for i, w in enumerate(["alpha only", "beta only", "gamma only", "delta only", "omega only"])]
    rows += [(100 + i, f"noise{i}.md", None, "alpha alpha alpha alpha") for i in range(25)]
    chunks = spark.createDataFrame(rows, "chunk_id long, path string, title string, content string")
    q = spark.createDataFrame([(1, "alpha beta gamma delta omega")], "qid long, text string")
    assert lexical.document_search(lexical.index(chunks), q, chunks, 3).orderBy("rank").first().path == "target.md"


def test_scope_changes_statistics(spark):
    chunks = spark.createDataFrame([(1, "scope word"), (2, "word"), (3, "other"), (4, "more")], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "scope word")], "qid long, text string")
    scoped = lexical.scoped(lexical.index(chunks), chunks.where("chunk_id <= 2"))
    assert {r.chunk_id for r in lexical.search(scoped, q).collect()} == {1, 2}


def test_fusion(spark):
    hits = spark.createDataFrame([(1, 7, 1, 0.5), (1, 8, 2, 0.2), (1, 9, 4, 2.0)], "qid long, chunk_id long, rank int, score double")
    got = {r.chunk_id: r.score for r in fusion.rrf(hits, 2.0).collect()}
    assert math.isclose(got[7], 2 / 61 + 0.005) and math.isclose(got[8], 2 / 62 + 0.002) and math.isclose(got[9], 2 / 64)
    assert math.isclose({r.chunk_id: r.score for r in fusion.scored_rrf(hits, 1.0).collect()}[9], 1.25 / 64)
    assert math.isclose({r.chunk_id: r.score for r in fusion.preservation(hits, F.lit(0.08)).collect()}[9], 2 * 0.08 / 2)
    assert one(spark, fusion.time_anchored(F.lit("maybe"))) is True  # cue words count inside longer words
    assert math.isclose(one(spark, fusion.recency(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp"))), math.exp(-1))
    tag = lambda *x: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("confidence")) for n, c in x))
    assert math.isclose(one(spark, fusion.tag_bonus(tag(("a", 1.0), ("b", 0.5)), tag(("a", 0.6)))), 0.004)
    assert math.isclose(one(spark, fusion.schema_bonus(F.array(F.lit("x")), F.array(F.lit("goal")), F.array(), F.array(F.lit("entity:x"), F.lit("facet:goal")))), 0.045)


def test_blend_and_protection(spark):
    rows = [(1, i, f"p{i}", 1.0 - i / 100, 0.9 if i == 15 else 0.0, i + 1) for i in range(20)]
    df = spark.createDataFrame(rows, "qid long, chunk_id long, path string, fused double, primary double, rank int").withColumn("rerank", F.lit(None).cast("double")).withColumn("query", F.lit("plain words"))
    out = fusion.protected(fusion.blended(df, 10), 10).where("final_rank <= 10").collect()
    assert "p15" in {r.path for r in out} and "p9" not in {r.path for r in out}
    assert one(spark, fusion.group_key(F.lit("a/b/session_abs_12.md"))) == "session"


def test_extraction(spark):
    rows = [
        (1, 0, "user", "Zac prefers Zed for editing v1.2 files. TODO: add migration tests is done!\nCan you compare Postgres and Redis before we decide?"),
        (1, 1, "assistant", "I'll remember that the repo uses Swift."), (1, 2, "user", "short. Zac prefers Zed for editing v1.2 files"), (2, 0, "user", None), (3, 0, None, ""),
    ]
    spans = {r.segment: (r.kind, r.status, r.reason) for r in extraction.spans(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn", "seq").collect() if r.turn < 2}
    assert spans["Zac prefers Zed for editing v1.2 files"] == ("profile", "active", None)
    assert spans["TODO: add migration tests is done"] == ("commitment", "resolved", None)
    assert spans["Can you compare Postgres and Redis before we decide"][2] == "not_memory_worthy"
    assert spans["I'll remember that the repo uses Swift"][2] == "not_memory_worthy"
    again = extraction.spans(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("turn = 2").orderBy("seq").collect()
    assert [r.reason for r in again] == ["too_short", "duplicate_span"]
    assert one(spark, schema.facets(F.lit("Zac prefers this project"), F.lit("profile"))) == ["fact_about_user", "preference", "project"]
    assert one(spark, F.transform(schema.entities(F.lit("Today we met Ada Lovelace in Berlin")), lambda e: e["value"])) == ["Today", "Ada Lovelace", "Berlin"]


def fold(rows):
    state = consolidation.State()
    return [state.ingest({"namespace": 1, "kind": k, "status": s, "canonical_key": key, "text": t, "seq": i}) for i, (k, s, key, t) in enumerate(rows)], state.rows


def test_consolidation():
    acts, rows = fold([("commitment", "active", "commitment:migration-tests", "TODO: add migration tests."), ("commitment", "resolved", "commitment:migration-tests", "TODO: add migration tests is done.")])
    assert acts == ["create", "merge_status"] and len(rows) == 1 and rows[0]["status"] == "resolved"
    acts, rows = fold([("decision", "active", "decision:db", "We chose Postgres"), ("decision", "active", "decision:db", "We chose Redis"), ("decision", "active", "decision:db", "we chose redis!")])
    assert acts == ["create", "supersede", "dedupe"] and [r["status"] for r in rows] == ["superseded", "active"] and rows[0]["superseded_by_id"] == rows[1]["id"]
    acts, _ = fold([("fact", "active", None, "The repo uses tests"), ("fact", "active", None, "the repository uses testing"), ("episode", "active", None, "Met Ann"), ("episode", "active", None, "Met Ann")])
    assert acts == ["create", "dedupe", "append_episode", "append_episode"]
    acts, rows = fold([("profile", "active", "profile:a", "Ann prefers dark roast coffee"), ("profile", "active", "profile:b", "Ann prefers light roast coffee")])
    assert acts == ["create", "replace_active"] and rows[1]["canonical_key"] == "profile:a"


def test_metrics(spark):
    got = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 3)], "qid long, doc_id long, rank int")
    rel = spark.createDataFrame([(1, 11), (1, 99), (2, 12), (3, 1)], "qid long, doc_id long")
    rows = {r.k: r for r in evaluation.recall_at(got, rel, [1, 3]).collect()}
    assert rows[1].hit == 0 and math.isclose(rows[3].recall, 0.5) and math.isclose(rows[3].mrr, (0.5 + 1 / 3) / 3, abs_tol=1e-6)
    best = (1 / math.log2(3)) / (1 + 1 / math.log2(3))
    assert math.isclose(rows[3].ndcg, (best + 0.5) / 3, abs_tol=1e-6)
    assert evaluation.mean_ndcg_retrieved(got, rel, 3).first().ndcg > rows[3].ndcg
    values = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(float("nan"),), (None,)], "v double")
    r = evaluation.latency(values, "v").first()
    assert (r.n, r.p50, r.p95) == (100, 51.0, 96.0)


def test_chunks():
    assert chunking.chunks("  \n ") == [] and chunking.chunks(None) == []
    text = "\n".join(f"# H{i}\n" + "word " * 150 for i in range(20))
    parts = chunking.chunks(text, target=1000, overlap=100)
    assert all(len(p) <= 1125 for p in parts) and parts[0].startswith("# H0") and sum(p.startswith("# H") for p in parts) >= 1
    covered = set()
    for p in parts:
        at = text.find(p)
        assert at >= 0
        covered |= set(range(at, at + len(p)))
    assert all(i in covered or text[i].isspace() for i in range(len(text)))
    with pytest.raises(ValueError):
        chunking.chunks("x", target=100, overlap=90)


def test_planner():
    assert planner.recall_plan("How many superseded notes?").temporal_intent == "count"
    assert planner.recall_plan("what happened to the task").statuses == {"active", "resolved"}
    assert planner.anchor_dates("2 weeks ago and yesterday", datetime.date(2024, 5, 20)) == [datetime.date(2024, 5, 19), datetime.date(2024, 5, 6)]
    assert planner.time_anchors("last monday", datetime.date(2024, 5, 20)) == ["2024-05-13", "may 13 2024", "may 13", "mon 13"]
    found = planner.branches("When did the release planning meeting move to Berlin", planner.recall_plan("release"), 5)
    assert found[0].weight == 2.0 and len({b.text for b in found}) == len(found) and len(found) <= 6
    assert planner.pool_limit(2000, 0) == 1000 and planner.pool_limit(20, 50) == 200


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\nbody")
    (tmp_path / ".hidden.md").write_text("x")
    (tmp_path / "b.bin").write_text("x")
    assert [(r.path.split("/")[-1], r.title, r.kind) for r in files.documents(spark, [str(tmp_path)]).collect()] == [("a.md", "Title", "markdown")]
    (tmp_path / "rows.jsonl").write_text('# note\n\n{"id": "1", "n": 2}\n')
    assert [tuple(r) for r in files.json_lines(spark, str(tmp_path / "rows.jsonl"), "id string, n int", ["id"]).collect()] == [("1", 2)]
    (tmp_path / "bad.jsonl").write_text('{"n": 2}\n')
    with pytest.raises(Exception, match="line 1: bad or incomplete"):
        files.json_lines(spark, str(tmp_path / "bad.jsonl"), "id string, n int", ["id"]).collect()
    np.save(tmp_path / "v.npy", np.ones((3, 2), np.float32))
    assert files.npy_vectors(spark, str(tmp_path)).count() == 3
    assert "| a |" in files.report(spark.range(1).withColumnRenamed("id", "a"), str(tmp_path / "r.json")) and json.loads((tmp_path / "r.json").read_text()) == [{"a": 0}]
    catalog.create(spark, str(tmp_path / "tables"))
    assert catalog.read(spark, str(tmp_path / "tables"), "memories").count() == 0
    assert one(spark, catalog.new_kind(F.lit(" Todo"))) == "commitment"


def test_engine(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for i in range(6):
        (tmp_path / "docs" / f"d{i}.md").write_text(f"# Doc {i}\ntoken{i} token{i + 1} shared words about planning")
    engine = Engine(spark, str(tmp_path / "engine"))
    assert engine.rebuild([str(tmp_path / "docs")]) == 6
    best = engine.search("token3 token4", 3, now="2024-12-31 00:00:00").collect()
    assert best[0].path.endswith("d3.md") and len({r.path for r in best}) == len(best)
    assert engine.search("  ").count() == 0
    assert engine.get("d3.md", 1, 1) == "# Doc 3"
    with pytest.raises(SearchError):
        engine.get("nothing.md")
    engine.add_to_context("c", [best[0].chunk_id])
    assert [r.path for r in engine.search("planning", 5, context="c").collect()] == [best[0].path]
    messages = spark.createDataFrame([(1, 0, "user", "We chose Postgres for the billing database. Ann prefers dark roast coffee every morning.")], "conv_id long, turn long, role string, text string")
    assert engine.ingest(engine.extract(messages)).count() == 2
    assert engine.ingest(engine.extract(messages)).count() == 2  # again: nothing new
    assert engine.recall("hybrid", "coffee", 1).first().kind == "profile"
    engine.remove([best[0].path])
    assert best[0].path not in {r.path for r in engine.paths().collect()}


def test_store(spark):
    rows = spark.createDataFrame([("a", "fact", "active", ["Zed"]), ("b", "fact", None, ["vim"]), ("c", "profile", "archived", [])], "id string, kind string, status string, tags array<string>")
    assert store.of_kind(rows, kinds=[]).count() == 0 and store.of_kind(rows, kinds=["fact"]).count() == 2
    assert [r.id for r in store.with_overlap(rows, tags=["zed"]).collect()] == ["a"]
    assert {r.id for r in store.visible(rows).collect()} == {"a", "b"}


def test_streams(spark, tmp_path):
    messages = [(1, 0, "user", "We chose Postgres for the billing database."), (1, 1, "user", "We chose Redis for the billing database."), (2, 0, "user", "Ann prefers dark roast coffee every day.")]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(messages, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = flows.actions(flows.candidates(stream)).writeStream.format("memory").queryName("acts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert sorted((r.namespace, r.action) for r in spark.table("acts").collect()) == [(1, "create"), (1, "supersede"), (2, "create")]
