"""Findings on larger tables: results equal to SQL there, and work that grows with the input."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import vector, words
from quarry.operators import evaluation, lexical, schema, store, vectors


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_duplicates_join_one_memory_per_text(spark):
    """Ten thousand memories and candidates of the same text: 10^8 pairs if each is joined with each."""
    memories = spark.range(10_000).select("id", F.lit("fact").alias("kind"), F.lit("same").alias("text"), F.when(F.col("id") % 7 == 0, "resolved").otherwise("active").alias("status"), (F.col("id") % 10).alias("updated_at"))
    found = store.duplicates(memories, spark.range(10_000).select(F.col("id").alias("cand_id"), F.lit("fact").alias("kind"), F.when(F.col("id") % 2 == 0, "same").otherwise("other").alias("text")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]
    assert {(r.cand_id % 2, r.id) for r in found.collect()} == {(0, 9_999)} and found.count() == 5_000


def test_best_sentence_keeps_its_digits(spark):
    """The place of a sentence is no set of characters to trim."""
    assert one(spark, evaluation.best_sentence(F.lit("0997 birds fly. 1 fish swims 1"), F.array(F.lit("birds")))) == "0997 birds fly."
    assert one(spark, evaluation.best_sentence(F.lit("0997 birds fly. 1 fish swims 1"), F.array(F.lit("fish")))) == "1 fish swims 1"


def test_json_rounds_the_exact_value(spark):
    """Halves go to even: 1/128 is 0.0078125 exactly."""
    halves = F.array(*map(F.lit, (1 / 128, 3 / 128, -1 / 128, 0.5, 2.0**70))).cast("array<float>")
    assert one(spark, vector.to_json(halves)) == "[0.007812,0.023438,-0.007812,0.500000,1180591620717411303424.000000]"
    assert one(spark, vector.to_json(F.array(F.lit(1.0), F.lit(None).cast("double")))) == "[1.000000,null]"
    assert one(spark, vector.to_json(F.lit(None).cast("array<float>"))) is None


@pytest.mark.parametrize("metric", ["cosine", "l2", "l1", "dot", "hamming"])
def test_many_queries_stay_where_they_are(spark, monkeypatch, metric):
    """Each query has k rows for each lot of the corpus, not for each task; all are those of brute force, also among copies."""
    monkeypatch.setattr(vectors, "QUERY_BYTES", 20_000)
    monkeypatch.setattr(vectors, "LOT_BYTES", 60_000)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v[100:160], v[5] = v[99], 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(7)
    found = vectors.knn(rows, rows.withColumnRenamed("vec_id", "qid"), 12, metric)
    wide, got = v.astype(float), {}
    for r in found.collect():
        got.setdefault(r.qid, []).append((r.distance, r.vec_id))
    for i, q in enumerate(wide):
        with np.errstate(invalid="ignore", divide="ignore"):
            d = {"dot": lambda: -(wide @ q), "cosine": lambda: 1 - wide @ q / (np.linalg.norm(wide, axis=1) * np.linalg.norm(q)), "l2": lambda: np.linalg.norm(wide - q, axis=1), "l1": lambda: np.abs(wide - q).sum(1), "hamming": lambda: (wide != q).sum(1)}[metric]()
        want = sorted((round(float(x), 6), j) for j, x in enumerate(d) if np.isfinite(x))[:12]
        assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in want] and np.allclose([x for x, _ in sorted(got.get(i, []))], [x for x, _ in want])
    lots = sum(1 for _ in vectors._lots(rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e")), 60_000))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == lots < 7


def test_nearest_beyond_single_precision():
    """Differences that single precision can't tell apart, and one value that makes the grid of L1 coarse."""
    c = np.concatenate([1e6 + np.arange(300)[:, None] * 1e-3 * np.ones(8), [[1e9] * 8]])
    for metric in ("l1", "l2"):
        kept = vectors.Best(1, 3)
        vectors._search(np.array([0]), c[150:151], kept, np.arange(len(c)), c, 3, metric)
        assert kept.ids.tolist() == [[150, 149, 151]] or sorted(kept.ids[0]) == [149, 150, 151]


TEXTS = ["alpha beta beta 7x", "alphabet Alpha, gamma", "", None, "delta alpha-beta", "gamma delta alpha", "nothing here", "BETA beta alpha 7"]


def _chunks(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, content string").repartition(3)


def _queries(spark):
    return spark.createDataFrame([(1, "alpha beta"), (2, "gamma 7"), (3, "of the"), (4, "zeta"), (5, "")], "qid long, text string")


def test_words_in_arrow_are_those_of_expressions(spark):
    """Also those of a piece that ends within a batch."""
    texts = [*TEXTS, "Straße ÉTÉ x_y 12,5 ٣ Ⅷ ... ?", "  "]
    want = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.words(F.col("t")).alias("w")).collect()]
    row, code, distinct = words.split(pa.array(texts))
    assert [[distinct[c].as_py() for c, r in zip(code, row) if r == i] for i in range(len(texts))] == want
    assert [(p.start, p.stop) for p in words.pieces(pa.array(["x" * words.PIECE, None, "y", "z" * words.PIECE]))] == [(0, 2), (2, 3), (3, 4)]


def test_texts_are_scored_where_they_are_read(spark, monkeypatch):
    """No posting is shuffled; written postings and several lots of queries give the same rows."""
    index = lexical.index(_chunks(spark))
    found = lexical.search(index, _queries(spark), 3)
    assert "postings" not in found.columns and "term" not in found._jdf.queryExecution().optimizedPlan().toString()
    key = lambda df: sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert key(found) and key(found) == key(lexical.search(lexical.Index(index.postings, index.lengths), _queries(spark), 3))
    monkeypatch.setattr(lexical, "LISTS", 2)
    assert key(found) == key(lexical.search(index, _queries(spark), 3))
    all_ = lexical.bm25(index, _queries(spark), X.relaxed_terms(F.col("text")), need_all=False)
    assert {(r.qid, r.chunk_id) for r in all_.collect()} == {(1, 0), (1, 1), (1, 4), (1, 5), (1, 7), (2, 0), (2, 1), (2, 5), (2, 7)}


def test_copies_go_by_their_number(spark):
    """Copies have the very same score in the second BM25, in whatever order their words come together; scores this large have no ninth digit to hide noise."""
    text = " ".join(f"word{i} " * (i % 7 + 1) for i in range(40))
    chunks = spark.createDataFrame([(i, text if i % 50 == 0 else f"other{i} text") for i in range(2000)], "chunk_id long, content string").repartition(16)
    found = lexical.miner(chunks, spark.createDataFrame([(1, text)], "qid long, text string"), 20).collect()
    assert [r.chunk_id for r in sorted(found, key=lambda r: r["rank"])] == [50 * i for i in range(20)] and len({r.score for r in found}) == 1


def test_diagnosis_reads_the_texts_once(spark):
    """Hits and relevant documents are made once, not again in each of their uses."""
    from quarry import queries_eval

    for rows in queries_eval._diagnosis(spark, "/root/testdata/sf0.001"):
        assert "MapInArrow" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_merged_values_split_each_value_once(spark):
    from quarry.queries_store import merged_filter_values

    plan = merged_filter_values(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # the text's and each value's
    null = F.lit(None).cast("array<string>")
    assert one(spark, F.to_json(F.array(schema.merged_values(F.array(F.lit("A"), F.lit("?"), F.lit(None).cast("string")), F.array(F.lit("a!"), F.lit("b"))), schema.merged_values(null, F.array(F.lit("-"))), schema.merged_values(null, null)))) == '[["A","b"],[],null]'


def test_tags_are_made_once_for_all_kinds(spark, monkeypatch):
    """And each kind keeps its own weight and its own limit."""
    from quarry.plans import search
    from quarry.queries_search import memory_search

    calls = []
    monkeypatch.setattr(search, "tag_hits", lambda chunks, names, limit, of=search.tag_hits: calls.append((names.columns, limit)) or of(chunks, names, limit))
    assert memory_search(spark, "/root/testdata/sf0.001").select("qid").distinct().count() > 0
    assert calls == [(["qid", "name"], 50)]


def test_anchors_of_chunks_by_word(spark):
    """A word that an anchor begins, or that begins an anchor, as in anchor_matches(); the words of a chunk are not joined with those of the corpus."""
    chunks = spark.createDataFrame([(1, "t", "ranking by retr"), (2, None, "nothing"), (3, "rank", "zzz")], "chunk_id long, title string, content string")
    hits = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 1)], "qid long, chunk_id long")
    wanted = spark.createDataFrame([(7, ["rank", "retrieval", "zz"]), (8, ["none"])], "qid long, anchors array<string>")
    got = {(r.qid, r.chunk_id): sorted(r.hit) for r in lexical._anchored(hits, wanted, chunks).collect()}
    assert got == {(7, 1): ["rank", "retrieval"], (7, 3): ["rank", "zz"]}
