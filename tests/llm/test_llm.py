"""The ten operators and the pipeline on small tables with nulls, empty and very long texts, ties, repeats and clashing names, against brute force."""

from __future__ import annotations

import math
import random
import shutil
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common, decontaminate, fm, grouping, jaccard, language_model, mixing, quality, sharding, substrings, surrogates, token_output, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, shard string, _p string, _order string, copy string"


def table(spark, rows, path):
    """Documents as files, with extra columns whose names the operators use themselves; rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "r", "h", "p", "o", f"c{i}") for i, r in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Odd rows: nulls, empty, blank, marks only, repeats, a very long text, near copies."""
    rng = random.Random(3)
    base = prose(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   "), (7, "!!! ..."), (None, base), (None, None), (1, base), (8, "Ünïcode " + prose(rng, 20)), (9, prose(rng, 60_000, 3000)), (10, "two words"), (11, "Two, words!"), (12, None, None), (13, prose(rng, 80), None)]
    return table(spark, rows, tmp_path_factory.mktemp("odd") / "documents.parquet"), rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return table(spark, [], tmp_path_factory.mktemp("empty") / "documents.parquet")


def grams_of(text, n=5):
    w = common.words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


# common


def test_tokens_are_words():
    texts = ["Hello, wörld_x 42", None, "", "İstanbul ǅ ß", "a" * 10_000 + " b", "日本 語-x"]
    tokens = common.tokenize(texts)
    at = 0
    seen = {}
    for t, a, b in zip(texts, tokens.bounds[:-1], tokens.bounds[1:]):
        low = (t or "").lower()
        assert [low[x:y] for x, y in zip(tokens.starts[a:b], tokens.ends[a:b])] == common.words(t)
        for w, h in zip(common.words(t), tokens.hashes[a:b]):
            assert seen.setdefault(w, h) == h
        at += b - a
    assert len(set(seen.values())) == len(seen)


def test_stable_scans(spark, odd):
    docs, _ = odd
    assert common.is_stable_scan(docs.select("doc_id").where("doc_id > 3"))
    assert not common.is_stable_scan(docs.repartition(2)) and not common.is_stable_scan(spark.range(3))


# 1 sharding


def test_sharding_is_exact_and_keeps_rows(spark, odd, empty):
    docs, rows = odd
    out = sharding.shuffled(docs, 5)
    assert out.columns == [*(c for c in docs.columns if c != "shard"), "shard", "position"]
    got = out.collect()
    assert sorted(Counter(r.shard for r in got).values(), reverse=True) == [4, 3, 3, 3, 3]
    assert Counter((r.doc_id, r.text, r.copy, r["_order"]) for r in got) == Counter((r.doc_id, r.text, r.copy, r["_order"]) for r in docs.collect())
    for s in range(5):
        assert sorted(r.position for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert [tuple(r) for r in sharding.shuffled(docs, 5).orderBy("shard", "position").collect()] == [tuple(r) for r in out.orderBy("shard", "position").collect()]
    assert sharding.shuffled(empty, 5).count() == 0
    assert sharding.shuffled(docs.repartition(4), 40).count() == len(rows)  # not a scan; more shards than rows


def test_matrix_rows_add_up_and_are_uniform():
    sizes, capacities = np.array([5, 0, 7, 3]), sharding.shard_sizes(15, 4)
    first = Counter()
    for seed in range(3000):
        m = np.array([sharding.matrix_row(sizes, capacities, p, seed) for p in range(4)])
        assert (m.sum(1) == sizes).all() and (m.sum(0) == capacities).all()
        first[int(m[2, 0])] += 1
    expected = {k: math.comb(7, k) * math.comb(8, 4 - k) / math.comb(15, 4) * 3000 for k in range(5)}
    assert sum((first[k] - e) ** 2 / e for k, e in expected.items()) < 20


def test_large_hypergeometric():
    rng = np.random.default_rng(1)
    x = [sharding.hypergeometric(rng, 3_000_000_000, 7_000_000_000, 1_000_000) for _ in range(400)]
    assert abs(np.mean(x) - 300_000) < 5 * math.sqrt(210_000 / 400) and 0.8 < np.std(x) / math.sqrt(210_000) < 1.2


# 2 mixing


def test_mixing(spark, tmp_path, empty):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 60)), s) for i, s in enumerate(["a"] * 60 + ["b"] * 12 + ["c"] * 6)] + [(100, None, "a"), (101, "", "d"), (102, "x y", None), (None, "z", "a")]
    docs = table(spark, rows, tmp_path / "d.parquet")
    got = mixing.mixed(docs, 32, {"a": 2, "b": 1, "c": 1, "d": 0, "": 0}).collect()
    assert {r.source for r in got} == {"a", "b", "c"}
    slots = Counter(s for s, _ in {(r.source, r.slot) for r in got})
    assert abs(slots["a"] / sum(slots.values()) - 0.5) < 0.05
    tokens = {r[0]: len((r[1] or "").split()) for r in rows if r[0] is not None}
    for r in got:
        assert 0 <= r.token_from <= r.token_to and r.token + r.token_to - r.token_from <= 32
    for doc, source in [(r[0], r[2]) for r in rows if r[0] is not None and r[2] in ("a", "b", "c")]:
        mine = {(r.token_from, r.token_to) for r in got if r.doc_id == doc}
        assert sum(b - a for a, b in mine) == tokens[doc] and mine
    again = mixing.resampled(docs, 32)
    assert again.columns == docs.columns
    seen = Counter(r.copy for r in again.collect())
    assert set(seen) == {f"c{i}" for i in range(len(rows))}  # nothing is left out
    assert mixing.mixed(empty).count() == 0 and mixing.resampled(empty).count() == 0


# 3 language model


def test_gradient():
    rng = np.random.default_rng(0)
    model = language_model.Model.start(np.ones(language_model.VOCABULARY))
    x, y = rng.integers(0, 50, (5, 3)).astype(np.int32), rng.integers(0, 500, (5, 3)).astype(np.int32)
    x[0], x[3, 1], y[2, 1] = language_model.VOCABULARY, language_model.VOCABULARY, -1
    grads, h = language_model.Model(np.zeros_like(model.flat)), np.zeros((3, language_model.HIDDEN), np.float32)
    model.gradient(x, y, h, grads)

    def loss(flat):
        m = language_model.Model(flat)
        live = np.flatnonzero(y.ravel() >= 0)
        return -m.output(m.states(x, h).reshape(-1, language_model.HIDDEN)[live], y.ravel()[live])[0].astype(float).mean()

    for k in np.argsort(-np.abs(grads.flat))[:300:30]:
        up, down = model.flat.copy(), model.flat.copy()
        up[k] += 0.01
        down[k] -= 0.01
        assert abs(grads.flat[k] - (loss(up) - loss(down)) / 0.02) < 1e-3


@pytest.mark.parametrize("scale", [1, 80])
def test_outputs_by_definition_without_large_matrices(scale):
    rng, k, m = np.random.default_rng(scale), 200, 8000
    model = language_model.Model.start(rng.integers(1, 1000, k * k))
    for name in ("Wc", "Wo"):
        model.p[name][:] *= scale  # with 80, logits are too large for exp()
    h, y = np.tanh(rng.normal(size=(m, language_model.HIDDEN))).astype(np.float32), np.minimum(rng.integers(0, k * k, m), rng.integers(0, k * k, m)).astype(np.int32)
    grads = language_model.Model(np.zeros_like(model.flat))
    tracemalloc.start()
    logp, dh = model.output(h, y, grads.p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * m * k  # less than one number for each row and class
    c, w = y // k, y % k
    logits = [h.astype(float) @ model.p["Wc"] + model.p["bc"], np.einsum("ij,ijk->ik", h.astype(float), model.p["Wo"][c]) + model.p["bo"][c]]
    logits = [x - x.max(1, keepdims=True) for x in logits]
    logits = [x - np.log(np.exp(x).sum(1, keepdims=True)) for x in logits]
    rows = np.arange(m)
    assert np.allclose(logp, logits[0][rows, c] + logits[1][rows, w], rtol=1e-4, atol=2e-3)
    dc, dw = (np.exp(x) for x in logits)
    dc[rows, c] -= 1
    dw[rows, w] -= 1
    wo = np.zeros((k, language_model.HIDDEN, k))
    np.add.at(wo, c, h[:, :, None] * dw[:, None, :] / m)
    assert np.allclose(grads.p["Wc"], h.T @ dc / m, atol=1e-5) and np.allclose(grads.p["bc"], dc.mean(0), atol=1e-5)
    assert np.allclose(grads.p["Wo"], wo, atol=1e-5)
    assert np.allclose(dh, (dc @ model.p["Wc"].T + np.einsum("ik,ijk->ij", dw, model.p["Wo"][c])) / m, rtol=1e-3, atol=1e-6 * scale)
    assert np.allclose(model.output(h, y)[0], logp)


def test_language_model_learns_and_scores_whole_documents(spark, tmp_path, odd, empty):
    rng = random.Random(5)
    pattern = lambda n: " ".join("abcdefgh"[(s := rng.randrange(8)) :] + " " + "xyz"[s % 3] for _ in range(n))
    docs = table(spark, [(i, pattern(200)) for i in range(150)], tmp_path / "d.parquet")
    flat, words = language_model.trained(docs)
    _, counts = language_model.vocabulary(docs)
    held = [language_model.Ids(words).of(common.tokenize([pattern(200)]).hashes) for _ in range(10)]
    before, after = (language_model.log_likelihoods(language_model.Model(f), held).sum() for f in (language_model.Model.start(counts).flat, flat))
    assert after > before + 100  # better than the unigram model it starts as, on texts that it hasn't seen
    model = language_model.Model(flat)
    alone = [language_model.log_likelihoods(model, [d])[0] for d in held]
    assert np.allclose(language_model.log_likelihoods(model, held), alone, rtol=1e-4)
    rows = language_model.scored(odd[0], flat, words).collect()
    assert len(rows) == len(odd[1]) and all((r.perplexity is None) == (r.n_words == 0) for r in rows)
    assert max(r.n_words for r in rows) == 60_000
    flat, words = language_model.trained(empty)
    assert language_model.scored(empty, flat, words).count() == 0


def test_words_in_buckets_are_scored_by_their_counts(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(f"w{min(rng.randrange(1, 3000), rng.randrange(1, 3000))}" for _ in range(60)) for _ in range(150)]
    docs = table(spark, list(enumerate(texts)), tmp_path / "d.parquet")
    flat, words = language_model.trained(docs)
    counts = Counter(h for t in texts for h in common.tokenize([t]).hashes.tolist())
    rare = {h: n for h, n in counts.items() if h not in set(words.words.tolist())}
    sums = Counter()
    for h, n in rare.items():
        sums[h % language_model.BUCKETS] += n
    seen = list(rare)
    assert len(rare) > 1000
    model, ids = language_model.Model(flat), language_model.Ids(words)
    new = table(spark, [(0, "never seen here"), *((i, t) for i, t in enumerate(texts) if i)], tmp_path / "n.parquet")
    for r in language_model.scored(new, flat, words).collect():
        hashes = common.tokenize([texts[r.doc_id] if r.doc_id else "never seen here"]).hashes
        tail = sum(math.log((rare[h] - 0.5) / sums[h % 64]) for h in hashes.tolist() if h in rare)
        tail += sum(math.log(0.5 * sum(x % 64 == h % 64 for x in seen) * 64 / 2**64 / sums[h % 64]) for h in hashes.tolist() if h not in counts)
        assert abs(r.log_likelihood - language_model.log_likelihoods(model, [ids.of(hashes)])[0] - tail) < 0.01


def test_texts_are_taken_apart_once(spark, tmp_path):
    rows = [(None, "One two, two"), (1, None), (2, ""), (3, "--"), *((i, prose(random.Random(i), 50)) for i in range(4, 600)), (600, prose(random.Random(0), 200_000, 10**6))]
    docs = language_model.hashed(table(spark, rows, tmp_path / "d.parquet"))
    shutil.rmtree(tmp_path / "d.parquet")  # all that follows comes from the table of words
    found = {}
    for ids, bounds, words, codes in language_model._rows(docs.toArrow().to_batches()):
        found |= {d: words[codes[a:b]].tolist() for d, a, b in zip(ids.to_pylist(), bounds[:-1], bounds[1:], strict=True)}
    assert found == {d: common.tokenize([t]).hashes.tolist() for d, t in rows}
    scores = {r.doc_id: r for r in language_model.scored(docs, *language_model.trained(docs)).collect()}
    assert {d: r.n_words for d, r in scores.items()} == {d: len(common.words(t)) for d, t in rows}
    assert scores[None].log_likelihood < 0 == scores[1].log_likelihood and scores[3].perplexity is None


def test_first_round_reads_no_more_rows_than_it_needs():
    taken = []
    words = (np.arange(40, dtype=np.uint64).tobytes(), np.arange(40, dtype=np.uint16).tobytes())
    batches = (taken.append(i) or pa.RecordBatch.from_pydict({"doc_ids": [[i]], "bounds": [np.array([0, 40]).tobytes()], "words": [words[0]], "codes": [words[1]]}) for i in range(100))
    lots = language_model._lots(language_model._rows(batches), lambda row: len(row[3]), 100)
    assert [len(x) for x in (next(lots), next(lots))] == [3, 3] and len(taken) == 6


def test_model_grows_with_the_corpus(spark, tmp_path, monkeypatch):
    assert language_model.classes_for(0) == 32 and language_model.classes_for(10**8) == 100 and language_model.classes_for(10**10) == 317
    monkeypatch.setattr(language_model, "MIN_CLASSES", 8)
    docs = table(spark, [(i, prose(random.Random(i), 100)) for i in range(200)], tmp_path / "d.parquet")
    flat, words = language_model.trained(docs)
    assert language_model.Model(flat).classes == words.classes == 12 and len(words.words) == 144 - language_model.BUCKETS


# 4 Jaccard join and groups


def brute_pairs(rows):
    sets = {}
    for doc, text in [(r[0], r[1]) for r in rows if r[0] is not None]:
        sets.setdefault(doc, []).append(grams_of(text))
    out = {}
    for a in sets:
        for b in sets:
            if a < b:
                best = max((len(x & y) / len(x | y) for x in sets[a] for y in sets[b] if x and y), default=0)
                if best >= jaccard.THRESHOLD:
                    out[a, b] = round(best, 6)
    return out


def test_near_pairs(spark, tmp_path, odd, empty):
    docs, rows = odd
    assert {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.near_pairs(docs).collect()} == brute_pairs(rows)
    rng = random.Random(7)
    many = []
    base = prose(rng, 150).split(" ")
    for i in range(90):  # more copies than the light path takes
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        many.append((i, " ".join(w)))
    many += [(200 + i, prose(rng, 60, 30)) for i in range(60)]
    big = table(spark, many, tmp_path / "d.parquet")
    assert {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.near_pairs(big).collect()} == brute_pairs(many)
    assert jaccard.near_pairs(empty).count() == 0


def brute_linked(rows):
    """(doc_id, class_id, links) of each row."""
    sets = [grams_of(r[1]) for r in rows]
    near = [{j for j, y in enumerate(sets) if j != i and x and y and len(x & y) / len(x | y) >= jaccard.THRESHOLD} for i, x in enumerate(sets)]
    out = []
    for i, r in enumerate(rows):
        group, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - group
            group |= new
            todo += new
        out.append((r[0], min((rows[j][0] for j in group if rows[j][0] is not None), default=None), len(near[i])))
    return out


def test_linked(spark, tmp_path, odd, empty, monkeypatch):
    docs, rows = odd
    assert Counter(tuple(r) for r in grouping.linked(docs).collect()) == Counter(brute_linked(rows))
    rng = random.Random(17)
    base = prose(rng, 150).split(" ")
    many = [(300 + i, " ".join(w if rng.random() > 0.02 else f"e{i}" for w in base)) for i in range(80)] + [(i, prose(rng, 40, 25)) for i in range(100)]
    many += [many[0]] * 40 + [(None, many[1][1]), (None, None), (7, "")]
    big = table(spark, many, tmp_path / "d.parquet")
    want = Counter(brute_linked(many))
    assert Counter(tuple(r) for r in grouping.linked(big).collect()) == want
    monkeypatch.setattr(jaccard, "FRAGMENT_GRAMS", 100)  # over 64 fragments
    assert Counter(tuple(r) for r in grouping.linked(big).collect()) == want
    assert grouping.linked(empty).count() == 0 and grouping.linked(docs).columns == ["doc_id", "class_id", "links"]


@pytest.mark.parametrize("levels", [(1, 3, 20), (2, 4, 8), (5, 200, 900), (64, 4096, 64**3)])
def test_levels_lose_no_pair(spark, tmp_path, monkeypatch, levels):
    """Groups, some of which share passages with many others, wholly or in part, at the borders of all levels."""
    rng = random.Random(sum(levels))
    passages = [prose(rng, 30, 5000) for _ in range(3)]
    rows = []
    for _ in range(25):
        base = prose(rng, rng.choice((12, 40, 80)), 3000).split(" ")
        for _ in range(rng.choice((1, 2, 6, 12))):
            own = [w if rng.random() > 0.04 else f"x{rng.randrange(10**6)}" for w in base]
            rows.append((len(rows), " ".join([*own, *rng.sample(passages, rng.randrange(0, 4))])))
    rows += [(len(rows) + i, " ".join(rng.sample(passages, 2))) for i in range(6)]
    docs = table(spark, rows, tmp_path / "d.parquet")
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    assert {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.near_pairs(docs).collect()} == brute_pairs(rows)


def test_sums_give_way_to_memory():
    rng = np.random.default_rng(2)
    sigs = rng.permutation(1000)[:20] * 7 - 3000
    for most in (0, 50, 10**6):
        sums, got, want = jaccard._Sums(), Counter(), Counter()
        for _ in range(20):
            own = rng.permutation(20)[:12]
            numbers = sums.numbers(sigs[own], np.abs(sigs[own]))
            a, b, n = rng.integers(0, 6, 30), rng.integers(6, 12, 30), rng.integers(1, 5, 30)
            for x, y, z in zip(sigs[own[a]].tolist(), sigs[own[b]].tolist(), n.tolist()):
                want[min(x, y), max(x, y), abs(min(x, y)) << 32 | abs(max(x, y))] += z
            sums.add(numbers[a], numbers[b], n)
            for r in (r for batch in sums.taken(most) for r in batch.to_pylist()):
                got[r["x"], r["y"], r["sizes"]] += r["n"]
        for r in (r for batch in sums.taken(0) for r in batch.to_pylist()):
            got[r["x"], r["y"], r["sizes"]] += r["n"]
        assert got == want


def test_sums_held_after_summing_are_handed_on():
    sums, got = jaccard._Sums(), Counter()
    numbers = sums.numbers(np.array([5, 3, 9]), np.array([10, 11, 12]))
    for _ in range(3):  # the third one sums what is held to two pairs, which stay
        sums.add(numbers[[0, 0]], numbers[[1, 2]], np.array([1, 2]))
        assert not list(sums.taken(4))
    assert (sums.held, sums.summed) == (2, 2)
    for r in (r for batch in sums.taken(0) for r in batch.to_pylist()):
        got[r["x"], r["y"]] += r["n"]
    assert got == {(3, 5): 3, (5, 9): 6} and not list(sums.taken(0))


def test_one_of_each_group(spark, odd, empty):
    docs, _ = odd
    out = grouping.one_of_each_group(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert all(r.rid == "r" and r.shard == "h" for r in kept)
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == [1, 4, 5, 6, 7, 8, 9, 10, 12, 13]
    assert sum(r.doc_id is None for r in kept) == 1  # the null text
    assert grouping.one_of_each_group(empty).count() == 0


def test_row_numbers_hold_when_files_are_split_otherwise(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, 60, 3000) for _ in range(300)]
    docs = table(spark, [(i, texts[i % 200]) for i in range(300)], tmp_path / "d.parquet")
    made = []

    def bitmaps(rows, make=common.bitmaps):
        made.append(1)  # as if an executor came or went: each job cuts the files another way
        spark.conf.set("spark.sql.files.minPartitionNum", str(1 + 6 * (len(made) % 2)))
        return make(rows)

    monkeypatch.setattr(common, "bitmaps", bitmaps)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        kept = sorted(r.doc_id for r in grouping.one_of_each_group(docs).collect())
        assert made and kept == list(range(200))
        assert {(r.doc_a, r.doc_b) for r in jaccard.near_pairs(docs).collect()} == {(i, i + 200) for i in range(100)}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r.u: r.v for r in grouping.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


# FM-index, 5 decontamination, 6 substrings


def test_fm_index():
    rng = np.random.default_rng(0)
    for _ in range(60):
        s = np.r_[rng.integers(0, 4, rng.integers(1, 60)), 0].astype(np.int64)
        index = fm.FMIndex(s, 5, sample=4)
        patterns, lengths = rng.integers(1, 4, (20, 3)), rng.integers(1, 4, 20)
        for p, n, a, b in zip(patterns, lengths, *index.find(patterns, lengths)):
            want = [i for i in range(len(s)) if s[i : i + n].tolist() == p[:n].tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_list_index_steps_as_the_wavelet_matrix():
    rng = np.random.default_rng(1)
    for _ in range(40):
        s = np.r_[rng.integers(0, 6, rng.integers(1, 80)), 0].astype(np.int64)
        one, other = fm.FMIndex(s, 7), fm.ListIndex(s)
        symbol, ends = rng.integers(1, 6, 50), np.sort(rng.integers(0, len(s) + 1, (2, 50)), axis=0)
        assert np.array_equal(one.step(symbol, *ends), other.step(symbol, *ends)) and np.array_equal(one.order, other.order)


def test_anchors_of_many_texts_by_definition():
    rng = np.random.default_rng(3)
    for length, k in ((50, 20), (12, 5), (7, 7), (9, 1)):
        sizes = rng.choice([0, 1, 5, length - 1, length, length + 1, 90, 200], 40)
        bounds = np.r_[0, np.cumsum(sizes)]
        hashes = rng.integers(0, 3 if k > 5 else 50, bounds[-1]).astype(np.uint64)  # equal K-grams in a window
        places, values, firsts = substrings.anchors(hashes, bounds, length, k)
        for a, b, i, j in zip(bounds[:-1], bounds[1:], firsts[:-1], firsts[1:]):
            v = common.grams(hashes[a:b], np.array([0, b - a]), k)[0]
            want = sorted({w + int(np.argmin(v[w : w + length - k + 1])) for w in range(b - a - length + 1)})
            assert (places[i:j] - a).tolist() == want and values[i:j].tolist() == v[want].tolist()
    assert [len(x) for x in substrings.anchors(np.zeros(0, np.uint64), np.zeros(1, np.int64), 50, 20)] == [0, 0, 1]


def test_decontamination(spark, tmp_path, odd, empty):
    rng = random.Random(2)
    items = [(1, prose(rng, 20, 50)), (2, "Short phrase here"), (3, None), (4, ""), (5, prose(rng, 9, 50)), (None, "nameless item text"), (6, "short PHRASE, here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    lines = [items[0][1].upper().replace(" ", ", ") + "!", "x short phrase here y", "before " + items[4][1] + " after", "clean text", None, "", "a nameless item text", "short phrase here short phrase here", "İ İ short phrase here z"]
    rows = [(i, t) for i, t in enumerate(lines)] + [(1, lines[1]), (None, lines[1])]
    docs = table(spark, rows, tmp_path / "d.parquet")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted(key(r) for r in decontaminate.spans(docs, bench).collect())
    assert got == sorted([(0, 0, 20, 1, 1), (1, 1, 4, 2, 2), (1, 1, 4, 2, 2), (-1, 1, 4, 2, 2), (2, 1, 10, 1, 5), (6, 1, 4, 0, -1), (7, 0, 6, 2, 2), (8, 2, 5, 2, 2)])
    out = {r.copy: r for r in decontaminate.clean(docs, bench).collect()}
    assert out["c1"].text == "x  y" and out["c1"].n_chars == 4 and out["c2"].text == "before  after" and out["c3"].text == "clean text" and out["c4"].text is None
    assert out["c8"].text == "İ İ  z" and "c7" not in out and out["c0"].text == "!"  # nothing was left of c7
    assert decontaminate.spans(empty, bench).count() == 0 and decontaminate.clean(odd[0], bench.limit(0)).count() == len(odd[1])


def test_slices_of_a_benchmark_are_cut_at_once(spark, tmp_path, monkeypatch):
    w = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(w[a : a + 12])) for i, a in enumerate(range(0, 24, 2))] + [(50, "left right " + " ".join(w[34:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "start " + " ".join(w[:34]) + " end"), (2, "left " + " ".join(w[:12]) + " right " + " ".join(w[34:40])), (3, None), (4, "clean"), (5, " ".join(w[:34]))]
    docs = table(spark, rows, tmp_path / "d.parquet")
    whole = {r.copy: r for r in decontaminate.clean(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 300)
    assert len(list(decontaminate._slices(bench, 8))) > 2
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns and {r.copy: r for r in out.collect()} == whole
    assert whole["c0"].text == "start  end" and whole["c1"].text == "left  right " + " ".join(w[34:40]) and "c4" not in whole


def brute_repeats(rows, length):
    texts = {(d, t) for d, t in ((r[0], r[1]) for r in rows) if t}
    where = {}
    for key in texts:
        w = common.words(key[1])
        for i in range(len(w) - length + 1):
            where.setdefault(tuple(w[i : i + length]), set()).add(key)
    out = []
    for key in texts:
        w = common.words(key[1])
        runs = []
        for i in range(len(w) - length + 1):
            if len(where[tuple(w[i : i + length])]) > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out += [(key[0], a, b) for a, b in runs]
    return out


def test_repeated_passages(spark, tmp_path, odd, empty):
    rng = random.Random(4)
    passage, line = prose(rng, 80), prose(rng, 30)
    rows = []
    for i in range(40):
        w = [prose(rng, rng.randrange(0, 90))]
        if i % 3 == 0:
            w += [passage, prose(rng, 10)]
        if i % 4 == 0:
            w += [line]
        if i % 10 == 0:  # within itself only
            w += ["own " * 120]
        rows.append((i, " ".join(w)))
    rows += [(3, rows[3][1]), (None, passage), (50, " ".join(passage.split(" ")[10:70])), (51, "z " * 200), (52, "z " * 300)]
    docs = table(spark, rows, tmp_path / "d.parquet")
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(key, (tuple(r) for r in substrings.repeated_passages(docs).collect()))) == sorted(map(key, brute_repeats(rows, substrings.L)))
    odds = [tuple(r) for r in substrings.repeated_passages(odd[0]).collect()]
    assert sorted(map(key, odds)) == sorted(map(key, brute_repeats(odd[1], substrings.L)))
    assert substrings.repeated_passages(empty).count() == 0


# 7 token output


def test_coder_round_trip():
    rng = np.random.default_rng(0)
    blocks = [(rng.zipf(1.3, n) % 50_000).astype(np.int64) for n in (1, 5, 300, 700)] + [np.array([0, 0, 0, 50_256, 50_255]), np.arange(200) % 3]
    for a, b in zip(blocks, token_output.decode_blocks(token_output.encode_blocks(blocks), [len(b) for b in blocks])):
        assert (a == b).all()
    assert token_output.encode_blocks([]) == []


def plain_code(ids):
    """The coder by definition, id by id."""
    total, known, held = 1 << 26, [{}, {}], [{}, {}]
    value, place, scale, counted, hits, plan = 0, 0, 1 << 22, [], [], token_output.updates(len(ids)).tolist()
    weight = lambda h, n: min(max((8192 * h + 4096) // (2 * n + 2), 32), 4064)
    for t, x in enumerate(ids):
        if t in plan:
            counted = sorted(ids[:t])
        one, two = ids[t - 1] if t else 65_535, ids[t - 2] if t > 1 else 65_535
        contexts, parts, rest = (one, (one * 40_503 + two * 2_654_435_761 & 0xFFFFFFFF) >> 9 & 0xFFFF), [], float(total - 65_536)
        for k, depth in ((1, 16), (0, 32)):
            seen = known[k].setdefault(contexts[k], [])[-depth:]
            kind = (min(len(seen).bit_length(), 7), len(seen) > 1 and seen[-1] == seen[-2])
            tally = held[k].setdefault(kind, [0, 0])
            w = rest * ((weight(*tally) if seen else 0) / 4096)
            rest -= w
            parts.append((w / max(len(seen), 1), seen))
            tally[0] += x in seen
            tally[1] += 1
            known[k][contexts[k]].append(x)
        recent = hits[-1024:]
        w = rest * ((weight(sum(recent), len(recent)) if counted else 0) / 4096)
        rest -= w
        parts.append((w / max(len(counted), 1), counted))
        hits.append(x in counted)

        def start(y):
            sum_ = rest * float(token_output._PRIOR[y])
            for w, seen in reversed(parts):
                sum_ += w * sum(s < y for s in seen)
            return int(sum_) + y

        low, high = start(x), start(x + 1)
        value, room = value + scale * low, scale * (high - low)
        shift = 49 - room.bit_length()
        value, place, scale = value << shift, place + shift, room << shift >> 26
    size = -(-(place + 2) // 8)
    value += (1 << 47) - 1
    gone = place + 49 - size * 8
    return (value >> gone if gone >= 0 else value << -gone).to_bytes(size, "big")


def test_coder_by_definition():
    rng = random.Random(5)
    blocks = [[rng.choice((3, 70, 70, 900, 50_000, rng.randrange(65_536))) for _ in range(n)] for n in (1, 2, 40, 700)] + [[7] * 300, [END for END in (50_256,) * 50], list(range(200)) * 2]
    assert token_output.encode_blocks([np.array(b, np.uint16) for b in blocks]) == [plain_code(b) for b in blocks]


def test_tokenizer_finds_the_pieces():
    tokenizer = token_output.Tokenizer(token_output.VOCABULARY)
    texts = ["I'm it's we'll they're 've'd 'start ''s  's\n's'", " \n\n x  y\t z ", "a  ", "né 日本語 1½ x²", "", "'", "'s", "  ", "don't!!  'quoted' \u0301x", "<|endoftext|>", "\x00", "a" * 3000, " " * 900 + "\n"]
    for some in (texts, texts[::-1], [*texts, "with \U0010ffff in it"]):
        for _ in range(2):
            ids, ends = tokenizer.all(some)
            for a, b, t in zip([0, *ends], ends, some):
                assert ids[a : b - 1].tolist() == tokenizer(t).tolist() and ids[b - 1] == token_output.END


def test_token_blocks_of_production_size(spark, tmp_path):
    rng = random.Random(8)
    rows = [(1, prose(rng, 20_000, 30_000)), (2, "same"), (3, "same"), (None, None), (5, prose(rng, 3000)), (6, "")]
    docs = table(spark, rows, tmp_path / "d.parquet")
    blocks = token_output.written_blocks(docs.coalesce(1))
    sizes = [r.n_ids for r in blocks.orderBy("block").collect()]
    assert len(sizes) > 3 and set(sizes[:-1]) == {token_output.BLOCK}
    assert Counter((r.doc_id, r.text) for r in token_output.read_blocks(blocks).collect()) == Counter((r[0], r[1]) for r in rows)


def test_token_output(spark, tmp_path, empty):
    rng = random.Random(1)
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (None, "<|endoftext|> is text"), (2, "né 日本 \x00"), (4, prose(rng, 3000)), (4, "tie"), (5, "tie")]
    docs = table(spark, rows, tmp_path / "d.parquet")
    blocks = token_output.written_blocks(docs, block=512)
    assert blocks.count() > 3
    back = token_output.read_blocks(blocks).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1]) for r in rows)
    with pytest.raises(Exception, match="damaged"):
        token_output.read_blocks(blocks.withColumn("checksum", F.col("checksum") + 1)).collect()
    assert token_output.written_blocks(empty).count() == 0


# 8 surrogates


def test_entities_and_surrogates():
    t = "Mail ann.b@x1.example.org, call +1 (017) 555-7713, host 97.51.17.173, card 4845168114407329, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\", Mr. John Smith met Mary Kowalska; John left. IBAN DE89 3704 0044 0532 0130 00."
    kinds = [k for _, _, k in surrogates.entities(t)]
    assert kinds == ["email", "phone", "ipv4", "card", "secret", "person", "person", "person", "iban"]
    for bad in ("999.1.1.1 and 1.2.3", "9807915762804490", "version 1.2.3.4.5", "Mary had", "CC BY-NC 4.0", None, ""):
        assert surrogates.entities(bad) == []
    s = {k: surrogates.surrogate(k, t[a:b]) for a, b, k in surrogates.entities(t) if k != "person"}
    assert surrogates.luhn(s["card"][:-1]) == int(s["card"][-1]) and s["card"][0] == "4"
    assert surrogates._mod97((p := s["iban"].replace(" ", ""))[4:] + p[:4]) == 1 and [k for _, _, k in surrogates.entities(s["email"])] == ["email"]
    assert surrogates.surrogate("ipv4", "10.1.2.3").startswith("10.") and surrogates.surrogate("person", "Мария") in surrogates._FIRST["cyrillic", "f"]
    rng = random.Random(0)
    for kind, make in (("ipv4", lambda: ".".join(str(rng.randrange(256)) for _ in range(4))), ("phone", lambda: f"+1 ({rng.randrange(1000):03d}) 555-{rng.randrange(10_000):04d}"), ("person", lambda: rng.choice("BCDFG") + rng.choice("aeiou") + rng.choice("bcd") + rng.choice("aeiou"))):
        values = {make() for _ in range(500)}
        assert len({surrogates.surrogate(kind, v) for v in values}) == len(values)


def test_replaced(spark, tmp_path, odd, empty, monkeypatch):
    rows = [(i, f"write to a{i % 5}@example.com or +1 (017) 555-{i % 7:04d} about 10.0.0.{i % 3}") for i in range(40)] + [(90, None), (91, ""), (92, "clean"), (None, "a1@example.com"), (1, "a1@example.com"), (93, "Mr. John Smith and Mrs. Mary Smith. John")]
    docs = table(spark, rows, tmp_path / "d.parquet")
    out = surrogates.replaced(docs)
    assert out.columns == [*docs.columns, "n_entities"]
    got = {r.copy: r for r in out.collect()}
    found = {}
    for i, r in enumerate(rows):
        new = got[f"c{i}"]
        for (a, b, kind), (x, y, kind2) in zip(surrogates.entities(r[1]), surrogates.entities(new.text)):
            assert kind == kind2 and found.setdefault((kind, r[1][a:b]), new.text[x:y]) == new.text[x:y] and r[1][a:b] not in new.text  # same value, same surrogate
    assert len(set(found.values())) == len(found) and not {v for _, v in found} & set(found.values())
    assert got["c40"].text is None and got["c41"].text == "" and got["c42"].text == "clean" and got["c42"].n_entities == 0
    name = got[f"c{len(rows) - 1}"].text.replace(".", "").split(" ")
    assert name[1] == name[-1] and name[2] == name[6] and name[1] != "John"
    monkeypatch.setattr(surrogates, "MAX_EXCEPTIONS", -1)
    assert {r.copy: r.text for r in surrogates.replaced(docs).collect()} == {c: r.text for c, r in got.items()}
    assert surrogates.replaced(empty).count() == 0 and surrogates.replaced(odd[0]).count() == len(odd[1])


def test_full_formats_have_surrogates_of_their_own(spark, tmp_path):
    for size in [*range(2, 70), 1000]:
        got = [surrogates._permute(x, size, b"k", "c") for x in range(size)]
        assert sorted(got) == list(range(size)) and all(x != y for x, y in enumerate(got))
    names = [a.upper() + b for a in surrogates._CONSONANTS for b in ("", *surrogates._VOWELS)] + [*"AEIOUY", "Ł", "Ś"]
    rows = [(i, f"Mr. {n}.") for i, n in enumerate(names)] + [(900 + i, f"at 192.168.{i >> 8}.{i & 255}") for i in range(300)]
    got = surrogates.assigned(table(spark, rows, tmp_path / "d.parquet")).collect()
    assert len(got) == len(rows) == len({(r.type, r.surrogate) for r in got}) and all(r.surrogate != r.value for r in got)


# 9 WARC


def test_warc_ranges(tmp_path):
    nested = warc.page_record(9, "http://inner", "x" * 50)
    raw = b"".join(warc.page_record(i, f"http://x/{i}", f"<p>{i} é</p>" * (i % 7)) for i in range(30))
    packer = __import__("zlib").compressobj(0, 8, 31)  # stored, so that the nested member is visible
    body = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(nested) + nested + b"\r\n\r\n"
    stored = packer.compress(body) + packer.flush()
    data = raw + stored + raw
    path = str(tmp_path / "a.warc.gz")
    for damage, content in ((0, data), (1, raw + b"\x00" * 100 + raw), (2, raw + b"\x1f\x8b\x08garbage" * 5 + raw)):
        with open(path, "wb") as f:
            f.write(content)
        size = len(content)
        whole = list(warc._range(path, 0, size, size))
        assert len(whole) == (61 if damage == 0 else 60)
        for split in (64, 777, 5000):
            assert [x for a in range(0, size, split) for x in warc._range(path, a, min(size, a + split), size)] == whole


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/é", "<p>x</p>"), (2, None, "y"), (3, "http://b", None), (None, "http://c\r\nX: y", ""), (1, "http://a/é", "<p>x</p>"), (4, "http://d", "z\r\n\r\nWARC/1.0\r\n\r\n" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    pages.write.parquet(str(tmp_path / "p"))
    read = spark.read.parquet(str(tmp_path / "p"))
    for split in (100, 1 << 20):
        assert Counter(tuple(r) for r in warc.pages(warc.read(warc.write(read), split)).collect()) == Counter(rows)
    assert warc.read(warc.write(read.limit(0))).count() == 0


# 10 quality rules


def test_quality_rules(spark, tmp_path, odd, empty):
    docs, rows = odd
    labels = spark.createDataFrame([(i, 1, int(i < 110)) for i in range(100, 130)] + [(None, 1, 1), (100, 0, 1), (101, 1, None)], "doc_id long, quality int, toxic int")
    words = table(spark, [(i, f"plain {prose(random.Random(i), 30)} {'vile nasty' if i < 110 else 'fine'}") for i in range(100, 130)], tmp_path / "d.parquet")
    terms = quality.toxic_terms(words, labels)
    assert terms == ["nasty", "vile"]
    marks = lambda text: {r for i, r in enumerate(quality.RULES) if quality.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string"), terms).first().fail_bits >> i & 1}
    assert "empty" in marks(None) and "empty" in marks(" \n") and "toxic_terms" in marks("a vile and NASTY text") and "toxic_terms" not in marks("a vile text")
    assert {"shouting", "exclaiming"} <= marks("LOUD!! WORDS!! " * 20) and "repeated_bigrams" in marks("again " * 50) and "table" in marks("a | b | c") and "repeated_lines" in marks("x\nx\nx\ny")
    book = quality.ledger(docs, terms)
    assert book.count() == len(rows)
    for p in quality.POLICIES:
        n = quality.accepted(docs, terms, p).count()
        assert n == book.where("keep_" + p.replace(".", "_")).count()
    kept = quality.accepted(docs, terms, "lenient.1")
    assert kept.columns == docs.columns and {r["_p"] for r in kept.collect()} == {"p"}
    for r in quality.ablations(book).collect():
        without = [f for f in quality.POLICIES[r.policy] if f != r.rule]
        quality.POLICIES["tmp"] = tuple(without)
        m = quality.mask("tmp")
        del quality.POLICIES["tmp"]
        assert r.rejected_without == sum((x.fail_bits & m) != 0 for x in book.collect()) and r.rejected - r.rejected_without == r.only_this
    assert quality.ledger(empty, quality.toxic_terms(empty, labels.limit(0))).count() == 0


# pipeline


def test_pipeline(spark, tmp_path, odd, empty):
    rng = random.Random(9)
    item = prose(rng, 20, 60)
    base = prose(rng, 100)
    rows = [*odd[1], (20, "JUNK!! " * 60), (21, base), (22, base + " x"), (23, "start " + item + " end of this text"), *((30 + i, prose(rng, 50), f"s{i % 3}") for i in range(30))]
    docs = table(spark, rows, tmp_path / "documents.parquet")
    spark.createDataFrame([(21, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*(c for c in docs.columns if c != "shard"), "shard", "position"]
    got = out.collect()
    ids = {r.doc_id for r in got}
    assert 20 not in ids and 22 not in ids and {21, 23, 1, 9, *range(30, 60)} <= ids and not {2, 3, 4, 5, 6} & ids
    assert all(item not in (r.text or "") for r in got) and next(r.text for r in got if r.doc_id == 23) == "start  end of this text"
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
