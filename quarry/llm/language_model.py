"""A gated recurrent language model: trained on every document by truncated backpropagation in numpy, then scores each document.

Words (lower case) are the symbols. The most frequent ones of the whole corpus have ids by rank, all others share a few
buckets by hash. The number of ids grows with the square root of the corpus, the classes with the root of the ids. The
output is factored: ids of neighbouring ranks form classes, P(word) = P(class) P(word | class). A word in a bucket also
has P(word | bucket): its discounted count in the whole corpus, what is discounted is spread evenly over the hashes of
words that the corpus doesn't have. All counts stay in tables; words meet them in an exchange by hash.

Training: a task lays its documents end to end in lanes and goes through them in windows; the hidden state is carried
from window to window and reset where a document begins, gradients end at a window. Tasks start from the same model and
their results are averaged by words, in two rounds: the first words of every task, then all the others. Scoring
carries the state through all windows of a document, and the log-likelihood is that of all words of the complete text.

Defined results
* Null, empty and word-less texts have no words, log-likelihood 0 and a null perplexity. Every row is scored by itself:
  repeated rows have equal scores, up to rounding in the last digits; doc_id may be null. Other columns are not read.
* An empty table gives no rows; documents without any words leave the model at its start.
* Ties in the counts of words are broken by hash, so ids are the same on every run.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_BITS, input_bytes, partition_id, tokenize, written

MIN_CLASSES, BUCKETS = 32, 64
#: Ids of the smallest model; there are as many classes as ids in a class.
VOCABULARY = MIN_CLASSES**2
#: Taken from the count of each word in a bucket, for words that the corpus doesn't have.
DISCOUNT = 0.5
HIDDEN, EMBEDDING = 16, 16
LANES, WINDOW = 512, 16
FIRST_ROUND_WORDS = 300_000
COUNT_BYTES = 32 << 20
RATES = (0.01, 0.004)
_SLICE = 1 << 14
#: Documents in a row of the table of words; words and documents that a task scores at once.
_ROW, _LOT = 256, 5_000_000
#: Distinct words of rows that a task adds up before it hands on their counts.
_HELD = 1 << 21
_HASHED = ["doc_ids", "bounds", "words", "codes"]
#: Numbers that steps over large arrays take at once, so that they stay in a core's cache.
_BLOCK = 1 << 15
#: Sums of exp() up to this and down to one over it need no maximum taken off before.
_SAFE = 1e12


def classes_for(n_words: int) -> int:
    """Classes of a model of a corpus of so many words: its ids are about the root of that."""
    return max(MIN_CLASSES, math.ceil(n_words**0.25))


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    """Of C and O, outputs for classes and for the words of each, the last column are the biases."""
    return {"E": (classes**2 + 1, EMBEDDING), "Wx": (EMBEDDING, 3 * HIDDEN), "Wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "C": (classes, HIDDEN + 1), "O": (classes, classes, HIDDEN + 1)}


def _size(classes: int) -> int:
    return sum(math.prod(s) for s in shapes(classes).values())


class Vocabulary:
    """Hashes of the words with ids, by rank, and what the words in buckets need: their table of counts by part, and the sums of each bucket."""

    def __init__(self, words: np.ndarray, classes: int, parts: int, n: np.ndarray, distinct: np.ndarray, counted: DataFrame | None) -> None:
        self.words, self.classes, self.parts, self.n, self.distinct, self.counted = words, classes, parts, n, distinct, counted

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counted": None}

    def log_tails(self, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log P(word | bucket) of words in buckets, which have these counts in the corpus."""
        bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        total, left = np.maximum(self.n, 1), np.where(self.n > 0, self.distinct * DISCOUNT, 1.0)
        return np.log(np.where(n > 0, n - DISCOUNT, left[bucket] * (BUCKETS / 2.0**64)) / total[bucket])


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The first of the sorted hashes of each part, and the end."""
    return np.searchsorted(((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def hashed(docs: DataFrame) -> DataFrame:
    """The words of docs as a table in the shared folder, so that texts are taken apart once. A row has some documents: their ids, the first word of each and the end, distinct hashes of words, and the place of every word among these."""
    if docs.columns == _HASHED:
        return docs

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROW):
                some = batch.slice(at, _ROW)
                tokens = tokenize(some.column("text").to_pylist())
                words, codes = np.unique(tokens.hashes, return_inverse=True)
                doc_ids = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), pa.concat_arrays([some.column("doc_id")]))
                blobs = [pa.array([x.tobytes()], pa.binary()) for x in (tokens.bounds.astype(np.int64), words, codes.astype(np.uint16 if len(words) <= 1 << 16 else np.int32))]
                yield pa.RecordBatch.from_arrays([doc_ids, *blobs], _HASHED)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_ids array<bigint>, bounds binary, words binary, codes binary"), "hashes")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of documents, first words, distinct hashes and places among these, of each row of a hashed() table."""
    for batch in batches:
        for i in range(batch.num_rows):
            bounds, words = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("bounds", np.int64), ("words", np.uint64)))
            codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint16 if len(words) <= 1 << 16 else np.int32)
            yield batch.column("doc_ids")[i].values, bounds, words, codes


def _lots(rows: Iterable[tuple], size: Callable[[tuple], int], most: int) -> Iterator[list[tuple]]:
    """Rows one after the other, until their sizes come to most."""
    lot: list[tuple] = []
    total = 0
    for row in rows:
        lot.append(row)
        total += size(row)
        if total >= most:
            yield lot
            lot, total = [], 0
    if lot:
        yield lot


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary of all documents, and the counts of all ids (words, then buckets)."""
    docs = hashed(docs)
    parts = max(8, -(-input_bytes(docs) // COUNT_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((words, np.bincount(codes, minlength=len(words))) for _, _, words, codes in _rows(batches) if len(words))
        for lot in _lots(found, lambda row: len(row[0]), _HELD):
            words, place = np.unique(np.concatenate([w for w, _ in lot]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([n for _, n in lot])).astype(np.int64)
            ends = _part(words, parts)
            rows = [(p, words[ends[p] : ends[p + 1]].tobytes(), n[ends[p] : ends[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(ends)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["part", "words", "n"])

    def add(table: pa.Table) -> pa.Table:
        words = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("words")])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("n")])
        words, place = np.unique(words, return_inverse=True)
        n = np.bincount(place, weights=n).astype(np.int64)
        return pa.table({"part": table.column("part")[:1], "total": pa.array([int(n.sum())]), "words": pa.array([words.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})

    made = docs.mapInArrow(count, "part int, words binary, n binary")
    counted = written(made.groupBy("part").applyInArrow(add, "part int, total long, words binary, n binary"), "words")
    classes = classes_for(counted.agg(F.sum("total")).first()[0] or 0)
    known = classes**2 - BUCKETS

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, c in zip(batch.column("words"), batch.column("n")):
                words, n = np.frombuffer(w.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64)
                top, bucket = np.lexsort((words, -n))[:known], (words % np.uint64(BUCKETS)).astype(np.int64)
                sums = np.bincount(bucket, weights=n, minlength=BUCKETS).astype(np.int64), np.bincount(bucket, minlength=BUCKETS)
                columns = np.r_[words[top].view(np.int64), np.arange(BUCKETS)], np.r_[n[top], sums[0]], np.r_[np.zeros(len(top), np.int64), sums[1]], np.r_[np.zeros(len(top), bool), np.ones(BUCKETS, bool)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["word", "n", "distinct", "bucket"])

    rows = counted.select("words", "n").mapInArrow(best, "word long, n long, distinct long, bucket boolean")
    top = rows.where("NOT bucket").orderBy(F.desc("n"), "word").limit(known).toPandas()
    other = rows.where("bucket").groupBy("word").agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct")).toPandas()
    words, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    bucket, at = (words % np.uint64(BUCKETS)).astype(np.int64), other["word"].to_numpy(np.int64)
    sums, distinct = (-np.bincount(bucket, weights=w, minlength=BUCKETS).astype(float) for w in (n, None))
    sums[at] += other["n"].to_numpy(float)
    distinct[at] += other["distinct"].to_numpy(float)
    counts = np.zeros(classes**2)
    counts[: len(n)] = n
    counts[known:] = sums
    return Vocabulary(words, classes, parts, sums, distinct, counted), counts


class Ids:
    def __init__(self, vocabulary_: Vocabulary) -> None:
        self.order, self.first = np.argsort(vocabulary_.words), vocabulary_.classes**2 - BUCKETS
        self.sorted = vocabulary_.words[self.order]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        bucket = (self.first + (hashes % np.uint64(BUCKETS)).astype(np.int64)).astype(np.int32)
        if not len(self.sorted):
            return bucket
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at].astype(np.int32), bucket)


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys (>= 0), and the sorted keys."""
    both = keys.astype(np.int64) << 32
    both |= np.arange(len(keys))
    both.sort()
    return both & 0xFFFFFFFF, both >> 32


def _heads(keys: np.ndarray) -> np.ndarray:
    """The first place of each of the sorted keys."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


class Model:
    def __init__(self, flat: np.ndarray) -> None:
        self.classes = next(c for c in itertools.count(1) if _size(c) >= len(flat))
        self.flat, self.p, self.bos, self.wide, at = flat, {}, self.classes**2, False, 0
        for name, shape in shapes(self.classes).items():
            size = math.prod(shape)
            self.p[name] = flat[at : at + size].reshape(shape)
            at += size
        c, o = self.p["C"], self.p["O"]
        self.p |= {"Wc": c[:, :HIDDEN].T, "bc": c[:, HIDDEN], "Wo": o[:, :, :HIDDEN].transpose(0, 2, 1), "bo": o[:, :, HIDDEN]}

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 1) -> Model:
        """Small random weights; the output biases are those of the words' frequencies."""
        classes = math.isqrt(len(counts))
        model = cls(np.zeros(_size(classes), np.float32))
        rng = np.random.default_rng(seed)
        for name in ("E", "Wx", "Wh", "Wc", "Wo"):
            model.p[name][:] = rng.normal(0, 0.1 if name in ("Wc", "Wo") else 0.25, model.p[name].shape)
        share = (counts + 0.5).reshape(classes, classes)
        model.p["bc"][:] = np.log(share.sum(1) / share.sum())
        model.p["bo"][:] = np.log(share / share.sum(1, keepdims=True))
        return model

    def _steps(self, x: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states [unit, time, lane] after reading x, from h [unit, lane]: lanes lie side by side, so that each step goes through long rows."""
        p, n = self.p, HIDDEN
        read = np.empty((2 * n, *x.shape), np.float32)  # states before, then what is read
        read.reshape(2 * n, -1)[n:] = np.take(p["E"], x.ravel(), axis=0).T  # take() is much faster than an index
        into, weights = p["Wx"].T.copy(), p["Wh"].T.copy()
        into[: 2 * n] *= -1  # so that gates are 1 / (1 + exp(sum))
        weights[: 2 * n] *= -1
        inputs = into @ read[n:].reshape(n, -1)
        inputs[: 2 * n] -= p["b"][: 2 * n, None]
        inputs[2 * n :] += p["b"][2 * n :, None]
        inputs = inputs.reshape(3 * n, *x.shape)
        out = np.empty((n, *x.shape), np.float32)
        alive = (x != self.bos).astype(np.float32)
        for t in range(len(x)):
            before = np.multiply(h, alive[t], out=read[:n, t])
            a = weights @ before
            gates = inputs[: 2 * n, t] + a[: 2 * n]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:n], gates[n:]
            c = r * a[2 * n :]
            c += inputs[2 * n :, t]
            np.tanh(c, out=c)
            h = out[:, t]
            np.subtract(before, c, out=h)
            h *= z
            h += c
            if keep is not None:
                keep.append((before, a[2 * n :], z, r, c))
        if keep is not None:
            keep.append(read)
        return out

    def states(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Hidden states [time, lane] after reading x, from h; a document's first symbol (bos) resets its lane."""
        return self._steps(x, h.T).transpose(1, 2, 0)

    def _normalizers(self, one: np.ndarray, weights: np.ndarray, ends: list[int], logp: np.ndarray, sums: np.ndarray, grads: np.ndarray | None, share: float) -> float:
        """For rows of one (states, then 1) up to each end and one matrix each, puts the weights (and 1) expected by exp(), not divided by the normalizer that is the last, into sums, or that one alone.

        With grads, also the gradient by the weights of share times the normalizers' logarithms. Biases come after exp() as factors, unless logits may be too large; returns the largest one.
        """
        rows, back, left, by = max(16, _BLOCK // weights.shape[1]), weights.copy(), one, None
        back[..., HIDDEN] = 1
        front = weights.reshape(-1, HIDDEN + 1).T
        if not self.wide:
            by = np.exp(weights[..., HIDDEN:])
            back *= by
            left, front = one[:, :HIDDEN], front[:HIDDEN]
        front, k = np.ascontiguousarray(front), weights.shape[1]
        back = back[..., -sums.shape[1] :]
        for c, (begin, end) in enumerate(itertools.pairwise(ends)):
            for at in range(begin, end, rows):
                some = slice(at, min(at + rows, end))
                e = left[some] @ front[:, c * k : (c + 1) * k]
                if self.wide:
                    top = e.max(1)
                    e -= top[:, None]
                    logp[some] -= top
                np.exp(e, out=e)
                found = np.matmul(e, back[c], out=sums[some])
                if grads is not None:
                    parts = one[some] * (share / found[:, -1:])
                    if at > begin:
                        grads[c] += e.T @ parts
                    else:
                        np.matmul(e.T, parts, out=grads[c])
        if by is None:
            return 1.0
        if grads is not None:
            grads *= by
        return float(by.max())

    def output(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probability of each next symbol y (>= 0) after state h; with grads (zeros), also the gradient by h of the negative mean."""
        p, n, m, share = self.p, HIDDEN, len(y), np.float32(1 / max(len(y), 1))
        order, y = _ordered(y)
        back = np.empty_like(order)
        back[order] = np.arange(m)
        cls, outputs = y // self.classes, p["O"].reshape(-1, n + 1)
        one = np.ones((m, n + 1), np.float32)
        one[:, :n] = np.take(h, order, axis=0)
        own = np.take(p["C"], cls, axis=0)
        own += np.take(outputs, y, axis=0)
        ends = np.searchsorted(y, np.arange(self.classes + 1) * self.classes).tolist()
        logp = np.einsum("ij,ij->i", one, own)
        sums = np.ones((2, m, 1 if grads is None else n + 1), np.float32)
        gc, go = (None, None) if grads is None else (grads["C"], grads["O"])
        step, factor = max(1, _BLOCK // outputs[: self.classes].size), 1.0
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            if m:
                factor = self._normalizers(one, p["C"][None], [0, m], logp, sums[0], None if gc is None else gc[None], share)
            for c in range(0, self.classes, step):
                some = ends[c : c + step + 1]
                if some[0] < some[-1]:
                    factor = max(factor, self._normalizers(one, p["O"][c : c + step], some, logp, sums[1], None if go is None else go[c : c + step], share))
        totals = sums[:, :, -1]
        if m and not self.wide and not (totals.min() > 1 / _SAFE and totals.max() < _SAFE and factor < _SAFE):
            self.wide = True  # logits are too large for exp(), here and maybe from now on
            if grads is not None:
                gc[:], go[:] = 0, 0
            return self.output(h, y[back], grads)
        logp -= np.log(totals).sum(0)
        if grads is None:
            return logp[back], None
        if m:
            heads = _heads(y)  # what the symbols that do follow take away
            taken = np.add.reduceat(one, heads, axis=0) * share
            go.reshape(-1, n + 1)[y[heads]] -= taken
            firsts = _heads(cls[heads])
            gc[cls[heads][firsts]] -= np.add.reduceat(taken, firsts, axis=0)
        mean, more = sums
        mean /= mean[:, -1:]
        more /= more[:, -1:]
        mean += more
        mean -= own
        mean *= share
        return logp[back], np.take(mean, back, axis=0)[:, :n]

    def gradient(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, grads: Model) -> np.ndarray:
        """Fills grads for one window; returns the last states. y < 0: nothing follows."""
        p, n, g = self.p, HIDDEN, grads.p
        grads.flat[:] = 0
        kept: list = []
        out = self._steps(x, h.T, kept)
        read = kept.pop()
        live = np.flatnonzero(y.ravel() >= 0)
        top = np.zeros((x.size, n), np.float32)
        if len(live):
            top[live] = self.output(np.take(np.ascontiguousarray(out.reshape(n, -1).T), live, axis=0), y.ravel()[live], g)[1]
        top = np.ascontiguousarray(top.T).reshape(out.shape)
        alive, carry = (x != self.bos).astype(np.float32), np.zeros((n, x.shape[1]), np.float32)
        d = np.empty((4 * n, *x.shape), np.float32)  # by the inputs of c, z and r, and by what h gives to c
        for t in reversed(range(len(x))):
            before, a, z, r, c = kept[t]
            dc, dz, dr, da = (d[k : k + n, t] for k in range(0, 4 * n, n))
            carry += top[:, t]
            new = 1 - z
            new *= carry
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= new
            np.subtract(before, c, out=dz)
            dz *= z
            dz *= new
            np.multiply(dc, r, out=da)
            np.subtract(1, r, out=dr)
            dr *= da
            dr *= a
            carry *= z
            carry += p["Wh"] @ d[n:, t]
            carry *= alive[t]
        d, ids = d.reshape(4 * n, -1), x.ravel()
        by = read.reshape(2 * n, -1) @ d.T
        g["Wh"][:] = by[:n, n:]
        g["Wx"][:] = np.roll(by[n:, : 3 * n], -n, axis=1)  # of c, z, r; weights have z, r, c
        into = d[: 3 * n]
        g["b"][:] = np.roll(into @ np.ones(x.size, np.float32), -n)
        de = into.T @ np.roll(p["Wx"].T, n, axis=0)
        order, ids = _ordered(ids)
        heads = _heads(ids)
        g["E"][ids[heads]] = np.add.reduceat(np.take(de, order, axis=0), heads, axis=0)
        return out[:, -1].T


class Trainer:
    """Adam on one task's documents."""

    def __init__(self, flat: np.ndarray, rate: float) -> None:
        self.model, self.rate, self.words, self.updates = Model(flat.copy()), rate, 0, 0
        self.grads, self.m, self.v = Model(np.zeros_like(flat)), np.zeros_like(flat), np.zeros_like(flat)

    def train(self, documents: list[np.ndarray]) -> None:
        bos = self.model.bos
        begin = np.full(1, bos, np.int32)
        stream = np.concatenate([part for d in documents for part in (begin, d)])
        self.words += len(stream) - len(documents)
        lanes = max(1, min(LANES, len(stream) // WINDOW))
        steps = -(-len(stream) // lanes)
        padded = np.full(lanes * steps + 1, bos, np.int32)
        padded[: len(stream)] = stream
        x = padded[:-1].reshape(lanes, steps).T
        y = padded[1:].reshape(lanes, steps).T
        y = np.where(y == bos, -1, y)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, steps, WINDOW):
            h = self.model.gradient(np.ascontiguousarray(x[at : at + WINDOW]), y[at : at + WINDOW], h, self.grads)
            self.update()

    def update(self) -> None:
        self.updates += 1
        norm = float(np.sqrt(self.grads.flat @ self.grads.flat))
        scale = float(self.rate * np.sqrt(1 - 0.99**self.updates) / (1 - 0.9**self.updates))
        block = _BLOCK
        step = np.empty(block, np.float32)
        for at in range(0, len(self.m), block):  # m is 10 times the mean of gradients, v 100 times that of their squares
            g, m, v, flat = (x[at : at + block] for x in (self.grads.flat, self.m, self.v, self.model.flat))
            t = step[: len(g)]
            if norm > 1:
                g *= 1 / norm
            m *= 0.9
            m += g
            v *= 0.99
            np.multiply(g, g, out=t)
            v += t
            np.sqrt(v, out=t)
            t += 1e-5
            np.divide(m, t, out=t)
            t *= scale
            flat -= t


def _documents(bounds: np.ndarray, symbols: np.ndarray) -> Iterator[np.ndarray]:
    return (symbols[a:b] for a, b in itertools.pairwise(bounds.tolist()))


def _round(docs: DataFrame, flat: np.ndarray, words: Vocabulary, first: bool) -> np.ndarray:
    """Every task trains from the same weights; returns their average by words."""
    shared, rate = docs.sparkSession.sparkContext.broadcast((flat, words)), RATES[0 if first else 1]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, vocabulary_ = shared.value
        ids, trainer, seen = Ids(vocabulary_), Trainer(start, rate), 0
        lot: list[np.ndarray] = []
        size = 0
        for document in (d for _, bounds, known, codes in _rows(batches) for d in _documents(bounds, ids.of(known)[codes])):
            early = seen < FIRST_ROUND_WORDS
            seen += len(document)
            if early != first:
                if first:
                    break
            elif len(document):
                lot.append(document)
                size += len(document)
                if size > 150_000:
                    trainer.train(lot)
                    lot, size = [], 0
        if lot:
            trainer.train(lot)
        if trainer.words:
            slices = [trainer.model.flat[at : at + _SLICE].tobytes() for at in range(0, len(trainer.model.flat), _SLICE)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(len(slices)), pa.int32()), "n": pa.array([float(trainer.words)] * len(slices)), "weights": pa.array(slices, pa.binary())})

    def average(table: pa.Table) -> pa.Table:
        total, n = 0.0, 0.0
        for w, blob in zip(table.column("n").to_pylist(), table.column("weights")):
            total = total + w * np.frombuffer(blob.as_buffer(), np.float32).astype(np.float64)
            n += w
        return pa.table({"slice": table.column("slice")[:1], "weights": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})

    found = docs.mapInArrow(train, "slice int, n double, weights binary").groupBy("slice").applyInArrow(average, "slice int, weights binary").collect()  # the weights of one model
    return np.frombuffer(b"".join(bytes(r.weights) for r in sorted(found, key=lambda r: r.slice)), np.float32) if found else flat


def trained(docs: DataFrame) -> tuple[np.ndarray, Vocabulary]:
    """Weights and vocabulary of a model of all documents."""
    docs = hashed(docs)
    words, counts = vocabulary(docs)
    flat = Model.start(counts).flat
    for first in (True, False):
        flat = _round(docs, flat, words, first)
    return flat, words


def log_likelihoods(model: Model, documents: list[np.ndarray]) -> np.ndarray:
    """Of the ids of complete documents: they are spread over lanes, longest first, each to the shortest lane."""
    out, bos = np.zeros(len(documents)), model.bos
    order = sorted((i for i in range(len(documents)) if len(documents[i])), key=lambda i: -len(documents[i]))
    if not order:
        return out
    lanes = [(0, k) for k in range(min(LANES, len(order)))]
    pieces: list[list[int]] = [[] for _ in lanes]
    for i in order:
        size, k = lanes[0]
        pieces[k].append(i)
        heapq.heapreplace(lanes, (size + len(documents[i]) + 1, k))
    # the longest lanes first, so that those still going are the first ones; each begins with the symbol before its first word
    lanes.sort(reverse=True)
    placed, begin = [i for _, k in lanes for i in pieces[k]], np.full(1, bos, np.int32)
    stream = np.concatenate([part for i in placed for part in (begin, documents[i])])
    owners = np.repeat(np.array(placed, np.int32), [len(documents[i]) + 1 for i in placed])
    lengths = np.array([length for length, _ in lanes])
    starts = np.cumsum(lengths) - lengths
    h = np.zeros((HIDDEN, len(lanes)), np.float32)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def add() -> None:
        states, y, owner = (np.concatenate(c) for c in zip(*held))
        out[:] += np.bincount(owner, weights=model.output(states, y)[0], minlength=len(out))

    for at in range(0, lanes[0][0], WINDOW):
        going = int(np.searchsorted(-lengths, -at))
        place = np.arange(at, at + WINDOW + 1)[:, None]
        past, place = place >= lengths[:going], np.minimum(place + starts[:going], len(stream) - 1)
        x = np.take(stream, place)
        x[past] = bos
        y, owner = x[1:].ravel(), np.take(owners, place[:-1]).ravel()
        states = model._steps(x[:-1], h[:, :going])
        h = states[:, -1]
        live = np.flatnonzero(y != bos)
        held.append((np.take(np.ascontiguousarray(states.reshape(HIDDEN, -1).T), live, axis=0), y[live], owner[live]))
        size += len(live)
        if size >= 4 * LANES * WINDOW:  # outputs of many windows at once
            add()
            held, size = [], 0
    if size:
        add()
    return out


def scored(docs: DataFrame, flat: np.ndarray, words: Vocabulary) -> DataFrame:
    """doc_id, n_words, log_likelihood (natural, of the whole text) and perplexity by word.

    The network's part is scored first. The words in buckets go to the parts of the corpus' counts, their sums come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast((flat, words))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, vocabulary_ = shared.value
        model, ids, base = Model(weights), Ids(vocabulary_), partition_id() << ROW_BITS
        for lot in _lots(_rows(batches), lambda row: len(row[0]) + len(row[3]), _LOT):
            rare: list[tuple[np.ndarray, np.ndarray]] = []
            documents: list[np.ndarray] = []
            for _, bounds, known, codes in lot:
                symbols = ids.of(known)[codes]
                some = np.flatnonzero(symbols >= ids.first)
                rare.append((np.searchsorted(bounds, some, "right") - 1 + len(documents), known[codes[some]]))
                documents += _documents(bounds, symbols)
            n = np.array([len(d) for d in documents], np.int64)
            logp = log_likelihoods(model, documents)
            owner, hashes = (np.concatenate(x) for x in zip(*rare))
            order = np.argsort(hashes)
            owner, hashes = owner[order].astype(np.int32), hashes[order]
            ends = _part(hashes, vocabulary_.parts)
            rows = [(p, base, owner[ends[p] : ends[p + 1]].tobytes(), hashes[ends[p] : ends[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(ends)).tolist()]
            m = len(documents)
            columns = [pa.array([-1] * m + [r[0] for r in rows], pa.int32()), pa.array([base] * (m + len(rows)), pa.int64()), pa.array([*range(m), *[m] * len(rows)], pa.int32())]
            columns += [pa.concat_arrays([*(row[0] for row in lot), pa.nulls(len(rows), pa.int64())]), pa.array(np.r_[n, np.zeros(len(rows), np.int64)]), pa.array(np.r_[logp, np.zeros(len(rows))])]
            columns += [pa.array([None] * m + [r[i] for r in rows], pa.binary()) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "base", "place", "doc_id", "n_words", "logp", "owner", "hashes"])
            base += m

    def look(sent: pa.Table, counted: pa.Table) -> pa.Table:
        vocabulary_, bases, tails = shared.value[1], sent.column("base").to_pylist(), []
        known = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in counted.column("words")] or [np.zeros(0, np.uint64)])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in counted.column("n")] or [np.zeros(0, np.int64)])
        for x, y in zip(sent.column("owner"), sent.column("hashes")):
            hashes, owner = np.frombuffer(y.as_buffer(), np.uint64), np.frombuffer(x.as_buffer(), np.int32)
            n = np.zeros(len(hashes), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                n = np.where(known[at] == hashes, counts[at], 0)
            tails.append(np.bincount(owner, weights=vocabulary_.log_tails(hashes, n)).tobytes())
        return pa.table({"base": pa.array(bases, pa.int64()), "tails": pa.array(tails, pa.binary())})

    def total(documents: pa.Table, tails: pa.Table) -> pa.Table:
        place, logp, n = (documents.column(c).to_numpy() for c in ("place", "logp", "n_words"))
        added = np.zeros(len(place))
        for blob in tails.column("tails"):
            some = np.frombuffer(blob.as_buffer(), np.float64)
            added[: len(some)] += some
        logp = logp + added[place]
        with np.errstate(over="ignore"):
            perplexity = np.exp(-logp / np.maximum(n, 1))
        return pa.table({"doc_id": documents.column("doc_id"), "n_words": n, "log_likelihood": logp, "perplexity": pa.array(perplexity, mask=n == 0)})

    made = written(hashed(docs).mapInArrow(score, "part int, base long, place int, doc_id long, n_words long, logp double, owner binary, hashes binary"), "scores")
    sent = made.where("part >= 0").select("part", "base", "owner", "hashes")
    tails = sent.groupBy("part").cogroup(words.counted.select("part", "words", "n").groupBy("part")).applyInArrow(look, "base long, tails binary")
    documents = made.where("part < 0").select("base", "place", "doc_id", "n_words", "logp")
    return documents.groupBy("base").cogroup(tails.groupBy("base")).applyInArrow(total, "doc_id long, n_words long, log_likelihood double, perplexity double")
