"""All pairs of documents whose sets of word n-grams have a Jaccard similarity of at least a threshold: exact, without caps.

Vertical partitioning: n-grams are ordered globally by level (how many classes have them: up to 64, 4096, 262144 or
more) and then by hash, the order is cut into fragments, every fragment counts what two documents share within it, and
the partial counts are summed per pair.

Passages that many documents share must not make pairs of all of these. So a fragment of a level above the first counts
only pairs of which both have a fifth of their joint size in n-grams of this level and those above. Of other pairs, the
sum of the levels below, and at most what either has above, tells whether they can be similar; for those that can be,
the levels above are intersected. No pair is lost by this, as similar documents share more than either has above, or
have enough there to be counted.

Before that, documents that cannot be in any pair are left out, exactly: similarity t needs t * size common n-grams, so
a document with fewer n-grams that any other has is out. That, too, is counted fragment by fragment, on 32 bits of each
hash (a collision only keeps a document in). Documents with equal sets are one class, which is joined once.

Defined results
* A document's set holds the hashes of its windows of n words (lower case); with fewer than n words, the one window of
  all. Texts that are null or without words are in no pair, whatever their number.
* Rows without doc_id are in no pair, as they cannot be named; rows that share a doc_id are no pair with each other, and
  of several pairs of rows with the same two doc_ids the most similar is reported. Other columns are not read.
* A similarity equal to the threshold counts. An empty table has no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Chooser, grams, input_bytes, numbered_table, tokenize, written

#: Near copies with up to about one word in ten changed have a similarity of at least 0.4 on 5-grams.
N, THRESHOLD = 5, 0.4
FRAGMENT_BYTES = 16 << 20
_BATCH_ROWS, _BATCH_GRAMS = 32_000, 1_000_000
#: n-grams in a fragment of the join, of all its classes; counts that a task holds before it sums them, and twice the sums that it keeps.
FRAGMENT_GRAMS, _HELD_PAIRS = 1_000_000, 6_000_000
#: An n-gram's level is how many of these numbers of classes it exceeds.
LEVELS = (64, 64**2, 64**3)
#: A pair is counted in a level if each has this part of their joint size there and above: one in _SHARE.
_SHARE = 5


def _sets(batch: pa.RecordBatch, n: int, rows: int = 512) -> Iterator[np.ndarray]:
    for at in range(0, batch.num_rows, rows):
        tokens = tokenize(batch.column("text").slice(at, rows).to_pylist())
        hashes, firsts = grams(tokens.hashes, tokens.bounds, n)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            yield np.unique(hashes[a:b])


def _fragment(hashes: np.ndarray, fragments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def _cut(sets: list[np.ndarray], fragments: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(fragment, place in sets, hash), sorted by fragment and then by hash."""
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    order = np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    ends = np.searchsorted(_fragment(hashes, fragments), np.arange(fragments + 1, dtype=np.uint64))
    for f in np.flatnonzero(np.diff(ends)).tolist():
        yield f, owner[ends[f] : ends[f + 1]], hashes[ends[f] : ends[f + 1]]


def _shared_grams(scan: DataFrame, n: int, fragments: int) -> DataFrame:
    """(base rid, places, counts) for batches of rows and fragments: of the rows that share n-grams with others in the fragment, their place in the batch and how many. Without places: the sizes of the batch's sets."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sets, total = -1, [], 0

        def flush() -> pa.RecordBatch:
            rows = [(f, base, len(sets), owner.tobytes(), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()) for f, owner, hashes in _cut(sets, fragments)]
            rows.append((-1 - (base ^ base >> 33) % fragments, base, len(sets), b"", np.array([len(s) for s in sets], np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["fragment", "base", "rows", "owner", "hashes"])

        for batch in batches:
            rids = batch.column("rid").to_numpy()
            for rid, one in zip(rids.tolist(), _sets(batch, n)):
                if sets and rid != base + len(sets):  # the next file begins
                    yield flush()
                    base, sets, total = -1, [], 0
                if base < 0:
                    base = rid
                sets.append(one)
                total += len(one)
                if len(sets) >= _BATCH_ROWS or total >= _BATCH_GRAMS:
                    yield flush()
                    base, sets, total = -1, [], 0
        if sets:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        bases, places, counts = table.column("base").to_pylist(), [], []
        if table.column("fragment")[0].as_py() < 0:
            places, counts = [None] * len(bases), [x.as_py() for x in table.column("hashes")]
        else:
            owner = [np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("owner")]
            ends = np.cumsum([len(x) for x in owner])
            keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("hashes")]).astype(np.uint64) << np.uint64(32)
            keys |= np.arange(len(keys), dtype=np.uint64)  # places in the fragment, of which there are less than 2**32
            keys.sort()
            same = keys[1:] >> np.uint64(32) == keys[:-1] >> np.uint64(32)
            shared = np.zeros(len(keys), bool)
            shared[(keys[np.r_[False, same] | np.r_[same, False]] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
            del keys, same
            for mine, hit in zip(owner, np.split(shared, ends[:-1])):
                found, n = np.unique(mine[hit], return_counts=True)
                places.append(found.tobytes())
                counts.append(n.astype(np.uint32).tobytes())
        return pa.table({"base": pa.array(bases, pa.int64()), "places": pa.array(places, pa.binary()), "counts": pa.array(counts, pa.binary())})

    made = scan.select("rid", "text").mapInArrow(spread, "fragment int, base long, rows int, owner binary, hashes binary")
    return made.groupBy("fragment").applyInArrow(count, "base long, places binary, counts binary")


def _candidates(scan: DataFrame, n: int, threshold: float, fragments: int) -> DataFrame:
    """rids of the rows that could be in a pair."""

    def decide(table: pa.Table) -> pa.Table:
        shared, sizes = np.zeros(_BATCH_ROWS + 1, np.int64), np.zeros(0, np.int64)
        for places, counts in zip(table.column("places"), table.column("counts")):
            values = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
            if places.as_py() is None:
                sizes = values
            else:
                shared[np.frombuffer(places.as_buffer(), np.uint16)] += values
        shared = shared[: len(sizes)]
        hit = np.flatnonzero((sizes > 0) & (shared >= np.ceil(threshold * sizes - 1e-9))) if len(sizes) else np.zeros(0, np.int64)
        return pa.table({"rid": pa.array(hit + table.column("base")[0].as_py(), pa.int64())})

    return _shared_grams(scan, n, fragments).groupBy("base").applyInArrow(decide, "rid long")


def _partial_overlaps(sizes: np.ndarray, owner: np.ndarray, hashes: np.ndarray, threshold: float, enough: np.ndarray | None = None, dense: int = LEVELS[0]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (a, b, n): places a < b of two classes whose sizes allow the threshold, and how many hashes both have. A pair may come in several blocks. enough: how many n-grams of this level and those above a class has; hashes are sorted."""
    starts = _starts(hashes)
    counts = np.diff(np.r_[starts, len(hashes)])
    owner = owner.astype(np.int64)
    m = len(sizes)
    codes: list[np.ndarray] = []

    def fitting(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = code // m, code % m
        ok = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
        if enough is not None:
            ok &= _SHARE * np.minimum(enough[a], enough[b]) >= sizes[a] + sizes[b]
        return a[ok], b[ok], n[ok]

    held = 0
    for k in np.unique(counts[(counts > 1) & (counts <= dense)]).tolist():
        firsts = starts[counts == k]
        i, j = np.triu_indices(k, 1)
        step = max(1, 500_000 // len(i))
        for at in range(0, len(firsts), step):
            block = np.sort(owner[firsts[at : at + step, None] + np.arange(k)], axis=1)
            codes.append((block[:, i] * m + block[:, j]).ravel())
            held += codes[-1].size
            if held > 1_500_000:
                yield fitting(*np.unique(np.concatenate(codes), return_counts=True))
                codes, held = [], 0
    if codes:
        yield fitting(*np.unique(np.concatenate(codes), return_counts=True))
    # n-grams of many classes: incidence matrices of those with the same first class, multiplied in blocks
    heavy = np.flatnonzero(counts > dense)
    lead = np.array([owner[starts[h] : starts[h] + counts[h]].min() for h in heavy], np.int64)
    for first in np.unique(lead).tolist():
        members = [owner[starts[h] : starts[h] + counts[h]] for h in heavy[lead == first].tolist()]
        ids = np.unique(np.concatenate(members))
        for at in range(0, len(members), 512):
            some = members[at : at + 512]
            matrix = np.zeros((len(ids), len(some)), np.float32)
            for c, x in enumerate(some):
                matrix[np.searchsorted(ids, x), c] = 1
            rows = max(1, 1_000_000 // len(ids))
            for r in range(0, len(ids), rows):
                found = matrix[r : r + rows] @ matrix[r:].T
                a, b = np.nonzero(np.triu(found, 1))
                yield fitting(ids[a + r] * m + ids[b + r], found[a, b].astype(np.int64))


def _starts(hashes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)


def _in_fragments(made: DataFrame, fragments: int, counted: Callable[[list[dict], _Sums], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What counted yields for the rows of each fragment, and the sums of a task: it counts several fragments, one after the other, and sums their counts before it sends them on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        sums = _Sums()
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["fragment"] != row["fragment"]:
                    yield from counted(held, sums)
                    held = []
                held.append(row)
        if held:
            yield from counted(held, sums)
        yield from sums.taken(0)

    tasks = min(fragments, max(8, 2 * made.sparkSession.sparkContext.defaultParallelism))
    return made.repartitionById(tasks, F.col("fragment") % tasks).sortWithinPartitions("fragment").mapInArrow(count, _COUNTED)


def _joined_rows(held: list[dict]) -> tuple[np.ndarray, ...]:
    """sig, size and enough of the classes of a fragment's rows, and the owner (a place among them) and hash of each n-gram, by hash. Empties held."""
    sigs = [np.frombuffer(r["sigs"], np.int64) for r in held]
    first = np.r_[0, np.cumsum([len(s) for s in sigs])]
    owner = np.concatenate([np.frombuffer(r["owner"], np.uint16).astype(np.int32) + np.int32(first[i]) for i, r in enumerate(held)])
    hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in held])
    sizes, enough = (np.concatenate([np.frombuffer(r[c], np.int32) for r in held]).astype(np.int64) for c in ("sizes", "enough"))
    held.clear()
    order = np.argsort(hashes, kind="stable")
    return np.concatenate(sigs), sizes, enough, owner[order], hashes[order]


def _cut_rows(sets: list[np.ndarray], sigs: np.ndarray, sizes: np.ndarray, enough: np.ndarray, fragments: int, shift: int = 0) -> pa.RecordBatch:
    rows = []
    for f, owner, hashes in _cut(sets, fragments):
        present, place = np.unique(owner, return_inverse=True)
        rows.append((f + shift, *[x[present].tobytes() for x in (sigs, sizes, enough)], place.astype(np.uint16).tobytes(), hashes.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int32(), *[pa.binary()] * 5))], ["fragment", "sigs", "sizes", "enough", "owner", "hashes"])


_CUT = "fragment int, sigs binary, sizes binary, enough binary, owner binary, hashes binary"
#: Of pairs of classes (level 0): sig_a, sig_b, both sizes and a partial count. Of n-grams of a level above: a class, the n-gram, the class' size, and 1.
_COUNTED = "level int, x long, y long, sizes long, n long"


def _first_level(chooser: Chooser, n: int, threshold: float, fragments: int, levels: tuple[int, ...]) -> DataFrame:
    """_COUNTED: counts of the pairs of classes that share n-grams of level 0, and all n-grams of the levels above."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], np.int32)
            return _cut_rows(sets, np.array([_signature(s) for s in sets], np.int64), sizes, sizes, fragments)

        total = 0
        for batch in batches:
            for one in _sets(chooser.of(batch), n):
                if len(one):
                    sets.append(one)
                    total += len(one)
                if len(sets) >= _BATCH_ROWS or total >= _BATCH_GRAMS:
                    yield flush()
                    sets, total = [], 0
        if sets:
            yield flush()

    def counted(held: list[dict], sums: _Sums) -> Iterator[pa.RecordBatch]:
        sig, sizes, _, owner, hashes = _joined_rows(held)
        starts = _starts(hashes)
        counts = np.diff(np.r_[starts, len(hashes)])
        level = np.repeat(np.searchsorted(levels, counts).astype(np.int32), counts)  # how many of them are below the count
        above = np.flatnonzero(level)
        for at in range(0, len(above), 100_000):
            some = above[at : at + 100_000]
            yield pa.RecordBatch.from_pydict({"level": level[some], "x": sig[owner[some]], "y": hashes[some].view(np.int64), "sizes": sizes[owner[some]], "n": np.ones(len(some), np.int64)})
        numbers = sums.numbers(sig, sizes)
        for a, b, n in _partial_overlaps(sizes, owner[level == 0], hashes[level == 0], threshold):
            sums.add(numbers[a], numbers[b], n)
            yield from sums.taken(_HELD_PAIRS)

    return _in_fragments(chooser.df.select("rid", "text").mapInArrow(spread, _CUT), fragments, counted)


def _levels_above(lists: DataFrame, threshold: float, fragments: int, levels: int) -> DataFrame:
    """_COUNTED: counts of the pairs of classes that share n-grams of a level above the first, if both have enough of them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                some = batch.slice(at, 2_000)
                sigs, sizes = some.column("sig").to_numpy(), some.column("size").to_numpy().astype(np.int32)
                sets = [[np.zeros(0, np.uint64) if g is None else np.array(g, np.int64).view(np.uint64) for g in some.column(f"g{k}").to_pylist()] for k in range(1, levels + 1)]
                enough = np.zeros(len(sigs), np.int32)
                for k in range(levels, 0, -1):
                    enough = enough + np.array([len(s) for s in sets[k - 1]], np.int32)
                    able = np.flatnonzero(_SHARE * enough.astype(np.int64) >= (1 + threshold) * sizes - 1e-6)
                    if len(able):
                        yield _cut_rows([sets[k - 1][i] for i in able.tolist()], sigs[able], sizes[able], enough[able], fragments, (k - 1) * fragments)

    def counted(held: list[dict], sums: _Sums) -> Iterator[pa.RecordBatch]:
        sig, sizes, enough, owner, hashes = _joined_rows(held)
        numbers = sums.numbers(sig, sizes)
        for a, b, n in _partial_overlaps(sizes, owner, hashes, threshold, enough):
            sums.add(numbers[a], numbers[b], n)
            yield from sums.taken(_HELD_PAIRS)

    return _in_fragments(lists.mapInArrow(spread, _CUT), fragments * levels, counted)


def _overlaps(chooser: Chooser, n: int, threshold: float, fragments: int, levels: tuple[int, ...]) -> DataFrame:
    """sig_a < sig_b, size_a, size_b and overlap of the pairs of classes at or above the threshold."""
    counted = written(_first_level(chooser, n, threshold, fragments, levels), "counted")
    ks = range(1, len(levels) + 1)
    above = counted.where("level > 0").groupBy(F.col("x").alias("sig")).agg(F.first("sizes").alias("size"), *[F.collect_list(F.when(F.col("level") == k, F.col("y"))).alias(f"g{k}") for k in ks])
    lists = written(above, "common")
    pieces = max(8, -(-(lists.agg(F.sum(sum((F.size(f"g{k}") for k in ks), F.lit(0)))).first()[0] or 0) // FRAGMENT_GRAMS))
    counts = counted.where("level = 0").unionByName(_levels_above(lists, threshold, pieces, len(levels)))
    # by one class alone, as tasks hand on a class' counts one after the other: such runs take little room
    summed = counts.repartition("x").groupBy(F.col("x").alias("sig_a"), F.col("y").alias("sig_b"), "sizes").agg(F.sum("n").alias("n"))
    summed = summed.select("sig_a", "sig_b", F.shiftright("sizes", 32).alias("size_a"), F.col("sizes").bitwiseAND(F.lit((1 << 32) - 1)).alias("size_b"), "n")

    def of(side: str, columns: list[Column]) -> DataFrame:
        return lists.select(F.col("sig").alias(f"sig_{side}"), *columns)

    def similar(n: Column) -> Column:
        return n / (F.col("size_a") + F.col("size_b") - n) >= threshold

    for side in "ab":
        have = [sum((F.size(f"g{j}") for j in ks if j >= k), F.lit(0)).alias(f"{side}{k}") for k in ks]
        summed = summed.join(of(side, have), f"sig_{side}", "left")
    # the levels from the first one that the fragments have not counted
    both = [F.least(F.coalesce(f"a{k}", F.lit(0)), F.coalesce(f"b{k}", F.lit(0))) for k in ks]
    level, most = F.lit(len(levels) + 1), F.lit(0)
    for k, have in reversed(list(zip(ks, both))):
        missed = _SHARE * have < F.col("size_a") + F.col("size_b")
        level, most = F.when(missed, k).otherwise(level), F.when(missed, have).otherwise(most)
    able = summed.select("sig_a", "sig_b", "size_a", "size_b", "n", level.alias("level"), most.alias("most")).where(similar(F.col("n") + F.col("most")))
    able = written(able, "able")
    done, todo = able.where("most = 0").withColumn("overlap", F.col("n")), able.where("most > 0")
    for side in "ab":
        todo = todo.join(of(side, [F.col(f"g{k}").alias(f"{side}{k}") for k in ks]), f"sig_{side}")
    shared = sum((F.when(F.col("level") <= k, F.size(F.array_intersect(f"a{k}", f"b{k}"))).otherwise(0) for k in ks), F.col("n"))
    columns = ["sig_a", "sig_b", "size_a", "size_b", "overlap"]
    return done.select(columns).unionByName(todo.withColumn("overlap", shared).select(columns)).where(similar(F.col("overlap")))


class _Sums:
    """Counts by pair of classes, summed as far as memory goes: 12 bytes each."""

    def __init__(self) -> None:
        self.sorted, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.sigs, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.summed = 0, 0

    def numbers(self, sigs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers that the (distinct) classes have in this task."""
        order = np.argsort(sigs)
        at = np.searchsorted(self.sorted, sigs[order])
        new = np.ones(len(sigs), bool)
        if len(self.sorted):
            new = self.sorted[np.minimum(at, len(self.sorted) - 1)] != sigs[order]
        fresh = order[new]
        self.sorted, self.place = np.insert(self.sorted, at[new], sigs[fresh]), np.insert(self.place, at[new], len(self.sigs) + np.arange(len(fresh)))
        self.sigs, self.sizes = np.append(self.sigs, sigs[fresh]), np.append(self.sizes, sizes[fresh])
        return self.place[np.searchsorted(self.sorted, sigs)]

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        swap = self.sigs[a] > self.sigs[b]
        self.parts.append((np.where(swap, b, a) << 32 | np.where(swap, a, b), n.astype(np.int32)))
        self.held += len(a)

    def taken(self, most: int) -> Iterator[pa.RecordBatch]:
        """Nothing while at most so many are held; the sums, if even those are many. With 0, all that is held."""
        if not self.held or most and self.held <= max(most, 2 * self.summed):
            return
        code, n = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        order = np.argsort(code)
        code, n = code[order], n[order]
        del order
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        code, n = code[starts], np.add.reduceat(n, starts)
        self.held = self.summed = 0
        if 2 * len(code) <= most:
            self.parts, self.held, self.summed = [(code, n)], len(code), len(code)
            return
        for at in range(0, len(code), 100_000):
            a, b = code[at : at + 100_000] >> 32, code[at : at + 100_000] & 0xFFFFFFFF
            yield pa.RecordBatch.from_pydict({"level": np.zeros(len(a), np.int32), "x": self.sigs[a], "y": self.sigs[b], "sizes": self.sizes[a] << 32 | self.sizes[b], "n": n[at : at + 100_000].astype(np.int64)})


def _signature(one: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(one.tobytes())).astype(np.int64))


def _members(chooser: Chooser, n: int) -> DataFrame:
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = chooser.of(batch)
            sets = list(_sets(some, n))
            yield pa.RecordBatch.from_arrays(
                [some.column("rid"), some.column("doc_id").cast(pa.int64()), pa.array([_signature(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["rid", "doc_id", "sig", "size"]
            )

    return chooser.df.select("rid", "doc_id", "text").mapInArrow(name, "rid long, doc_id long, sig long, size long")


def joined(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, scan: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members has rid (row number in scan, a numbered_table() of docs that is made if not given), doc_id, sig and size of the candidate rows; pairs has the similar classes sig_a < sig_b with overlap, size_a and size_b."""
    scan = numbered_table(docs.select("doc_id", "text")) if scan is None else scan
    n_rows = scan.count()
    fragments = max(8, -(-input_bytes(scan.select("doc_id", "text")) // FRAGMENT_BYTES))
    chosen = written(_candidates(scan, n, threshold, fragments), "candidates")
    members = written(_members(Chooser(scan, chosen, n_rows), n), "members")
    firsts = written(members.groupBy("sig").agg(F.min("rid").alias("rid"), F.first("size").alias("size")), "firsts")
    fragments = max(8, -(-(firsts.agg(F.sum("size")).first()[0] or 0) // FRAGMENT_GRAMS))
    return members, _overlaps(Chooser(scan, firsts, n_rows), n, threshold, fragments, LEVELS)


def near_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_a < doc_b, overlap, size_a, size_b and jaccard (6 digits) of every pair of documents at or above the threshold."""
    members, pairs = joined(docs, n, threshold)
    named = members.where("doc_id IS NOT NULL").select("sig", "doc_id", "size")
    a, b = named.select(F.col("sig").alias("sig_a"), F.col("doc_id").alias("x")), named.select(F.col("sig").alias("sig_b"), F.col("doc_id").alias("y"))
    across = pairs.join(a, "sig_a").join(b, "sig_b").select("x", "y", "overlap", "size_a", "size_b")
    within = named.select(F.col("sig"), F.col("doc_id").alias("x"), "size").join(named.select("sig", F.col("doc_id").alias("y")), "sig").where("x < y").select("x", "y", F.col("size").alias("overlap"), F.col("size").alias("size_a"), F.col("size").alias("size_b"))
    both = across.unionByName(within).where("x <> y")
    swap = F.col("x") > F.col("y")
    out = both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "overlap", F.when(swap, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"), F.when(swap, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"))
    out = out.withColumn("jaccard", F.round(F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap")), 6))
    best = out.groupBy("doc_a", "doc_b").agg(F.max(F.struct("jaccard", "overlap", "size_a", "size_b")).alias("m"))
    return best.select("doc_a", "doc_b", "m.overlap", "m.size_a", "m.size_b", "m.jaccard")


#: The sets g of n-grams and their sizes s of the rows of d (rid, text).
GRAMS_SQL = rf"""w AS (SELECT rid, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
s AS (SELECT rid, count(*) AS n FROM g GROUP BY rid)"""
