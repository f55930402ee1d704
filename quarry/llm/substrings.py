"""Passages of at least L words that occur in other documents, too: matching statistics from FM-indexes.

Documents meet in shards by content. Each window of L words has an anchor, its least hash of K words, and equal windows
have equal anchors. An anchor that a single document has cannot lie in a shared passage, so only text around anchors of
two documents or more is sent: to the shard of the anchor, with the L - K words before and after it, so that every
window with this anchor is whole there. All shared windows are found, whatever their number.

A shard joins its pieces to one sequence and indexes it (places of each word in the Burrows-Wheeler transform). Pieces are
then streamed through the index, all of them in step: from each end place the match with another document is extended
backwards as far as it goes. The places of a shared window are marked, and marked places merge into intervals.

Equal pieces of several documents are shared as a whole; one copy of them is indexed, marked as belonging to many.

Defined results
* Words are runs of letters and digits in lower case. Null or short texts have no intervals.
* Rows of the same doc_id and text are one document: a passage that only such rows share is not reported. Rows without
  doc_id report a null. A passage that a document repeats within itself alone is not shared.
* Intervals are [word_start, word_end) and maximal. Other columns are not read; an empty table has no intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _BASE, doc_key, input_bytes, mix, stable, tokenize, written
from .fm import ListIndex

L, K = 50, 20
ANCHOR_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
#: Filters sent to all tasks at once (some 100 GB of documents); with more, documents are read again for the next lot.
FILTER_BYTES = 256 << 20


def anchors(hashes: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of several texts, and each text's first one: the least K-gram of each window of `length` words, the leftmost of equal ones."""
    n = len(hashes) - length + 1  # windows, also those across texts, which are left out below
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    values = whole_grams(hashes, k)
    # a sliding minimum by doubling; places are those of the leftmost
    width = length - k + 1
    least, place, size = values, np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64), 1
    while size < width:
        by = min(size, width - size)
        later = least[by:] < least[:-by]
        place = np.where(later, place[by:], place[:-by])
        least = np.minimum(least[:-by], least[by:])
        size += by
    place = place[np.arange(n) + length <= np.repeat(bounds[1:], np.diff(bounds))[:n]]
    places = place[np.flatnonzero(np.diff(place, prepend=-1))].astype(np.int64)  # they never go back
    return places, values[places], np.searchsorted(places, bounds)


def whole_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """grams() of all windows of k words of one text, by doubling."""
    n = len(hashes) - k + 1
    made, have, piece, size = np.zeros(len(hashes) + 1, np.uint64), 0, hashes, 1
    while True:
        power = np.uint64(pow(int(_BASE), size, 2**64))
        if k & size:
            made = made[: len(hashes) - have - size + 1] * power + piece[have:]
            have += size
        if have == k:
            return mix(made[:n])
        piece = piece[:-size] * power + piece[size:]
        size *= 2


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[int, int | None, np.ndarray, np.ndarray, np.ndarray]]:
    """Key, doc_id, words, and places and hashes of the anchors of each text that is long enough."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            tokens = tokenize(part.column("text").to_pylist())
            ids = part.column("doc_id").to_pylist() if "doc_id" in part.schema.names else [None] * part.num_rows
            places, values, firsts = anchors(tokens.hashes, tokens.bounds, L, K)
            for key, doc_id, a, b, i, j in zip(part.column("key").to_pylist(), ids, tokens.bounds[:-1].tolist(), tokens.bounds[1:].tolist(), firsts[:-1].tolist(), firsts[1:].tolist()):
                if b - a >= L:
                    yield key, doc_id, tokens.hashes[a:b], places[i:j] - a, values[i:j]


def _bloom_bits(anchors: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = anchors & np.uint64(0xFFFFFFFF), mix(anchors) & np.uint64(0xFFFFFFFF)
    return ((low * np.uint64(size)) >> np.uint64(32)).astype(np.int64), ((high * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


def _part(anchors: np.ndarray, parts: int) -> np.ndarray:
    return (((anchors >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def shared_anchors(docs: DataFrame, parts: int) -> Iterator[dict[int, np.ndarray]]:
    """Filters for the anchor hashes that two documents or more have: bits by part of the hash range, in one or more lots."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, keys, held = [], [], 0
        for key, _, _, _, values in _texts(batches):
            one = np.unique(values)
            found.append(one)
            keys.append(np.full(len(one), key, np.int64))
            held += len(one)
            if held > 500_000:
                yield emit(found, keys)
                found, keys, held = [], [], 0
        if found:
            yield emit(found, keys)

    def emit(found: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        a, k = np.concatenate(found), np.concatenate(keys)
        part = _part(a, parts)
        order = np.argsort(part, kind="stable")
        a, k, ends = a[order], k[order], np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(s, a[ends[s] : ends[s + 1]].tobytes(), k[ends[s] : ends[s + 1]].tobytes()) for s in np.flatnonzero(np.diff(ends)).tolist()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["part", "anchors", "keys"])

    def count(table: pa.Table) -> pa.Table:
        a = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("anchors")])
        k = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("keys")])
        order = np.argsort(a, kind="stable")
        a, k = a[order], k[order]
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        shared = a[starts[np.minimum.reduceat(k, starts) != np.maximum.reduceat(k, starts)]]
        bits = np.zeros(max(64, 16 * len(shared)), bool)
        for at in _bloom_bits(shared, len(bits)):
            bits[at] = True
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "n": pa.array([len(bits) if len(shared) else 0], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes() if len(shared) else b""], pa.binary())})

    made = docs.select("key", "text").mapInArrow(find, "part int, anchors binary, keys binary")
    table = written(made.groupBy("part").applyInArrow(count, "part int, n long, bits binary").where("n > 0"), "anchors")
    lot, total = [], 0
    for r in table.select("part", "n").orderBy("part").collect():  # a row per part
        lot.append(r.part)
        total += r.n // 8
        if total > FILTER_BYTES:
            yield {x.part: (x.n, np.frombuffer(bytes(x.bits), np.uint8)) for x in table.where(F.col("part").isin(lot)).collect()}
            lot, total = [], 0
    if lot:
        yield {x.part: (x.n, np.frombuffer(bytes(x.bits), np.uint8)) for x in table.where(F.col("part").isin(lot)).collect()}


def _maybe_shared(a: np.ndarray, parts: int, known: dict[int, tuple[int, np.ndarray]]) -> np.ndarray:
    out, part = np.zeros(len(a), bool), _part(a, parts)
    for p in np.unique(part).tolist():
        if p in known:
            mine = np.flatnonzero(part == p)
            size, bits = known[p]
            hit = np.ones(len(mine), bool)
            for at in _bloom_bits(a[mine], size):
                hit &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            out[mine] = hit
    return out


def _pieces(docs: DataFrame, known: object, parts: int, shards: int) -> DataFrame:
    """The text around every anchor that may be shared, packed by shard: keys, doc_ids (with presence), places, lengths and words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size = 0
        # anchors of many texts are looked up together
        lot: list[tuple] = []
        for text in _texts(batches):
            lot.append(text)
            if len(lot) == 256:
                size += gather(lot, held)
                lot = []
                if size > 1_500_000:
                    yield emit(held)
                    held, size = {}, 0
        gather(lot, held)
        if held:
            yield emit(held)

    def gather(lot: list[tuple], held: dict[int, list[tuple]]) -> int:
        if not lot:
            return 0
        values = np.concatenate([x[4] for x in lot])
        hits, shard = _maybe_shared(values, parts, known.value), _part(mix(values), shards)
        at = added = 0
        for key, doc_id, hashes, places, own in lot:
            for i in np.flatnonzero(hits[at : at + len(own)]).tolist():
                start = max(0, int(places[i]) - (L - K))
                words = (hashes[start : int(places[i]) + L] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                held.setdefault(int(shard[at + i]), []).append((key, doc_id, start, words))
                added += len(words)
            at += len(own)
        return added

    def emit(held: dict[int, list[tuple]]) -> pa.RecordBatch:
        rows = [
            (s, np.array([x[0] for x in p], np.int64).tobytes(), np.array([x[1] or 0 for x in p], np.int64).tobytes(), np.array([x[1] is not None for x in p], np.uint8).tobytes(),
             np.array([x[2] for x in p], np.int32).tobytes(), np.array([len(x[3]) for x in p], np.int32).tobytes(), np.concatenate([x[3] for x in p]).tobytes())
            for s, p in held.items()
        ]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 6))], ["shard", "keys", "ids", "named", "starts", "lengths", "words"])

    return docs.select("key", "doc_id", "text").mapInArrow(cut, "shard int, keys binary, ids binary, named binary, starts binary, lengths binary, words binary")


def shared_windows(index: ListIndex, seq: np.ndarray, begins: np.ndarray, lengths: np.ndarray, owners: np.ndarray, owner_at: np.ndarray, length: int) -> np.ndarray:
    """For each place of seq, whether a window of `length` begins there, in one of these pieces, that another owner has.

    owner_at: the owner of each suffix, in the index's order. All pieces advance in step; each extends the match that ends
    at `end` backwards to `first`, its first undecided start. A failure decides all starts up to the place of failure.
    """
    n = index.n
    marks = np.zeros(n + 1, np.int64)  # +1 where a run of shared starts begins, -1 after its end
    change = np.flatnonzero(np.r_[owner_at[1:] != owner_at[:-1], True]) + 1
    next_other = change[np.searchsorted(change, np.arange(n), "right")]
    live = np.flatnonzero(lengths >= length)
    begin, size, owner = begins[live], lengths[live], owners[live]
    first, end = np.zeros(len(live), np.int64), size.copy()
    place, lo, hi = end.copy(), np.zeros(len(live), np.int64), np.full(len(live), n, np.int64)
    while len(begin):
        new_lo, new_hi = index.step(seq[begin + place - 1], lo, hi)
        at = np.minimum(new_lo, n - 1)
        ok = (new_hi > new_lo) & ((owner_at[at] != owner) | (next_other[at] < new_hi))
        lo, hi, place = np.where(ok, new_lo, lo), np.where(ok, new_hi, hi), place - ok
        ended = ~ok | (place == first)
        if ended.any():
            i = np.flatnonzero(ended)
            good = end[i] - place[i] >= length
            np.add.at(marks, (begin + place)[i[good]], 1)
            np.add.at(marks, (begin + end)[i[good]] - length + 1, -1)
            won, short = place[i] == first[i], end[i] == first[i] + length
            # won: all starts up to end - length are shared. Lost with the shortest end: none before `place` is.
            step = np.where(won, end[i] - length + 1, np.where(short, place[i], first[i]))
            reach = np.where(won, size[i], np.where(short, step + length, first[i] + length + (end[i] - first[i] - length) // 2))
            first[i], end[i] = step, np.minimum(reach, size[i])
            place[i], lo[i], hi[i] = end[i], 0, n
            keep = np.ones(len(begin), bool)
            keep[i] = first[i] + length <= size[i]
            if not keep.all():
                begin, size, owner, first, end, place, lo, hi = (x[keep] for x in (begin, size, owner, first, end, place, lo, hi))
    return np.cumsum(marks)[:n] > 0


def _search(table: pa.Table) -> pa.Table:
    column = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
    keys, ids, named, starts = column("keys", np.int64), column("ids", np.int64), column("named", np.uint8), column("starts", np.int32).astype(np.int64)
    lengths, words = column("lengths", np.int32).astype(np.int64), column("words", np.uint32)
    firsts = np.r_[0, np.cumsum(lengths)]
    raw = words.tobytes()
    content: dict[bytes, int] = {}
    which = np.fromiter((content.setdefault(raw[4 * a : 4 * b], len(content)) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())), np.int64, len(keys))
    del raw, content
    order = np.argsort(which, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(which[order]) != 0])
    many = np.minimum.reduceat(keys[order], heads) != np.maximum.reduceat(keys[order], heads)
    one = order[heads]  # of each content, a piece
    size = lengths[one]
    begins = np.r_[0, np.cumsum(size + 1)]
    _, symbols = np.unique(words, return_inverse=True)
    seq = np.zeros(int(begins[-1]), np.int64)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    seq[np.repeat(begins[:-1], size) + inside] = symbols[np.repeat(firsts[:-1][one], size) + inside] + 1
    owners = np.where(many, -1 - np.arange(len(one)), np.unique(keys[one], return_inverse=True)[1])
    index = ListIndex(seq)
    owner_at = np.repeat(owners, size + 1)[index.order]
    index.drop_order()
    marked = shared_windows(index, seq, begins[:-1][~many], size[~many], owners[~many], owner_at, L)
    edges = np.flatnonzero(np.diff(np.r_[False, marked, False].astype(np.int8)))
    a, b = edges[::2], edges[1::2]
    piece = np.searchsorted(begins, a, "right") - 1
    # contents of one document: every piece with it has the found intervals; contents of many: the whole piece
    by_content = np.argsort(which[one])
    runs = np.bincount(piece, minlength=len(one))
    run_first = np.r_[0, np.cumsum(runs)]
    place = by_content[which]
    whole = many[place] & (lengths >= L)
    count = np.where(whole, 1, runs[place])
    rows = np.repeat(np.arange(len(keys)), count)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    run = np.minimum(run_first[place[rows]] + nth, max(len(a) - 1, 0))
    low = np.where(whole[rows], 0, (a[run] - begins[place[rows]]) if len(a) else 0)
    high = np.where(whole[rows], lengths[rows], (b[run] - begins[place[rows]] + L - 1) if len(a) else 0)
    return pa.table({"key": keys[rows], "doc_id": pa.array(ids[rows], pa.int64(), mask=named[rows] == 0), "word_start": starts[rows] + low, "word_end": starts[rows] + high})


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, word_start, word_end (exclusive) of the intervals of each document whose windows of L words other documents have."""
    docs = stable(docs.select("doc_id", "text"), "passages")
    keyed = docs.select(doc_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(8, -(-input_bytes(docs) // ANCHOR_BYTES))
    shards = max(8, -(-input_bytes(docs) // SHARD_BYTES))
    found = None
    for filters in shared_anchors(keyed, parts):
        known = docs.sparkSession.sparkContext.broadcast(filters)
        some = _pieces(keyed, known, parts, shards).groupBy("shard").applyInArrow(_search, "key long, doc_id long, word_start long, word_end long")
        found = some if found is None else found.unionByName(some)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, word_start long, word_end long")
    by = Window.partitionBy("key").orderBy("word_start", "word_end")
    before = F.max("word_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(F.col("word_start") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("key", "island").agg(F.first("doc_id").alias("doc_id"), F.min("word_start").alias("word_start"), F.max("word_end").alias("word_end")).select("doc_id", "word_start", "word_end")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(range(0, len(w) - {L} + 1)) AS s, unnest(list_transform(range(1, len(w) - {L} + 2), lambda i: md5(array_to_string(w[i:i + {L - 1}], ' ')))) AS g FROM d WHERE len(w) >= {L}),
r AS (SELECT g FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1),
h AS (SELECT doc_id, s, s + {L} AS e FROM g SEMI JOIN r USING (g)),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM h),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, min(s) AS word_start, max(e) AS word_end FROM i GROUP BY doc_id, island"""
