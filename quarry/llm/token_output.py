"""Token ids as compressed binary blocks: an adaptive context-mixing range coder.

Documents become ids of a public byte-level BPE vocabulary, each followed by an end id; the ids are cut into blocks.
Every block is coded by itself, from models in their first state, and holds a checksum of its ids.

An id takes one step of the range coder, with the interval that a mixture of four distributions gives it:
* order 2: what followed the last occurrences of the same two ids (a 16-bit hash of them) in the block, order 1: the
  same for the one id before; both by counts in a window of the latest occurrences;
* order 0: counts of all ids of the block up to the last update; updates come densely at first, then every UPDATE ids;
* a fixed prior that falls with the id, as vocabularies are ordered by frequency.
The weights adapt: an order weighs as much as its prediction has held so far in the block, at the same number of
occurrences and agreement of the last two. All sums are of integers, or of doubles in a fixed order (monotone in the id, the
same on all machines), so a decoder finds the same intervals. All bits go through the coder.

The encoder knows all ids, so it finds the counts of all positions at once by sorting; only the coder's range goes
from id to id, in three numpy calls for all blocks of a lot. The code is the sum of the intervals' starts, added at
their bit positions at the end. The decoder goes from id to id, in step for all blocks of a lot.

Defined results
* A null text is listed as null in its block, an empty one is not; both have no ids but the end id. doc_ids may be null
  or repeat. Rows are coded in the order of their partition. An empty table gives no blocks. Other columns are not read.
* A text that contains the end token's name is ordinary text. A text longer than a block goes on in the next ones; ids
  of any length of text are coded, and read_blocks() puts them together again.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partition_id, spans, written

#: The vocabulary: "byte_bpe_50k.tiktoken" of the public tokenizers, or another file of ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50_256
#: Ids in a block (at most 2**14), blocks coded in step, blocks modelled at once; blocks decoded in step.
BLOCK, LANES, _SOME = 16_384, 128, 2
READ_LANES = 256
BLOCKS = "part int, block int, first_doc long, n_ids int, checksum long, doc_ids array<long>, null_docs array<int>, payload binary"
#: Occurrences that order 1 and order 2 look back on; ids between two updates of order 0, at most; ids its weight looks back on.
ORDER1, ORDER2, UPDATE, RECENT = 32, 16, 512, 1024
_NONE = 65_535
_TOTAL_BITS, _RANGE_BITS = 26, 22
_TOTAL = 1 << _TOTAL_BITS
_MIXED = _TOTAL - (1 << 16)  # every id has 1 besides
_FIELD = _TOTAL_BITS + _RANGE_BITS + 1
_PRIOR = np.zeros(65_537, np.int64)
_PRIOR[1:] = np.cumsum((1 << 32) // (np.arange(65_536, dtype=np.int64) + 300))
_PRIOR = _PRIOR / _PRIOR[-1]
_CLASS = np.array([min(int(i).bit_length(), 7) for i in range(256)], np.uint8)


#: Parts texts in a joined string, where it stands for the end id.
_PART = "\U0010ffff"
_LETTER, _NUMBER, _SPACE, _OTHER, _BREAK = range(5)
#: Longer texts are tokenized one by one; pieces whose ids are kept.
_LONG, _PIECES_KEPT = 1_000_000, 1_000_000


def _kinds() -> np.ndarray:
    import regex

    everything = "".join(map(chr, [*range(0xD800), *([32] * 0x800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            kinds[m.start() : m.end()] = kind
    kinds[ord(_PART)] = _BREAK
    return kinds


def pieces(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where PATTERN's matches start in a string of code points that ends with a break; a break is a match of its own."""
    kind = kinds[points]
    start = np.empty(len(kind), bool)
    start[0], start[1:] = True, kind[1:] != kind[:-1]
    start |= kind == _BREAK
    runs = np.flatnonzero(start)
    blank = np.flatnonzero(kind[runs] == _SPACE)
    follow = runs[blank + 1]  # there is always a break at the end
    inner = follow[kind[follow] != _BREAK]  # the last space of a run before something else stands alone,
    start[inner - 1] = True
    start[inner[points[inner - 1] == 32]] = False  # or, if it is a blank, goes with what follows
    marks = np.flatnonzero((points == 39) & start)
    marks = marks[start[marks + 1] & (kind[marks + 1] == _LETTER)]
    one, two = points[marks + 1], points[np.minimum(marks + 2, len(points) - 1)]
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for at, n in ((marks[single], 2), (marks[double], 3)):
        start[at + 1] = False
        start[at + n] = True
    return np.flatnonzero(start)


class Tokenizer:
    """Ids of texts. The pieces of many texts are found at once and looked up by hash; their bytes are held against the text."""

    _made: dict[str, Tokenizer] = {}

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kinds = _kinds()
        names = [b""] * (END + 1)
        for name, i in ranks.items():
            names[i] = name
        names[END] = _PART.encode()
        self.name_sizes = np.array(list(map(len, names)), np.int64)
        self.name_starts = np.cumsum(self.name_sizes) - self.name_sizes
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self._forget()

    @classmethod
    def of(cls, path: str) -> Tokenizer:
        """The one of this Python worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        """Empty the sorted hashes of the pieces that are known, and where and how long their ids are."""
        self.hashes, self.places, self.flat = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64), np.zeros(0, np.uint16)

    def __call__(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=())).astype(np.uint16)

    def all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with an end id, and where each text's ids end."""
        joined = _PART.join(texts) + _PART
        if joined.count(_PART) == len(texts) and len(joined) < _LONG:
            ids = self._looked_up(joined)
            sizes = self.name_sizes[ids]
            ends = np.cumsum(sizes)
            spelt = self.names[np.repeat(self.name_starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])]
            if np.array_equal(spelt, np.frombuffer(joined.encode(), np.uint8)):
                return ids, np.flatnonzero(ids == END) + 1
        each = [np.append(self(t), np.uint16(END)) for t in texts]
        return np.concatenate(each), np.cumsum([len(x) for x in each])

    def _looked_up(self, joined: str) -> np.ndarray:
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = pieces(points, self.kinds)
        hashes, first, which = np.unique(spans(points, starts, np.append(starts[1:], len(points))), return_index=True, return_inverse=True)
        if len(self.hashes) > _PIECES_KEPT:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        missing = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(missing):
            ends, new = np.append(starts[1:], len(points))[first[missing]].tolist(), []
            for a, b in zip(starts[first[missing]].tolist(), ends):
                new.append([END] if joined[a] == _PART else self.encoding.encode_ordinary(joined[a:b]))
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            self.places = np.insert(self.places, at[missing], [len(self.flat) + np.cumsum(sizes) - sizes, sizes], axis=1)
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(new), np.uint16, int(sizes.sum())))
            self.hashes = np.insert(self.hashes, at[missing], hashes[missing])
            at = np.searchsorted(self.hashes, hashes)
        begins, sizes = self.places[:, at][:, which]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1])]

    def bytes(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


def updates(size: int) -> np.ndarray:
    """Positions at which order 0 takes in all ids before: 0, 32, 40, ... with steps of a quarter, UPDATE at most."""
    at = [0, 32]
    while at[-1] < size:
        at.append(at[-1] + min(UPDATE, at[-1] // 4))
    return np.array(at)


def _contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = np.full_like(ids, _NONE), np.full_like(ids, _NONE)
    one[:, 1:], two[:, 2:] = ids[:, :-1], ids[:, :-2]
    return one, _pair(one, two)


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one.astype(np.uint32) * np.uint32(40_503) + two.astype(np.uint32) * np.uint32(2_654_435_761) >> np.uint32(9)).astype(np.uint16)


def _weight(hits: np.ndarray, trials: np.ndarray) -> np.ndarray:
    """The share of hits in 4096ths."""
    return np.clip((8192 * hits + 4096) // (2 * trials + 2), 32, 4064)


def _shares(l2: np.ndarray, l1: np.ndarray, l0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the mixed mass, the parts of orders 2, 1 and 0 and of the prior; weights are in 4096ths."""
    w2 = l2 * (_MIXED / 4096)
    rest = _MIXED - w2
    w1 = rest * (l1 * (1 / 4096))
    rest = rest - w1
    w0 = rest * (l0 * (1 / 4096))
    return w2, w1, w0, rest - w0


def _windows(ids: np.ndarray, context: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the last occurrences of each position's context: how many were followed by a smaller id, by the same id, how many they are; and their class for the weights."""
    lanes, size = ids.shape
    bits = max(1, int(size - 1).bit_length())
    key = context.astype(np.int32) << bits | np.arange(size, dtype=np.int32)
    key.sort(axis=1)
    group = key >> bits
    first = np.ones((lanes, size), bool)
    first[:, 1:] = group[:, 1:] != group[:, :-1]
    flat = ((key & (1 << bits) - 1) + np.arange(lanes, dtype=np.int32)[:, None] * size).ravel()
    x, places = ids.ravel()[flat], np.arange(lanes * size, dtype=np.int32)
    seen = np.minimum(places - np.maximum.accumulate(np.where(first.ravel(), places, 0)), depth).astype(np.uint8)
    less, same = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
    test, ok = np.empty(len(x), bool), np.empty(len(x), bool)
    for d in range(1, min(depth, size - 1) + 1):
        a, b = test[d:], np.greater_equal(seen[d:], d, out=ok[d:])
        less[d:] += np.logical_and(np.less(x[:-d], x[d:], out=a), b, out=a).view(np.uint8)
        same[d:] += np.logical_and(np.equal(x[:-d], x[d:], out=a), b, out=a).view(np.uint8)
    kind = _CLASS[seen] * np.uint8(2)
    kind[2:] += (x[1:-1] == x[:-2]) & (seen[2:] >= 2)
    out = np.empty((4, lanes * size), np.uint8)
    for row, values in zip(out, (less, same, seen, kind)):
        row[flat] = values
    return tuple(out.reshape(4, lanes, size))


def _held(kind: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The weight that each position's class has earned before it."""
    lanes, size = kind.shape
    order = np.argsort(kind, axis=1, kind="stable").astype(np.int32)
    order += np.arange(lanes, dtype=np.int32)[:, None] * size
    order = order.ravel()
    k, h = kind.ravel()[order], hit.ravel()[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    first[::size] = True
    places = np.arange(len(k), dtype=np.int32)
    start = np.maximum.accumulate(np.where(first, places, 0))
    before = np.cumsum(h, dtype=np.int32) - h
    out = np.empty(len(k), np.int32)
    out[order] = _weight(before - before[start], places - start)
    return out.reshape(lanes, size)


def _counts(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the ids before the last update: how many are smaller, how many the same. Ranks in bitmaps over the sorted ids."""
    lanes, size = ids.shape
    bits = max(1, int(size - 1).bit_length())
    less, same = np.zeros((lanes, size), np.int32), np.zeros((lanes, size), np.int32)
    edge, index = np.ones(size + 1, bool), np.arange(size, dtype=np.int32)
    low, high = np.empty(size, np.int32), np.empty(size, np.int32)
    if size <= at[1]:
        return less, same
    ranks = [(a, min(b, size)) for a, b in zip(at[1:].tolist(), [*at[2:].tolist(), size]) if a < size]
    words = np.zeros((len(ranks), size // 64 + 1), np.uint64)
    octets = words.view(np.uint8)
    sums = np.zeros((len(ranks), size // 64 + 2), np.int32)
    which = np.zeros(size, np.int64)
    for k, (a, b) in enumerate(ranks):
        which[a:b] = k
    from_word, from_sum, learned = which * words.shape[1], which * sums.shape[1], at[1]
    for lane in range(lanes):
        key = ids[lane].astype(np.int32) << bits | index
        key.sort()
        place, value = key & (1 << bits) - 1, key >> bits
        edge[1:-1] = value[1:] != value[:-1]
        low[place] = np.maximum.accumulate(np.where(edge[:-1], index, 0))
        high[place] = np.minimum.accumulate(np.where(edge[1:], index + 1, size)[::-1])[::-1]
        place = place.astype(np.int16)
        for row, (a, _) in zip(octets, ranks):
            packed = np.packbits(place < a, bitorder="little")
            row[: len(packed)] = packed
        np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int32, out=sums[:, 1:])
        one = []
        for s in (low, high):
            word = s >> 6
            below = words.ravel()[from_word + word] & ((np.uint64(1) << (s & 63).astype(np.uint64)) - np.uint64(1))
            one.append(sums.ravel()[from_sum + word] + np.bitwise_count(below))
        less[lane, learned:], same[lane, learned:] = one[0][learned:], (one[1] - one[0])[learned:]
    return less, same


def _recent(hit: np.ndarray) -> np.ndarray:
    """The weight that order 0 has earned on the latest ids."""
    size = hit.shape[1]
    sums = np.zeros((len(hit), size + 1), np.int32)
    np.cumsum(hit, axis=1, out=sums[:, 1:])
    now = np.arange(size)
    since = np.maximum(now - RECENT, 0)
    return _weight(sums[:, :-1] - sums[:, since], now - since)


def intervals(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each id's interval, in 2**26ths; ids: a block in each row."""
    size = ids.shape[1]
    one, two = _contexts(ids)
    less1, same1, seen1, kind1 = _windows(ids, one, ORDER1)
    less2, same2, seen2, kind2 = _windows(ids, two, ORDER2)
    at = updates(size)
    less0, same0 = _counts(ids, at)
    seen0 = at[np.searchsorted(at, np.arange(size), "right") - 1]
    l2 = (_held(kind2, same2 > 0) * (seen2 > 0)).astype(np.float64)
    l1 = (_held(kind1, same1 > 0) * (seen1 > 0)).astype(np.float64)
    w2, w1, w0, rest = _shares(l2, l1, (_recent(same0 > 0) * (seen0 > 0)).astype(np.float64))
    place = ids.astype(np.int64)
    start, end = rest * _PRIOR.take(place), rest * _PRIOR[1:].take(place)
    for w, less, same, seen in ((w0, less0, same0, seen0), (w1, less1, same1, seen1), (w2, less2, same2, seen2)):
        w /= np.maximum(seen, 1).astype(np.float64)
        less = less.astype(np.float64)
        start += w * less
        less += same.astype(np.float64)
        end += w * less
    low = start.astype(np.int32) + ids
    return low, end.astype(np.int32) + ids + 1 - low


def _stepped(start: np.ndarray, length: np.ndarray) -> list[bytes]:
    """The code of each lane; start and length: lanes by steps. A step of length 2**26 changes nothing.

    The range is a float in [1, 2) of 22 bits, times a power of two that the steps' shifts give."""
    lanes, steps = length.shape
    ranges = np.ones((steps + 1, lanes))
    product, bits = np.empty(lanes), ranges.view(np.int64)
    raw, one = product.view(np.int64), np.float64(1).view(np.int64)
    keep = np.int64((1 << _RANGE_BITS) - 1) << np.int64(52 - _RANGE_BITS)
    factors = np.ascontiguousarray(length.T).astype(np.float64)
    for now, factor, then in zip(ranges, factors, bits[1:]):
        np.multiply(now, factor, out=product)
        np.bitwise_and(raw, keep, out=then)
        np.bitwise_or(then, one, out=then)
    del factors
    out = []
    for lane in range(lanes):
        own = ranges[:-1, lane].copy()
        shift = _TOTAL_BITS + 1023 - ((own * length[lane]).view(np.int64) >> 52)
        ends = np.cumsum(shift)  # bits before the next step
        # the sum of value * 2**-at in 32-bit limbs; at last a number that needs few bits is chosen
        value = np.append((own * (1 << _RANGE_BITS)).astype(np.int64) * start[lane], (1 << _FIELD - 2) - 1)
        at = np.append(ends - shift, ends[-1]) + _FIELD
        width = int(at[-1]) // 32 + 2
        sums = np.zeros(width + 1)
        for part, end in ((value & 0xFFFFFF, at), (value >> 24, at - 24)):
            part, limb = part << (-end & 31), (end - 1 >> 5) + 1
            sums += np.bincount(limb, part & 0xFFFFFFFF, width + 1)
            sums += np.bincount(limb - 1, part >> 32, width + 1)
        limbs = sums.astype(np.int64)
        while (carry := limbs >> 32).any():
            limbs &= 0xFFFFFFFF
            limbs[:-1] += carry[1:]
        out.append(limbs[1:].astype(">u4").tobytes()[: -(-int(ends[-1] + 2) // 8)])
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The payload of each block of ids."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    start, length = np.zeros((len(blocks), len(blocks[order[0]])), np.int32), np.full((len(blocks), len(blocks[order[0]])), _TOTAL, np.int32)
    for a in range(0, len(order), _SOME):
        some = order[a : a + _SOME]
        ids = np.zeros((len(some), len(blocks[some[0]])), np.uint16)
        for row, i in zip(ids, some):
            row[: len(blocks[i])] = blocks[i]
        for i, low, n in zip(some, *intervals(ids)):
            start[i, : len(blocks[i])], length[i, : len(blocks[i])] = low[: len(blocks[i])], n[: len(blocks[i])]
    return _stepped(start, length)


class _Reader:
    """The decoder's models of all lanes, and their codes."""

    def __init__(self, payloads: list[bytes], size: int) -> None:
        lanes = len(payloads)
        self.lane, self.ids = np.arange(lanes), np.full((lanes, size), _NONE, np.int64)
        self.last = [np.full((lanes, 65_536), -1, np.int16) for _ in range(2)]
        self.windows = [np.zeros((size, lanes, depth), np.uint16) for depth in (ORDER1, ORDER2)]
        self.sizes = [np.zeros((size, lanes), np.int64) for _ in range(2)]
        self.held = [np.zeros((2, lanes, 16), np.int64) for _ in range(2)]
        self.hits = np.zeros((lanes, size + 1), np.int64)
        self.counts, self.at, self.seen = np.zeros((lanes, 65_537), np.int16), updates(size), 0
        self.data = np.zeros((lanes, max(map(len, payloads)) + 16), np.uint8)
        for row, p in zip(self.data, payloads):
            row[: len(p)] = np.frombuffer(p, np.uint8)
        self.range, self.place = np.full(lanes, 1 << _RANGE_BITS, np.int64), np.zeros(lanes, np.int64)
        self.value = self._bits(np.full(lanes, _FIELD))

    def _bits(self, n: np.ndarray) -> np.ndarray:
        """The next n bits of each lane, as a number; 56 at most."""
        byte, out = self.place >> 3, np.zeros(len(n), np.uint64)
        for k in range(8):
            out = out << np.uint64(8) | self.data[self.lane, np.minimum(byte + k, self.data.shape[1] - 1)]
        out = (out << (self.place & 7).astype(np.uint64)) >> np.uint64(8)
        self.place = self.place + n
        return (out >> (56 - n).astype(np.uint64)).astype(np.int64)

    def _window(self, k: int, t: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What followed the last occurrences of each lane's context, the latest first, and how many they are: those of the last one, and what followed that."""
        at = self.last[k][self.lane, context].astype(np.int64)
        old, now = self.windows[k][at, self.lane], self.windows[k][t]
        now[:, 1:], now[:, 0] = old[:, :-1], self.ids[self.lane, at]
        self.sizes[k][t] = n = np.where(at < 0, 0, np.minimum(self.sizes[k][at, self.lane] + 1, now.shape[1]))
        self.last[k][self.lane, context] = t
        depth = int(n.max())
        return np.where(np.arange(depth)[:, None] < n, now[:, :depth].T, np.int32(1 << 20)), n

    def step(self, t: int) -> None:
        lane = self.lane
        if t and t in self.at:
            for row, ids in zip(self.counts, self.ids[:, :t]):
                row[1:] = np.cumsum(np.bincount(ids, minlength=65_536))
            self.seen = t
        one = self.ids[:, t - 1] if t else np.full(len(lane), _NONE)
        two = self.ids[:, t - 2] if t > 1 else np.full(len(lane), _NONE)
        contexts = (one, _pair(one.astype(np.uint16), two.astype(np.uint16)).astype(np.int64))
        windows, weights, kinds = [], [], []
        for k in range(2):
            found, n = self._window(k, t, contexts[k])
            kind = _CLASS[n] * 2 + ((n >= 2) & (found[0] == found[1]) if len(found) > 1 else 0)
            hits, trials = self.held[k][:, lane, kind]
            windows.append((found, n))
            kinds.append(kind)
            weights.append(_weight(hits, trials) * (n > 0))
        since = max(t - RECENT, 0)
        l0 = _weight(self.hits[:, t] - self.hits[:, since], np.full(len(lane), t - since)) * (self.seen > 0)
        w2, w1, w0, rest = _shares(weights[1], weights[0], l0)
        w0, w1, w2 = w0 / max(self.seen, 1), w1 / np.maximum(windows[0][1], 1), w2 / np.maximum(windows[1][1], 1)

        def start(x: np.ndarray) -> np.ndarray:
            total = rest * _PRIOR[x] + w0 * self.counts[lane, x]  # the encoder adds in the same order
            for w, (found, _) in ((w1, windows[0]), (w2, windows[1])):
                total += w * np.add.reduce(found < x, axis=0, dtype=np.uint8)
            return total.astype(np.int64) + x

        target, x = self.value // self.range, np.zeros(len(lane), np.int32)
        for bit in range(15, -1, -1):
            x += (start(x + (1 << bit)) <= target) * np.int32(1 << bit)
        low, high = start(x), start(x + 1)
        product = self.range * (high - low)
        shift = _FIELD - np.frexp(product.astype(np.float64))[1]
        self.value = (self.value - self.range * low << shift) | self._bits(shift)
        self.range = product << shift >> _TOTAL_BITS
        self.ids[:, t] = x
        for k, (found, _) in enumerate(windows):
            self.held[k][0, lane, kinds[k]] += (found == x).any(axis=0)
            self.held[k][1, lane, kinds[k]] += 1
        self.hits[:, t + 1] = self.hits[:, t] + (self.counts[lane, x + 1] > self.counts[lane, x])


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    if not payloads:
        return []
    reader = _Reader(payloads, max(sizes))
    for t in range(max(sizes)):
        reader.step(t)
    return [row[:n].astype(np.uint16) for row, n in zip(reader.ids, sizes)]


def slices(batch: pa.RecordBatch, most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many characters, a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def written_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """One row per block, see BLOCKS: doc_ids are those of the documents whose end is in the block, null_docs the places of null texts among them, first_doc the number in the part of the document that the block begins with."""
    if not 0 < block <= 1 << 14:
        raise ValueError("a block has 1 to 16384 ids")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, number, docs_before = Tokenizer.of(vocabulary), partition_id(), 0, 0
        blocks: list[tuple[np.ndarray, list, list]] = []
        parts, size, ids, nulls = [], 0, [], []

        def close() -> None:
            nonlocal parts, size, ids, nulls
            blocks.append((np.concatenate(parts), ids, nulls))
            parts, size, ids, nulls = [], 0, [], []

        def emit() -> pa.RecordBatch:
            nonlocal number, docs_before
            rows = []
            for (b, d, n), p in zip(blocks, encode_blocks([b for b, _, _ in blocks])):
                rows.append((part, number, docs_before, len(b), zlib.crc32(b.tobytes()), d, n, p))
                number, docs_before = number + 1, docs_before + len(d)
            blocks.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["part", "block", "first_doc", "n_ids", "checksum", "doc_ids", "null_docs", "payload"])

        for batch in batches:
            for some in slices(batch):
                texts = some.column("text").to_pylist()
                symbols, ends = tokenizer.all([t or "" for t in texts])
                done = 0
                for doc_id, text, e in zip(some.column("doc_id").to_pylist(), texts, ends.tolist()):
                    while size + e - done > block:
                        parts.append(symbols[done : done + block - size])
                        done += block - size
                        size = block
                        close()
                        if len(blocks) == LANES:
                            yield emit()
                    parts.append(symbols[done:e])
                    size += e - done
                    done = e
                    if text is None:
                        nulls.append(len(ids))
                    ids.append(doc_id)
        if size:
            close()
        if blocks:
            yield emit()

    return docs.select("doc_id", "text").mapInArrow(code, BLOCKS)


_PIECES = "part int, doc long, block int, ended boolean, whole boolean, doc_id long, missing boolean, piece binary"


def read_blocks(blocks: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text from the blocks, each decoded by itself; only documents that go over several blocks are put together in a shuffle. A wrong checksum is an error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.of(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, READ_LANES):
                rows = batch.slice(at, READ_LANES).to_pylist()
                out = []
                for r, found in zip(rows, decode_blocks([r["payload"] for r in rows], [r["n_ids"] for r in rows])):
                    if zlib.crc32(found.tobytes()) != r["checksum"]:
                        raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
                    ends, first, nulls = np.flatnonzero(found == END).tolist(), 0, set(r["null_docs"])
                    for k, (doc_id, e) in enumerate(zip(r["doc_ids"], ends)):
                        out.append((r["part"], r["first_doc"] + k, r["block"], True, k > 0, doc_id, k in nulls, tokenizer.bytes(found[first:e])))
                        first = e + 1
                    if first < len(found):
                        out.append((r["part"], r["first_doc"] + len(ends), r["block"], False, False, None, False, tokenizer.bytes(found[first:])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary()))],
                    ["part", "doc", "block", "ended", "whole", "doc_id", "missing", "piece"],
                )

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        text = None if rows[-1]["missing"] else b"".join(r["piece"] for r in rows).decode()
        return pa.table({"doc_id": pa.array([rows[-1]["doc_id"]], pa.int64()), "text": pa.array([text], pa.string())})

    pieces = written(blocks.mapInArrow(decode, _PIECES), "pieces")
    whole = pieces.where("whole").select("doc_id", F.when(~F.col("missing"), F.decode("piece", "utf-8")).alias("text"))
    return whole.unionByName(pieces.where("NOT whole").groupBy("part", "doc").applyInArrow(join, "doc_id long, text string"))
