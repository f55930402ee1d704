"""Removal of benchmark passages from training documents, found in an FM-index of each shard of the documents.

Test phrases are all windows of N words of the benchmark items (an item with fewer words is one phrase). A shard is a
run of documents within a task. Its words become symbols; words that no phrase has match nothing, so all of them are
the separator, and stretches between separators that are too short for any phrase are left out - neither changes what
is found. Phrases are searched backwards through the ranks of a wavelet matrix, occurrences are located by sampled
suffix positions, and overlapping or touching occurrences merge into removal spans.

Defined results
* Words are runs of letters and digits in lower case, so case, punctuation and line breaks don't hide a passage.
* Null, empty and word-less texts or items have no hits. Every row of documents is searched by itself: repeated rows
  have equal spans, a row without doc_id reports null. Repeated items are hits under each of their ids; rows of the
  benchmark without item_id still remove text and count as no item.
* clean() keeps every column and row, except rows of which nothing but white space is left of a text that had a hit; if
  a column n_chars exists, it is updated where the text changed. Without phrases nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, input_bytes, stable, tokenize
from .fm import FMIndex

N = 8
#: Phrases are sent to the tasks; a benchmark of more bytes than this is searched slice by slice.
SLICE_BYTES = 64 << 20
_SHARD_WORDS = 2_000_000


class Phrases:
    """The distinct phrases of a benchmark, as rows of symbols, with the items that each occurs in."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int) -> None:
        tokens = tokenize([t for _, t in items])
        self.vocabulary, symbols = np.unique(tokens.hashes, return_inverse=True)
        symbols = symbols.astype(np.uint32) + 1
        found: dict[bytes, set[int]] = {}
        for (item, _), a, b in zip(items, tokens.bounds[:-1].tolist(), tokens.bounds[1:].tolist()):
            size = min(n, b - a)
            for at in range(a, b - size + 1 if size else a):
                found.setdefault(symbols[at : at + size].tobytes(), set()).update([] if item is None else [item])
        self.items = list(found.values())
        self.lengths = np.array([len(k) // 4 for k in found], np.int64)
        self.patterns = np.zeros((len(found), n), np.uint32)
        for row, k in zip(self.patterns, found):
            row[: len(k) // 4] = np.frombuffer(k, np.uint32)
        self.least = int(self.lengths.min()) if len(found) else 0

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


class Shard:
    """Documents gathered for one FM-index."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases, self.pieces, self.rows, self.firsts, self.words, self.documents = phrases, [], [], [], 0, 0

    def add(self, texts: list[str | None]) -> None:
        tokens = tokenize(texts)
        symbols = self.phrases.symbols(tokens.hashes)
        symbols = np.r_[0, np.insert(symbols, tokens.bounds[1:], 0)]  # a separator before and after each text
        edges = np.flatnonzero(np.diff(symbols != 0))
        starts, ends = edges[::2] + 1, edges[1::2] + 1
        long = ends - starts >= self.phrases.least
        bounds = tokens.bounds + np.arange(len(tokens.bounds))
        row = np.searchsorted(bounds, starts[long] - 1, "right") - 1
        for a, b, r in zip(starts[long].tolist(), ends[long].tolist(), row.tolist()):
            self.pieces.append(symbols[a:b])
            self.rows.append(self.documents + r)
            self.firsts.append(a - 1 - int(bounds[r]))
        self.words += len(tokens.hashes)
        self.documents += len(texts)

    def spans(self) -> dict[int, list[tuple[int, int, set[int]]]]:
        """Per document (in order of adding): merged spans of words with the items found in them."""
        if not self.pieces:
            return {}
        seq = np.zeros(sum(map(len, self.pieces)) + len(self.pieces), np.int64)
        begins = np.r_[0, np.cumsum([len(p) + 1 for p in self.pieces])]
        for p, at in zip(self.pieces, begins.tolist()):
            seq[at : at + len(p)] = p
        index = FMIndex(seq, len(self.phrases.vocabulary) + 1).drop_order()
        lo, hi = index.find(self.phrases.patterns, self.phrases.lengths)
        hit = np.flatnonzero(hi > lo)
        counts = hi[hit] - lo[hit]
        total = int(counts.sum())
        rows = np.repeat(lo[hit] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(total)
        places, which = index.locate(rows), np.repeat(hit, counts)
        piece = np.searchsorted(begins, places, "right") - 1
        document = np.array(self.rows, np.int64)[piece]
        start = places - begins[piece] + np.array(self.firsts, np.int64)[piece]
        order = np.lexsort((start, document))
        out: dict[int, list[tuple[int, int, set[int]]]] = {}
        for d, a, k in zip(document[order].tolist(), start[order].tolist(), which[order].tolist()):
            spans, b = out.setdefault(d, []), a + int(self.phrases.lengths[k])
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]), spans[-1][2] | self.phrases.items[k])
            else:
                spans.append((a, b, set(self.phrases.items[k])))
        return out


def _slices(benchmark: DataFrame, n: int) -> list[Phrases]:
    """The benchmark's phrases, on the driver in slices of a bounded size."""
    benchmark = stable(benchmark.select("item_id", "text"), "benchmark")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    count = max(1, -(-input_bytes(benchmark) * 4 // SLICE_BYTES))
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k)
        phrases = Phrases([(r.item_id, r.text) for r in part.toLocalIterator()], n)
        if phrases.items:
            yield phrases


def _shards(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[tuple[list[pa.RecordBatch], dict]]:
    shard, held = Shard(phrases), []
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            shard.add(batch.column("text").slice(at, 512).to_pylist())
        held.append(batch)
        if shard.words >= _SHARD_WORDS:
            yield held, shard.spans()
            shard, held = Shard(phrases), []
    if held:
        yield held, shard.spans()


_SPANS = "rid long, doc_id long, word_start long, word_end long, items array<long>"


def _found(docs: DataFrame, phrases: Phrases) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, spans in _shards(batches, phrases):
            ids = pa.chunked_array([b.column("doc_id") for b in held]).cast(pa.int64())
            rids = pa.chunked_array([b.column("rid") for b in held])
            rows = [(rids[d].as_py(), ids[d].as_py(), a, b, sorted(items)) for d, found in spans.items() for a, b, items in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.list_(pa.int64())))], ["rid", "doc_id", "word_start", "word_end", "items"])

    return docs.select("rid", "doc_id", "text").mapInArrow(search, _SPANS)


def _merged(found: DataFrame) -> DataFrame:
    """Spans of several slices of the benchmark, merged per row."""

    def merge(table: pa.Table) -> pa.Table:
        out: list[list] = []
        for r in sorted(table.to_pylist(), key=lambda r: r["word_start"]):
            if out and r["word_start"] <= out[-1][3]:
                out[-1][3] = max(out[-1][3], r["word_end"])
                out[-1][4] = sorted({*out[-1][4], *r["items"]})
            else:
                out.append([r["rid"], r["doc_id"], r["word_start"], r["word_end"], r["items"]])
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (*[pa.int64()] * 4, pa.list_(pa.int64())))], ["rid", "doc_id", "word_start", "word_end", "items"])

    return found.groupBy("rid").applyInArrow(merge, _SPANS)


def spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row per span to remove: doc_id, word_start, word_end (exclusive), n_items and the least item_id."""
    numbered = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    found: list[DataFrame] = [_found(numbered, phrases) for phrases in _slices(benchmark, n)]
    if not found:
        out = docs.sparkSession.createDataFrame([], _SPANS)
    elif len(found) == 1:
        out = found[0]
    else:
        from functools import reduce

        out = _merged(reduce(DataFrame.unionByName, found))
    return out.select("doc_id", "word_start", "word_end", F.size("items").alias("n_items"), F.array_min("items").alias("item_id"))


def cut(text: str, found: list[tuple[int, int, set[int]]]) -> str:
    """text without the characters from the first to the last word of each span."""
    tokens = tokenize([text])
    starts, ends = tokens.starts, tokens.ends
    if len(text.lower()) != len(text):  # some letters become two in lower case
        at = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
        starts, ends = at[starts], at[ends - 1] + 1
    kept, last = [], 0
    for a, b, _ in found:
        kept.append(text[last : starts[a]])
        last = int(ends[b - 1])
    return "".join([*kept, text[last:]])


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """docs with the spans cut out of the texts. The spans of all slices of a benchmark are found in the original text, merged and cut at once."""
    out, held, last = docs, fresh(docs, "_spans"), None
    for phrases in _slices(benchmark, n):
        if last is not None:
            out = _marked(out, last, held)
        last = phrases
    return docs if last is None else _cleaned(out, last, held if held in out.columns else None)


_HELD = "array<struct<a:long,b:long>>"


def _marked(docs: DataFrame, phrases: Phrases, held: str) -> DataFrame:
    """docs with the spans of one slice of the benchmark added to the column held, its last."""
    docs = docs if held in docs.columns else docs.withColumn(held, F.lit(None).cast(_HELD))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, spans in _shards(batches, phrases):
            first = 0
            for batch in some:
                column = batch.column(batch.num_columns - 1)
                found = [(old or []) + [{"a": a, "b": b} for a, b, _ in spans.get(first + i, [])] for i, old in enumerate(column.to_pylist())]
                first += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x or None for x in found], column.type)], schema=batch.schema)

    return docs.mapInArrow(mark, docs.schema)


def _joined(spans: list[tuple[int, int, set[int]]]) -> list[tuple[int, int, set[int]]]:
    """Spans of several slices in one text, overlapping and touching ones as one."""
    out: list[tuple[int, int, set[int]]] = []
    for a, b, items in sorted(spans, key=lambda s: s[:2]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2] | items)
        else:
            out.append((a, b, items))
    return out


def _cleaned(docs: DataFrame, phrases: Phrases, earlier: str | None = None) -> DataFrame:
    """docs without the spans of phrases, and of those in the column earlier, the last, which is left out."""
    kept = docs.drop(earlier) if earlier else docs
    names = kept.columns
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, spans in _shards(batches, phrases):
            first = 0
            for batch in held:
                mine = {d - first: s for d, s in spans.items() if first <= d < first + batch.num_rows}
                first += batch.num_rows
                if earlier:
                    for d, old in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                        if old:
                            mine[d] = _joined([*mine.get(d, []), *((s["a"], s["b"], set()) for s in old)])
                    batch = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
                if mine:
                    columns = list(batch.columns)
                    new = {d: cut(columns[text_at][d].as_py(), s) for d, s in mine.items()}
                    hit = np.zeros(batch.num_rows, bool)
                    hit[list(new)] = True
                    order = sorted(new)
                    replace = lambda column, values: pc.replace_with_mask(column, pa.array(hit), pa.array(values, column.type))
                    columns[text_at] = replace(columns[text_at], [new[d] for d in order])
                    if chars_at is not None:
                        columns[chars_at] = replace(columns[chars_at], [len(new[d]) for d in order])
                    keep = np.ones(batch.num_rows, bool)
                    keep[[d for d in order if not new[d].strip()]] = False
                    batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))
                yield batch

    return docs.mapInArrow(remove, kept.schema)


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), {N}) AS k, unnest(list_transform(range(1, len(w) - least(len(w), {N}) + 2), lambda i: array_to_string(w[i:i + least(len(w), {N}) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM p),
g AS (SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS pos, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM d, ks WHERE len(w) >= k),
h AS (SELECT doc_id, pos AS s, pos + k AS e, list(DISTINCT item_id) AS items FROM g JOIN p USING (k, g) GROUP BY ALL),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM h),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, min(s) AS word_start, max(e) AS word_end, CAST(len(list_distinct(flatten(list(items)))) AS INT) AS n_items, list_min(flatten(list(items))) AS item_id FROM i GROUP BY doc_id, island"""
