"""Words of texts in Arrow: the words of functions.text.words(), for Python tasks that read whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import SPLIT

#: Texts that are split at once.
PIECE = 4 << 20


def pieces(texts: pa.Array) -> Iterator[slice]:
    """Ranges of rows of about PIECE bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield slice(at, stop)
        at = stop


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """row, code: of each word its text and its place among the distinct words; those. Null is a text without words."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), SPLIT)
    words = lists.flatten()
    row, full = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), np.asarray(pc.greater(pc.binary_length(words), 0))
    coded = words.filter(pa.array(full)).dictionary_encode()
    return row[full], coded.indices.to_numpy(), coded.dictionary
