"""Cut texts into overlapping chunks at headings, rules, blank lines and declarations, never inside a code fence."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET_TOKENS, OVERLAP_TOKENS, CHARS = 900, 135, 4
_DECLARATION = re.compile(r"(interface|def|import|var|let|actor|extension|protocol|enum|struct|class|func) |(internal|private|public) func")
CODE = sorted("zsh yaml yml ts tsx toml swift sql sh scala rs rb py php mm m kt json jsx js java hpp h go css cs cpp c bash".split())


def _score(line: str, code: bool) -> int:
    heading = re.match(r"(#{1,6}) ", line)
    if heading:
        return 110 - 10 * len(heading[1])
    if line.startswith("```"):
        return 80
    if line in ("___", "***", "---"):
        return 60
    if not line:
        return 20
    if code and _DECLARATION.match(line):
        return 70
    return 5 if re.match(r"[+*-] |\d.{0,2}[.)]", line) else 0


def chunks(text: str | None, code: bool = False, target: int = TARGET_TOKENS * CHARS, overlap: int = OVERLAP_TOKENS * CHARS) -> list[str]:
    """The chunks of a text, without outer white space; a rest of up to target plus an eighth stays whole."""
    if overlap >= target * 3 // 4:
        raise ValueError("the overlap must be less than three quarters of the target")
    text = (text or "").replace("\r\n", "\n")
    if not text.strip():
        return []
    window, marks, fences, opened, at = target // 4, [], [], None, 0
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("```"):
            if opened is None:
                opened = at
            else:
                fences.append((opened, at + len(line)))
                opened = None
        if score := _score(bare, code):
            marks.append((at, score))
        at += len(line) + 1
    marks = [m for m in marks if not any(a < m[0] < b for a, b in fences)]
    places, out, position = [p for p, _ in marks], [], 0
    while position < len(text):
        if len(text) - position <= target + window // 2:
            out.append(text[position:].strip())
            break
        goal = position + target
        near = marks[bisect.bisect_left(places, max(position + 1, goal - window)) : bisect.bisect_right(places, goal)]
        # the first of the best ones
        cut = max(near, key=lambda m: (m[1] * (1 - 0.7 * ((goal - m[0]) / window) ** 2), -m[0]))[0] if near else goal
        out.append(text[position:cut].strip())
        position = cut - overlap if overlap and cut > overlap else cut
    return [c for c in out if c]


def chunked(documents: DataFrame, target: int = TARGET_TOKENS * CHARS, overlap: int = OVERLAP_TOKENS * CHARS) -> DataFrame:
    """document_id, ordinal, content, token_count of documents (document_id, path, text)."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, code in batches:
            yield pd.Series([chunks(t, bool(c), target, overlap) for t, c in zip(texts, code)])

    is_code = F.coalesce(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(CODE), F.lit(False))
    rows = documents.select("document_id", F.posexplode(cut(F.col("text"), is_code)).alias("ordinal", "content"))
    return rows.withColumn("token_count", F.ceil(F.length("content") / CHARS).cast("int"))
