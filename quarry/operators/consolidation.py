"""Consolidation of extracted memories: dedupe, replace, supersede, merge of status - an ordered fold per namespace and kind.

A candidate sees what earlier ones of its namespace and kind wrote, so the fold is sequential within that group and
parallel across groups. Rows of a group come in order; the fold holds the group's live memories only.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import QUERY_STOP_WORDS, SYNONYMS

MEMORY = "id string, namespace long, kind string, status string, canonical_key string, text string, seq long, action string, supersedes_id string, superseded_by_id string"
_RECENT = 200
_STOP = set(QUERY_STOP_WORDS)
_CANONICAL = set("todo task switched switch status resolved profile memory memories item finished fact done decision completed commitment closed add action".split())
_MATCH = set("using updated update remember recently ready launch instead implemented implement finished default decided current continue complete chose choose before approved actually".split())


def _fold(text: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


def comparison_key(text: str) -> str:
    return " ".join(_fold(text))


def semantic_key(text: str) -> str:
    return " ".join(w for w in (SYNONYMS.get(w, w) for w in _fold(text)) if w not in _STOP)


def match_tokens(text: str, key: str | None) -> set[str]:
    found = (SYNONYMS.get(w, w) for w in _fold(f"{text} {key or ''}"))
    return {w for w in found if len(w) >= 3 and w not in _STOP and w not in _CANONICAL and w not in _MATCH}


def memory_id(namespace: int, kind: str, text: str, seq: int) -> str:
    """Deterministic, so a repeated run writes the same rows."""
    return hashlib.sha256(f"{namespace}|{kind}|{text}|{seq}".encode()).hexdigest()[:32]


class State:
    """The memories of one namespace and kind."""

    def __init__(self, rows: Iterable[dict] = ()) -> None:
        self.rows: list[dict] = list(rows)

    def _live(self, statuses: tuple[str, ...]) -> list[dict]:
        return [r for r in reversed(self.rows) if r["status"] in statuses]

    def _by_key(self, key: str, statuses: tuple[str, ...]) -> dict | None:
        return next((r for r in self._live(statuses) if r["canonical_key"] == key), None)

    def _related(self, c: dict, statuses: tuple[str, ...]) -> dict | None:
        if c["kind"] not in ("commitment", "decision", "profile"):
            return None
        own, best, score = match_tokens(c["text"], c["canonical_key"]), None, 0.0
        if len(own) < 2:
            return None
        for r in self._live(statuses)[:_RECENT]:
            other = match_tokens(r["text"], r["canonical_key"])
            both = len(own & other)
            if len(other) < 2 or both < 2 or 2 * both < min(len(own), len(other)):
                continue
            value = both / min(len(own), len(other)) + (0.05 if r["status"] == c["status"] else 0.0)
            if best is None or value > score:
                best, score = r, value
        return best

    def _insert(self, c: dict, act: str, supersedes: dict | None = None) -> str:
        row = {**c, "id": memory_id(c["namespace"], c["kind"], c["text"], c["seq"]), "action": act, "supersedes_id": supersedes and supersedes["id"], "superseded_by_id": None}
        self.rows.append(row)
        return act

    def _supersede(self, c: dict, old: dict, act: str) -> str:
        self._insert(c, act, old)
        old["status"], old["superseded_by_id"] = "superseded", self.rows[-1]["id"]
        return act

    def _same(self, old: dict, c: dict) -> bool:
        return comparison_key(old["text"]) == comparison_key(c["text"]) and old["status"] == c["status"]

    def ingest(self, c: dict) -> str:
        """Write one candidate; returns the action taken."""
        kind, key = c["kind"], c["canonical_key"]
        if kind == "fact":
            active, own = self._live(("active",)), semantic_key(c["text"])
            if any(r["text"] == c["text"] for r in active) or own and any(semantic_key(r["text"]) == own for r in active[:_RECENT]):
                return "dedupe"
            return self._insert(c, "create")
        if kind == "episode":
            return self._insert(c, "append_episode")
        if key is None:
            return self._insert(c, "create")
        if kind == "commitment":
            old = self._by_key(key, ("active", "resolved")) or self._related(c, ("active", "resolved"))
            if old is None:
                return self._insert(c, "create")
            if c["status"] != "active":
                changed, old["status"] = old["status"] != c["status"], c["status"]
                return "merge_status" if changed else "dedupe"
            if self._same(old, c):
                return "dedupe"
            return self._supersede(c, old, "supersede") if old["status"] == "active" else self._insert(c, "create", old)
        exact = self._by_key(key, ("active",))
        old = exact or self._related(c, ("active",))
        if old is None:
            return self._insert(c, "create")
        if self._same(old, c):
            return "dedupe"
        if exact is None and old["canonical_key"]:
            c = {**c, "canonical_key": old["canonical_key"]}
        return self._supersede(c, old, "supersede" if kind == "decision" else "replace_active")


def consolidated(candidates: DataFrame, namespace: str = "conv_id") -> DataFrame:
    """The memories after all candidates (conv_id, turn, seq, segment, kind, status, canonical_key) were written in order."""
    rows = candidates.select(F.col(namespace).cast("long").alias("namespace"), "kind", "status", "canonical_key", F.col("segment").alias("text"), (F.col("turn") * 100000 + F.col("seq")).cast("long").alias("seq"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        state = State()
        for c in group.sort_values("seq").astype(object).where(lambda d: d.notna(), None).to_dict("records"):
            state.ingest(c)
        columns = [c.split(" ")[0] for c in MEMORY.split(", ")]
        return pd.DataFrame(state.rows, columns=columns)

    return rows.groupBy("namespace", "kind").applyInPandas(fold, MEMORY)


def materialized(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents and chunks of memories: path memory://id, tags facet:, entity: and topic:."""
    docs = memories.select(F.concat(F.lit("memory://"), "id").alias("path"), F.initcap("kind").alias("title"), F.col("id").alias("memory_id"), F.col("kind").alias("memory_kind"), F.col("status").alias("memory_status"))
    from .extraction import facets, topics

    tag = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v))
    chunks = memories.select(F.concat(F.lit("memory://"), "id").alias("path"), F.lit(0).alias("ordinal"), F.col("text").alias("content"), F.concat(tag("facet", facets(F.col("text"), F.col("kind"))), tag("topic", topics(F.col("text")))).alias("tags"))
    return docs, chunks
