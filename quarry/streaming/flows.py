"""Structured Streaming: extraction and consolidation of conversations as they arrive, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions import text as X
from quarry.operators import consolidation, extraction


def candidates(messages: DataFrame) -> DataFrame:
    """Memories in a stream of messages, without state: duplicates are left to the consolidation."""
    pieces = messages.select("conv_id", "turn", "role", F.posexplode(extraction.segments(F.col("text"))).alias("seq", "segment"))
    rows = pieces.withColumn("kind", extraction.kind(F.col("segment"))).withColumn("status", extraction.status(F.col("segment"), F.col("kind")))
    good = rows.where((F.length("segment") >= 18) & extraction.extractable(F.col("segment"), F.col("kind"), F.col("role")))
    return extraction.described(good.withColumn("tags", X.tags(F.col("segment"))))


_STATE = "rows array<struct<id:string,namespace:bigint,kind:string,status:string,canonical_key:string,text:string,seq:bigint,action:string,supersedes_id:string,superseded_by_id:string>>"
_OUT = "namespace long, kind string, seq long, text string, action string"


def actions(found: DataFrame) -> DataFrame:
    """The action taken for each candidate (namespace, kind, seq, text, action), with the memories of a namespace and kind as state."""
    rows = found.select(F.col("conv_id").cast("long").alias("namespace"), "kind", "status", "canonical_key", F.col("segment").alias("text"), (F.col("turn") * 100000 + F.col("seq")).cast("long").alias("seq"))
    names = [c.split(" ")[0] for c in consolidation.MEMORY.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = consolidation.State([dict(zip(names, r)) for r in (state.get[0] if state.exists else [])])
        group = pd.concat(list(batches)).sort_values("seq")
        out = []
        for c in group.astype(object).where(lambda d: d.notna(), None).to_dict("records"):
            out.append((key[0], key[1], c["seq"], c["text"], held.ingest(c)))
        state.update(([tuple(r[n] for n in names) for r in held.rows],))
        yield pd.DataFrame(out, columns=["namespace", "kind", "seq", "text", "action"])

    return rows.groupBy("namespace", "kind").applyInPandasWithState(fold, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling (or sliding) windows; rows later than the watermark are left out of a stream."""
    w: Column = F.window("ts", size, slide) if slide else F.window("ts", size)
    found = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: events that are no further apart than the gap."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
