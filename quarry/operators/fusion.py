"""Rank fusion: contributions of ranked branches, bonuses, blending with a reranker, document dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X

K = 60.0
TIME_WORDS = (
    "after|apr|april|aug|august|before|between|chronological|chronology|date|dates|dec|december|earliest|feb|february|first|jan|january|jul|july|jun|june|kick-off|kickoff"
    "|latest|mar|march|may|milestone|most recent|nov|november|oct|october|order of|past month|past two months|recently|schedule|scheduled|sep|sept|september|timeline|today|tomorrow|valentine|valentine's|when|yesterday"
).split("|")


def contains_any(text: Column, needles: list[str]) -> Column:
    """Whether the text contains one of the needles, as it is spelt."""
    import re

    return text.rlike("|".join(re.escape(n) for n in needles))


def time_anchored(text: Column) -> Column:
    """A cue word anywhere (also inside a longer word), a year, or a numeric date."""
    low = F.lower(text)
    return contains_any(low, TIME_WORDS) | low.rlike(r"\b(19|20)\d{2}\b") | low.rlike(r"\b\d{1,2}[/-]\d{1,2}\b")


def rrf(hits: DataFrame, weight: float | Column = 1.0, k: float = K) -> DataFrame:
    """Sum over branches of weight / (k + rank), more at ranks 1 to 3. hits: qid, chunk_id, rank (and weight)."""
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    extra = F.when(F.col("rank") == 1, 0.0025).when(F.col("rank") <= 3, 0.001).otherwise(0.0)
    return hits.groupBy("qid", "chunk_id").agg(F.sum(w / (k + F.col("rank")) + w * extra).alias("score"))


def scored_rrf(hits: DataFrame, weight: float | Column = 1.0, k: float = K) -> DataFrame:
    """Like rrf(), scaled by the hit's score: .75 to 1.25 times."""
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    extra = F.when(F.col("rank") == 1, 0.0015).otherwise(0.0)
    return hits.groupBy("qid", "chunk_id").agg(F.sum(w * (0.75 + 0.5 * bounded) / (k + F.col("rank")) + w * extra).alias("score"))


def preservation(hits: DataFrame, base: Column, weight: float = 2.0, rank_limit: int = 10) -> DataFrame:
    """Largest of weight * base / sqrt(rank) over the first ranks."""
    return hits.where(F.col("rank") <= rank_limit).groupBy("qid", "chunk_id").agg(F.max(weight * base / F.sqrt("rank")).alias("score"))


#: Cues of questions about times and numbers, of those that several documents answer, of broad recall.
AGGREGATE_CUES = ["as of", "count", "days passed", "first", "from earliest to latest", "how many", "how much", "last time", "most recently", "order of", "what month", "when did", "which date"]
SUPPORT_CUES = sorted("average|combined|different|from first to last|how many|how much|in total|including|order of|total|typical week|after the|before the|day before|days before|earliest to latest|first to last|last week|past month|past few months|past two months".split("|"))
SUPPORT_NUMBERS = r"\b(which|what|the|my)\s+(two|three|four|five|six)\b"
RECALL_CUES = sorted("find|how|look up|recall|remember|search|show me|tell me|what|when|where|which|who".split("|"))


def temporal_or_aggregate(query: Column) -> Column:
    return time_anchored(query) | contains_any(F.lower(query), AGGREGATE_CUES)


def needs_several(query: Column) -> Column:
    """Whether a question needs the evidence of several documents."""
    low = F.lower(query)
    return contains_any(low, SUPPORT_CUES) | low.rlike(SUPPORT_NUMBERS)


def broad_recall(query: Column) -> Column:
    """Short queries that begin with a question word; longer ones that ask, or have eight words."""
    low, n = F.lower(query), F.size(F.filter(F.split(X.comparison_key(query), " "), lambda w: w != ""))
    return F.when(n < 5, low.rlike("^(what|when|where|which|who|how) ")).otherwise(F.contains(low, F.lit("?")) | contains_any(low, RECALL_CUES) | (n >= 8))


def preservation_base(query: Column, semantic: bool) -> Column:
    high, low = (0.24, 0.08) if semantic else (0.36, 0.05)
    return F.when(temporal_or_aggregate(query), high).otherwise(low)


def promotion(hits: DataFrame, weight: float = 1.0) -> DataFrame:
    """Of lexical expansions: hits has qid, chunk_id, rank, text (of the expansion) and primary (the query's text)."""
    concise = (F.size(F.split(X.comparison_key(F.col("text")), " ")) <= 5) & (X.overlap_ratio(F.col("text"), F.col("primary")) <= 0.35)
    temporal = temporal_or_aggregate(F.col("primary"))
    limit = F.when(temporal, 2).otherwise(1)
    base = F.when(concise, 0.75).otherwise(0.24)
    return hits.where((concise | temporal) & (F.col("rank") <= limit)).groupBy("qid", "chunk_id").agg(F.max(weight * base / F.sqrt("rank")).alias("score"))


def recency(modified_at: Column, now: Column, days: float = 30.0) -> Column:
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp(modified_at)) / 86400.0)
    return F.exp(-age / days)


def coverage_anchors(query: Column) -> Column:
    """Up to four tokens with a digit or a capital; else up to three long ones that are no stop words."""
    raw = F.filter(F.split(query, X.SPLIT), lambda w: F.length(w) >= 2)
    first = F.array_distinct(F.transform(F.filter(raw, lambda w: w.rlike(r"\p{N}") | (w.rlike(r"^\p{Lu}") & (F.length(w) >= 3))), lambda w: F.lower(w)))
    rest = F.array_distinct(F.filter(F.transform(raw, lambda w: F.lower(w)), lambda w: (F.length(w) >= 5) & ~w.isin(X.QUERY_STOP_WORDS)))
    return F.when(F.size(first) > 0, F.slice(first, 1, 4)).otherwise(F.slice(rest, 1, 3))


def anchor_bonus(query: Column, title: Column, content: Column) -> Column:
    found = coverage_anchors(query)
    where = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(content, 1, 2000)))
    return F.when(F.size(found) > 0, 0.003 * F.size(F.filter(found, lambda a: F.contains(where, a))) / F.size(found)).otherwise(0.0)


def tag_bonus(query_tags: Column, chunk_tags: Column) -> Column:
    """Of arrays of (name, confidence) with distinct names: .01 times the matched share of the query's confidence."""
    def bonus(both: Column) -> Column:
        mass = F.aggregate(both["q"], F.lit(0.0), lambda s, t: s + t["confidence"])
        of = lambda name: F.coalesce(F.array_max(F.transform(F.filter(both["c"], lambda c: c["name"] == name), lambda c: c["confidence"])), F.lit(0.0))
        hit = F.aggregate(both["q"], F.lit(0.0), lambda s, t: s + F.least(t["confidence"], of(t["name"])))
        return F.when(mass > 0, 0.01 * F.least(F.lit(1.0), hit / mass)).otherwise(0.0)

    # in a lambda, so that the arrays are made once for a row
    return F.get(F.transform(F.array(F.struct(query_tags.alias("q"), chunk_tags.alias("c"))), bonus), F.lit(0))


def schema_bonus(entities: Column, facets: Column, topics: Column, chunk_tag_names: Column) -> Column:
    hit = lambda values, kind: F.size(F.array_intersect(F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v)), chunk_tag_names))
    return F.least(0.03 * hit(entities, "entity"), F.lit(0.09)) + F.least(0.015 * hit(facets, "facet"), F.lit(0.06)) + F.least(0.01 * hit(topics, "topic"), F.lit(0.04))


def temporal_bonus(intent: Column, modified_at: Column, now: Column, status: Column, content: Column) -> Column:
    fresh = F.least(F.lit(0.05), 0.05 * recency(modified_at, now, 14.0))
    past = F.when(status.isin("superseded", "archived"), 0.04).otherwise(0.0)
    return F.when(intent.isin("recent", "most_recent"), fresh).when(intent == "historical", past).when(intent.isin("time_anchored", "count") & time_anchored(content), 0.025).otherwise(0.0)


def status_bonus(preferred: Column, status: Column) -> Column:
    return F.when(F.array_contains(preferred, status), 0.035).otherwise(0.0)


def fusion_weights(query: Column) -> tuple[Column, Column, Column]:
    """Weights of the semantic, lexical and recency scores."""
    t = time_anchored(query)
    return F.when(t, 0.64).otherwise(0.62), F.when(t, 0.35).otherwise(0.33), F.when(t, 0.01).otherwise(0.05)


def fused(candidates: DataFrame, now: str) -> DataFrame:
    """fused score, recency and anchor bonus of candidates: qid, query, chunk_id, semantic, lexical, title, content, modified_at; other bonuses come as `bonus`."""
    moment = F.to_timestamp(F.lit(now))
    ws, wl, wr = fusion_weights(F.col("query"))
    out = candidates.withColumn("recency", recency(F.col("modified_at"), moment)).withColumn("anchor", anchor_bonus(F.col("query"), F.col("title"), F.col("content")))
    extra = F.coalesce(F.col("bonus"), F.lit(0.0)) if "bonus" in candidates.columns else F.lit(0.0)
    return out.withColumn("fused", ws * F.coalesce("semantic", F.lit(0.0)) + wl * F.coalesce("lexical", F.lit(0.0)) + wr * F.col("recency") + F.col("anchor") + extra)


def by_rank(df: DataFrame, score: str, limit: int | None = None, name: str = "rank") -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc(F.round(score, 9)), "chunk_id")
    out = df.withColumn(name, F.row_number().over(w))
    return out.where(F.col(name) <= limit) if limit else out


def hydration_limit(limit: int, rerank: int, pool: int) -> int:
    """How many candidates have their texts read."""
    return pool if rerank == 0 else min(1000, max(pool, -(-3 * max(limit, rerank) // 2), 200))


def protection_limit(limit: int, hydration: int) -> int:
    """How many of each signal's best are among them in any case."""
    return min(max(40, limit // 2), max(1, hydration // 3))


#: Score columns of a candidate, in the order in which their best are protected.
SIGNALS = ["semantic", "lexical", "promotion", "primary_semantic", "primary_lexical"]


def preselected(scores: DataFrame, protect: int, limit: int) -> DataFrame:
    """Candidates whose texts are read: those protected by any of SIGNALS, one signal after the other while there is room, then by preliminary score, `limit` at most of a query.

    scores: qid, query, chunk_id and SIGNALS (null: the branch has not found it). Adds preliminary.
    """
    c = {s: F.coalesce(s, F.lit(0.0)) for s in SIGNALS}
    ws, wl, _ = fusion_weights(F.col("query"))
    scores = scores.withColumn("preliminary", ws * (c["semantic"] + c["primary_semantic"]) + wl * (c["lexical"] + c["promotion"] + c["primary_lexical"]))
    turn = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(SIGNALS))):
        scores = scores.withColumn(f"_{s}", F.row_number().over(Window.partitionBy("qid").orderBy(F.col(s).isNull(), F.desc(F.round(s, 9)), "chunk_id")))
        turn = F.when(F.col(s).isNotNull() & (F.col(f"_{s}") <= protect), i * protect + F.col(f"_{s}")).otherwise(turn)
    w = Window.partitionBy("qid").orderBy(F.col("_turn").isNull(), "_turn", F.desc(F.round("preliminary", 9)), "chunk_id")
    kept = scores.withColumn("_turn", turn).withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= limit)
    return kept.drop("_turn", "_place", *(f"_{s}" for s in SIGNALS))


def overlap_rerank(query: Column, title: Column, content: Column) -> Column:
    """The default reranker: share of the query's tokens in title and content, .2 more if the phrase occurs; at most 1."""
    own = lambda c: F.filter(X.tokens(c), lambda t: (F.length(t) >= 3) & ~t.isin(X.QUERY_STOP_WORDS))
    where = F.concat_ws(" ", title, F.substring(content, 1, 300), F.substring(content, 1, 240))
    q = own(query)
    phrase = F.when(F.contains(F.lower(where), F.lower(query)), 0.2).otherwise(0.0)
    return F.when(F.size(q) > 0, F.least(F.lit(1.0), F.size(F.array_intersect(q, own(where))) / F.size(q) + phrase)).otherwise(0.0)


def blended(ranked: DataFrame, limit: int) -> DataFrame:
    """fused_norm and blended of rows with fused, rank and rerank (null beyond the reranked ones): the fused part weighs .75, .60 or .40 by rank. Without a rerank score, blended is fused."""
    best = F.max("fused").over(Window.partitionBy("qid"))
    norm = F.when(best > 0, F.col("fused") / best).otherwise(0.0)
    fw = F.when(F.col("rank") <= 3, 0.75).when(F.col("rank") <= 10, 0.60).otherwise(0.40)
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rerank")))
    out = ranked.withColumn("fused_norm", F.least(F.lit(1.0), F.greatest(F.lit(0.0), norm))).withColumn("blended", F.when((F.col("rank") <= limit) & F.col("rerank").isNotNull(), fw * F.col("fused_norm") + (1 - fw) * clamped).otherwise(F.col("fused")))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("blended", 9)), F.desc(F.round("fused", 9)), "chunk_id")
    return out.withColumn("final_rank", F.row_number().over(w))


def one_per_document(ranked: DataFrame, key: str = "path", rank: str = "rank") -> DataFrame:
    """The best row of each document, ranked again."""
    first = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("qid", key).orderBy(rank, "chunk_id"))).where("_n = 1").drop("_n")
    return first.withColumn("doc_rank", F.row_number().over(Window.partitionBy("qid").orderBy(rank, "chunk_id")))


def strong_signal(hits: DataFrame, query_tokens: Column) -> DataFrame:
    """Per qid: whether its best lexical score is at least .10 and .05 above the next, for queries of up to 12 tokens."""
    top = hits.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("next"), F.first(query_tokens).alias("n_tokens"))
    return top.withColumn("strong", (F.col("n_tokens") <= 12) & (F.col("top") >= 0.10) & (F.col("top") - F.col("next") >= 0.05))


def skip_semantic(strong: Column, hits: Column, limit: int, scope: Column) -> Column:
    """Whether a search below a path can do without vectors: a strong signal with enough lexical hits, or lexical hits for the whole scope."""
    return (hits > 0) & ((strong & (hits >= min(limit, 8))) | (hits >= F.greatest(F.lit(8), F.least(F.lit(limit), scope, F.lit(24)))))


DOCUMENT_WEIGHTS = (0.45, 0.60)


def document_branches(branches: DataFrame, lexical_limit: int, limit: int) -> DataFrame:
    """Branches that also search whole documents, two of a query at most, with their limit and weight.

    branches: qid, branch (0 is the query itself), kind, weight, text, hits (of its lexical search), strong.
    """
    first = F.col("branch") == 0
    open_ = ~F.col("strong") & (F.lit(lexical_limit) >= 32) & (F.col("hits") < 12) & F.when(first, broad_recall(F.col("text"))).otherwise(F.col("kind") == "lexical")
    used = F.row_number().over(Window.partitionBy("qid").orderBy("branch"))
    most = F.when(first, min(lexical_limit, min(96, max(24, 4 * limit)))).otherwise(min(lexical_limit, min(96, max(24, 3 * limit))))
    return branches.where(open_).withColumn("used", used).where("used <= 2").drop("used").withColumn("document_limit", most).withColumn("document_weight", F.col("weight") * F.when(first, DOCUMENT_WEIGHTS[0]).otherwise(DOCUMENT_WEIGHTS[1]))


def protected(ranked: DataFrame, limit: int, explicit: int | None = None) -> DataFrame:
    """The first `limit` rows of each query, with documents that the primary branch found swapped into their tail.

    ranked: qid, query, chunk_id, path, blended, fused, primary (sum of the preservation scores), final_rank; as many
    rows of a query as its pool has. A document goes in for the last one that isn't protected and that it comes up to:
    .75 of its blended or fused score, .55 for questions about times and numbers. Swaps depend on those before, so each
    query's rows are walked through in Python.
    """
    import pandas as pd

    most = min(limit, explicit) if explicit is not None else min(limit, min(5, max(1, limit // 2))) if limit > 1 else 0
    schema = "qid long, chunk_id long, path string, blended double, fused double, primary double, ratio double, final_rank int"

    def swap(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["final_rank", "chunk_id"]).reset_index(drop=True)
        best = rows[rows.primary > 0].sort_values(["primary", "final_rank"], ascending=[False, True]).drop_duplicates("path").head(most)
        guarded, top = set(best.path), list(rows.index[:limit])
        for i, row in best.iterrows():
            if row.path in {rows.path[j] for j in top}:
                continue
            for at in reversed(range(len(top))):
                old = rows.loc[top[at]]
                if old.path not in guarded and (explicit is not None or old.blended <= 0 or row.blended >= row.ratio * old.blended or row.fused >= row.ratio * old.fused):
                    top[at] = i
                    break
        out = rows.loc[sorted(top)].copy()
        out["final_rank"] = range(1, len(out) + 1)
        return out

    rows = ranked.withColumn("ratio", F.when(temporal_or_aggregate(F.col("query")), 0.55).otherwise(0.75))
    return rows.select("qid", "chunk_id", "path", "blended", "fused", "primary", "ratio", F.col("final_rank").cast("int").alias("final_rank")).groupBy("qid").applyInPandas(swap, schema).drop("ratio")


def group_key(path: Column) -> Column:
    """Folder and file stem without a trailing number (and _abs before it), which files of one series share; null for other files and for memories."""
    low = F.regexp_replace(X.fold(path), r"\\", "/")
    stem = F.regexp_replace(low, r"\.[a-z0-9]+$", "")
    name = F.element_at(F.split(stem, "/"), -1)
    series = F.regexp_replace(name, r"(_abs)?_\d+$", "")
    return F.when(~F.startswith(low, F.lit("memory://")) & (series != name) & F.contains(series, F.lit("_")), F.regexp_replace(stem, r"(_abs)?_\d+$", ""))


def support(lexical: Column, semantic: Column, bonuses: Column, rank: Column) -> Column:
    return F.greatest(lexical, semantic) + 0.45 * F.least(lexical, semantic) + bonuses + 0.02 / F.sqrt(rank)


def multi_evidence(ranked: DataFrame, limit: int) -> DataFrame:
    """new_rank for questions that need several documents: two anchors, the best later sibling of up to three groups, then by support; at last up to three siblings take the places of weak rows.

    ranked: qid, query, chunk_id, path, final_rank, support; one row of a document, at most as many as a search returns.
    Other questions, and those with up to ten rows, keep their order.
    """
    import pandas as pd

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("final_rank").reset_index(drop=True)
        window = min(10, limit, len(rows))
        out = list(rows.index)
        if rows.several[0] and len(rows) > 10 and limit > 1 and window >= 4:
            out = _evidence_order(rows.support.tolist(), [g or None for g in rows.group.tolist()], window)
        rows = rows.loc[out]
        return rows.assign(new_rank=range(1, len(rows) + 1)).drop(columns=["several", "group"])

    rows = ranked.select("qid", "chunk_id", "path", F.col("final_rank").cast("int").alias("final_rank"), "support", needs_several(F.col("query")).alias("several"), F.coalesce(group_key(F.col("path")), F.lit("")).alias("group"))
    return rows.groupBy("qid").applyInPandas(order, "qid long, chunk_id long, path string, final_rank int, support double, new_rank int")


def _evidence_order(support_: list[float], group: list[str | None], window: int) -> list[int]:
    """Places of the rows (place i has document rank i + 1) in their new order."""
    pool = range(min(len(support_), max(50, window * 5)))
    median = sorted(support_[:window])[window // 2]
    later = lambda i: (-(support_[i] + 0.08 / (i + 1) ** 0.5), i)
    chosen, led = list(range(min(2, window))), set()
    known = {g for g in group[:window] if g}
    for i in sorted((i for i in pool[window:] if i < 30 and group[i] in known), key=later):
        if len(chosen) < window and len(led) < min(3, max(1, window - 2)) and group[i] not in led:
            led.add(group[i])
            chosen.append(i)
    chosen += [i for i in sorted((i for i in pool[2:] if i < 30 or support_[i] >= 0.55 * median), key=lambda i: (-support_[i], i)) if i not in chosen][: window - len(chosen)]
    chosen += [i for i in pool if i not in chosen][: window - len(chosen)]
    count = {g: sum(group[i] == g for i in chosen) for g in {group[i] for i in chosen} - {None}}
    open_ = sorted((i for i in pool[window:] if i < 60 and group[i] in count and i not in chosen and support_[i] >= max(0.04, 0.08 * median)), key=later)
    swaps = 0
    for i in open_ if len(chosen) >= window else []:
        weak = [at for at in range(2, len(chosen)) if group[chosen[at]] is None or (group[chosen[at]] != group[i] and count[group[chosen[at]]] > 1)]
        if swaps < 3 and count[group[i]] < 3 and weak:
            at = min(weak, key=lambda at: (support_[chosen[at]], -at))
            if group[chosen[at]]:
                count[group[chosen[at]]] -= 1
            chosen[at] = i
            count[group[i]] += 1
            swaps += 1
    return chosen + [i for i in range(len(support_)) if i not in chosen]


def oracle_order(ranked: DataFrame) -> DataFrame:
    """Relevant rows first, in their order: the best that reranking could do. ranked has rank and relevant."""
    return ranked.withColumn("oracle_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("relevant"), "rank")))
