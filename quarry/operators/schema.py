"""What a memory is about: facets, entities, topics, canonical key; normal forms of such values; tags' confidence.

Phrases are looked for in the text's comparison key (folded words joined by blanks), between word ends. The gazetteers
of names and topics are parameters; the defaults hold common names only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.functions import text as X

MOST_ENTITIES, MOST_TOPICS = 8, 16
#: Cue phrases of the facets that need nothing else.
CUES: dict[str, list[str]] = {
    "constraint": ["blocked", "cannot", "constraint", "limit", "must not"],
    "emotion": ["celebrate", "celebrated", "excited", "feel", "frustrated", "happy", "stressed", "worried"],
    "goal": ["aim", "goal", "objective"],
    "habit": ["habit", "often", "routine", "usually"],
    "identity_signal": ["i am", "i m", "maintainer", "name", "owner", "role"],
    "lesson": ["learned", "lesson", "retrospective", "takeaway"],
    "location": ["location", "office", "remote", "timezone", "where"],
    "preference": ["dislikes", "favorite", "likes", "prefer", "preference", "prefers"],
    "project": ["branch", "milestone", "project", "repository"],
    "task": ["action item", "follow up", "next step", "task", "todo"],
    "time_sensitive": ["asap", "deadline", "urgent"],
    "tool": ["apple intelligence", "coreml", "framework", "fts5", "leaf ir", "library", "sdk", "slack", "sqlite", "sqlite vec", "tool", "zed"],
}
PROJECT_CONTEXT = ["coordination", "debugged", "maintainer", "owner", "planning", "project", "recall", "release", "review", "role", "work"]
DUE = ["before launch", "before release", "by friday", "by monday", "by tomorrow", "next week", "this week", "today", "tomorrow"]
DUE_PATTERN = r"(?i)\b(by|before)\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday|release|launch|eod|end of (day|week|month))\b"
WITH_PATTERN = r"\b(works|collaborates|coordinates)\s+(closely\s+)?with\s+[A-Z][A-Za-z'-]{2,}\b"
MET_PATTERN = r"\bmet\s+[A-Z][A-Za-z'-]{2,}\b"
SAID_PATTERN = r"\b[A-Z][A-Za-z'-]{2,}\s+(noted|said|asked|joined)\b"
#: What a kind always has.
KIND_FACETS = {"commitment": "task", "decision": "decision_topic", "fact": "fact_about_world", "profile": "fact_about_user"}

#: (phrase, value, label, confidence); more specific ones first.
GAZETTEER: list[tuple[str, str, str, float]] = [
    ("annie", "Annie", "person", 0.9), ("sam", "Sam", "person", 0.88), ("zac", "Zac", "person", 0.9),
    ("apple intelligence", "Apple Intelligence", "tool", 0.88), ("coreml", "CoreML", "tool", 0.9), ("fts5", "FTS5", "tool", 0.84), ("leaf-ir", "LEAF-IR", "tool", 0.9),
    ("lmdb", "LMDB", "tool", 0.84), ("slack", "Slack", "tool", 0.78), ("sqlite-vec", "sqlite-vec", "tool", 0.88), ("sqlite", "SQLite", "tool", 0.78), ("zed", "Zed", "tool", 0.84),
    ("longmemeval", "LongMemEval", "other", 0.84), ("pacific time", "Pacific Time", "other", 0.82), ("readme", "README", "other", 0.76), ("san francisco", "San Francisco", "location", 0.88),
]
#: (topic, phrases that all must occur).
TOPICS: list[tuple[str, list[str]]] = [
    *((t, [t]) for t in sorted(
        "app group storage|canonical memory schema|canonical memory storage|default path|entity overlap tests|eval surface|experimental flag|facet tags|hybrid retrieval|longmemeval licensing|model downloads|model training|neural reranking"
        "|pacific time|recall precision|release coordination|release owner|reranker latency|retrieval metadata|semantic search|vector lookup|working offline".split("|")
    )),
    ("embeddings for recall", ["embeddings", "recall"]), ("morning updates", ["morning", "updates"]), ("pipeline on-device", ["pipeline", "on device"]), ("sqlite-vec indexing latency", ["sqlite vec", "indexing", "latency"]),
]
GENERIC_TOPICS = ["action item", "current status", "next owner", "next person", "next step", "status update"]
GENERIC_ENTITIES = "action assistant context current decision done guide handoff memories memory need note notes procedure question runbook status task todo user we workflow".split()
EDGE_NOISE = "action completed context current decision done friday guide handoff monday next on procedure runbook saturday status step sunday the thursday todo tuesday wednesday workflow".split()
KEY_NOISE = "action add closed commitment completed decision done fact finished item memories memory profile resolved status switch switched task todo".split()
GENERIC_SIGNALS = "action commitment decision fact item memories memory profile project repo repository task todo".split()
#: Attributes of a profile by what its text contains; the first that fits counts.
ATTRIBUTES = [("timezone", "timezone"), ("time zone", "timezone"), ("editor", "editor"), ("favorite", "favorite"), ("prefer", "preference"), ("my name", "name"), ("name is", "name"), ("role", "role"), ("maintainer", "role"), ("owner", "role"), ("location", "location"), ("email", "email"), ("phone", "phone"), ("birthday", "birthday")]


def envelope(text: Column) -> Column:
    return F.concat(F.lit(" "), X.comparison_key(text), F.lit(" "))


def has(env: Column, phrases: Iterable[str]) -> Column:
    """Whether the envelope has one of the phrases (in comparison form) as whole words."""
    return env.rlike(" (" + "|".join(re.escape(p) for p in phrases) + ") ")


def _key(phrase: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", phrase.lower()))


def facets(text: Column, kind: Column, gazetteer: list[tuple[str, str, str, float]] = GAZETTEER) -> Column:
    """Facet tags in alphabetical order: by cue phrases, by known names, and what a kind always has."""
    env = envelope(text)

    def known(label: str) -> Column:
        phrases = [_key(p) for p, _, of, _ in gazetteer if of == label]
        return has(env, phrases) if phrases else F.lit(False)

    rules = {name: has(env, cues) for name, cues in CUES.items()}
    rules["preference"] |= (kind == "profile") & has(env, ["avoid"])
    rules["project"] |= known("project") & ((kind == "decision") | has(env, PROJECT_CONTEXT))
    rules["tool"] |= known("tool")
    rules["location"] |= known("location")
    rules["time_sensitive"] |= (kind == "commitment") & has(env, ["need to", "todo"]) & (has(env, DUE) | text.rlike(DUE_PATTERN))
    rules["constraint"] |= (kind == "decision") & (has(env, ["hot path", "skip"]) | (has(env, ["apple intelligence"]) & has(env, ["experimental flag"])))
    relation = kind.isin("profile", "episode", "handoff") & (has(env, ["closely with"]) | text.rlike(WITH_PATTERN))
    rules["relationship"] = relation
    rules["person"] = relation | ((kind == "handoff") & has(env, ["next person"])) | ((kind == "episode") & (known("person") | text.rlike(MET_PATTERN) | text.rlike(SAID_PATTERN)))
    of_kind = F.create_map(*(F.lit(x) for pair in KIND_FACETS.items() for x in pair))[kind]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in sorted(rules.items())), of_kind))))


def facets_of_version_2(kind: Column, text: Column, tags: Column) -> Column:
    """Facets that memories of the second table layout get: by substrings, in order, six at most."""
    low, names = F.lower(text), F.transform(tags, lambda t: F.lower(F.trim(t)))
    cues = [
        ("preference", "prefer|favorite"), ("project", "project|repo"), ("goal", "goal|objective"), ("task", "todo|task|follow up"), ("tool", "tool|sdk|framework|sqlite"), ("time_sensitive", "today|tomorrow|deadline|urgent"),
        ("constraint", "constraint|blocked|cannot"), ("lesson", "lesson|learned|takeaway"), ("emotion", "feel|frustrated|happy"), ("identity_signal", "name|role|timezone"),
    ]
    found = [F.when(low.rlike(c) | (F.array_contains(names, "preference") if name == "preference" else F.lit(False)), F.lit(name)) for name, c in cues]
    of_kind = F.create_map(*(F.lit(x) for pair in KIND_FACETS.items() for x in pair))[F.lower(F.trim(kind))]
    return F.slice(F.array_distinct(F.array_compact(F.array(*found, of_kind))), 1, 6)


# entities: runs of words need a walk through the text -----------------------------------------------------------------

_ENTITY = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("label", "value", "normalized_value")] + [T.StructField("confidence", T.DoubleType())]))
_MARKS = ",:;!?()[]{}\"'`"


def entity_key(value: str) -> str:
    bare = re.sub(r"(?i)'s\b", "", value.replace("’s", "'s").replace("’S", "'S").strip().strip(_MARKS + " \t\r\n"))
    return " ".join(bare.split()).lower()


def _bare(token: str) -> str:
    a, b = 0, len(token)
    while a < b and unicodedata.category(token[a])[0] == "P":
        a += 1
    while b > a and unicodedata.category(token[b - 1])[0] == "P":
        b -= 1
    return token[a:b]


def _in_run(token: str) -> bool:
    if len(token) < 2:
        return False
    if token[0].isupper() or any(c in token for c in "./+"):
        return True
    if "-" in token:
        return any(c.isupper() or c.isnumeric() for c in token)
    return any(c.isupper() for c in token[1:])


def _alone(token: str) -> bool:
    key = entity_key(token)
    return len(token) >= 2 and bool(key) and key not in GENERIC_ENTITIES and (_in_run(token) or ("-" not in token and all(c.isupper() or not c.isalpha() for c in token)))


def _of_run(run: list[str]) -> list[str]:
    while run and entity_key(run[0]) in EDGE_NOISE:
        run = run[1:]
    while run and entity_key(run[-1]) in EDGE_NOISE:
        run = run[:-1]
    if len(run) > 1 and all(map(_alone, run)):
        return [" ".join(run)]
    return run[:1] if run and _alone(run[0]) else [t for t in run if _alone(t)]


def find_entities(text: str | None, gazetteer: list[tuple[str, str, str, float]] = GAZETTEER) -> list[dict]:
    """Known names, then runs of names in the text; generic ones left out, each once, MOST_ENTITIES at most."""
    env = f" {_key(_unaccented(text or ''))} "
    found = [(label, value, confidence) for phrase, value, label, confidence in gazetteer if f" {_key(phrase)} " in env]
    run: list[str] = []
    for token in [*(text or "").split(" "), ""]:
        bare = _bare(token)
        if bare and _in_run(bare):
            run.append(bare)
        elif run:
            found += [("other", v, 0.6) for v in _of_run(run)]
            run = []
    out: dict[str, dict] = {}
    for label, value, confidence in found:
        key = entity_key(value)
        if key and key not in GENERIC_ENTITIES and key not in out and len(out) < MOST_ENTITIES:
            out[key] = {"label": label, "value": value, "normalized_value": key, "confidence": confidence}
    return list(out.values())


def _unaccented(text: str) -> str:
    return text.lower().translate(str.maketrans(X._ACCENTED, X._PLAIN))


@F.pandas_udf(_ENTITY)
def entities(texts: pd.Series) -> pd.Series:
    """find_entities() of each text, in Arrow batches."""
    return texts.map(find_entities)


# topics, keys -------------------------------------------------------------------------------------------------------


def topic_key(topic: Column) -> Column:
    """Lower case, without marks at the ends, four words at most."""
    bare = F.lower(F.regexp_replace(topic, r"^[\s.,:;!?()\[\]{}\"'`]+|[\s.,:;!?()\[\]{}\"'`]+$", ""))
    return F.array_join(F.slice(F.filter(F.split(bare, r"\s+"), lambda w: w != ""), 1, 4), " ")


def topics(text: Column, seeds: Column | None = None, known: list[tuple[str, list[str]]] = TOPICS) -> Column:
    """Known topics, then windows of 2, 4 and 3 informative words, then the seed tags; each once, MOST_TOPICS at most."""
    env = envelope(text)
    named = F.array_compact(F.array(*(F.when(_all(env, phrases), F.lit(topic)) for topic, phrases in known)))
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}+./-]+"), lambda w: (F.length(w) >= 3) & ~w.isin(X.QUERY_STOP_WORDS))

    def windows(n: int) -> Column:
        return F.filter(F.transform(X.windows(words, n), lambda w: topic_key(F.array_join(w, " "))), lambda t: ~t.isin(GENERIC_TOPICS))

    all_ = F.concat(named, windows(2), windows(4), windows(3), F.transform(X.tags(text) if seeds is None else seeds, topic_key))
    return F.slice(F.array_distinct(F.filter(all_, lambda t: t != "")), 1, MOST_TOPICS)


def _all(env: Column, phrases: list[str]) -> Column:
    out = F.lit(True)
    for p in phrases:
        out = out & F.contains(env, F.lit(f" {_key(p)} "))
    return out


def _parts(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), X.SPLIT), lambda w: w != "")


def key_seed(text: Column, entity_values: Column, topic_values: Column, most: int = 6) -> Column:
    """The first informative words of the entities and topics that are not generic, of the text if there are none; null without any."""
    specific = F.filter(F.concat(entity_values, topic_values), lambda v: F.exists(_parts(v), lambda w: ~w.isin(GENERIC_SIGNALS + X.QUERY_STOP_WORDS)))
    source = F.when(F.size(specific) > 0, F.flatten(F.transform(specific, _parts))).otherwise(_parts(text))
    informative = F.slice(F.array_distinct(F.filter(source, lambda w: (F.length(w) >= 3) & ~w.isin(X.QUERY_STOP_WORDS + KEY_NOISE))), 1, most)
    return F.when(F.size(informative) > 0, F.array_join(informative, "-"))


def canonical_key(kind: Column, text: Column, entity_values: Column | None = None, topic_values: Column | None = None, explicit: Column | None = None) -> Column:
    """What memories about the same thing share: an explicit key; an attribute of a profile; one for all handoffs; else kind and seed. Null for facts and episodes."""
    none = F.array().cast("array<string>")
    seed = key_seed(text, none if entity_values is None else entity_values, none if topic_values is None else topic_values)
    low, attribute = F.lower(text), F.lit(None).cast("string")
    for needle, name in reversed(ATTRIBUTES):
        attribute = F.when(F.contains(low, F.lit(needle)), F.lit(name)).otherwise(attribute)
    taste = F.when(seed.isNull(), F.concat(F.lit("profile:"), attribute)).otherwise(F.concat(F.lit("profile:"), attribute, F.lit(":"), seed))
    profile = F.when(attribute.isin("preference", "favorite"), taste).otherwise(F.concat(F.lit("profile:"), F.coalesce(attribute, seed)))
    found = F.when(kind == "profile", profile).when(kind == "handoff", "handoff:primary").when(kind.isin("decision", "commitment", "procedure"), F.concat(kind, F.lit(":"), seed))
    given = F.lower(X.stripped(explicit)) if explicit is not None else F.lit(None).cast("string")
    return F.coalesce(F.when(given != "", given), found)


# normal forms -------------------------------------------------------------------------------------------------------


def _clamped(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def normalized_hints(hints: DataFrame, most: int) -> DataFrame:
    """qid, tag, confidence, explicit: each tag once (the surest, explicit ones first), `most` of a query."""
    rows = hints.withColumn("confidence", _clamped(F.col("confidence")))
    best = rows.groupBy("qid", "tag").agg(F.max(F.struct("confidence", "explicit")).alias("b")).select("qid", "tag", "b.confidence", "b.explicit")
    w = Window.partitionBy("qid").orderBy(F.desc("confidence"), F.desc("explicit"), "tag")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def normalized_tags(tags: DataFrame, most: int) -> DataFrame:
    """id, name, confidence: names in lower case with single blanks, each once by comparison key (the surest; of equals the first by name), `most` of an id."""
    rows = tags.withColumn("name", F.lower(X.spaced(F.col("name")))).withColumn("confidence", _clamped(F.col("confidence"))).where((F.col("name") != "") & ~F.isnan("confidence"))
    own = Window.partitionBy("id", X.comparison_key(F.col("name"))).orderBy(F.desc("confidence"), "name")
    best = rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    w = Window.partitionBy("id").orderBy(F.desc("confidence"), "name")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("id", "name", "confidence", "place")


def merged_values(left: Column, right: Column) -> Column:
    """The values of both arrays in order, each once by comparison key, without empty ones; null if neither array is there."""
    both = F.concat(F.coalesce(left, F.array().cast("array<string>")), F.coalesce(right, F.array().cast("array<string>")))
    keyed = F.filter(F.transform(both, lambda v: F.struct(v.alias("v"), X.comparison_key(v).alias("k"))), lambda x: x["v"].isNotNull() & (x["k"] != ""))

    def merged(x: Column) -> Column:
        keys = F.transform(x, lambda p: p["k"])
        return F.transform(F.filter(x, lambda p, i: F.array_position(keys, p["k"]) == i + 1), lambda p: p["v"])

    # in a lambda, so that values and keys are made once for a row
    return F.when(left.isNotNull() | right.isNotNull(), F.get(F.transform(F.array(keyed), merged), F.lit(0)))


def tag_confidence(rank: Column, relevance: Column, previous: Column) -> Column:
    """Confidence of the tag at a rank (from 0): .88 to the power of the rank; blended .6 to .4 with a relevance of 1 to 5 unless that jumps up by more than .35; .1 at least. previous: the last reliable relevance, as a share."""
    decayed = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.pow(F.lit(0.88), rank)))
    share = F.when(relevance.between(1, 5), (relevance - 1) / 4.0)
    share = F.when(previous.isNull() | (share <= previous + 0.35), share)
    return F.when(share.isNull(), decayed).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.6 * share + 0.4 * decayed)))


def tag_confidences(relevances: Column) -> Column:
    """tag_confidence() of each of an array of relevances in rank order; a relevance is reliable if it was taken."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(None).cast("double").alias("last"))

    def step(s: Column, r: Column) -> Column:
        share = F.when(r.between(1, 5), (r - 1) / 4.0)
        taken = F.when(s["last"].isNull() | (share <= s["last"] + 0.35), share)
        return F.struct(F.concat(s["out"], F.array(tag_confidence(F.size(s["out"]), r, s["last"]))).alias("out"), F.coalesce(taken, s["last"]).alias("last"))

    return F.aggregate(relevances, start, step, lambda s: s["out"])
