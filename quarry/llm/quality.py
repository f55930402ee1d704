"""Quality rules as a ledger: every rule is evaluated once per document, what it measured and one failure bit are kept.

A policy is a set of rules under a version name; it rejects a document that fails any of its rules. Because the ledger
holds the bits, a new policy or the effect of leaving a rule out (ablation) needs no second look at the texts.

Defined results
* A null or empty text, or one of white space, fails ``empty``; its measurements are 0 and no ratio rule fails.
* Nulls in other columns and extra columns of any name are passed on and not read. Repeated rows get equal entries.
* An empty table gives an empty ledger; without usable labels no document fails ``toxic_terms``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own

WS, TOKEN_GAP = r"[ \t\n\r\f]+", r"[^\p{L}\p{N}]+"
SYMBOLS = "#*$%&<>{}[]~^="
STOP_WORDS = "the of and to in is that it a de la le les des et que el los en y der die das und zu den von ein".split()

#: Rule -> (measurement that it compares, SQL condition). The order gives the bit.
RULES: dict[str, str] = {
    "empty": "n_words = 0",
    "word_length": "n_words >= 20 AND mean_word > 15",
    "symbols": "n_words > 0 AND symbols_per_word > 0.3",
    "shouting": "n_words >= 20 AND upper_share > 0.4",
    "exclaiming": "n_words > 0 AND bangs_per_word > 0.3",
    "table": "n_words > 0 AND pipes_per_word > 0.2",
    "repeated_bigrams": "n_words >= 20 AND distinct_bigrams < 0.3",
    "repeated_lines": "n_lines >= 3 AND repeated_lines > 0.4",
    "ellipses": "n_lines > 0 AND ellipsis_lines > 0.3",
    "bullets": "n_lines >= 3 AND bullet_lines > 0.9",
    "toxic_terms": "toxic_terms >= 2",
    "few_words": "n_words < 50",
    "few_letters": "n_words > 0 AND letter_share < 0.6",
    "no_stop_words": "n_words > 0 AND stop_words < 2",
}
#: Policies by version. The pipeline applies "lenient.1", which leaves short but well-formed documents alone.
POLICIES: dict[str, tuple[str, ...]] = {
    "lenient.1": ("empty", "word_length", "symbols", "shouting", "exclaiming", "table", "repeated_bigrams", "repeated_lines", "ellipses", "bullets", "toxic_terms"),
    "strict.1": tuple(RULES),
}
MEASURES = ("n_words", "n_lines", "mean_word", "symbols_per_word", "upper_share", "bangs_per_word", "pipes_per_word", "distinct_bigrams", "repeated_lines", "ellipsis_lines", "bullet_lines", "toxic_terms", "letter_share", "stop_words")
#: toxic_terms(): at most this many labelled documents are read, chosen by hash.
MAX_LABELLED = 20_000
MIN_SUPPORT, MAX_TERMS = 5, 2_000


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def toxic_terms(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[str]:
    """Words that mark labelled toxic documents: in at least MIN_SUPPORT of them, and 20 times more often than in others.

    Labels that are null or contradict each other for a doc_id are left out; of more than max_labelled doc_ids, those with the least MD5 are used.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"), F.min("toxic").alias("_least"))
        .where("_toxic = _least").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_labelled).select("doc_id", "_toxic")
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows of 12 bytes
    terms = found.select("doc_id", "_toxic", F.explode(F.array_distinct(_tokens(F.col("text")))).alias("term")).distinct()
    counted = terms.groupBy("term").agg(F.sum("_toxic").alias("toxic"), F.count("*").alias("n")).where(f"toxic >= {MIN_SUPPORT} AND (n - toxic) * 20 <= toxic")
    return [r.term for r in counted.orderBy(F.desc("toxic"), "term").limit(MAX_TERMS).collect()]


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_GAP), lambda w: w != "")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def measured(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """docs with a struct column _m of the measurements."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda marks: F.length(t) - F.length(F.translate(t, marks, ""))
    parts = docs.withColumn("_p", F.struct(
        F.filter(F.split(t, WS), lambda w: w != "").alias("words"),
        F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "").alias("lines"),
        F.array_distinct(_tokens(F.col(text))).alias("tokens"),
        F.length(t).alias("chars"), F.length(F.translate(t, " \t\n\r\f", "")).alias("solid"), without(SYMBOLS).alias("symbols"), without("!").alias("bangs"), without("|").alias("pipes"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).alias("upper"), F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).alias("letters"),
    ))
    w, lines = F.col("_p.words"), F.col("_p.lines")
    n, n_lines = F.size(w), F.size(lines)
    bigrams = F.zip_with(w, F.slice(w, 2, F.greatest(n, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))  # the last is null
    counted = lambda words: F.size(F.array_intersect(F.col("_p.tokens"), F.array(*map(F.lit, words)))) if words else F.lit(0)
    m = {
        "n_words": n, "n_lines": n_lines, "mean_word": _share(F.col("_p.solid"), n), "symbols_per_word": _share(F.col("_p.symbols"), n),
        "upper_share": _share(F.col("_p.upper"), F.col("_p.letters")), "bangs_per_word": _share(F.col("_p.bangs"), n), "pipes_per_word": _share(F.col("_p.pipes"), n),
        "distinct_bigrams": _share(F.size(F.array_distinct(F.filter(bigrams, lambda x: x.isNotNull()))), n - 1),
        "repeated_lines": _share(n_lines - F.size(F.array_distinct(lines)), n_lines),
        "ellipsis_lines": _share(F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[ ]*$"))), n_lines),
        "bullet_lines": _share(F.size(F.filter(lines, lambda x: x.rlike(r"^[ ]*[-*•]"))), n_lines),
        "toxic_terms": counted(terms), "letter_share": _share(F.col("_p.letters"), F.col("_p.solid")), "stop_words": counted(STOP_WORDS),
    }
    return parts.withColumn("_m", F.struct(*(c.alias(k) for k, c in m.items()))).drop("_p")


def _bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        for name in sorted(MEASURES, key=len, reverse=True):
            condition = _qualified(condition, name)
        bits = bits + F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0))
    return bits


def _qualified(condition: str, name: str) -> str:
    import re

    return re.sub(rf"(?<![.\w]){name}\b", f"_m.{name}", condition)


def ledger(docs: DataFrame, terms: list[str]) -> DataFrame:
    """One row per row of docs: doc_id, the measurements, fail_bits, and keep_<policy> for every policy."""
    found = measured(docs.select("doc_id", "text"), terms).select("doc_id", "_m").withColumn("fail_bits", _bits())
    kept = [(F.col("fail_bits").bitwiseAND(F.lit(mask(p))) == 0).alias("keep_" + p.replace(".", "_")) for p in POLICIES]
    return found.select("doc_id", *(F.col(f"_m.{k}").alias(k) for k in MEASURES), "fail_bits", *kept)


def accepted(docs: DataFrame, terms: list[str], policy: str) -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs."""
    row = docs.select(F.struct(*own(docs)).alias("row"), F.col("text"))  # apart, so that no name can clash
    return measured(row, terms).withColumn("_bits", _bits()).where(F.col("_bits").bitwiseAND(F.lit(mask(policy))) == 0).select("row.*")


def ablations(entries: DataFrame) -> DataFrame:
    """Of each policy and rule of it: documents failing the rule, and those that only this rule rejects.

    Works on the distinct failure patterns (at most 2**rules of them), by bit operations.
    """
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    names = list(RULES)
    each = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).cast("long").alias("m"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for p, rules in POLICIES.items() for r in rules))
    out = patterns.select("fail_bits", "n", F.explode(each).alias("e")).select("fail_bits", "n", "e.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("m"))
    return out.groupBy("policy", "rule").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) != 0, F.col("n")).otherwise(0)).alias("rejected_without"),
        F.bit_or(hit).alias("seen_bits"),
    )


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN round(CAST({a} AS DOUBLE) / {b}, 6) ELSE 0.0 END"
    without = lambda marks: f"length(t) - length(translate(t, '{marks}', ''))"
    ws = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"
    measures = {
        "n_words": "len(w)", "n_lines": "len(l)", "mean_word": share("solid", "len(w)"), "symbols_per_word": share("symbols", "len(w)"), "upper_share": share("upper_n", "letters"),
        "bangs_per_word": share("bangs", "len(w)"), "pipes_per_word": share("pipes", "len(w)"),
        "distinct_bigrams": share("len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))", "(len(w) - 1)"),
        "repeated_lines": share("(len(l) - len(list_distinct(l)))", "len(l)"), "ellipsis_lines": share(r"len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ ]*$')))", "len(l)"),
        "bullet_lines": share("len(list_filter(l, lambda x: regexp_matches(x, '^[ ]*[-*•]')))", "len(l)"), "toxic_terms": "len(list_intersect(tok, terms))", "letter_share": share("letters", "solid"), "stop_words": f"len(list_intersect(tok, [{stop}]))",
    }
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(RULES.values()))
    keeps = ", ".join(f"(fail_bits & {mask(p)}) = 0 AS keep_{p.replace('.', '_')}" for p in POLICIES)
    tokens = r"list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return rf"""
WITH lab AS (SELECT doc_id, max(toxic) AS tox FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id HAVING max(toxic) = min(toxic) ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT {MAX_LABELLED}),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lt AS (SELECT DISTINCT doc_id, tox, unnest({tokens}) AS term FROM d JOIN lab USING (doc_id)),
tt AS (SELECT term FROM lt GROUP BY term HAVING sum(tox) >= {MIN_SUPPORT} AND (count(*) - sum(tox)) * 20 <= sum(tox) ORDER BY sum(tox) DESC, term LIMIT {MAX_TERMS}),
tl AS (SELECT coalesce(list(term), CAST([] AS VARCHAR[])) AS terms FROM tt),
p AS (SELECT doc_id, terms, list_filter(string_split_regex(t, '[ \t\n\r\f]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS l,
  list_distinct({tokens}) AS tok, length(t) AS chars, length(translate(t, {ws}, '')) AS solid, {without(SYMBOLS)} AS symbols, {without("!")} AS bangs, {without("|")} AS pipes,
  length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS upper_n, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters FROM d, tl),
m AS (SELECT doc_id, {", ".join(f"{c} AS {k}" for k, c in measures.items())} FROM p),
b AS (SELECT *, {bits} AS fail_bits FROM m)
SELECT doc_id, {", ".join(f"CAST({k} AS INT) AS {k}" if k.startswith("n_") or k in ("toxic_terms", "stop_words") else k for k in MEASURES)}, CAST(fail_bits AS BIGINT) AS fail_bits, {keeps} FROM b"""


ORACLE_SQL = _sql()
