"""Text functions as Column expressions: tokens, lexical terms, normal forms, lines, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists are sets; they are kept in alphabetical order.
LEXICAL_STOP_WORDS = (
    "about after again against all also among an and any are as at be been before between both but by can did do does during each end for from had has have"
    " how if in into is it its just like more most need not of on or our out over should so some than that the their them then there these they this those"
    " to too under up use using was we what when where which who why with would you your"
).split()
SHORT_TERMS = "ai api ci db id qa sdk sli slo ui ux".split()
QUERY_STOP_WORDS = (
    "about after all also an and any are as at be been before but by can do does for from how if in into is it its of on or our that the their them there"
    " these they this to up was we what when where which who why with you your"
).split()
SPLIT = r"[^\p{L}\p{N}]+"
#: Accented letters and the plain ones they fold to.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
SYNONYMS = {"repo": "repository", "db": "database", "doc": "docs", "documentation": "docs", "tests": "test", "testing": "test", "migrations": "migration", "embeddings": "embedding", "caching": "cache"}


def literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def words(text: Column) -> Column:
    """All words, lower case, with repeats (default tokenizer)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Distinct words in order that have two characters or a digit."""
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) >= 2) | w.rlike(r"\p{N}")))


def anchors(text: Column, most: int = 16) -> Column:
    """Significant tokens: with a digit, known short terms, or of three letters and no stop word."""
    keep = lambda w: w.rlike(r"\p{N}") | w.isin(SHORT_TERMS) | ((F.length(w) >= 3) & ~w.isin(LEXICAL_STOP_WORDS))
    return F.slice(F.filter(tokens(text), keep), 1, most)


def strict_terms(text: Column) -> Column:
    """Prefix terms that all must match: the first six anchors."""
    return anchors(text, 6)


def relaxed_terms(text: Column) -> Column:
    """Prefix terms of which one must match: the first twelve anchors, or tokens if there is no anchor."""
    found = anchors(text, 12)
    return F.when(F.size(found) > 0, found).otherwise(F.slice(tokens(text), 1, 12))


def anchor_matches(wanted: Column, text: Column) -> Column:
    """The anchors of which a token of the text is a prefix, or that are a prefix of one."""
    own = tokens(text)
    return F.filter(wanted, lambda a: F.exists(own, lambda t: F.startswith(t, a) | F.startswith(a, t)))


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def comparison_key(text: Column) -> Column:
    """Folded words joined by a space."""
    return F.array_join(F.filter(F.split(fold(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != ""), " ")


def semantic_key(text: Column) -> Column:
    """Like comparison_key, with synonyms unified and stop words left out."""
    known = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    found = F.transform(F.split(fold(F.coalesce(text, F.lit(""))), SPLIT), lambda w: F.coalesce(known[w], w))
    return F.array_join(F.filter(found, lambda w: (w != "") & ~w.isin(QUERY_STOP_WORDS)), " ")


def overlap_ratio(left: Column, right: Column) -> Column:
    """Share of the distinct words of left that right has; 1 without words."""
    a, b = F.array_distinct(F.split(comparison_key(left), " ")), F.split(comparison_key(right), " ")
    return F.when(comparison_key(left) == "", F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def tags(text: Column) -> Column:
    """The first six distinct words of four letters that are no stop words."""
    return F.slice(F.array_distinct(F.filter(words(text), lambda w: (F.length(w) >= 4) & ~w.isin(QUERY_STOP_WORDS))), 1, 6)


def title(text: Column) -> Column:
    """The first line that begins with '#', without the marks; null if there is none."""
    line = F.regexp_extract(text, r"(?m)^[ \t]*#[^\n]*", 0)
    bare = F.trim(F.regexp_replace(F.trim(line), r"^#+", ""))
    return F.when(line == "", F.lit(None)).otherwise(F.when(bare == "", F.lit(None)).otherwise(bare))


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def windows(items: Column, n: int) -> Column:
    """All runs of n neighbours of an array, each an array. The items are made once for each of the n places, not for each run."""
    most = F.greatest(F.size(items) - (n - 1), F.lit(0))
    zipped = F.arrays_zip(*(F.slice(items, k + 1, most).alias(f"w{k}") for k in range(n)))
    return F.transform(zipped, lambda z: F.array(*(z[f"w{k}"] for k in range(n))))


def line_range(text: Column, start: int, end: int) -> Column:
    """Lines start to end (from 1; reversed bounds are swapped, others clamped)."""
    start, end = min(start, end), max(start, end)
    start = max(1, start)
    return F.array_join(F.slice(lines(text), start, max(0, end - start + 1)), "\n")


def query_prompt(text: Column) -> Column:
    return F.concat(F.lit("query: "), text)


def document_prompt(title_: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(title_, F.lit("none")), F.lit(" | text: "), text)


def snippet(text: Column, query: Column) -> Column:
    """Up to 300 characters: all of a short text, a window around the query's first place, or the beginning."""
    at = F.instr(F.lower(text), F.lower(query))
    window = F.substring(text, F.greatest(at - 120, F.lit(1)), F.lit(300))
    return F.when(F.length(text) <= 300, text).when((at > 0) & (F.length(query) > 0), window).otherwise(F.substring(text, 1, 300))


def coverage(wanted: Column, text: Column) -> Column:
    """Share of the wanted phrases that the text contains (by comparison key); 1 if none is wanted."""
    own = comparison_key(text)
    hit = F.filter(wanted, lambda w: F.contains(own, comparison_key(w)))
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(F.size(hit) / F.size(wanted))


def safe_filename(text: Column) -> Column:
    """Letters, digits and '-' stay; other characters become one '_', none at the ends. Empty if nothing is left."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}-]+", "_"), r"^_+|_+$", "")


def match_key(text: Column) -> Column:
    """Folded and lower case, for comparisons with expected texts."""
    return fold(F.coalesce(text, F.lit("")))


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def spaced(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def path_in(path: Column, prefix: Column | str) -> Column:
    """Whether path is prefix or lies below it."""
    prefix = F.rtrim(F.trim(F.lit(prefix) if isinstance(prefix, str) else prefix), F.lit("/"))
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def glob(path: Column, pattern: str) -> Column:
    """Anchored match of a pattern with * and ?."""
    import re

    return path.rlike("^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$")
