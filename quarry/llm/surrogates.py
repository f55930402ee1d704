"""Personal data replaced by keyed surrogates of the same type, format, script and gender.

Detected: e-mail addresses, IPv4 addresses, payment cards (Luhn), IBANs (mod 97), social security numbers, phone numbers,
secrets (keys and tokens after a telling name), and person names (after a form of address, or with a known first name).

A surrogate is a keyed permutation of the values of its format: letters stay letters of their case and script, digits
stay digits, check digits are right again, private addresses stay private, known first names become others of the same
same gender and script. A permutation never maps two values to one nor a value to itself, and the same value has the
same surrogate everywhere (coreference). What a permutation cannot promise is checked over the whole corpus: a surrogate
of the same type that two formats share, or that equals another original, is drawn again with other tweaks. Every first
surrogate stays reserved meanwhile. A value may keep it if it is another original's text, which cannot be avoided where
all values of a format occur (and is not tried for names and values of two characters); if two values still share one,
an error is raised.

Defined results
* Null texts stay null, empty ones empty; both have no entities. Rows are treated one by one: repeated rows and rows
  without doc_id get the same replacements. Other columns are passed on by replaced(). Numbers that fail their check
  digits are left alone.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import own, written

KEY = b"quarry surrogates 1"
#: Exceptions (values with a tweak) sent to all tasks; more of them are joined instead.
MAX_EXCEPTIONS = 200_000
#: Tweaks tried for surrogates that are another original, and, from there on, for those still shared.
_ROUNDS, MAX_TWEAKS, MAX_HARD_TWEAKS = 6, 16, 64

_FIRST = {
    ("latin", "f"): "Anna Maria Emma Sophie Laura Julia Lena Sarah Mary Emily Alice Claire Camille Isabel Carmen Lucia Elena Ingrid Helga Marta Nadia Olivia Grace Chloe Manon Sofia Paula Ines Petra Ursula".split(),
    ("latin", "m"): "John James Robert Michael David Thomas Peter Paul Mark Daniel Hans Karl Stefan Jürgen Pierre Jean Louis Antoine Carlos Miguel Pablo Javier Diego Martin Lukas Felix Oscar Henri George Andrew".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел Олег".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη Γεωργία Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Γιάννης Παναγιώτης Αντώνης Σπύρος".split(),
}
_POOL = {name: (pool, i) for pool, names in _FIRST.items() for i, name in enumerate(names)}
_TITLES = r"Mrs?|Ms|Miss|Mme|Monsieur|Madame|Herr|Frau|Señora?|Sra?|Dr|Prof|Г-жа|Г-н|Κος|Κα"
_WORD = r"[^\W\d_][\w'’-]*"
_NAME = rf"(?:(?:{_TITLES})\.?[ ](?P<titled>{_WORD}(?:[ ]{_WORD}){{0,2}}))"
_KNOWN = "|".join(sorted(_POOL, key=len, reverse=True))

_PATTERNS = {
    "email": r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+",
    "secret": r"(?i:(?:api[_-]?key|secret|token|passw(?:or)?d|access[_-]?key)\w*[\"']?\s*[:=]\s*[\"']?)(?P<secret>[A-Za-z0-9_+/-]{16,})|\b(?P<named>(?:AKIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{16,})",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
}
_RE = {k: re.compile(p) for k, p in _PATTERNS.items()}
_HAS_DIGIT, _CAPITAL = re.compile(r"\d"), re.compile(r"[A-ZÀ-ÞΆ-ΫЀ-Я]\w*")
_HAS_NAME = re.compile(rf"\b(?:{_NAME})|\b(?P<known>(?:{_KNOWN})(?:[ ]{_WORD})?)\b")
_HINTS = frozenset([*_POOL, *"Mr Mrs Ms Miss Mme Monsieur Madame Herr Frau Señor Señora Sr Sra Dr Prof Г Κος Κα".split()])


def luhn(digits: str) -> int:
    """The check digit of the digits before it."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, none of which overlap; the earlier type in the list of patterns wins."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    digits = _HAS_DIGIT.search(text) is not None
    for kind, pattern in _RE.items():
        if "@" not in text if kind == "email" else not digits:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "secret":
                a, b = m.span("secret") if m["secret"] else m.span("named")
                if not _HAS_DIGIT.search(text, a, b):
                    continue
            if kind == "email":
                b -= len(m[0]) - len(m[0].rstrip(".-_"))
            plain = re.sub(r"[ -]", "", text[a:b])
            if kind == "ipv4" and any(int(x) > 255 or str(int(x)) != x for x in text[a:b].split(".")):
                continue
            if kind == "card" and luhn(plain[:-1]) != int(plain[-1]) or kind == "iban" and _mod97(plain[4:] + plain[:4]) != 1:
                continue
            if kind == "phone" and not 9 <= sum(c.isdigit() for c in plain) <= 15:
                continue
            if all(b <= x or a >= y for x, y, _ in found):
                found.append((a, b, kind))
    if not _HINTS.isdisjoint(_CAPITAL.findall(text)):
        full, alone = set(), []
        for m in _HAS_NAME.finditer(text):
            a, b = m.span("titled") if m["titled"] else m.span("known")
            parts = text[a:b].split(" ")
            keep = 0
            while keep < len(parts) and parts[keep][:1].isupper():
                keep += 1
            if not keep or any(a < y and x < b for x, y, _ in found):
                continue
            b = a + len(" ".join(parts[:keep]))
            if m["titled"] or keep > 1:
                found.append((a, b, "person"))
                full.update(parts[:keep])
            else:
                alone.append((a, b, parts[0]))
        # a first name by itself is a person only if the document has it in a full name
        found += [(a, b, "person") for a, b, name in alone if name in full]
    return sorted(found)


def _permute(x: int, size: int, key: bytes, context: str) -> int:
    """A keyed permutation of 0 to size - 1 without fixed points: one cycle through all of them, in the order of a Feistel network."""
    return x if size < 2 else _network((_network(x, size, key, context) + 1) % size, size, key, context, back=True)


def _network(x: int, size: int, key: bytes, context: str, back: bool = False) -> int:
    """A keyed permutation of 0 to size - 1, or its inverse: a Feistel network on the next even number of bits, walked until it is inside."""
    half = max(1, (max(1, (size - 1).bit_length()) + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = (x & mask, x >> half) if back else (x >> half, x & mask)
        for i in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
            f = hmac.digest(key, f"{context}|{size}|{i}|{right}".encode(), hashlib.sha256)
            f = int.from_bytes(f, "big") if half <= 256 else int.from_bytes(hashlib.shake_256(f).digest(half // 8 + 1), "big")
            left, right = right, left ^ (f & mask)
        x = right << half | left if back else left << half | right
        if x < size:
            return x


_VOWELS, _CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшщыэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЫЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
_NAMES = [_VOWELS, _CONSONANTS, _VOWELS.upper(), _CONSONANTS.upper(), *_ALPHABETS[3:]]
_LATIN = "àáâäãåæçèéêëìíîïñòóôöõøœùúûüý"
_HEX = ["0123456789abcdef"], ["0123456789ABCDEF"]


def _template(value: str, alphabets: list[str], key: bytes, context: str) -> str:
    """value with every character of an alphabet exchanged within it, all of them by one permutation; others stay."""
    of = {c: (a, i) for a in alphabets for i, c in enumerate(a)}
    size, x, shape = 1, 0, []
    for c in value:
        a, i = of.get(c, (None, 0))
        shape.append(a or c)
        if a:
            x, size = x * len(a) + i, size * len(a)
    y = _permute(x, size, key, f"{context}|{'|'.join(shape)}")
    out = []
    for c, s in zip(reversed(value), reversed(shape)):
        if c in of:
            y, i = divmod(y, len(s))
            out.append(s[i])
        else:
            out.append(c)
    return "".join(reversed(out))


def surrogate(kind: str, value: str, tweak: int = 0, key: bytes = KEY) -> str:
    context = f"{kind}|{tweak}"
    if kind == "email":
        local, _, domain = value.rpartition("@")
        name, _, top = domain.rpartition(".")
        alphabets = [*_ALPHABETS, _LATIN, _LATIN.upper()]
        return _template(f"{local}@{name}", alphabets, key, context) + "." + top
    if kind == "ipv4":
        number = int.from_bytes(bytes(map(int, value.split("."))), "big")
        for base, bits in ((0x0A000000, 24), (0xC0A80000, 16), (0x7F000000, 24), (0xAC100000, 20)):
            if number >> bits == base >> bits:
                number = base | _permute(number & ((1 << bits) - 1), 1 << bits, key, f"{context}|{base}")
                break
        else:
            special = True
            while special:  # walk on until the address is a public one again
                number = _permute(number, 1 << 32, key, context)
                special = any(number >> b == base >> b for base, b in ((0x0A000000, 24), (0xC0A80000, 16), (0x7F000000, 24), (0xAC100000, 20)))
        return ".".join(map(str, number.to_bytes(4, "big")))
    if kind == "card":
        plain = re.sub(r"\D", "", value)
        new = plain[0] + _template(plain[1:-1], _ALPHABETS[:1], key, f"{context}|{plain[0]}")
        digits = iter(new + str(luhn(new)))
        return "".join(next(digits) if c.isdigit() else c for c in value)
    if kind == "iban":
        plain = value.replace(" ", "")
        new = _template(plain[4:], _ALPHABETS[:3], key, f"{context}|{plain[:2]}")
        chars = iter(plain[:2] + f"{98 - _mod97(new + plain[:2] + '00'):02d}" + new)
        return "".join(c if c == " " else next(chars) for c in value)
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=[ .(-])", value)
        cut = country.end() if country else 0
        return value[:cut] + _template(value[cut:], _ALPHABETS[:1], key, f"{context}|{value[:cut]}")
    if kind == "person":
        return " ".join(_person(w, tweak, key) for w in value.split(" "))
    if kind == "secret":
        for alphabets in _HEX:
            if all(c in alphabets[0] for c in value):
                return _template(value, alphabets, key, context + "|hex")
    return _template(value, _ALPHABETS, key, context)


def _person(word: str, tweak: int, key: bytes) -> str:
    if word in _POOL:
        pool, i = _POOL[word]
        order = sorted(_FIRST[pool], key=lambda name: hmac.digest(key, f"first|{tweak}|{name}".encode(), hashlib.sha256))
        return order[(order.index(word) + 1) % len(order)]  # the next in a keyed ring: never the name itself
    new = _template(word, [*_NAMES, _LATIN, _LATIN.upper()], key, f"last|{tweak}")
    if new == word:  # of letters that no alphabet has: others by hash, whose repeats assigned() finds
        digest = hmac.digest(key, f"other|{tweak}|{word}".encode(), hashlib.sha256)
        new = "".join("BCDFGHJKLMNPRSTV"[x % 16].lower() + "aeio"[x // 16 % 4] for x in digest[: max(3, len(word) // 2)]).capitalize()
    return new


def _units(kind: str, value: str) -> list[tuple[str, str]]:
    """What has a surrogate of its own: the words of a name, so that a part of the name refers to the same person; else the value."""
    return [(kind, w) for w in value.split(" ")] if kind == "person" else [(kind, value)]


def mentioned(docs: DataFrame) -> DataFrame:
    """type, value: the distinct units found in the corpus."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {u for at in range(0, batch.num_rows, 512) for t in batch.column("text").slice(at, 512).to_pylist() for a, b, kind in entities(t) for u in _units(kind, t[a:b])}
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*seen)], ["type", "value"])

    return docs.select("text").mapInArrow(find, "type string, value string").distinct()


def _assigned(units: DataFrame) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("type", "value", "tweak")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("type", "value", "tweak")), pa.array([surrogate(*r) for r in rows], pa.string())], ["type", "value", "tweak", "surrogate"])

    return units.select("type", "value", "tweak").mapInArrow(assign, "type string, value string, tweak int, surrogate string")


def assigned(docs: DataFrame) -> DataFrame:
    """type, value, tweak, surrogate of every unit in the corpus, without collisions."""
    table = written(_assigned(mentioned(docs).withColumn("tweak", F.lit(0))), "surrogates")
    originals = table.select("type", F.col("value").alias("surrogate"), F.lit(True).alias("original"))
    place = lambda: F.row_number().over(Window.partitionBy("type", "surrogate").orderBy("value"))
    # values shorter than 3 characters have too few values to avoid all others; names come from short lists
    marked = table.withColumn("place", place()).join(originals, ["type", "surrogate"], "left")
    marked = marked.withColumn("hard", (F.col("place") > 1) | (F.col("surrogate") == F.col("value"))).withColumn("loose", (F.length("value") < 3) | (F.col("type") == "person"))
    todo = written(marked.where("hard OR (original AND NOT loose)").select("type", "value", "hard", "loose"), "collisions")
    moved: DataFrame | None = None
    for tweak in range(1, MAX_HARD_TWEAKS + 1):
        # beyond MAX_TWEAKS, only those that share a surrogate go on, and take the texts of other originals, too
        more = todo if tweak <= MAX_TWEAKS else todo.where("hard")
        if not more.take(1):
            break
        reserved = table.select("type", "surrogate")
        reserved = (reserved if moved is None else reserved.unionByName(moved.select("type", "surrogate"))).distinct()
        drawn = _assigned(more.withColumn("tweak", F.lit(tweak))).join(more, ["type", "value"]).join(originals, ["type", "surrogate"], "left")
        free = drawn.where("surrogate <> value").where(F.col("original").isNull() | (F.col("loose") | F.lit(tweak > MAX_TWEAKS))).join(reserved, ["type", "surrogate"], "left_anti")
        won = written(free.withColumn("place", place()).where("place = 1").select("type", "value", "tweak", "surrogate"), "redrawn")
        moved = won if moved is None else written(moved.unionByName(won), "redrawn")
        todo = written(todo.join(won, ["type", "value"], "left_anti"), "collisions")
    left = todo.where("hard").limit(1).collect()
    if left:
        raise RuntimeError(f"a value of type {left[0]['type']} has no surrogate of its own after {MAX_HARD_TWEAKS} tweaks")
    return table if moved is None else table.join(moved.select("type", "value"), ["type", "value"], "left_anti").unionByName(moved)


def _replace(text: str | None, lookup: dict[tuple[str, str], int] | None) -> tuple[str | None, int]:
    found = entities(text)
    if not found:
        return text, 0
    out, last = [], 0
    for a, b, kind in found:
        units = _units(kind, text[a:b])
        out += [text[last:a], " ".join(surrogate(*u, lookup.get(u, 0)) for u in units)]
        last = b
    return "".join([*out, text[last:]]), len(found)


def replaced(docs: DataFrame) -> DataFrame:
    """docs with surrogates in the texts, and the number of entities as n_entities (a column of that name is replaced)."""
    docs = docs.drop("n_entities")
    exceptions = assigned(docs).where("tweak > 0").select("type", "value", "tweak")
    few = [tuple(r) for r in exceptions.limit(MAX_EXCEPTIONS + 1).collect()]
    if len(few) > MAX_EXCEPTIONS:
        return _joined(docs, exceptions)
    lookup = docs.sparkSession.sparkContext.broadcast({(k, v): t for k, v, t in few})
    at = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                done = [_replace(t, lookup.value) for t in part.column("text").to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([t for t, _ in done], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int32())], [*part.schema.names, "n_entities"])

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, T.StructField("n_entities", T.IntegerType())]))


def _joined(docs: DataFrame, exceptions: DataFrame) -> DataFrame:
    """The same for many exceptions: each document's own are brought to it by joins."""
    keyed = docs.select(F.struct(*own(docs)).alias("row"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(k, *u) for k, t in zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist()) for a, b, kind in entities(t) for u in _units(kind, t[a:b])}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], ["_key", "type", "value"])

    wanted = keyed.select("_key", "text").mapInArrow(find, "_key long, type string, value string").distinct().join(exceptions, ["type", "value"])
    mine = wanted.groupBy("_key").agg(F.collect_list(F.struct("type", "value", "tweak")).alias("_own"))
    both = keyed.join(mine, "_key", "left")
    at, names = docs.columns.index("text"), docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_replace(t, {(o["type"], o["value"]): o["tweak"] for o in own or []}) for t, own in zip(batch.column("text").to_pylist(), batch.column("_own").to_pylist())]
            columns = list(batch.column("row").flatten())
            columns[at] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int32())], [*names, "n_entities"])

    return both.mapInArrow(apply, T.StructType([*docs.schema.fields, T.StructField("n_entities", T.IntegerType())]))
