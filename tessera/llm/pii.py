"""Personal data: detection and keyed surrogates.

Every detected entity is replaced by a surrogate of the same type and format:
digits by digits, letters by letters of their script and case, a first name by
one of the same gender, a card number or an IBAN by one with the same status of
its check digits.  An entity is first brought to one spelling - lower case, bare
digits, no spaces - then mapped by a keyed permutation of that spelling's format
(Feistel networks over mixed alphabets), and written in the way of the original, so

* the same entity has the same surrogate in every document, however it is
  written (coreference),
* two entities never share one (distinctness), with no table of entities to
  keep, and at any size of corpus; :func:`collisions` checks it on real data,
  and :func:`report` says for each row whether it found one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

KINDS = ("email", "ip", "iban", "phone", "ssn", "number", "name")
_SPELLED = pa.list_(pa.struct([("kind", pa.string()), ("surrogate", pa.string())]))

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_IP = re.compile(r"(?<![\w.])(?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2})(?!\w|\.\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\w|[.-]\d)|(?<![\w+])\+\d{9,15}(?!\w)")
_NUMBER = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w|[.-]\d)")
_DIGIT = re.compile(r"\d")

_TITLES = {
    "m": "Mr Herr Monsieur Señor Sr Mister",
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Mlle Señora Sra Señorita",
    "": "Dr Prof",
}
_TITLE_GENDER = {t: g for g, names in _TITLES.items() for t in names.split()}
_FIRST = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Edward Hans Klaus Jürgen Stefan Wolfgang Dieter Uwe Günther Matthias Lukas Pierre Jean François Philippe Alain Bernard Luc Étienne Olivier Julien José Juan Carlos Luis Javier Miguel Ángel Pedro Diego Andrés",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Ursula Monika Sabine Petra Heike Jürgine Käthe Anke Brigitte Greta Marie Nathalie Isabelle Sylvie Camille Chloé Élodie Amélie Juliette Céline María Carmen Josefa Ana Lucía Sofía Inés Elena Pilar Rocío",
}
_GENDER = {n: g for g, names in _FIRST.items() for n in names.split()}
_ANY_TITLE = "|".join(sorted(_TITLE_GENDER, key=len, reverse=True))
#: A capitalised word that isn't itself a title.
_NAME_WORD = rf"(?!(?:{_ANY_TITLE})(?!\w))[^\W\d_a-z][^\W\d_]*"
_NAME = re.compile(rf"(?<!\w)(?:{_ANY_TITLE})\.?[  ]({_NAME_WORD}(?:[  -]{_NAME_WORD}){{0,2}})")
_WORDS = re.compile(r"[^\W\d_]+")
_HINTS = tuple(_TITLE_GENDER)
#: Country calling codes of one and of two digits; all others have three (ITU-T E.164).
_CALLING = {*"17", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}

_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäæçèéêëìíîïñòóôöœùúûüÿ", "ÀÁÂÄÆÇÈÉÊËÌÍÎÏÑÒÓÔÖŒÙÚÛÜŸ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"]
_OF = {c: a for a in _ALPHABETS for c in a}


def _stream(key: bytes, tweak: str, round_: int, data: str, n: int) -> bytes:
    out, k = b"", 0
    while len(out) < 4 * n:
        out += hashlib.blake2b(f"{tweak}|{round_}|{k}|{data}".encode("utf-8", "surrogatepass"), key=key, digest_size=64).digest()
        k += 1
    return out


def permute(text: str, key: bytes, tweak: str) -> str:
    """A keyed permutation of the texts with the same alphabets in the same places; other characters stay."""
    places = [i for i, c in enumerate(text) if c in _OF]
    if not places:
        return text
    chars = list(text)
    format_ = "".join(chr(48 + _ALPHABETS.index(_OF[c])) if c in _OF else c for c in text)
    if len(places) == 1:
        sides = ([places[0]], [])
    else:
        sides = (places[: len(places) // 2], places[len(places) // 2 :])
    for k in range(8 if len(places) > 1 else 1):
        move, fixed = sides[k % 2], sides[1 - k % 2]
        noise = _stream(key, f"{tweak}|{format_}", k, "".join(chars[i] for i in fixed), len(move))
        for j, i in enumerate(move):
            a = _OF[chars[i]]
            chars[i] = a[(a.index(chars[i]) + int.from_bytes(noise[4 * j : 4 * j + 4], "big")) % len(a)]
    return "".join(chars)


def _luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _ip(value: str, key: bytes) -> str:
    hi, lo = (int(a) * 256 + int(b) for a, b in (value.split(".")[:2], value.split(".")[2:]))
    usual = lambda high: 0 < high >> 8 < 224 and high >> 8 != 127
    was = usual(hi)
    while True:  # walks on the permutation's cycle to the next address of the same class
        for k in range(6):
            hi, lo = lo, hi ^ int.from_bytes(_stream(key, "ip", k, str(lo), 1)[:2], "big")
        if usual(hi) == was:
            return f"{hi >> 8}.{hi & 255}.{lo >> 8}.{lo & 255}"


def _fill(pattern: str, digits: str) -> str:
    feed = iter(digits)
    return "".join(next(feed) if c.isdigit() else c for c in pattern)


def _number(value: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", value)
    valid = _luhn(digits)
    while True:  # walks on the permutation's cycle until the check digit's status is the same
        digits = permute(digits, key, "number")
        if _luhn(digits) == valid:
            return _fill(value, digits)


@lru_cache(maxsize=8)
def _ring(key: bytes, gender: str) -> dict[str, str]:
    """The gender's first names, each with the next in a keyed order: nobody keeps their name."""
    names = sorted(set(_FIRST[gender].split()), key=lambda n: hashlib.blake2b(n.encode(), key=key).digest())
    return dict(zip(names, names[1:] + names[:1], strict=True))


def _cased(new: str, old: str) -> str:
    """``new`` with the capitals of ``old``, of the same length."""
    return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for n, o in zip(new, old, strict=True))


def _name_word(word: str, key: bytes) -> str:
    known = word[:1].upper() + word[1:].lower()
    if known in _GENDER:
        new = _ring(key, _GENDER[known])[known]
        return new.upper() if word.isupper() and len(word) > 1 else new
    low = word.lower()
    if len(low) != len(word):  # a letter whose lower case is longer: spelled as it is
        return permute(word, key, "name")
    while True:  # a surname must not become a listed first name, else it could meet that name's surrogate
        low = permute(low, key, "name")
        if low[:1].upper() + low[1:] not in _GENDER:
            return _cased(low, word)


def _check_digits(country: str, account: str) -> int:
    """What the check digits of an IBAN should be."""
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return 98 - int(number) % 97


def _iban(value: str, key: bytes) -> str:
    bare = re.sub(r"\W", "", value)
    country, check, account = bare[:2], int(bare[2:4]), bare[4:]
    new = permute(account, key, "iban" + country)
    off = (check - _check_digits(country, account)) % 100  # 0 for a valid one
    bare = country + f"{(_check_digits(country, new) + off) % 100:02d}" + new
    feed = iter(bare)
    return "".join(next(feed) if c.isalnum() else c for c in value)


def _phone(value: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", value)
    keep = 0
    if value.startswith("+"):
        keep = next((n for n in (1, 2) if digits[:n] in _CALLING), 3)
    return _fill(value, digits[:keep] + permute(digits[keep:], key, "phone" + ("+" + digits[:keep] if keep else "")))


def _email(value: str, key: bytes) -> str:
    low = value.lower()
    local, _, domain = low.rpartition("@")
    host, dot, top = domain.rpartition(".")
    return _cased(permute(local, key, "email") + "@" + permute(host, key, "host") + dot + top, value)


def spelling(kind: str, value: str) -> str:
    """The one spelling of an entity, however it is written."""
    if kind in ("phone", "number"):
        return ("+" if value.startswith("+") else "") + re.sub(r"\D", "", value)
    if kind == "iban":
        return re.sub(r"\W", "", value)
    if kind == "name":
        return " ".join(_WORDS.findall(value)).lower()
    return value.lower()


def surrogate(kind: str, value: str, key: bytes) -> str:
    """The surrogate of one entity; one-to-one among entities of a kind and format."""
    if kind == "name":
        return _WORDS.sub(lambda m: _name_word(m.group(), key), value)
    known = {"email": _email, "ip": _ip, "number": _number, "phone": _phone, "iban": _iban}
    return known[kind](value, key) if kind in known else permute(value, key, kind)


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the whole text's entities, in order and without overlap; the first kind listed wins.

    A name is found after a title; all other mentions in the same text of it or
    of one of its words (two letters or more, in that spelling) count as well.
    """
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))  # places of what is found already, so that no two spans are compared

    def add(kind: str, spans) -> None:
        for s, e in spans:
            if taken.find(1, s, e) < 0:
                taken[s:e] = b"\x01" * (e - s)
                found.append((s, e, kind))

    if "@" in text:
        add("email", (m.span() for m in _EMAIL.finditer(text)))
    if _DIGIT.search(text):
        add("ip", (m.span() for m in _IP.finditer(text) if all(int(x) < 256 for x in m.group().split("."))))
        add("iban", (m.span() for m in _IBAN.finditer(text) if 15 <= len(re.sub(r"\W", "", m.group())) <= 34))
        add("ssn", (m.span() for m in _SSN.finditer(text)))
        add("number", (m.span() for m in _NUMBER.finditer(text)))
        for m in _PHONE.finditer(text):
            n = sum(c.isdigit() for c in m.group())
            if 9 <= n <= 15 or 7 <= n <= 8 and m.group()[0] == "(":
                add("phone", [m.span()])
    if any(t in text for t in _HINTS):
        names = [m.span(1) for m in _NAME.finditer(text)]
        add("name", names)
        if names:
            words = {w for s, e in names for w in _WORDS.findall(text[s:e]) if len(w) > 1}
            add("name", _mentions(text, words))
    return sorted(found)


def _mentions(text: str, words: set[str]) -> Iterator[tuple[int, int]]:
    """Runs of the words, which one space or hyphen may join."""
    start = end = -1
    for m in _WORDS.finditer(text):
        s, e = m.span()
        if m.group() not in words or s and (text[s - 1].isdigit() or text[s - 1] == "_") or text[e : e + 1].isdigit() or text[e : e + 1] == "_":
            continue
        if start >= 0 and s == end + 1 and text[end] in " \u00a0-":
            end = e
            continue
        if start >= 0:
            yield start, end
        start, end = s, e
    if start >= 0:
        yield start, end


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with surrogates, and ``(kind, value, surrogate)`` of each entity; null stays null."""
    spans = entities(text)
    if not spans:
        return text, []
    out, at, log = [], 0, []
    for s, e, kind in spans:
        new = surrogate(kind, text[s:e], key)
        log.append((kind, text[s:e], new))
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), log


def _checked(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """Collisions of the corpus, which are none: they are looked for all the same."""
    return cut(collisions(docs, key, text_col))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its texts' entities replaced; every row and column stays.

    First all entities of the corpus are checked: if two shared a surrogate, this
    raises instead of merging them.  Null and empty texts stay as they are; an
    empty table stays empty.  Two scans and a shuffle of the distinct entities;
    other columns pass through, whatever their names.
    """
    secret, at = key.encode(), docs.columns.index(text_col)
    if (clash := _checked(docs, key, text_col).first()) is not None:
        raise ValueError(f"{clash['n_values']} entities of kind {clash['kind']} share a surrogate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [replace(t.as_py(), secret)[0] for t in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, n_entities, entities, n_collisions)`` per row: the new text, its entities' kinds and surrogates.

    ``n_collisions`` counts a row's entities whose surrogate another entity of the
    corpus has, written in any way: 0 unless a permutation isn't one-to-one.
    Nulls, empty texts and repeated rows keep their rows; an empty table gives
    none; other columns are not read.  Only where there are collisions do texts
    go through a join of their entities with all of them.
    """
    secret, clashes = key.encode(), _checked(docs, key, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [replace(t.as_py(), secret) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([d[0] for d in done], pa.string()),
                    pa.array([len(d[1]) for d in done], pa.int64()),
                    pa.array([",".join(f"{k}:{s}" for k, _, s in d[1]) for d in done], pa.string()),
                    pa.array([[{"kind": k, "surrogate": spelling(k, s)} for k, _, s in d[1]] for d in done] if clash else [None] * len(done), _SPELLED),
                ],
                names=["doc_id", "text", "n_entities", "entities", "spelled"],
            )

    clash = not clashes.isEmpty()
    new = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, text string, n_entities long, entities string, spelled array<struct<kind:string,surrogate:string>>"
    )
    if not clash:
        return new.drop("spelled").withColumn("n_collisions", F.lit(0).cast("long"))
    # however many there are, they stay on the executors: rows are numbered once, as ids may repeat
    rows = cut(new.withColumn("row", F.monotonically_increasing_id()))
    counts = rows.select("row", F.explode("spelled").alias("x")).select("row", "x.kind", "x.surrogate").join(clashes, ["kind", "surrogate"]).groupBy("row").agg(F.count("*").alias("n"))
    return rows.join(counts, "row", "left").select("doc_id", "text", "n_entities", "entities", F.coalesce("n", F.lit(0).cast("long")).alias("n_collisions"))


def collisions(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``(kind, surrogate, n_values)`` of surrogates that several entities share, in their one spelling: none, as the permutations are one-to-one."""
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            log = list(dict.fromkeys((k, spelling(k, v), spelling(k, s)) for t in batch.column(0) for k, v, s in replace(t.as_py(), secret)[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in log], pa.string()) for k in range(3)], names=["kind", "value", "surrogate"]
            )

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, value string, surrogate string")
    return (
        found.distinct()
        .groupBy("kind", "surrogate")
        .agg(F.count("*").alias("n_values"))
        .where("n_values > 1")
    )
