"""Secret scans: fixed patterns and a battery of randomness tests.

DataFrame functions only.  Positions are code points: the text between the
matches (``split``) and the matches (``regexp_extract_all``) alternate, so their
lengths add up to the places.

A run of an encoding's characters is tested for randomness: chi-squared tests of
the alphabet and of its classes (vowels, consonants, digits by case: the test
with power in short runs), a runs test and a serial correlation.  What passes may still be
natural, the more so the shorter it is.  So each encoding and band of lengths has
natural strings made of all the words of all texts, *decoys*, and asks of how many of the accepted
runs these would account for: see :func:`accepted_bands`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the longest run is taken, so asking for its length drops the same matches
HEX = r"[0-9a-f]{32,}"
#: Runs that may be encoded bytes.
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"

_HEX, _UPPER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ENCODINGS = {"hex": _HEX, "base32": _UPPER, "base64": _BASE64}
_BANDS = (20, 24, 28, 32, 40, 48, 64, 96)
#: Characters of one class in each alphabet.
_CLASSES = {
    "hex": ("ae", "bcdf", "0123456789"),
    "base32": ("AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "234567"),
    "base64": ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789+/"),
}
#: Least p-values that a band may ask of its runs.
_LEVELS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.4)
#: Words that are spelled in one way: enough for a string of the longest band.
_SLICE = 32


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Array of ``(s, k, e, hit)`` for the matches whose ``group`` has ``least`` characters."""
    p = F.lit(pattern)

    def built(gaps: Column, hits: Column, sizes: Column) -> Column:
        lengths = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))
        last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))
        ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(last(acc) + n)))
        return let(
            ends,
            lambda e: F.transform(
                hits,
                lambda h, i: F.struct(
                    (F.get(e, i) - F.length(h)).alias("s"),
                    F.lit(KINDS.index(kind)).alias("k"),
                    F.get(e, i).alias("e"),
                    h.alias("hit"),
                    F.length(F.get(sizes, i)).alias("n"),
                ),
            ),
        )

    every = let(
        F.struct(
            F.split(text, pattern, -1).alias("gaps"),
            F.regexp_extract_all(text, p, F.lit(0)).alias("hits"),
            F.regexp_extract_all(text, p, F.lit(group)).alias("sizes"),
        ),
        lambda x: built(x["gaps"], x["hits"], x["sizes"]),
    )
    kept = F.filter(every, lambda m: m["n"] >= least)
    none = F.array().cast("array<struct<s:int,k:int,e:int,hit:string,n:int>>")
    return F.when(text.rlike(pattern), kept).otherwise(none)


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Bowling's logistic form, error below 2e-4)."""
    return let(z, lambda z: 1 / (1 + F.exp(F.least(F.lit(600.0), 1.5976 * z + 0.070566 * z * z * z))))


def _chi_squared(statistic: Column, degrees: int) -> Column:
    """Its p-value (Wilson and Hilferty)."""
    z = (F.pow(F.greatest(statistic, F.lit(1e-9)) / degrees, F.lit(1 / 3)) - (1 - 2 / (9 * degrees))) / (2 / (9 * degrees)) ** 0.5
    return _tail(z)


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def _pieces(text: Column) -> Column:
    """The characters of a string in order, equal ones as one string: regular expressions count faster than lambdas."""
    return F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(.)\1*"), F.lit(0))


def _p_classes(spelled: Column, encoding: str) -> Column:
    """The p-value of the frequencies of character classes in a string of the encoding."""
    size, classes, n = len(_ENCODINGS[encoding]), _CLASSES[encoding], F.length(spelled).cast("double")
    squared = lambda x: F.pow(F.length(x).cast("double"), F.lit(2))
    marks = F.translate(spelled, "".join(classes), "".join(str(k) * len(c) for k, c in enumerate(classes)))
    weights = F.array(*[F.lit(size / len(c)) for c in classes])
    grouped = _total(F.transform(_pieces(marks), lambda x: squared(x) * F.get(weights, F.ascii(x) - ord("0")))) / n - n
    return _chi_squared(grouped, len(classes) - 1)


def _p_characters(spelled: Column, encoding: str) -> Column:
    """The p-value of the frequencies of characters in a string of the encoding."""
    size, n = len(_ENCODINGS[encoding]), F.length(spelled).cast("double")
    single = _total(F.transform(_pieces(spelled), lambda x: F.pow(F.length(x).cast("double"), F.lit(2)))) * size / n - n
    return _chi_squared(single, size - 1)


def _p_order(spelled: Column, encoding: str) -> Column:
    """The lesser p-value of the runs test (of the alphabet's halves) and the serial correlation in a string of the encoding."""
    alphabet, n = _ENCODINGS[encoding], F.length(spelled).cast("double")
    half = len(alphabet) // 2

    def runs(halves: Column) -> Column:
        changes = F.size(F.regexp_extract_all(halves, F.lit("h+|l+"), F.lit(0))).cast("double")
        ones = F.length(F.replace(halves, F.lit("l"), F.lit(""))).cast("double")

        def z(ones: Column) -> Column:
            zeros = n - ones
            mean = 2 * ones * zeros / n + 1
            variance = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
            return F.when((ones == 0) | (zeros == 0), F.lit(9.0)).otherwise(F.abs(changes - mean) / F.sqrt(variance))

        return let(ones, z)

    z_runs = let(F.translate(spelled, alphabet, "l" * half + "h" * (len(alphabet) - half)), runs)

    def serial(x: Column) -> Column:
        products = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: a * b)

        def z(m: Column) -> Column:
            # sums about the mean from raw sums; the ends lack one neighbour
            spread = m["squares"] - m["sum"] * m["sum"] / n
            mean = m["sum"] / n
            along = m["along"] - mean * (2 * m["sum"] - F.get(x, F.lit(0)) - F.element_at(x, -1)) + (n - 1) * mean * mean
            return F.when(spread <= 1e-9, F.lit(9.0)).otherwise(F.abs(along / spread) * F.sqrt(n))

        return let(F.struct(_total(x).alias("sum"), _total(F.transform(x, lambda a: a * a)).alias("squares"), _total(products).alias("along")), z)

    symbols = F.transform(F.split(spelled, ""), lambda c: F.greatest(F.lit(0), F.instr(F.lit(alphabet), c) - 1).cast("double"))
    return F.least(2 * _tail(z_runs), 2 * _tail(let(symbols, serial)))


def _core(hit: Column) -> Column:
    """A run in the standard alphabet, without padding."""
    return F.regexp_replace(F.translate(hit, "-_", "+/"), "=+$", "")


def _encoding(core: Column) -> Column:
    return F.when(core.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(core.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")


def _band(core: Column) -> Column:
    band = F.lit(0)
    for b in _BANDS:
        band = F.when(F.length(core) >= b, F.lit(b)).otherwise(band)
    return band


def _bonferroni(encoding: str, alpha: float) -> Callable[[Column], Column]:
    """Four times the least p-value of the tests, or of those up to the first below ``alpha``: no level is less, so the others can't matter."""
    tests = (_p_classes, _p_characters, _p_order)

    def from_(k: int, x: Column, p: Column) -> Column:
        if k == len(tests):
            return p
        return F.when(p < alpha, p).otherwise(let(F.least(p, 4 * tests[k](x, encoding)), lambda q: from_(k + 1, x, q)))

    return lambda x: from_(0, x, F.lit(1.0))


def _p(core: Column, encoding: Column, alpha: float) -> Column:
    """Bonferroni's p-value of the four tests of a run's encoding, exact from ``alpha`` on."""
    p = None
    for name in _ENCODINGS:
        spelled = F.lower(core) if name == "hex" else core
        value = let(spelled, _bonferroni(name, alpha))
        p = F.when(encoding == name, value) if p is None else p.when(encoding == name, value)
    return p


def _word(core: Column) -> Column:
    """Whether a run reads like a word: lower case but for the first letter."""
    return core.rlike("^[A-Za-z][a-z+/]*$")


def _tested(m: Column, alpha: float) -> Column:
    """A run with its encoding, length band, p-value and whether it reads like a word."""
    return let(
        _core(m["hit"]),
        lambda core: let(
            _encoding(core),
            lambda e: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e"), e.alias("encoding"), _band(core).alias("band"), _p(core, e, alpha).alias("p"), _word(core).alias("word")),
        ),
    )


def _runs(text: Column, alpha: float) -> Column:
    return F.transform(_spans(text, RUN, "random"), lambda m: _tested(m, alpha))


def _natural(texts: DataFrame) -> DataFrame:
    """``(encoding, core)`` of the natural strings that all words of ``texts(text)`` make, each word once.

    Words are those outside the runs.  Each slice of a text's words is spelled in
    one way: an identifier in camel case, one with numbers between or a path
    (base64), capitals (base32), or the words' hexadecimal bytes; and cut into
    strings of one length, its end into a shorter one.  Hashes of the slice
    choose the way and the length.  No run is as short as the ends left out.
    """
    bits = F.xxhash64("w")
    pick = lambda shift, n: F.pmod(F.shiftright(bits, shift), n.cast("long") if isinstance(n, Column) else F.lit(n)).cast("int")
    low, high = F.array(*[F.lit(b) for b in _BANDS]), F.array(*[F.lit(b) for b in (*_BANDS[1:], 2 * _BANDS[-1])])
    w, kind, core, size = F.col("w"), F.col("kind"), F.col("core"), F.col("size")
    titled = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))
    made = (
        F.when(kind == 0, F.array_join(F.transform(w, lambda x, i: F.when(i == 0, F.lower(x)).otherwise(titled(x))), ""))
        .when(kind == 1, F.array_join(F.transform(w, lambda x, i: F.concat(titled(x), F.pmod(F.xxhash64(x, i), F.lit(100)).cast("string"))), ""))
        .when(kind == 2, F.lower(F.array_join(w, "/")))
        .when(kind == 3, F.upper(F.array_join(w, "")))
        .otherwise(F.lower(F.hex(F.array_join(w, " "))))
    )
    words = F.regexp_extract_all(F.regexp_replace("text", RUN, " "), F.lit("[A-Za-z]{2,}"), F.lit(0))
    slices = let(words, lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(1), F.size(x), F.lit(_SLICE)), lambda at: F.slice(x, at, F.lit(_SLICE)))))
    band = pick(40, len(_BANDS))
    pieces = F.transform(F.sequence(F.lit(1), F.length(core), size), lambda at: F.substring(core, at, size))
    return (
        texts.select(F.explode(slices).alias("w"))
        .select("w", pick(52, 5).alias("kind"), (F.get(low, band) + pick(20, F.get(high, band) - F.get(low, band))).alias("size"))
        .select(made.alias("core"), "size", F.when(kind <= 2, "base64").when(kind == 3, "base32").otherwise("hex").alias("encoding"))
        .select("encoding", F.explode(pieces).alias("core"))
        .where(F.length("core") >= _BANDS[0])
    )


def _decoys(texts: DataFrame, alpha: float) -> DataFrame:
    """``(encoding, band, p, word)`` of all natural strings of ``texts(text)``."""
    core = F.col("core")
    return _natural(texts).select("encoding", _band(core).alias("band"), _p(core, F.col("encoding"), alpha).alias("p"), F.lit(True).alias("word"))


def accepted_bands(docs: DataFrame, alpha: float = 0.01, rate: float = 0.05, least: int = 40, text_col: str = "text") -> list[tuple[str, int, float]]:
    """Encodings and length bands with the p-value that a run must reach there to be reported.

    Decoys are the runs that read like words, and natural strings made of every
    word of the documents.  Among them, the share ``(f + 1) / (d + 1)`` that reaches a level is
    the p-value of "this run is natural" at that level.  A band takes the
    lowest level, ``alpha`` or more, at which this share of all *tested* runs is
    at most ``rate`` times the runs found: the step-up rule of Benjamini and Hochberg
    on those p-values.  A band with fewer than ``least`` decoys borrows those of
    the shorter bands, which pass more easily; without enough even so, or if no
    level serves, nothing in it is reported.  At most 48 rows reach the driver.
    """
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.select(F.explode_outer(_runs(F.col("text"), alpha)).alias("r")).where("r is not null").select("r.encoding", "r.band", "r.p", "r.word")
    runs = found.union(_decoys(texts, alpha))
    levels = [x for x in (alpha, *_LEVELS) if x >= alpha]
    counts = runs.groupBy("encoding", "band", "word").agg(F.count("*").alias("n"), *[F.count_if(F.col("p") >= x).alias(f"n{k}") for k, x in enumerate(levels)])
    got = {(r["encoding"], r["band"], r["word"]): [r["n"], *[r[f"n{k}"] for k in range(len(levels))]] for r in counts.collect()}
    none, out = [0] * (1 + len(levels)), []
    for encoding in _ENCODINGS:
        for at, band in enumerate(_BANDS):
            tested, decoys = got.get((encoding, band, False), none), none
            for b in _BANDS[at::-1]:
                if decoys[0] < least:
                    decoys = [x + y for x, y in zip(decoys, got.get((encoding, b, True), none), strict=True)]
            for k, level in enumerate(levels, 1):
                if decoys[0] >= least and tested[k] and (decoys[k] + 1) / (decoys[0] + 1) * tested[0] <= rate * tested[k]:
                    out.append((encoding, band, level))
                    break
    return out


def scan(docs: DataFrame, alpha: float = 0.01, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random)`` for every row of ``docs``.

    Base kinds may overlap each other; runs that the tests add don't overlap
    base spans.  Null texts count as empty; texts are read whole; repeated rows
    give repeated results; other columns are not read; an empty table gives an
    empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bands = accepted_bands(docs, alpha, rate, text_col=text_col)
    fits = F.lit(False)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(
        "doc_id",
        _spans(text, ASSIGN, "assign", 2, 8).alias("assign"),
        _spans(text, ACCESS, "access").alias("access"),
        _spans(text, HEX, "hex").alias("hex"),
        _runs(text, alpha).alias("runs") if bands else F.array().cast("array<struct<s:int,k:int,e:int,encoding:string,band:int,p:double,word:boolean>>").alias("runs"),
    )
    short = lambda c: F.transform(c, lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e")))
    known = F.array_sort(F.concat(short(F.col("assign")), short(F.col("access")), short(F.col("hex"))))

    def chosen(m: Column) -> Column:
        ok = fits
        for encoding, band, level in bands:
            ok = ok | ((m["encoding"] == encoding) & (m["band"] == band) & (m["p"] >= level))
        free = ~F.exists(F.col("base"), lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"]))
        return ok & ~m["word"] & free

    def joined(c: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(c, lambda m: F.concat_ws(":", F.get(names, m["k"]), m["s"].cast("string"), m["e"].cast("string"))), ",")

    out = base.withColumn("base", known).withColumn("added", short(F.filter("runs", chosen)))
    size = lambda c: F.size(c).cast("long")
    return out.select(
        "doc_id",
        size("assign").alias("n_assign"),
        size("access").alias("n_access"),
        size("hex").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        size("added").alias("n_random"),
    )
