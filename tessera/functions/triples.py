"""Parsers of model responses into triplets, cleaning and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import contains_ci, let, not_blank, relation_key, strip, term_clean, term_key
from tessera.schema import TRIPLET

_NONE = f"cast(array() as array<{TRIPLET}>)"
_QUOTED = r"""["']{key}["']\s*:\s*["']([^"']+)["']"""
_FALLBACK = r"\s*,\s*".join(_QUOTED.format(key=k) for k in ("head", "relation", "tail"))


def _elements(response: Column) -> Column:
    """The ``triplets`` list of the outermost JSON object as variants; null if there is no such list."""
    first = F.instr(response, "{")
    last = F.length(response) - F.instr(F.reverse(response), "}") + 1
    body = F.when((first > 0) & F.contains(response, F.lit("}")) & (last > first), F.substring(response, first, last - first + 1))
    return F.try_variant_get(F.try_parse_json(body), "$.triplets", "array<variant>")


def _field(v: Column, key: str) -> Column:
    """A field that is a string; null if it is missing or of another kind."""
    return let(F.try_variant_get(v, f"$.{key}", "variant"), lambda raw: F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string")))


def _as_triplet(v: Column) -> Column:
    return F.struct(*[_field(v, k).alias(k) for k in ("head", "relation", "tail")])


def is_well_formed(t: Column) -> Column:
    """All three fields are strings and not blank."""
    ok = F.lit(True)
    for k in ("head", "relation", "tail"):
        ok = ok & F.coalesce(not_blank(t[k]), F.lit(False))
    return ok


def json_triplets(response: Column) -> Column:
    """Well-formed triplets of a JSON response."""
    return F.coalesce(F.filter(F.transform(_elements(response), _as_triplet), is_well_formed), F.expr(_NONE))


def json_counts(response: Column) -> Column:
    """``(usable, malformed)`` elements of a JSON response; null if it isn't one."""

    def counted(flags: Column) -> Column:
        usable = F.size(F.filter(flags, lambda f: f))
        return F.when(flags.isNotNull(), F.struct(usable.alias("usable"), (F.size(flags) - usable).alias("malformed")))

    return let(F.transform(_elements(response), lambda v: is_well_formed(_as_triplet(v))), counted)


def regex_triplets(response: Column) -> Column:
    """Triplets by pattern: the three keys in their order, values without quotes."""
    groups = [F.transform(F.regexp_extract_all(response, F.lit("(?U)" + _FALLBACK), F.lit(g)), strip) for g in (1, 2, 3)]
    pairs = F.zip_with(groups[0], groups[1], lambda h, r: F.struct(h.alias("head"), r.alias("relation")))
    return F.zip_with(pairs, groups[2], lambda p, t: F.struct(p["head"].alias("head"), p["relation"].alias("relation"), t.alias("tail")))


def response_triplets(response: Column) -> Column:
    """JSON if it has a well-formed triplet, else the pattern over the whole response."""
    either = let(json_triplets(response), lambda found: F.when(F.size(found) > 0, found).otherwise(regex_triplets(response)))
    return F.coalesce(either, F.expr(_NONE))


def marker_triplets(response: Column) -> Column:
    """``<triplet> subject <subj> object <obj> relation``; a subject may own several objects.

    White space collapses, special tokens go, and triplets with an empty part
    are left out.  A JSON object with a ``triplets`` list is read as such.
    """
    bare = F.regexp_replace(response, "<s>|<pad>|</s>", "")
    spaced = F.concat(F.lit(" "), F.regexp_replace(bare, r"(?U)\s+", " "), F.lit(" "))

    def of_subject(part: Column) -> Column:
        def triple(head: Column, sides: Column) -> Column:
            return F.struct(head.alias("head"), strip(F.coalesce(F.get(sides, F.size(sides) - 1), F.lit(""))).alias("relation"), strip(F.get(sides, F.lit(0))).alias("tail"), F.size(sides).alias("n"))

        def of_pieces(pieces: Column) -> Column:
            rest = F.slice(pieces, F.lit(2), F.size(pieces))
            return let(strip(F.get(pieces, F.lit(0))), lambda head: F.transform(rest, lambda p: let(F.split(p, "(?<= )<obj>(?= )"), lambda sides: triple(head, sides))))

        return let(F.split(part, "(?<= )<subj>(?= )"), of_pieces)

    subjects = F.split(spaced, "(?<= )<triplet>(?= )")
    raw = F.flatten(F.transform(F.slice(subjects, F.lit(2), F.size(subjects)), of_subject))
    kept = F.filter(raw, lambda t: (t["n"] > 1) & (t["head"] != "") & (t["relation"] != "") & (t["tail"] != ""))
    marked = F.transform(kept, lambda t: F.struct(t["head"].alias("head"), t["relation"].alias("relation"), t["tail"].alias("tail")))
    trimmed = lambda t: F.struct(*[strip(t[k]).alias(k) for k in ("head", "relation", "tail")])
    is_json = F.try_parse_json(response).isNotNull()
    return F.coalesce(F.when(is_json, F.transform(json_triplets(response), trimmed)).otherwise(marked), F.expr(_NONE))


def grounded(sentence: Column, head: Column, tail: Column) -> Column:
    """Both ends occur in the sentence they were read from."""
    return contains_ci(sentence, strip(head)) & contains_ci(sentence, strip(tail))


def clean(df: DataFrame) -> DataFrame:
    """``head``, ``relation`` and ``tail`` in their normal forms."""
    return df.withColumns({"head": term_clean(F.col("head")), "relation": relation_key(F.col("relation")), "tail": term_clean(F.col("tail"))})


def dedup_undirected(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first of the triplets that join the same two terms, either way round, by the same relation.

    The partition is a text and a pair of terms, so it stays small; ``order``
    is a total one within a text.
    """
    h, t = term_key(F.col("head")), term_key(F.col("tail"))
    keyed = df.withColumns({"_lo": F.least(h, t), "_hi": F.greatest(h, t), "_rel": relation_key(F.col("relation"))})
    first = F.row_number().over(Window.partitionBy(*by, "_lo", "_hi", "_rel").orderBy(*order))
    return keyed.withColumn("_n", first).where("_n = 1").drop("_lo", "_hi", "_rel", "_n")
