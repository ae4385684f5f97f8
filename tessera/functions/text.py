"""String normalisers and sentence handling as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schema import PLACEHOLDER

_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it for each of their elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """``value`` as a generator's output: filters on it, and columns made of it, don't compute it anew for each use."""
    return F.explode(F.array(value))


def strip(c: Column) -> Column:
    """White space off both ends, by Unicode; Spark's ``trim`` takes spaces only."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def not_blank(c: Column) -> Column:
    """Whether :func:`strip` would leave something; it ends at the first such character."""
    return F.rlike(c, F.lit(r"(?U)[^\s\x1c-\x1f]"))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, _SPACE, " "))


def term_clean(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit("_"), F.lit(" "))


def term_key(c: Column) -> Column:
    return collapse(F.replace(F.lower(c), F.lit("_"), F.lit(" ")))


def relation_key(c: Column) -> Column:
    """Lower case; what isn't a letter, digit or underscore becomes one; a leading digit gets one before it."""
    return F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}_]|^(?=\p{Nd})", "_")


def edge_type(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}_]|^(?=\p{Nd})", "_"))


def node_name(c: Column, underscores_to_spaces: bool) -> Column:
    one_line = F.replace(c, F.lit("\n"), F.lit(" "))
    return term_clean(one_line) if underscores_to_spaces else F.lower(collapse(one_line))


def endpoint_name(c: Column, underscores_to_spaces: bool) -> Column:
    return F.lower(strip(F.replace(c, F.lit("_"), F.lit(" ")))) if underscores_to_spaces else F.lower(strip(c))


def description_clean(c: Column) -> Column:
    return strip(F.replace(F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit(" ")))


def prompt_clean(c: Column) -> Column:
    return collapse(c)


def seed_term(c: Column) -> Column:
    return strip(F.lower(c))


def described(c: Column) -> Column:
    """A description, or the placeholder for none."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(PLACEHOLDER))


def contains_ci(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def sentences(text: Column) -> Column:
    """Array of sentences: maximal runs without ``. ! ?`` or a line break, stripped, blank ones left out."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+"), F.lit(0)), strip), lambda s: s != "")


def sentence_batches(parts: Column, size: int = 3) -> Column:
    """Groups of ``size`` sentences, joined by spaces."""
    def batches(p: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(p)), lambda i: (i % size == 0) & (i < F.size(p)))
        return F.transform(starts, lambda i: F.array_join(F.slice(p, i + 1, F.lit(size)), " "))

    return let(parts, batches)


def render_path(nodes: Column, rels: Column) -> Column:
    """``(a)-[:R]->(b)...`` of arrays of names and relationship types."""
    steps = F.zip_with(rels, F.slice(nodes, F.lit(2), F.size(rels)), lambda r, n: F.concat(F.lit("-[:"), r, F.lit("]->("), n, F.lit(")")))
    return F.concat(F.lit("("), F.get(nodes, F.lit(0)), F.lit(")"), F.array_join(steps, ""))
