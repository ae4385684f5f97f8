"""Growing the graph: descriptions, and expansion level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import seed_term, strip
from tessera.lineage import cut
from tessera.operators.graph import KnowledgeGraph, build_edges, description_rows, first_of_description, merge_edges, merge_nodes, merge_terms, seed_terms, top_k
from tessera.schema import FAILED, NOT_AVAILABLE, SENTINELS, AgentProfile

#: ``texts(key, text)`` to ``(key, pos, head, relation, tail)``, cleaned and without repeats.
Extractor = Callable[[DataFrame], DataFrame]
#: ``terms(name, parent, source)`` to ``(name, description, grounded)``.
Describer = Callable[[DataFrame], DataFrame]


def pending(triplets: DataFrame, terms: DataFrame) -> DataFrame:
    """Heads and tails that have no description yet, once each."""
    ends = triplets.select(F.explode(F.array("head", "tail")).alias("name")).where("name != ''").distinct()
    return ends.join(terms.where("description is not null").select("name"), "name", "left_anti")


def describe_prompt(term: Column, summary: Column, parent: Column, source: Column) -> Column:
    """Grounded in the summary if there is one, else with the parent and source as hints."""
    hints = F.concat(
        F.when(parent.isNotNull() & (parent != ""), F.concat(F.lit(" It was mentioned with '"), parent, F.lit("'."))).otherwise(F.lit("")),
        F.when(source.isNotNull() & (source != ""), F.concat(F.lit(" Context: "), source)).otherwise(F.lit("")),
    )
    return F.when(
        F.coalesce(summary != "", F.lit(False)), F.concat(F.lit("Describe '"), term, F.lit("' from this text alone: "), summary)
    ).otherwise(F.concat(F.lit("Describe '"), term, F.lit("' briefly."), hints))


def described(response: Column, summary: Column) -> Column:
    """``(description, grounded)``; a blank response is the sentinel and not grounded."""
    text = F.nullif(strip(response), F.lit(""))
    return F.struct(
        F.coalesce(text, F.lit(NOT_AVAILABLE)).alias("description"),
        (text.isNotNull() & F.coalesce(summary != "", F.lit(False))).alias("grounded"),
    )


def usable(description: Column) -> Column:
    return F.coalesce((description != "") & ~description.isin(*SENTINELS), F.lit(False))


def gate(tails: DataFrame, terms: DataFrame) -> DataFrame:
    """Tails ``(name, ...)`` whose term passed the fact check; unknown ones don't."""
    return tails.join(terms.where("fact_checked = 'Yes'").select("name"), "name", "left_semi")


def branches(triplets: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` triplets ``(key, pos, ...)`` of each key in list order."""
    return top_k(triplets, ["key"], ["pos"], cap)


def grounding_stats(found: DataFrame) -> DataFrame:
    """Grounded and ungrounded usable descriptions, and the share of the first in per cent."""
    ok = found.where(usable(F.col("description")))
    return ok.agg(F.count_if("grounded").alias("grounded"), F.count_if(~F.col("grounded")).alias("model_only")).withColumn(
        "grounded_pct", F.round(100.0 * F.col("grounded") / F.nullif(F.col("grounded") + F.col("model_only"), F.lit(0)), 1)
    )


def _context(level: DataFrame) -> DataFrame:
    """``(name, parent, source)`` of a level's terms: a tail's parent, and the text or term that the triplet came from."""
    ends = level.select(F.explode(F.array(F.struct(F.col("head").alias("name"), F.lit(None).cast("string").alias("parent"), "source"), F.struct(F.col("tail").alias("name"), "parent", "source"))).alias("e")).select("e.*")
    return ends.groupBy("name").agg(F.min("parent").alias("parent"), F.min("source").alias("source"))


def expand(graph: KnowledgeGraph, triplets: DataFrame, extract: Extractor, describe: Describer, profile: AgentProfile, max_depth: int) -> KnowledgeGraph:
    """Adds ``triplets(key, pos, parent, head, relation, tail[, source])`` and what follows from their tails' descriptions.

    Level by level: terms and descriptions are merged, edges built, then each
    distinct tail is expanded once, at its smallest depth, by the first
    ``branch_cap`` triplets of its description.  Depths 0 and 1 stop after the
    first level.  ``source`` is the text that the triplets were read from; deeper
    levels have their parent's name.  A description that was generated before, for
    another term, isn't stored again: of one level's, the smallest name keeps it.
    One pass of joins for each level; nothing is collected.
    """
    terms, edges = graph.terms, graph.edges
    level = triplets if "source" in triplets.columns else triplets.withColumn("source", F.col("parent"))
    seen = made = None
    for depth in range(1, max(1, max_depth) + 1):
        level = cut(level.where("tail != ''"))
        terms = merge_nodes(terms, level.select(F.explode(F.array("head", "tail")).alias("name")).where("name != ''").distinct())
        found = describe(pending(level, terms).join(_context(level), "name", "left"))
        fresh = first_of_description(description_rows(found), "name").where("description is not null")
        if made is not None:
            fresh = fresh.join(made, "description", "left_anti").select(*fresh.columns)
        fresh = cut(fresh)
        made = fresh.select("description") if made is None else made.union(fresh.select("description"))
        terms = cut(merge_terms(terms, fresh))
        edges = cut(merge_edges(edges, build_edges(level, terms, profile)))
        if depth >= max_depth:
            break
        tails = level.select(F.col("tail").alias("name")).distinct()
        if seen is not None:
            tails = tails.join(seen, "name", "left_anti")
        seen = tails if seen is None else seen.union(tails)
        if profile.gate_on_fact_check:
            tails = gate(tails, terms)
        texts = tails.join(terms.where(usable(F.col("description"))), "name").select(F.col("name").alias("key"), F.col("description").alias("text"))
        level = branches(extract(texts), profile.branch_cap).withColumns({"parent": F.col("key"), "source": F.col("key")})
    return KnowledgeGraph(terms, edges)


def from_seeds(
    graph: KnowledgeGraph, seeds: DataFrame, extract: Extractor, describe: Describer, profile: AgentProfile, max_depth: int, check: Callable[[DataFrame], DataFrame] | None = None
) -> KnowledgeGraph:
    """Adds ``seeds(ord, prompt, response)``: a term for each prompt, described by its response, and what the response says.

    A failed response is the sentinel text, which is mined like any other.  A
    profile that validates its top level keeps the triplets that ``check`` confirms;
    those found deeper aren't checked.
    """
    ready = seeds.select(F.col("ord").cast("string").alias("key"), "ord", seed_term(F.col("prompt")).alias("term"), F.coalesce("response", F.lit(FAILED)).alias("description"))
    terms = merge_terms(graph.terms, seed_terms(ready, profile))
    said = extract(ready.select("key", F.col("description").alias("text")))
    known = ready.select("key", F.col("term").alias("parent"), F.col("description").alias("source"))
    rows = said.join(known, "key")
    if profile.validate_top_level and check is not None:
        rows = check(rows.withColumn("text", F.col("source"))).drop("text")
    return expand(KnowledgeGraph(terms, graph.edges), rows, extract, describe, profile, max_depth)
