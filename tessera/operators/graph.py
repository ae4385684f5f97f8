"""The property graph: two frames and the statements on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import description_clean, edge_type, endpoint_name, node_name
from tessera.schema import SENTINELS, AgentProfile


@dataclass(frozen=True)
class KnowledgeGraph:
    """``terms(name, description, fact_checked)`` with unique names, ``edges(src, rel, dst)`` with unique rows."""

    terms: DataFrame
    edges: DataFrame

    def all_nodes(self) -> DataFrame:
        return self.terms.select("name", "description", "fact_checked")

    def all_triples(self) -> DataFrame:
        return self.edges.select(F.col("src").alias("subject"), F.col("rel").alias("predicate"), F.col("dst").alias("object"))

    def related(self, term: str) -> DataFrame:
        """Outgoing neighbours; the filter reaches the scan of the edges."""
        return self.edges.where(F.col("src") == term.lower()).select(F.col("rel").alias("relation"), F.col("dst").alias("related_term"))

    def sql(self, query: str, args: dict | None = None) -> DataFrame:
        """A read with named parameters (``:name``) over the frames ``{terms}`` and ``{edges}``; errors are raised."""
        return self.terms.sparkSession.sql(query, args=args, terms=self.terms, edges=self.edges)

    def describe(self, names: DataFrame) -> DataFrame:
        """``name`` of the given rows with what is stored of it, in one join."""
        return names.join(self.terms, "name", "left")

    def prune(self) -> KnowledgeGraph:
        """Descriptions of terms that failed the fact check go; flags stay."""
        erased = F.when(F.col("fact_checked") == "No", None).otherwise(F.col("description"))
        return KnowledgeGraph(self.terms.withColumn("description", erased), self.edges)

    def prune_counts(self) -> DataFrame:
        flagged = F.col("fact_checked") == "No"
        return self.terms.agg(
            F.count_if(flagged & F.col("description").isNotNull()).alias("pruned"), F.count_if(flagged).alias("flagged")
        )


def merge_terms(terms: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of ``new(name, description, fact_checked)``: what is new and not null wins.

    One shuffle on the name; both sides aggregate before it.
    """
    both = terms.select("name", "description", "fact_checked", F.lit(0).alias("age")).unionByName(
        new.select("name", "description", "fact_checked", F.lit(1).alias("age"))
    )
    pick = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("age", c)))[c].alias(c)
    return both.groupBy("name").agg(pick("description"), pick("fact_checked"))


def merge_nodes(terms: DataFrame, names: DataFrame) -> DataFrame:
    """Terms for ``names(name)`` that aren't there yet, without properties."""
    bare = names.select("name", F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("fact_checked"))
    return merge_terms(terms, bare)


def seed_terms(seeds: DataFrame, profile: AgentProfile) -> DataFrame:
    """Rows to merge for ``seeds(ord, term, description)``; the profile decides on the flag and on repeated descriptions."""
    named = seeds.select(
        "ord", node_name(F.col("term"), profile.underscores_to_spaces).alias("name"), description_clean(F.col("description")).alias("description")
    )
    if profile.dedup_seed_description:
        named = first_of_description(named, "ord")
        named = named.where("description is not null")
    return (
        named.groupBy("name")
        .agg(F.max_by("description", "ord").alias("description"))
        .withColumn("fact_checked", F.lit(profile.seed_flag))
    )


def description_rows(found: DataFrame) -> DataFrame:
    """Rows to merge for ``found(name, description, grounded)``; sentinels and blanks don't count."""
    clean = description_clean(F.col("description"))
    return found.where(~F.coalesce(F.col("description").isin(*SENTINELS), F.lit(True)) & (clean != "")).select(
        "name", clean.alias("description"), F.when(F.col("grounded"), "Yes").otherwise("No").alias("fact_checked")
    )


def first_of_description(rows: DataFrame, order: str) -> DataFrame:
    """A description that several terms share stays with the first in ``order``; the others get none.

    Partial aggregates find the first, so that a very common description isn't gathered in one task.
    """
    firsts = rows.where("description is not null").groupBy("description").agg(F.min(order).alias("_first"))
    kept = rows.join(firsts, "description", "left")
    return kept.withColumn("description", F.when(F.col(order) == F.col("_first"), F.col("description"))).drop("_first").select(*rows.columns)


def build_edges(triplets: DataFrame, terms: DataFrame, profile: AgentProfile) -> DataFrame:
    """Edges of ``triplets(parent, head, relation, tail)``: from the parent and from the head to the tail.

    A blank tail makes none; a blank relation is ``HAS_TERM`` from the parent and
    none from the head.  Edges whose ends aren't terms are left out.
    """
    name = lambda c: endpoint_name(F.col(c), profile.underscores_to_spaces)
    both = triplets.where(F.coalesce(F.col("tail") != "", F.lit(False))).select(
        F.explode(
            F.array(
                F.struct(name("parent").alias("src"), edge_type(F.coalesce(F.nullif(F.col("relation"), F.lit("")), F.lit("HAS_TERM"))).alias("rel"), name("tail").alias("dst")),
                F.struct(F.when((F.col("head") != "") & (F.col("relation") != ""), name("head")).alias("src"), edge_type(F.col("relation")).alias("rel"), name("tail").alias("dst")),
            )
        ).alias("e")
    ).select("e.*")
    known = terms.select("name")
    return (
        both.where("src is not null and dst is not null")
        .distinct()
        .join(known.withColumnRenamed("name", "src"), "src", "left_semi")
        .join(known.withColumnRenamed("name", "dst"), "dst", "left_semi")
        .select("src", "rel", "dst")
    )


def merge_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.select("src", "rel", "dst").unionByName(new.select("src", "rel", "dst")).distinct()


def supported_edges(triplets: DataFrame, support: int) -> DataFrame:
    """Edges ``head -relation-> tail`` that ``support`` triplets or more state."""
    return (
        triplets.groupBy(F.col("head").alias("src"), F.col("relation").alias("rel"), F.col("tail").alias("dst"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= support)
        .select("src", "rel", "dst")
    )


def top_k(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps ``k`` a group before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")
