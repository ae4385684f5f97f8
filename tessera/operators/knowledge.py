"""External knowledge as joins: candidates, their checks and the chosen page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip

BAND = 0.15
#: Titles that share a word are compared with a term in blocks of about so many.
BLOCK = 512


def search(terms: DataFrame, pages: DataFrame, top: int = 5, rarest: int = 3) -> DataFrame:
    """The best ``top`` pages of each term by shared title words: ``(term, ord, title, score)``.

    A stand-in for an online search, whose ranking can't be had offline.  A page is
    a candidate if it has one of the term's ``rarest`` words (those in the fewest
    titles, in alphabetical order among equals); all shared words then count for the score.  So
    common words bring no pairs together, unless a term has no others.

    Titles with a word come in blocks of some ``BLOCK``, a key each; a term keeps its best
    ``top`` of a block at once, under the rarest of its words that the title has.  So
    pairs are neither stored nor gathered, however many titles share a word.
    """
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    asked = terms.select("term").distinct().select("term", F.explode(tokens(F.col("term"))).alias("word"))
    offered = pages.select("title").where("title is not null").distinct().select("title", tokens(F.col("title")).alias("words"))
    by_word = offered.select("title", "words", F.explode("words").alias("word"))
    found_in = by_word.groupBy("word").agg(F.count("*").alias("df"))
    common = F.broadcast(found_in.where(F.col("df") > BLOCK).select("word", F.ceil(F.col("df") / BLOCK).cast("int").alias("_n")))
    ranked = asked.join(found_in, "word").groupBy("term").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "word"))), 1, rarest)["word"].alias("keys"))
    keys = ranked.select("term", "keys", F.posexplode("keys").alias("k", "word")).join(common, "word", "left")
    wanted = keys.select("term", tokens(F.col("term")).alias("own"), F.slice("keys", F.lit(1), F.col("k")).alias("rarer"), "word", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)).alias("_b"))
    block = F.coalesce(F.pmod(F.xxhash64("title"), F.col("_n")).cast("int"), F.lit(0))
    blocks = by_word.join(common, "word", "left").groupBy("word", block.alias("_b")).agg(F.collect_list(F.struct("title", "words")).alias("titles"))
    new = F.filter("titles", lambda x: ~F.arrays_overlap(F.col("rarer"), x["words"]))
    scored = F.transform(new, lambda x: F.struct((-F.size(F.array_intersect(F.col("own"), x["words"]))).alias("less"), x["title"].alias("title")))
    best = wanted.join(blocks, ["word", "_b"]).select("term", F.explode(F.slice(F.array_sort(scored), 1, top)).alias("x"))
    met = best.select("term", "x.title", (-F.col("x.less")).cast("long").alias("score"))
    order = Window.partitionBy("term").orderBy(F.desc("score"), "title")
    return met.withColumn("ord", F.row_number().over(order) - 1).where(F.col("ord") < top).select("term", "ord", "title", "score")


def relevant(candidates: DataFrame, response: Column) -> DataFrame:
    """Candidates whose check answered exactly ``yes``; anything else, or a failed call, drops them."""
    return candidates.where(F.coalesce(F.lower(strip(response)) == "yes", F.lit(False)))


def resolve(candidates: DataFrame) -> DataFrame:
    """``(term, ord, title)`` of valid candidates ``(term, ord, title, status)``; none for an ambiguous term.

    A disambiguation page in place 0 ends the lookup, later ones are skipped.
    """
    return candidates.join(ambiguous(candidates).where("is_ambiguous").select("term"), "term", "left_anti").where("status = 'ok'").select("term", "ord", "title")


def ambiguous(candidates: DataFrame) -> DataFrame:
    """``(term, is_ambiguous)``."""
    return candidates.groupBy("term").agg(F.bool_or((F.col("ord") == 0) & (F.col("status") == "disambiguation")).alias("is_ambiguous"))


def entity_band(candidates: DataFrame, delta: float = BAND) -> DataFrame:
    """Candidates ``(term, score, ...)`` within ``delta`` of their term's best score; null scores stay.

    An aggregate and a join, so that a term with very many candidates isn't gathered in one task.
    """
    best = candidates.groupBy(F.col("term").alias("_term")).agg(F.max("score").alias("_best"))
    kept = candidates.join(best, F.col("term").eqNullSafe(F.col("_term")))
    return kept.where(F.col("score").isNull() | (F.col("score") >= F.col("_best") - delta)).select(*candidates.columns)


def first_success(found: DataFrame) -> DataFrame:
    """The candidate that comes first in search order: ``(term, ord, title, ...)``, one a term."""
    rest = [c for c in found.columns if c not in ("term", "ord")]
    return found.groupBy("term").agg(F.min_by(F.struct("ord", *rest), "ord").alias("w")).select("term", "w.*")


def best_topic(found: DataFrame) -> DataFrame:
    """The candidate with the largest ``topic_score``; ties and failed scores go by search order."""
    rest = [c for c in found.columns if c != "term"]
    key = F.struct(F.coalesce("topic_score", F.lit(float("-inf"))), -F.col("ord"))
    return found.groupBy("term").agg(F.max_by(F.struct(*rest), key).alias("w")).select("term", "w.*")


def summary(chunks: Column) -> Column:
    """Chunks as one text; null if there is none."""
    return F.nullif(F.array_join(chunks, "\n\n"), F.lit(""))
