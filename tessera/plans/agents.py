"""The two agents' stages around a model: extraction, description and the check of triplets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import sentence_batches, sentences, strip
from tessera.functions.triples import clean, dedup_undirected, grounded, marker_triplets, response_triplets
from tessera.lineage import cut
from tessera.operators.grow import Describer, Extractor, describe_prompt, described
from tessera.schema import AgentProfile
from tessera.sources.external import ExternalKnowledge

#: A frame with a ``prompt`` to the same with a ``response``.
Model = Callable[[DataFrame], DataFrame]
#: Places of a triplet: so many for each piece of text.
_PIECE = 1_000_000


def extract_prompt(text: Column) -> Column:
    return F.concat(F.lit('List the facts of this text as JSON: {"triplets": [{"head": "", "relation": "", "tail": ""}]}. Text: '), text)


def check_prompt(head: Column, relation: Column, tail: Column, text: Column) -> Column:
    return F.concat(F.lit("Does the text say that '"), head, F.lit("' - "), relation, F.lit(" - '"), tail, F.lit("'? Answer yes or no. Text: "), text)


def _asked(pieces: DataFrame, model: Model, parse: Callable[[Column], Column]) -> DataFrame:
    """``(key, pos, piece, head, relation, tail)`` of ``pieces(key, n, piece, prompt)``; the model sees each piece once."""
    answered = cut(model(pieces)).select("key", "n", "piece", F.posexplode(parse(F.col("response"))).alias("i", "t"))
    return answered.select("key", (F.col("n").cast("long") * _PIECE + F.col("i")).alias("pos"), "piece", "t.head", "t.relation", "t.tail")


def _finished(found: DataFrame) -> DataFrame:
    return dedup_undirected(clean(found.drop("piece")), ["key"], ["pos"])


def extractor(model: Model, profile: AgentProfile) -> Extractor:
    """Triplets of ``texts(key, text)``: sentences, pieces of ``sentences_a_batch``, a call each, parser, cleaning, deduplication.

    With ``ground_in_sentence``, a piece is what the seq2seq model reads: its output
    is parsed by markers and both ends must occur in the piece.  Otherwise responses are
    JSON, and a text all of whose pieces gave nothing is asked once more as a whole.
    """

    def run(texts: DataFrame) -> DataFrame:
        parts = sentence_batches(sentences(F.col("text")), profile.sentences_a_batch)
        pieces = texts.select("key", F.posexplode(parts).alias("n", "piece"))
        if profile.ground_in_sentence:
            found = _asked(pieces.withColumn("prompt", F.col("piece")), model, marker_triplets)
            return _finished(found.where(grounded(F.col("piece"), F.col("head"), F.col("tail"))))
        found = _asked(pieces.withColumn("prompt", extract_prompt(F.col("piece"))), model, response_triplets)
        silent = texts.join(found.select("key").distinct(), "key", "left_anti").where(strip(F.col("text")) != "")
        whole = silent.select("key", F.lit(0).alias("n"), F.col("text").alias("piece"), extract_prompt(F.col("text")).alias("prompt"))
        return _finished(found.unionByName(_asked(whole, model, response_triplets)))

    return run


def describer(source: ExternalKnowledge, model: Model, lookup_model: Model | None = None) -> Describer:
    """Descriptions of ``terms(name, parent, source)``: lookup with a hint, prompt grounded in what it found or not, call, result.

    The hint is the parent, else the source text.  An ambiguous lookup grounds nothing.
    """

    def run(terms: DataFrame) -> DataFrame:
        hint = F.coalesce(F.nullif("parent", F.lit("")), F.col("source"))
        looked = source.lookup(terms.select(F.col("name").alias("term"), hint.alias("hint")), model=lookup_model or model)
        summary = F.when(~F.coalesce("is_ambiguous", F.lit(False)), F.col("summary"))
        known = looked.select(F.col("term").alias("name"), summary.alias("summary"))
        prompt = describe_prompt(F.col("name"), F.col("summary"), F.col("parent"), F.col("source"))
        answered = cut(model(terms.join(known, "name", "left").withColumn("prompt", prompt)))
        return answered.withColumn("r", described(F.col("response"), F.col("summary"))).select("name", "r.description", "r.grounded")

    return run


def checker(model: Model) -> Callable[[DataFrame], DataFrame]:
    """Triplets ``(head, relation, tail, text, ...)`` that the model confirms: a response that starts with yes.

    Incomplete triplets and failed calls don't count.
    """

    def run(triplets: DataFrame) -> DataFrame:
        whole = triplets.where("head != '' and relation != '' and tail != ''")
        asked = whole.withColumn("prompt", check_prompt(F.col("head"), F.col("relation"), F.col("tail"), F.col("text")))
        yes = F.coalesce(F.startswith(F.lower(strip(F.col("response"))), F.lit("yes")), F.lit(False))
        return cut(model(asked)).where(yes).select(*triplets.columns)

    return run
