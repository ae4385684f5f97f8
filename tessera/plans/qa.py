"""Graph to question/answer pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.qa import forward_prompt, keyed_option, options, parse_mcq, parse_open, reverse_prompt, validation_prompt
from tessera.lineage import cut
from tessera.operators import validate
from tessera.operators.graph import KnowledgeGraph
from tessera.operators.paths import find_paths, with_details
from tessera.schema import PATH_LIMIT

#: A frame with a ``prompt`` to the same with a ``response``.
Model = Callable[[DataFrame], DataFrame]

FORWARD, REVERSE = "multi_hop_path_open", "multi_hop_path_mcq_reverse"
_ANSWERS = "question string, answer string"


def _details() -> Column:
    checked = lambda i: F.get("nodes", i)["fact_checked"]
    return F.struct(
        "nodes",
        F.col("rels").alias("relationships"),
        F.struct(checked(F.lit(0)).alias("start_node"), checked(F.size("nodes") - 1).alias("end_node")).alias("fact_checked"),
    )


def _id(kind: str) -> Column:
    """A stable id: equal paths get equal ids, on any cluster and in any run."""
    names = F.transform("nodes", lambda n: n["name"])
    return F.sha2(F.concat_ws("\x1f", F.lit(kind), F.array_join(names, "\x1f"), F.array_join("rels", "\x1f")), 256)


def forward(paths: DataFrame, model: Model, topic: str | None = None) -> DataFrame:
    """Open pairs of ``paths(nodes, rels, complexity)`` with details."""
    asked = paths.withColumn("prompt", forward_prompt(F.col("nodes"), F.col("rels"), F.lit(topic)))
    qa = cut(model(asked)).withColumn("p", parse_open(F.col("response"))).where("p is not null")
    return qa.select(
        _id(FORWARD).alias("id"), "p.question", "p.answer", F.lit(None).cast("map<string,string>").alias("options"),
        F.lit(None).cast("string").alias("correct_answer_key"), F.lit(FORWARD).alias("source_type"), "complexity", _details().alias("source_details"),
    )


def reverse(paths: DataFrame, model: Model, topic: str | None = None) -> DataFrame:
    """Multiple-choice pairs whose keyed option is the path's first term."""
    asked = paths.withColumn("prompt", reverse_prompt(F.col("nodes"), F.col("rels"), F.lit(topic)))
    qa = cut(model(asked)).withColumn("p", parse_mcq(F.col("response"))).where("p is not null")
    right = qa.where(F.lower(keyed_option(F.col("p"))) == F.lower(F.get("nodes", F.lit(0))["name"]))
    return right.select(
        _id(REVERSE).alias("id"), "p.question", F.lit(None).cast("string").alias("answer"), options(F.col("p")).alias("options"),
        F.col("p.key").alias("correct_answer_key"), F.lit(REVERSE).alias("source_type"), "complexity", _details().alias("source_details"),
    )


def generate(
    graph: KnowledgeGraph,
    model: Model,
    judge: Model | None = None,
    max_complexity: int = 2,
    exact_complexity: int | None = None,
    limit: int | None = None,
    skip_validation: bool = False,
    validation_sample_rate: float = 1.0,
    topic: str | None = None,
    generate_reverse: bool = False,
    path_limit: int | None = PATH_LIMIT,
    fail_open: bool = True,
) -> DataFrame:
    """Pairs from the graph's paths, validated unless told otherwise.

    Pairs outside the sample are kept without validation.  Paths and what the
    models say are stored, so that each prompt is asked once.
    """
    paths = find_paths(graph.edges, max_complexity, exact_complexity, path_limit)
    if limit is not None and limit > 0:
        paths = paths.orderBy("nodes", "rels").limit(limit)
    paths = cut(with_details(paths, graph.terms))
    pairs = forward(paths, model, topic)
    if generate_reverse:
        pairs = pairs.unionByName(reverse(paths, model, topic))
    if skip_validation:
        return pairs
    if judge is None:
        return validate.structural(pairs, need_details=False)
    split = validate.sample(pairs, validation_sample_rate)
    asked = validate.structural(split.where("sampled")).withColumn(
        "prompt",
        validation_prompt(F.col("question"), F.col("answer"), F.col("source_details.nodes"), F.col("source_details.relationships"), F.lit(topic)),
    )
    passed = cut(judge(asked)).where(validate.accepted(F.col("response"), fail_open))
    return passed.select(*pairs.columns).unionByName(split.where("not sampled").select(*pairs.columns))
