"""Upserting a stream of conversation turns into the graph (an extension: the original has no streams)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.graph import KnowledgeGraph
from tessera.schema import EDGES, TERMS


def _stored(spark: SparkSession, folder: str, epoch: int | None) -> KnowledgeGraph:
    if epoch is None:
        return KnowledgeGraph(spark.createDataFrame([], TERMS), spark.createDataFrame([], EDGES))
    return KnowledgeGraph(spark.read.parquet(f"{folder}/{epoch}/terms"), spark.read.parquet(f"{folder}/{epoch}/edges"))


def upsert_stream(turns: DataFrame, folder: str, checkpoint: str, grow: Callable[[KnowledgeGraph, DataFrame], KnowledgeGraph]) -> StreamingQuery:
    """Runs ``grow`` on each batch; the graph after batch ``k`` is in ``folder/k``.

    A batch reads the version before it and writes its own, so a batch that is
    run again after a failure gives the same version.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        graph = grow(_stored(rows.sparkSession, folder, epoch - 1 if epoch else None), rows)
        graph.terms.write.mode("overwrite").parquet(f"{folder}/{epoch}/terms")
        graph.edges.write.mode("overwrite").parquet(f"{folder}/{epoch}/edges")

    return turns.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
