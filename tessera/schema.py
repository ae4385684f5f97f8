"""Shapes, settings and the differences between the two agent profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TERMS = T.StructType(
    [T.StructField("name", T.StringType(), False), T.StructField("description", T.StringType()), T.StructField("fact_checked", T.StringType())]
)
EDGES = T.StructType([T.StructField(c, T.StringType(), False) for c in ("src", "rel", "dst")])
TRIPLET = "struct<head:string,relation:string,tail:string>"

#: Descriptions that count as none.
NOT_AVAILABLE = "Description not available."
FAILED = "Error generating description."
SENTINELS = (NOT_AVAILABLE, FAILED)
PLACEHOLDER = "No description available."
DEFAULT_DEPTH = 2
PATH_LIMIT = 1000


@dataclass(frozen=True)
class AgentProfile:
    """What distinguishes the two ways of growing a graph."""

    name: str
    seed_flag: str
    underscores_to_spaces: bool  # in node names and edge endpoints
    gate_on_fact_check: bool
    branch_cap: int
    validate_top_level: bool
    ground_in_sentence: bool
    sentences_a_batch: int
    dedup_seed_description: bool


CHAT = AgentProfile("chat", "Yes", True, True, 2, False, False, 3, True)
SEQ2SEQ = AgentProfile("seq2seq", "No", False, False, 3, True, True, 1, False)
