"""The interactive surface as methods: each takes and gives frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import prompt_clean
from tessera.lineage import cut
from tessera.operators.graph import KnowledgeGraph
from tessera.operators.grow import Describer, Extractor, from_seeds
from tessera.plans.qa import Model, generate
from tessera.schema import DEFAULT_DEPTH, AgentProfile


@dataclass
class Session:
    """A graph and the stages that grow and question it."""

    graph: KnowledgeGraph
    profile: AgentProfile
    answer: Model
    extract: Extractor
    describe: Describer
    judge: Model | None = None
    check: Callable[[DataFrame], DataFrame] | None = None
    topic: str | None = None
    max_depth: int = DEFAULT_DEPTH

    def set_max_depth(self, depth: int) -> None:
        if depth < 0:
            raise ValueError("the depth must not be negative")
        self.max_depth = depth

    def ask(self, questions: DataFrame) -> DataFrame:
        """Answers ``questions(ord, prompt)`` and adds what the answers say to the graph."""
        asked = questions.select("ord", prompt_clean(F.col("prompt")).alias("prompt")).where("prompt != ''")
        answered = cut(self.answer(asked))
        self.graph = from_seeds(self.graph, answered.select("ord", "prompt", "response"), self.extract, self.describe, self.profile, self.max_depth, self.check)
        return answered

    def related(self, term: str) -> DataFrame:
        return self.graph.related(term.strip())

    def generate_qa(self, **options) -> DataFrame:
        rate = options.get("validation_sample_rate", 1.0)
        if not 0.0 <= rate <= 1.0:
            raise ValueError("the sample rate must be between 0 and 1")
        for name in ("limit", "max_complexity", "exact_complexity"):
            if (value := options.get(name)) is not None and value < 0:
                raise ValueError(f"{name} must not be negative")
        return generate(self.graph, self.answer, self.judge, topic=self.topic, **options)

    def prune(self, confirm: bool = False) -> DataFrame | None:
        """Counts of what pruning erases; it takes effect only with ``confirm``."""
        counts = self.graph.prune_counts()
        if confirm:
            self.graph = self.graph.prune()
        return counts

    def save(self, folder: str) -> None:
        self.graph.terms.write.mode("overwrite").parquet(f"{folder}/terms")
        self.graph.edges.write.mode("overwrite").parquet(f"{folder}/edges")
