"""Sources of external knowledge: frames of terms in, frames of passages out."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.chunks import body_sections, body_text, chunks, first_chunks, opening, pdf_passage, previews, section_chunks, select_chunks
from tessera.functions.text import contains_ci
from tessera.lineage import cut
from tessera.operators.knowledge import ambiguous, best_topic, entity_band, first_success, relevant, resolve, search, summary


@runtime_checkable
class ExternalKnowledge(Protocol):
    def lookup(self, terms: DataFrame, *, model: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
        """``terms(term, hint)`` to ``(term, summary, is_ambiguous)``."""


@dataclass(frozen=True)
class PageSource:
    """A table ``pages(title, status, summary, sections)`` in place of an online encyclopedia."""

    pages: DataFrame
    top: int = 5
    max_chars: int = 1000
    per_section: bool = False
    entity_score: Callable[[Column, Column], Column] | None = None
    topic_score: Callable[[Column, Column], Column] | None = None

    def lookup(self, terms: DataFrame, *, model: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
        found = self.lookup_chunks(terms, model=model)
        return found.select("term", summary(F.col("chunks")).alias("summary"), "is_ambiguous")

    def lookup_chunks(self, terms: DataFrame, *, model: Callable[[DataFrame], DataFrame] | None, topic: str | None = None) -> DataFrame:
        """``(term, chunks, is_ambiguous, title)``; titles are filtered before the wide texts are joined."""
        if model is None:
            raise ValueError("a lookup needs a model")
        status = self.pages.select("title", "status")
        candidates = search(terms, self.pages, self.top).join(status, "title", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
        if self.entity_score is None or self.topic_score is None:
            hints = terms.groupBy("term").agg((F.min("hint") if "hint" in terms.columns else F.lit(None).cast("string")).alias("hint"))
            context = F.when(F.coalesce("hint", F.lit("")) != "", F.concat(F.lit(" It was mentioned with: "), "hint")).otherwise(F.lit(""))
            asked = candidates.join(hints, "term").withColumn("prompt", F.concat(F.lit("Is the page '"), "title", F.lit("' about '"), "term", F.lit("'? yes or no."), context))
            # stored, as three frames below read it and the model is asked once
            kept = cut(relevant(model(asked), F.col("response"))).select(*candidates.columns)
            chosen = first_success(self._with_chunks(resolve(kept), topic).where(F.size("chunks") > 0))
        else:
            kept = candidates
            scored = resolve(kept).withColumn("score", self.entity_score(F.col("term"), F.col("title")))
            texts = self._with_chunks(entity_band(scored), topic).where(F.size("chunks") > 0)
            chosen = best_topic(texts.withColumn("topic_score", self.topic_score(F.lit(topic), F.col("opening"))))
        flags = ambiguous(kept)
        return (
            terms.select("term").distinct().join(flags, "term", "left").join(chosen, "term", "left")
            .select("term", F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"), F.coalesce("is_ambiguous", F.lit(False)).alias("is_ambiguous"), "title")
        )

    def _with_chunks(self, titles: DataFrame, topic: str | None) -> DataFrame:
        texts = titles.join(self.pages.select("title", "summary", "sections"), "title").withColumn("body", body_text(F.col("summary"), F.col("sections")))
        if self.per_section:
            firsts = first_chunks(F.transform(body_sections(F.col("sections")), lambda s: s["text"]))
            picked = section_chunks(F.col("summary"), firsts, self.max_chars)
        else:
            texts = texts.withColumn("parts", chunks(F.col("body")))
            picked = select_chunks(F.col("parts"), F.lit(topic).cast("string"), opening(F.col("body"), self.max_chars), self.max_chars)
        return texts.withColumn("chunks", picked).withColumn("opening", opening(F.col("body"), self.max_chars)).drop("summary", "sections", "body", "parts")


@dataclass(frozen=True)
class PdfSource:
    """One text for all terms: the pages of a PDF, joined by blank lines, or any frame with a ``text``."""

    texts: DataFrame
    max_chars: int = 1000

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> PdfSource:
        """Reads PDF files by Spark, so ``path`` may lie in any store; needs the ``pypdf`` reader."""

        def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pypdf import PdfReader

            for frame in frames:
                yield pd.DataFrame({"text": ["\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(b)).pages) for b in frame["content"]]})

        return cls(spark.read.format("binaryFile").load(path).select("content").mapInPandas(pages, "text string"))

    def lookup(self, terms: DataFrame, *, model: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
        """A passage for each term and text; never ambiguous.

        The first chunk that names the term; only terms that none names are put to
        the model, with the openings of the first chunks.  Texts are broadcast up
        to 32 MB in all, as every term is looked up in each.
        """
        if model is None:
            raise ValueError("a lookup needs a model")
        parts = cut(self.texts.select(F.lit(1).alias("one"), chunks(F.col("text")).alias("parts")))
        size = parts.agg(F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda n, c: n + F.octet_length(c)))).first()[0] or 0
        both = terms.select("term", F.lit(1).alias("one")).join(parts.hint("broadcast") if size <= 32_000_000 else parts, "one").drop("one")
        named = F.exists("parts", lambda c: contains_ci(c, F.col("term")))
        shown = F.transform(previews(F.col("parts")), lambda c, i: F.concat(F.lit("\n["), i.cast("string"), F.lit("] "), c))
        prompt = F.concat(F.lit("Which passage is about '"), "term", F.lit("'? Reply with its number or none."), F.array_join(shown, ""))
        asked = cut(model(both.where(~named & (F.size("parts") > 0)).withColumn("prompt", prompt)).select("term", "parts", "response"))
        rest = both.where(named | (F.size("parts") == 0)).withColumn("response", F.lit(None).cast("string"))
        passage = pdf_passage(F.col("parts"), F.col("term"), F.col("response"), self.max_chars)
        return asked.unionByName(rest).select("term", passage.alias("summary"), F.lit(False).alias("is_ambiguous"))
