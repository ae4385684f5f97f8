"""Splitting text into overlapping chunks, and choosing among them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import contains_ci, let, strip

SIZE, OVERLAP = 1000, 100
SEPARATORS = ("\n\n", "\n", " ", "")
APPENDICES = (
    "references", "further reading", "external links", "see also", "notes", "citations",
    "bibliography", "sources", "footnotes", "works cited", "gallery",
)


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that serves.

    Pieces are merged while they fit; each chunk begins with as many of the last
    pieces as fit into ``overlap``.  Pieces that are too long are split again by
    the next separator.
    """
    for k, sep in enumerate(separators):
        if sep == "" or sep in text:
            break
    pieces = list(text) if sep == "" else [p for p in text.split(sep) if p]
    out: list[str] = []
    held: list[str] = []
    joined = lambda ps: len(sep) * max(0, len(ps) - 1) + sum(map(len, ps))

    def close() -> None:
        if chunk := sep.join(held).strip():
            out.append(chunk)

    for piece in pieces:
        if len(piece) > size:
            close()
            held = []
            out += split_text(piece, size, overlap, separators[k + 1 :])
            continue
        if held and joined([*held, piece]) > size:
            close()
            while held and (joined(held) > overlap or joined([*held, piece]) > size):
                held.pop(0)
        held.append(piece)
    close()
    return out


def chunks(text: Column) -> Column:
    """Chunks of each text; no column expression can merge pieces greedily."""

    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield series.map(lambda t: split_text(t) if t else [])

    # made here and not on import, as workers without a session import this module too
    return F.pandas_udf("array<string>")(split)(text)


def first_chunks(texts: Column) -> Column:
    """The first chunk of each text of an array; empty where there is none."""

    def split(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in arrays:
            yield series.map(lambda ts: None if ts is None else [(split_text(t) or [""])[0] if t else "" for t in ts])

    return F.pandas_udf("array<string>")(split)(texts)


def fixed_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` characters every ``size - overlap``: the splitter's form without separators."""
    stride = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * stride + 1, F.lit(size)))


def body_sections(sections: Column) -> Column:
    """Sections but those of the appendix."""
    return F.filter(sections, lambda s: ~F.coalesce(F.lower(strip(s["title"])).isin(*APPENDICES), F.lit(False)))


def body_text(summary: Column, sections: Column) -> Column:
    """The summary and the body sections' texts on lines; blank ones are left out."""
    parts = F.concat(F.array(summary), F.transform(body_sections(sections), lambda s: s["text"]))
    return F.array_join(F.filter(parts, lambda p: F.coalesce(strip(p) != "", F.lit(False))), "\n")


def opening(text: Column, size: int = SIZE) -> Column:
    return F.substring(strip(text), 1, size)


def select_chunks(parts: Column, topic: Column, lead: Column, size: int = SIZE) -> Column:
    """At most two passages: the first that names the topic, then the lead (else the first chunk).

    A topic passage within the lead is dropped, and so is a lead within the topic passage.
    """
    none = F.array().cast("array<string>")

    def choose(x: Column) -> Column:
        first, entity = x["first"], x["entity"]
        has = F.coalesce(entity != "", F.lit(False))
        topic_alone = first.isNotNull() & ~(has & F.contains(entity, first))
        return (
            F.when(topic_alone & has & ~F.contains(first, entity), F.array(first, entity))
            .when(topic_alone, F.array(first))
            .when(has, F.array(entity))
            .otherwise(none)
        )

    def of_parts(p: Column) -> Column:
        about = F.when(topic.isNotNull() & (topic != ""), F.get(F.filter(p, lambda c: contains_ci(c, topic)), F.lit(0)))
        entity = opening(F.coalesce(F.nullif(lead, F.lit("")), F.get(p, F.lit(0))), size)
        return F.when(F.size(p) > 0, let(F.struct(opening(about, size).alias("first"), entity.alias("entity")), choose)).otherwise(none)

    return let(parts, of_parts)


def section_chunks(lead: Column, pieces: Column, size: int = SIZE) -> Column:
    """The whole lead, then the first chunk of each section unless a chosen one contains it.

    ``pieces`` has the sections' first chunks.  What is kept depends on what was
    kept before, hence a fold.
    """
    start = F.when(F.coalesce(strip(lead) != "", F.lit(False)), F.array(strip(lead))).otherwise(F.array().cast("array<string>"))

    def step(kept: Column, piece: Column) -> Column:
        chunk = opening(piece, size)
        skip = ~F.coalesce(chunk != "", F.lit(False)) | F.exists(kept, lambda s: F.contains(s, chunk))
        return F.when(skip, kept).otherwise(F.concat(kept, F.array(chunk)))

    return F.aggregate(pieces, start, step)


def pdf_passage(parts: Column, term: Column, response: Column, size: int = SIZE) -> Column:
    """The first chunk that names the term; else what the model chose among previews.

    ``none`` means none; a valid number that chunk; anything else the first.
    """
    named = F.get(F.filter(parts, lambda c: contains_ci(c, term)), F.lit(0))
    said = F.lower(strip(response))
    number = F.when(said.rlike(r"^\d{1,9}$"), said.cast("int"))
    valid = number.isNotNull() & (number < F.size(parts))
    fallback = (
        F.when(F.coalesce(said == "none", F.lit(False)), F.lit(None))
        .when(F.coalesce(valid, F.lit(False)), F.get(parts, number))
        .otherwise(F.get(parts, F.lit(0)))
    )
    return F.substring(F.coalesce(named, fallback), 1, size)


def previews(parts: Column, count: int = 10, size: int = 500) -> Column:
    return F.transform(F.slice(parts, F.lit(1), F.lit(count)), lambda c: F.substring(c, 1, size))
