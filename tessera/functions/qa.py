"""Prompts and response parsers of question/answer generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import described, let, render_path, strip


def _topic_line(topic: Column | None) -> Column:
    if topic is None:
        return F.lit("")
    return F.when(topic.isNotNull() & (topic != ""), F.concat(F.lit("Keep to the topic: "), topic, F.lit(".\n"))).otherwise(F.lit(""))


def _ends(nodes: Column, names: Column, rels: Column) -> list[Column]:
    start, end = F.get(nodes, F.lit(0)), F.get(nodes, F.size(rels))
    return [
        F.lit("Path: "), render_path(names, rels),
        F.lit("\nFrom: "), start["name"], F.lit(" = "), described(start["description"]),
        F.lit("\nTo: "), end["name"], F.lit(" = "), described(end["description"]),
    ]


def forward_prompt(nodes: Column, rels: Column, topic: Column | None = None) -> Column:
    """Asks for an open question that needs the whole path, and its answer."""
    names = F.transform(nodes, lambda n: n["name"])
    return F.concat(
        F.lit("Write one question whose answer needs every step of the path, and answer it.\n"),
        _topic_line(topic),
        *_ends(nodes, names, rels),
        F.lit("\nReply with two lines, Question: and Answer:"),
    )


def reverse_prompt(nodes: Column, rels: Column, topic: Column | None = None) -> Column:
    """Asks for a multiple-choice question whose right option is the path's first term."""
    names = F.transform(nodes, lambda n: n["name"])
    return F.concat(
        F.lit("Write one question with four options A) to D); the right option is '"),
        F.get(names, F.lit(0)),
        F.lit("'.\n"),
        _topic_line(topic),
        *_ends(nodes, names, rels),
        F.lit("\nReply with Question:, the four options and Correct Answer: on lines of their own"),
    )


def validation_prompt(question: Column, answer: Column, nodes: Column, rels: Column, topic: Column | None = None) -> Column:
    """Asks for four verdicts; a malformed path is named instead of failing."""
    names = F.transform(nodes, lambda n: n["name"])
    whole = F.coalesce((F.size(rels) > 0) & (F.size(nodes) == F.size(rels) + 1), F.lit(False))
    path = F.when(whole, render_path(names, rels)).when(F.size(nodes) > 0, F.lit("[incomplete path]")).otherwise(F.lit("[no path]"))
    start, end = F.get(nodes, F.lit(0)), F.get(nodes, F.size(nodes) - 1)
    part = lambda n: F.concat(F.coalesce(n["name"], F.lit("[none]")), F.lit(" = "), F.substring(described(n["description"]), 1, 150))
    return F.concat(
        F.lit("Judge this pair by the source alone.\nQuestion: "), F.coalesce(question, F.lit("[no question]")),
        F.lit("\nAnswer: "), F.coalesce(answer, F.lit("[no answer]")),
        F.lit("\nTopic: "), F.coalesce(topic, F.lit("")) if topic is not None else F.lit(""),
        F.lit("\nPath: "), path, F.lit("\nFrom: "), part(start), F.lit("\nTo: "), part(end),
        F.lit("\nReply with four lines: grammar, answerable, topic, ethics"),
    )


def _line(text: Column, pattern: str) -> Column:
    """What follows on the line of the first match; null if there is none or it is blank."""
    return F.nullif(strip(F.regexp_extract(text, f"(?idU){pattern}\\s*(.*)", 1)), F.lit(""))


def parse_open(text: Column) -> Column:
    """``(question, answer)``; null if either is missing or blank."""
    q, a = _line(text, "Question:"), _line(text, "Answer:")
    return F.when(q.isNotNull() & a.isNotNull(), F.struct(q.alias("question"), a.alias("answer")))


def parse_mcq(text: Column) -> Column:
    """``(question, a, b, c, d, key)``; null if any is missing or blank."""
    parts = {"question": _line(text, "Question:")} | {k: _line(text, rf"\n{k.upper()}\)") for k in "abcd"}
    parts["key"] = F.upper(F.nullif(F.regexp_extract(text, r"(?i)\nCorrect Answer:\s*([A-D])", 1), F.lit("")))
    ok = F.lit(True)
    for v in parts.values():
        ok = ok & v.isNotNull()
    return F.when(ok, F.struct(*[v.alias(k) for k, v in parts.items()]))


def options(mcq: Column) -> Column:
    return F.create_map(*[x for k in "abcd" for x in (F.lit(k.upper()), mcq[k])])


def keyed_option(mcq: Column) -> Column:
    return F.element_at(options(mcq), mcq["key"])


def parse_verdict(text: Column) -> Column:
    """Four verdicts of a response: one ``key: value`` a line, the last of a key counts; all false if it is empty."""
    # lines without a colon are no verdict
    lines = F.filter(F.split(strip(text), "\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(
        lines,
        lambda x: F.struct(
            F.replace(F.lower(strip(F.substring_index(x, ":", 1))), F.lit(" "), F.lit("_")).alias("key"),
            F.upper(strip(F.substring(x, F.instr(x, ":") + 1, F.length(x)))).alias("value"),
        ),
    )

    there = F.coalesce(text != "", F.lit(False))

    def judged(pairs: Column) -> Column:
        def last(key: str) -> Column:
            return let(F.filter(pairs, lambda e: e["key"] == key), lambda own: F.get(own, F.size(own) - 1)["value"])

        yes = lambda key: there & F.coalesce(last(key) == "YES", F.lit(False))
        return F.struct(
            yes("grammar_fluency").alias("grammar"),
            yes("answerable_from_source").alias("answerable"),
            (there & F.coalesce(last("topic_relevant") != "NO", F.lit(True))).alias("topic"),
            yes("ethics_privacy_safe").alias("ethics"),
        )

    return let(entries, judged)


def structurally_sound(question: Column, answer: Column) -> Column:
    """A question of 10 to 200 characters and an answer."""
    return F.coalesce(F.length(question).between(10, 200) & (F.length(answer) >= 1), F.lit(False))
