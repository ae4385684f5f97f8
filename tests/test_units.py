"""Operators on hand-made rows, with the odd cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import chunks as ch
from tessera.functions import qa, triples
from tessera.functions import text as tx
from tessera.operators import graph as g
from tessera.operators import knowledge as kb
from tessera.operators import validate
from tessera.operators.paths import find_paths
from tessera.plans.model import Calls, Timeout, with_response
from tessera.schema import SEQ2SEQ


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("is a", "is_a"), ("1st place", "_1st_place"), ("née-de", "née_de"), ("co_x", "co_x"), ("", "")])
def test_relation_key(spark, raw, want):
    assert one(spark, tx.relation_key(F.col("a")), a=raw) == want


def test_strip_is_unicode(spark):
    assert one(spark, tx.strip(F.col("a")), a="\t\n\u00a0\u001c\u3000x\u3000") == "x"


def test_sentences(spark):
    assert one(spark, tx.sentences(F.col("a")), a="This is a sentence. And another one!") == ["This is a sentence", "And another one"]


def test_normalisers_agree_with_python(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    texts = []

    @settings(max_examples=150, database=None)
    @given(st.text(alphabet=st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=12))
    def draw(t):
        texts.append(t)

    draw()
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    for r in df.select("a", tx.strip(F.col("a")).alias("s"), tx.term_key(F.col("a")).alias("k")).collect():
        assert r["s"] == r["a"].strip()
        assert r["k"] == " ".join(r["a"].lower().replace("_", " ").split())


def test_well_formed(spark):
    said = '{"triplets": [{"head": "a", "relation": "r", "tail": "b"}, {"head": "a", "relation": "r", "tail": null}, {"head": "a", "relation": "r", "tail": 5}, {"head": "a", "relation": "r"}, 7]}'
    assert [tuple(t) for t in one(spark, triples.json_triplets(F.col("a")), a=said)] == [("a", "r", "b")]
    assert tuple(one(spark, triples.json_counts(F.col("a")), a=said)) == (1, 4)


def test_marker(spark):
    said = "<s><triplet> Golden  Gate <subj> bay <obj> spans <subj> fog <obj> has part</s>"
    assert [tuple(t) for t in one(spark, triples.marker_triplets(F.col("a")), a=said)] == [("Golden Gate", "spans", "bay"), ("Golden Gate", "has part", "fog")]
    assert one(spark, triples.marker_triplets(F.col("a")), a="nothing") == []


def test_undirected_dedup(spark):
    rows = spark.createDataFrame([(0, 0, "a", "likes", "b"), (0, 1, "b", "likes", "a"), (0, 2, "a", "hates", "b")], "d int, pos int, head string, relation string, tail string")
    assert sorted(r["pos"] for r in triples.dedup_undirected(rows, ["d"], ["pos"]).collect()) == [0, 2]


def test_edge_needs_both_ends_and_normalisers_disagree(spark):
    terms = spark.createDataFrame([("a b",), ("x",)], "name string")
    said = spark.createDataFrame([("a  b", "x", "r", "x"), ("x", "", "", "gone")], "parent string, head string, relation string, tail string")
    # the second profile collapses spaces in node names but not in ends, which loses the parent's edge
    assert [tuple(r) for r in g.build_edges(said, terms, SEQ2SEQ).collect()] == [("x", "R", "x")]


def test_paths_use_edges_once(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("a", "r", "a"), ("a", "s", "c")], "src string, rel string, dst string")
    assert [find_paths(e, exact_length=n).count() for n in (1, 2, 3)] == [4, 6, 5]
    assert find_paths(e, 3).count() == 15
    assert find_paths(e, 0).count() == 0


def test_paths_of_a_hub_are_dealt_out(spark):
    n = 2100
    e = spark.range(n).select(F.concat(F.lit("i"), "id").alias("src"), F.lit("r").alias("rel"), F.lit("hub").alias("dst"))
    e = e.union(spark.range(n).select(F.lit("hub"), F.lit("r"), F.concat(F.lit("o"), "id")))
    rows = find_paths(e, exact_length=2).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in rows) == n * n
    assert max(r["count"] for r in rows) < n * n / 2


@pytest.mark.parametrize("side", [1, 2, 1024])
def test_paths_do_not_depend_on_cells(spark, monkeypatch, side):
    from tessera.operators import paths

    monkeypatch.setattr(paths, "SIDE", side)
    pairs = [(a, r, b) for a in "abcd" for b in "abcd" for r in "xy" if (a, r, b) != ("a", "y", "a")]
    e = spark.createDataFrame(pairs, "src string, rel string, dst string")
    want = []
    level = [[x] for x in pairs]
    for _ in range(3):
        want += [(tuple([p[0][0], *[x[2] for x in p]]), tuple(x[1] for x in p)) for p in level if p[0][0] != p[-1][2]]
        level = [[*p, x] for p in level for x in pairs if x[0] == p[-1][2] and x not in p]
    got = [(tuple(r["nodes"]), tuple(r["rels"])) for r in find_paths(e, 3).collect()]
    assert sorted(got) == sorted(want)
    for limit in (0, 1, 50, 700, len(want) + 1):
        assert [(tuple(r["nodes"]), tuple(r["rels"])) for r in find_paths(e, 3, limit=limit).collect()] == sorted(want)[:limit]


def test_limited_search_leaves_out_later_paths(spark, monkeypatch):
    from tessera.operators import paths

    grown, hop = [], paths._hop
    monkeypatch.setattr(paths, "_hop", lambda level, *rest: grown.append(level.count()) or hop(level, *rest))
    e = spark.range(1000).select(F.format_string("n%03d", "id").alias("src"), F.lit("r").alias("rel"), F.format_string("n%03d", (F.col("id") + 1) % 1000).alias("dst"))
    assert [r["nodes"][0] for r in find_paths(e, 2, limit=10).collect()] == [f"n{i:03d}" for i in range(5) for _ in range(2)]
    assert grown == [10]


@pytest.mark.parametrize("name", ["triplet_json_parse", "triplet_malformed_counts", "triplet_well_formed"])
def test_responses_are_made_and_parsed_once(spark, sf, name):
    from tessera.plans import queries

    plan = getattr(queries, name)(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    assert plan.count("[\\p{L}\\p{N}]+") == 1


@pytest.mark.parametrize("raw", ["", " ", "\t\n\u00a0\u001c\u3000", " x ", "\u001cx", None])
def test_not_blank_is_a_strip_that_leaves_something(spark, raw):
    row = spark.createDataFrame([(raw,)], "a string").select(tx.not_blank(F.col("a")).alias("x"), (tx.strip(F.col("a")) != "").alias("y")).first()
    assert row["x"] == row["y"]


def test_json_counts(spark):
    good, bad = '{"head": "a", "relation": "r", "tail": "b"}', '{"head": " ", "relation": "r", "tail": 5}'
    for said, want in [(f'x {{"triplets": [{good}, {bad}, 7]}} y', (1, 2)), ('{"triplets": []}', (0, 0)), ('{"triplets": 1}', None), (f'{{"triplets": [{good}}}', None), ("no", None), (None, None)]:
        row = spark.createDataFrame([(said,)], "a string").select(triples.json_counts(F.col("a")).alias("x")).first()["x"]
        assert (row and tuple(row)) == want


@pytest.mark.parametrize("block", [2, 512])
def test_search_in_blocks(spark, monkeypatch, block):
    import re
    from collections import Counter

    monkeypatch.setattr(kb, "BLOCK", block)
    titles = [f"The of {a} {b}" for a in "uvw" for b in ("", "x", "y x", "of z")] + ["the", "of", "The OF", "", "!"]
    words = {x: set(re.findall(r"\w+", x.lower())) for x in titles}
    df = Counter(w for ws in words.values() for w in ws)
    want = set()
    for term in {x.lower() for x in titles}:
        own = set(re.findall(r"\w+", term))
        keys = set(sorted(own, key=lambda w: (df[w], w))[:3])
        near = sorted((-len(own & ws), x) for x, ws in words.items() if keys & ws)[:5]
        want |= {(term, n, x, -s) for n, (s, x) in enumerate(near)}
    pages = spark.createDataFrame([(x,) for x in titles], "title string")
    found = kb.search(pages.select(F.lower("title").alias("term")), pages, 5)
    assert {tuple(r) for r in found.collect()} == want


def test_search_makes_no_row_a_pair(spark):
    """600 titles share a word: the ranking gets some rows a term, not one a pair."""
    pages = spark.range(600).select(F.concat(F.lit("same t"), "id").alias("title"))
    found = kb.search(pages.select(F.col("title").alias("term")), pages, 5)
    found.collect()
    rows, node = [], found._jdf.queryExecution().executedPlan()
    stack = [node]
    while stack:
        x = stack.pop()
        if x.nodeName() == "AdaptiveSparkPlan":
            stack.append(x.executedPlan())
            continue
        if x.nodeName().endswith("QueryStage"):
            stack.append(x.plan())
        if x.metrics().contains("numOutputRows"):
            rows.append(x.metrics().apply("numOutputRows").value())
        stack += [x.children().apply(i) for i in range(x.children().size())]
    assert max(rows) < 600 * 600 / 10


def test_prune(spark):
    t = spark.createDataFrame([(f"{f}{d}", d, f) for f in ("Yes", "No", None) for d in ("x", None)], "name string, description string, fact_checked string")
    kg = g.KnowledgeGraph(t, None)
    assert kg.prune_counts().first()["pruned"] == 1
    assert {r["name"] for r in kg.prune().terms.where("description is not null").collect()} == {"Yesx", "Nonex"}


def test_select_chunks(spark):
    pick = ch.select_chunks(F.col("c"), F.col("t"), F.col("l"), 50)
    assert one(spark, pick, c=["the Bridge", "other"], t="bridge", l="the Bridge and more") == ["the Bridge and more"]
    assert one(spark, pick, c=["first", "second"], t="absent", l="lead") == ["lead"]
    assert one(spark, pick, c=["first", "about Fog"], t="fog", l="lead") == ["about Fog", "lead"]
    assert one(spark, pick, c=[], t="fog", l="lead") == []


def test_split_text():
    text = "\n\n".join("word " * n for n in (30, 150, 250, 3))
    parts = ch.split_text(text)
    assert all(len(p) <= 1000 for p in parts)
    assert "".join(text.split()) in "".join("".join(p.split()) for p in parts) or len(parts) > 1
    assert ch.split_text("x" * 2500) == ["x" * 1000, "x" * 1000, "x" * 700]
    assert ch.split_text("") == []


def test_pdf_fallback(spark):
    pick = ch.pdf_passage(F.col("c"), F.col("t"), F.col("r"), 50)
    for response, want in (("none", None), ("2", "c2"), ("99", "c0"), ("text", "c0"), (None, "c0")):
        assert one(spark, pick, c=["c0", "c1", "c2"], t="zz", r=response) == want


def test_band_and_ambiguity(spark):
    scored = spark.createDataFrame([("t", 1.0), ("t", 0.882), ("t", 0.716)], "term string, score double")
    assert kb.entity_band(scored).count() == 2
    c = spark.createDataFrame(
        [("a", 0, "x", "disambiguation"), ("a", 1, "y", "ok"), ("b", 0, "x", "ok"), ("b", 1, "y", "disambiguation")], "term string, ord int, title string, status string"
    )
    assert [(r["term"], r["title"]) for r in kb.resolve(c).collect()] == [("b", "x")]


def test_verdicts(spark):
    v = lambda t: tuple(one(spark, qa.parse_verdict(F.col("a")), a=t))
    good = "Grammar Fluency: yes\nAnswerable From Source: YES\nEthics Privacy Safe: YES"
    assert v(good) == (True, True, True, True)
    assert v(good + "\nTopic Relevant: N/A") == (True, True, True, True)
    assert v(good + "\nTopic Relevant: no") == (True, True, False, True)
    assert v(good + "\ngrammar_fluency: NO") == (False, True, True, True)
    assert v("") == (False, False, False, False)
    assert one(spark, validate.accepted(F.col("a")), a=None) is True


def test_question_lengths(spark):
    for n, ok in ((9, False), (10, True), (200, True), (201, False)):
        assert one(spark, qa.structurally_sound(F.col("q"), F.col("a")), q="q" * n, a="x") is ok


def test_sampling(spark):
    pairs = spark.range(10)
    for rate, n in ((0.0, 1), (0.55, 5), (1.0, 10)):
        assert validate.sample(pairs, rate).where("sampled").count() == n


def test_line_ends_are_newlines_only(spark):
    assert tuple(one(spark, qa.parse_open(F.col("a")), a="QUESTION: why?\nAnswer: a\rb")) == ("why?", "a\rb")


class _Client:
    def __init__(self):
        self.calls = 0

    def invoke(self, system, human):
        self.calls += 1
        if human == "slow" and self.calls < 2:
            raise Timeout
        if human == "bad":
            raise ValueError
        return human.upper()


def test_model_stage(spark):
    df = spark.createDataFrame([("hi",), ("bad",), ("slow",), (None,)], "prompt string").coalesce(1)
    out = with_response(df, _Client, "", "prompt", Calls(pause=0))
    assert {r["prompt"]: r["response"] for r in out.collect()} == {"hi": "HI", "bad": None, "slow": "SLOW", None: None}
    assert Calls(pause=0)(_Client(), "", "slow") == "SLOW"


def test_sources(spark):
    from tessera.sources.external import ExternalKnowledge, PageSource, PdfSource

    pages = spark.createDataFrame(
        [("Golden Gate", "ok", "A strait.", [("History", "It was named long ago."), ("References", "none")]), ("Gate", "ok", "A door.", []), ("Gate list", "disambiguation", "", [])],
        "title string, status string, summary string, sections array<struct<title:string,text:string>>",
    )
    yes = lambda df: df.withColumn("response", F.lit("yes"))
    source = PageSource(pages)
    assert isinstance(source, ExternalKnowledge)
    terms = spark.createDataFrame([("golden gate", ""), ("nothing", "")], "term string, hint string")
    got = {r["term"]: (r["summary"], r["is_ambiguous"]) for r in source.lookup(terms, model=yes).collect()}
    assert got == {"golden gate": ("A strait.\nIt was named long ago.", False), "nothing": (None, False)}
    pdf = PdfSource(spark.createDataFrame([("The gate is red.",)], "text string"))
    assert pdf.lookup(terms, model=yes).count() == 2
    for s in (source, pdf):
        with pytest.raises(ValueError):
            s.lookup(terms, model=None)


def test_session(spark, tmp_path):
    from tessera.operators.graph import KnowledgeGraph
    from tessera.plans.queries import _answer, _describe, _extract, _judge
    from tessera.plans.session import Session
    from tessera.schema import CHAT, EDGES, TERMS

    kg = KnowledgeGraph(spark.createDataFrame([], TERMS), spark.createDataFrame([], EDGES))
    reply = lambda df: df.withColumn("response", F.lit("bridges span bays. bays hold fog")) if "rels" not in df.columns else _answer(df)
    s = Session(kg, CHAT, reply, _extract, _describe, _judge, topic="bay")
    s.ask(spark.createDataFrame([(1, "what  are bridges")], "ord long, prompt string"))
    assert {tuple(r) for r in s.related(" Bridges ").collect()} == {("SPAN", "bays")}
    assert s.generate_qa(skip_validation=True).count() > 0
    with pytest.raises(ValueError):
        s.generate_qa(validation_sample_rate=2.0)
    with pytest.raises(ValueError):
        s.set_max_depth(-1)
    before = s.prune().first()["pruned"]
    assert s.prune(confirm=True).first()["pruned"] == before
    assert s.prune().first()["pruned"] == 0
    s.save(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/edges").count() > 0


def test_reverse_pairs_fail_when_validated(spark):
    from tessera.operators.graph import KnowledgeGraph
    from tessera.plans.qa import REVERSE, generate
    from tessera.plans.queries import _answer, _judge

    kg = KnowledgeGraph(
        spark.createDataFrame([("alpha", "d", "Yes"), ("beta", None, None)], "name string, description string, fact_checked string"),
        spark.createDataFrame([("alpha", "TO", "beta")], "src string, rel string, dst string"),
    )
    kept = generate(kg, _answer, skip_validation=True, generate_reverse=True)
    assert kept.where(F.col("source_type") == REVERSE).count() == 1
    judged = generate(kg, _answer, _judge, generate_reverse=True)
    assert judged.where(F.col("source_type") == REVERSE).count() == 0


def test_stream(spark, sf, tmp_path):
    from tessera.operators.graph import KnowledgeGraph, merge_nodes
    from tessera.streaming.upsert import upsert_stream

    source = str(tmp_path / "in")
    spark.createDataFrame([("a",), ("b",), ("a",)], "name string").write.parquet(source)
    grow = lambda kg, rows: KnowledgeGraph(merge_nodes(kg.terms, rows.distinct()), kg.edges)
    q = upsert_stream(spark.readStream.schema("name string").parquet(source), str(tmp_path / "out"), str(tmp_path / "cp"), grow)
    q.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    assert spark.read.parquet(f"{tmp_path}/out/{last}/terms").count() == 2


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(catalogue_names()) <= set(e.queries())


def catalogue_names():
    from tessera import catalogue

    return catalogue.queries()


class _Counting:
    """A model whose calls are counted over all tasks, by lines of a file."""

    def __init__(self, path, reply):
        self.path, self.reply = path, reply

    def __call__(self, df):
        path, reply, at = self.path, self.reply, df.columns.index("prompt")
        from pyspark.sql import types as T

        def run(batches):
            import os

            import pyarrow as pa

            for b in batches:
                prompts = b.column(at).to_pylist()
                fd = os.open(path, os.O_APPEND | os.O_CREAT | os.O_WRONLY)
                os.write(fd, "".join(repr(p) + "\n" for p in prompts).encode())
                os.close(fd)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([reply(p) for p in prompts], pa.string())], names=[*b.schema.names, "response"])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("response", T.StringType())]))

    def calls(self):
        with open(self.path) as f:
            return f.read().splitlines()


_FACTS = 'List the facts of this text as JSON: {"triplets": [{"head": "", "relation": "", "tail": ""}]}. Text: '


def _reply(prompt):
    if prompt.startswith("List the facts"):
        text = prompt.split("Text: ", 1)[1]
        if text.startswith("Silent") and "whole" not in text:
            return "nothing"
        words = text.split()
        return f'{{"triplets": [{{"head": "{words[0]}", "relation": "{words[1]}", "tail": "{words[-1]}"}}, {{"head": null}}]}}'
    if prompt.startswith("Describe"):
        return "" if "'blank'" in prompt else "Same words." if "'twin" in prompt else f"About {prompt.split(chr(39))[1]} here."
    if prompt.startswith("Is the page"):
        return "yes"
    if prompt.startswith("Does the text say"):
        return "Yes." if "'bays'" in prompt else "no"
    if prompt.startswith("Which passage"):
        return "1"
    if prompt.startswith("Write one question"):
        return "Question: What follows from this path here?\nAnswer: that" if "four options" not in prompt else "Question: What leads there, please?\nA) a\nB) b\nC) c\nD) d\nCorrect Answer: A"
    if prompt.startswith("Judge"):
        return "Grammar Fluency: yes\nAnswerable From Source: YES\nEthics Privacy Safe: YES"
    return "bridges span bays. twin1 holds twin2. blank is blank."


def _pages(spark):
    return spark.createDataFrame(
        [("Bays", "ok", "Water by land.", []), ("Bridges", "ok", "They span.", [])],
        "title string, status string, summary string, sections array<struct<title:string,text:string>>",
    )


@pytest.mark.parametrize("profile", ["CHAT", "SEQ2SEQ"])
def test_each_prompt_is_asked_once(spark, tmp_path, profile):
    from tessera import schema
    from tessera.operators.graph import KnowledgeGraph
    from tessera.plans.agents import checker, describer, extractor
    from tessera.plans.session import Session
    from tessera.sources.external import PageSource

    p = getattr(schema, profile)

    def reply(x):
        said = x.removeprefix(_FACTS).split()
        threes = [said[k : k + 3] for k in range(0, len(said) - 2, 3)]
        if x.startswith(_FACTS):
            return '{"triplets": [' + ", ".join(f'{{"head": "{h}", "relation": "{r}", "tail": "{t}"}}' for h, r, t in threes) + "]}"
        if profile == "SEQ2SEQ" and (x in ("bridges span bays", "twin1 holds twin2", "blank is blank") or x.startswith("About ")):
            return "".join(f"<triplet> {h} <subj> {t} <obj> {r} " for h, r, t in threes)
        return _reply(x)

    model = _Counting(str(tmp_path / "calls"), reply)
    kg = KnowledgeGraph(spark.createDataFrame([], schema.TERMS), spark.createDataFrame([], schema.EDGES))
    s = Session(kg, p, model, extractor(model, p), describer(PageSource(_pages(spark)), model), model, checker(model), topic="bay", max_depth=2)
    answered = s.ask(spark.createDataFrame([(1, "what are bridges"), (2, "and what else")], "ord long, prompt string"))
    assert answered.count() == 2 and s.graph.terms.count() > 3 and s.graph.edges.count() > 0
    assert s.generate_qa(generate_reverse=True, validation_sample_rate=0.5).count() > 0
    calls = model.calls()
    # two seeds with equal answers ask for the same facts, once each; no other prompt comes twice
    assert [x for x in sorted(set(calls)) if calls.count(x) > (2 if "bridges span bays" in x or "twin1 holds twin2" in x or "blank is blank" in x else 1)] == []
    assert sum(x == "'what are bridges'" for x in calls) == 1
    rels = {r["rel"] for r in s.graph.edges.collect()}
    assert "SPAN" in rels and ("HOLDS" in rels) == (p is schema.CHAT)  # the second agent's check rejects the other triplet


def test_extractor_asks_again_and_describer_shares_no_text(spark, tmp_path):
    from tessera.operators.grow import expand
    from tessera.operators.graph import KnowledgeGraph
    from tessera.plans.agents import describer, extractor
    from tessera.schema import CHAT, EDGES, NOT_AVAILABLE, TERMS
    from tessera.sources.external import PageSource

    model = _Counting(str(tmp_path / "calls"), _reply)
    texts = spark.createDataFrame([("a", "Silent one. Two. Three. Four and the whole."), ("b", "One is two. x. y. Four is five."), ("c", "")], "key string, text string")
    got = {(r["key"], r["pos"], r["head"], r["relation"], r["tail"]) for r in extractor(model, CHAT)(texts).collect()}
    assert got == {("a", 1_000_000, "four", "and", "whole"), ("b", 0, "one", "is", "y"), ("b", 1_000_000, "four", "is", "five")}
    only = spark.createDataFrame([("z", "Silent one. Two.")], "key string, text string")
    assert extractor(model, CHAT)(only).count() == 0 and sum("Silent one. Two." in x for x in model.calls()) == 1
    describe = describer(PageSource(_pages(spark)), model)
    rows = {r["name"]: r for r in describe(spark.createDataFrame([("bays", None, "s"), ("blank", "p", "s"), ("twin1", None, None)], "name string, parent string, source string")).collect()}
    assert rows["bays"]["grounded"] and not rows["twin1"]["grounded"] and rows["blank"]["description"] == NOT_AVAILABLE
    level = spark.createDataFrame([("k", 0, "twin3", "twin1", "r", "twin2", "the text")], "key string, pos int, parent string, head string, relation string, tail string, source string")
    kg = expand(KnowledgeGraph(spark.createDataFrame([], TERMS), spark.createDataFrame([], EDGES)), level, extractor(model, CHAT), describe, CHAT, 1)
    # an identical description stays with its first term
    assert {r["name"]: r["description"] for r in kg.terms.collect()} == {"twin1": "Same words.", "twin2": None}
    assert any("Context: the text" in x and "twin2" in x for x in model.calls())


def test_pdf_previews_are_shown_only_where_needed(spark, tmp_path):
    from tessera.sources.external import PdfSource

    model = _Counting(str(tmp_path / "calls"), _reply)
    pdf = PdfSource(spark.createDataFrame([("The gate is red.\n\n" + "x" * 990 + "\n\nThe bay is blue.",)], "text string"))
    got = {r["term"]: r["summary"] for r in pdf.lookup(spark.createDataFrame([("gate", ""), ("moon", "")], "term string, hint string"), model=model).collect()}
    assert got["gate"].startswith("The gate") and got["moon"].startswith("x" * 50)
    calls = model.calls()
    assert len(calls) == 1 and "moon" in calls[0] and "[0] The gate" in calls[0]


def test_title_check_shows_the_hint(spark, tmp_path):
    from tessera.sources.external import PageSource

    model = _Counting(str(tmp_path / "calls"), _reply)
    PageSource(_pages(spark)).lookup(spark.createDataFrame([("bays", "harbours")], "term string, hint string"), model=model).count()
    assert len(model.calls()) == 1 and "harbours" in model.calls()[0]


def test_retries_and_errors(spark):
    class Flaky(_Client):
        def invoke(self, system, human):
            self.calls += 1
            if self.calls < 3:
                raise ValueError("busy")
            return human

    assert Calls(pause=0)(Flaky(), "", "x") is None
    assert Calls(pause=0, any_error=True)(Flaky(), "", "x") == "x"
    df = spark.createDataFrame([("bad",), ("hi",)], "prompt string").coalesce(1)
    rows = {r["prompt"]: (r["response"], r["why"]) for r in with_response(df, _Client, "", "prompt", Calls(pause=0), error="why").collect()}
    assert rows["hi"] == ("HI", None) and rows["bad"][0] is None and rows["bad"][1].startswith("ValueError")


def test_reads_with_parameters(spark):
    kg = g.KnowledgeGraph(spark.createDataFrame([("a", "d", "Yes")], "name string, description string, fact_checked string"), spark.createDataFrame([("a", "R", "b"), ("b", "R", "c")], "src string, rel string, dst string"))
    assert [tuple(r) for r in kg.sql("SELECT dst FROM {edges} JOIN {terms} ON src = name WHERE src = :term", {"term": "a"}).collect()] == [("b",)]
