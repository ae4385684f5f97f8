"""Queries over the test tables: each applies one operator to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import chunks as ch
from tessera.functions import qa, triples
from tessera.functions import text as tx
from tessera.lineage import cut
from tessera.operators import graph as g
from tessera.operators import grow, validate
from tessera.operators import knowledge as kb
from tessera.operators.paths import find_paths, with_details
from tessera.plans import qa as plan
from tessera.schema import CHAT, FAILED, NOT_AVAILABLE, PATH_LIMIT, SEQ2SEQ
from tessera.sources.adapters import (
    document_terms,
    page_rows,
    positional_triplets,
    seeds,
    sentence_rows,
    star_graph,
    table,
    text_edges,
    text_triplets,
)

_str = lambda c: F.col(c).cast("string")


def _flat_paths(df: DataFrame) -> DataFrame:
    return df.select(F.array_join("nodes", " > ").alias("nodes"), F.array_join("rels", " > ").alias("rels"), F.col("complexity").cast("long").alias("complexity"))


# graph


def kg_all_triples(s: SparkSession, d: str) -> DataFrame:
    return star_graph(s, d).all_triples()


def kg_all_nodes(s, d):
    return star_graph(s, d).all_nodes()


def _terms(s, d):
    return document_terms(s, d).select("name", "description", "fact_checked")


def kg_merge_nodes(s, d):
    labelled = document_terms(s, d).where("fact_checked is not null").select("name", "description", "fact_checked")
    names = document_terms(s, d).select("name").union(table(s, d, "conversations").select(F.concat(F.lit("conv "), _str("conv_id"))))
    return g.merge_nodes(labelled, names)


def kg_seed_nodes(s, d):
    rows = seeds(s, d).select("ord", F.col("prompt").alias("term"), F.col("response").alias("description"))
    return g.seed_terms(rows, CHAT)


def kg_seed_nodes_seq2seq(s, d):
    rows = seeds(s, d).select("ord", F.col("prompt").alias("term"), F.col("response").alias("description"))
    return g.seed_terms(rows, SEQ2SEQ)


def kg_merge_descriptions(s, d):
    found = table(s, d, "labels").select(
        F.concat(F.lit("doc "), _str("doc_id")).alias("name"),
        F.when(F.col("doc_id") % 5 == 0, NOT_AVAILABLE).otherwise(F.concat(F.lit("it's\nsummary "), _str("doc_id"))).alias("description"),
        (F.col("toxic") == 0).alias("grounded"),
    )
    return g.merge_terms(_terms(s, d), g.description_rows(found))


def kg_build_edges(s, d):
    said = text_triplets(s, d).select(
        F.concat(F.lit("lang_"), "lang").alias("parent"),
        "head",
        F.when(F.col("pos") % 7 == 0, "").otherwise(F.replace("relation", F.lit("ß"), F.lit("ss"))).alias("relation"),
        F.when(F.col("pos") % 11 == 0, "").otherwise(F.col("tail")).alias("tail"),
    )
    names = said.select(F.col("head").alias("name")).union(said.select(F.replace("parent", F.lit("_"), F.lit(" ")))).distinct()
    return g.build_edges(said, names, CHAT)


def kg_point_lookup(s, d):
    names = table(s, d, "lineitem").select(F.concat(F.lit("part "), _str("l_partkey")).alias("name")).union(
        table(s, d, "events").select(F.concat(F.lit("customer "), _str("user_id")))
    ).distinct()
    return star_graph(s, d).describe(names)


def kg_related_terms(s, d):
    return star_graph(s, d).related("PART 1")


def kg_prune(s, d):
    return g.KnowledgeGraph(_terms(s, d), None).prune().terms


def kg_prune_count(s, d):
    return g.KnowledgeGraph(_terms(s, d), None).prune_counts()


def kg_description_dedup(s, d):
    rows = document_terms(s, d).select("doc_id", tx.description_clean(F.col("description")).alias("description"))
    return g.first_of_description(rows, "doc_id").select("doc_id", F.col("description").isNotNull().alias("kept"))


def kg_grounding_stats(s, d):
    found = table(s, d, "labels").select(
        F.when(F.col("doc_id") % 9 == 0, FAILED).otherwise(F.concat(F.lit("d"), _str("doc_id"))).alias("description"), (F.col("quality") == 1).alias("grounded")
    )
    return grow.grounding_stats(found)


# paths


def paths_exact1(s, d):
    return _flat_paths(find_paths(text_edges(s, d, 2), exact_length=1))


def paths_exact2(s, d):
    return _flat_paths(find_paths(text_edges(s, d, 2), exact_length=2))


def paths_exact3(s, d):
    return _flat_paths(find_paths(text_edges(s, d, 2), exact_length=3))


def paths_max2(s, d):
    return _flat_paths(find_paths(text_edges(s, d, 2), 2))


def paths_max3(s, d):
    return _flat_paths(find_paths(text_edges(s, d, 3), 3))


def paths_limited(s, d):
    return _flat_paths(find_paths(text_edges(s, d, 2), 2, limit=PATH_LIMIT))


def paths_star_max2(s, d):
    return _flat_paths(find_paths(star_graph(s, d).edges, 2))


def _detailed(s, d):
    kg = star_graph(s, d)
    return with_details(find_paths(kg.edges.where("rel in ('BASED_IN', 'LOCATED_IN', 'PART_OF')"), exact_length=2), kg.terms)


def paths_with_details(s, d):
    return _detailed(s, d).select(
        F.array_join(F.transform("nodes", lambda n: F.concat_ws("/", n["name"], F.coalesce(n["description"], F.lit("-")), F.coalesce(n["fact_checked"], F.lit("-")))), " > ").alias("nodes"),
        F.array_join("rels", " > ").alias("rels"),
    )


# text and triplets


def text_sentences(s, d):
    return sentence_rows(table(s, d, "documents"), F.col("text"), "doc_id").withColumn("pos", F.col("pos").cast("long"))


def text_sentence_batches(s, d):
    batches = tx.sentence_batches(tx.sentences(F.col("text")), 3)
    return table(s, d, "documents").select("doc_id", F.posexplode(batches).alias("pos", "batch")).withColumn("pos", F.col("pos").cast("long"))


def text_normalisers(s, d):
    raw = F.concat(F.lit(" \t"), F.col("p_type"), F.lit("_X\n"), _str("p_size"), F.lit("  "))
    rel = F.concat(_str("p_size"), F.lit("st "), F.col("p_brand"))
    return table(s, d, "part").select(
        "p_partkey",
        tx.term_clean(raw).alias("s1"), tx.term_key(raw).alias("s2"), tx.relation_key(rel).alias("s3"), tx.edge_type(rel).alias("s4"),
        tx.node_name(raw, True).alias("s5"), tx.node_name(raw, False).alias("s6"), tx.endpoint_name(raw, True).alias("s7a"), tx.endpoint_name(raw, False).alias("s7b"),
        tx.description_clean(F.concat(F.lit("it's\n"), F.col("p_name"))).alias("s8"), tx.prompt_clean(raw).alias("s9"), tx.seed_term(raw).alias("s10"),
    )


def triplet_clean(s, d):
    return triples.clean(text_triplets(s, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "head", "relation", "tail")


def triplet_dedup_undirected(s, d):
    kept = triples.dedup_undirected(triples.clean(text_triplets(s, d)), ["doc_id"], ["pos"])
    return kept.select("doc_id", F.col("pos").cast("long").alias("pos"), "head", "relation", "tail")


def triplet_grounded_in_sentence(s, d):
    rows = text_triplets(s, d).withColumn("tail", F.when(F.col("pos") % 3 == 0, F.concat("tail", F.lit("q"))).otherwise(F.col("tail")))
    ok = rows.where(triples.grounded(F.col("sentence"), F.col("head"), F.col("tail")))
    return ok.groupBy("doc_id").agg(F.count("*").alias("n"))


def triplet_model_validate(s, d):
    said = F.when(F.col("pos") % 3 == 0, "Yes, it does").when(F.col("pos") % 3 == 1, "no")
    ok = F.coalesce(F.startswith(F.lower(tx.strip(said)), F.lit("yes")), F.lit(False))
    return text_triplets(s, d).where(ok & (F.col("head") != "") & (F.col("tail") != "")).groupBy("doc_id").agg(F.count("*").alias("n"))


def _responses(s, d) -> DataFrame:
    """A model's response for each sentence: well formed, with gaps, as quoted pairs or without braces."""
    q = lambda k, v: F.concat(F.lit(f'"{k}": "'), v, F.lit('"'))
    h, r, t = F.col("head"), F.col("relation"), F.col("tail")
    whole = F.concat(F.lit("{"), q("head", h), F.lit(", "), q("relation", r), F.lit(", "), q("tail", t), F.lit("}"))
    gap = lambda x: F.concat(F.lit("{"), q("head", h), F.lit(", "), q("relation", r), F.lit(x), F.lit("}"))
    wrap = lambda *xs: F.concat(F.lit('Here: {"triplets": ['), *[y for i, x in enumerate(xs) for y in ((F.lit(", "), x) if i else (x,))], F.lit("]} done"))
    k = (F.col("doc_id") + F.col("pos")) % 6
    response = (
        F.when(k == 0, wrap(whole, whole)).when(k == 1, wrap(gap(', "tail": null'), whole)).when(k == 2, wrap(gap(""), gap(', "tail": 5')))
        .when(k == 3, F.concat(F.lit("'head': '"), h, F.lit("', 'relation' : '"), r, F.lit("','tail':'"), t, F.lit("'")))
        .when(k == 4, F.concat(F.lit('{"triplets": ['), whole, F.lit("}"))).otherwise("no triplet")
    )
    return text_triplets(s, d).select("doc_id", F.col("pos").cast("long").alias("pos"), tx.once(response).alias("response"))


def _exploded(df: DataFrame, found: Column) -> DataFrame:
    return df.select("doc_id", "pos", F.posexplode(found).alias("ord", "t")).select("doc_id", "pos", F.col("ord").cast("long").alias("ord"), "t.head", "t.relation", "t.tail")


def triplet_well_formed(s, d):
    return _exploded(_responses(s, d), triples.json_triplets(F.col("response")))


def triplet_malformed_counts(s, d):
    counts = _responses(s, d).select("doc_id", "pos", tx.once(triples.json_counts(F.col("response"))).alias("c")).where("c is not null")
    return counts.select("doc_id", "pos", F.col("c.usable").cast("long").alias("usable"), F.col("c.malformed").cast("long").alias("malformed"))


def triplet_regex_fallback(s, d):
    return _exploded(_responses(s, d), triples.regex_triplets(F.col("response")))


def triplet_json_parse(s, d):
    return _exploded(_responses(s, d), triples.response_triplets(F.col("response")))


def triplet_marker_parse(s, d):
    said = text_triplets(s, d)
    response = F.concat(
        F.lit("<s><triplet> "), "head", F.lit(" <subj>  "), "tail", F.lit(" <obj> "), "relation", F.lit(" <subj> "), "relation", F.lit(" <obj> "),
        F.when((F.col("doc_id") + F.col("pos")) % 4 == 0, "").otherwise("part\nof"), F.lit(" <triplet> "), "tail", F.lit(" <subj> "), "head", F.lit(" <obj> in</s>"),
    )
    return _exploded(said.select("doc_id", F.col("pos").cast("long").alias("pos"), response.alias("response")), triples.marker_triplets(F.col("response")))


# external knowledge


def _pages(s, d):
    return page_rows(s, d)


def kb_candidates(s, d):
    pages = _pages(s, d)
    found = kb.search(pages.select(F.lower("title").alias("term")), pages, 5)
    return found.select("term", F.col("ord").cast("long").alias("ord"), "title", F.col("score").cast("long").alias("score"))


def kb_body_sections(s, d):
    return _pages(s, d).select("page_id", F.explode(ch.body_sections(F.col("sections"))).alias("s")).select("page_id", "s.title", "s.text")


def kb_body_text(s, d):
    return _pages(s, d).select("page_id", ch.body_text(F.col("summary"), F.col("sections")).alias("body"))


def kb_opening_window(s, d):
    return table(s, d, "documents").select("doc_id", ch.opening(F.col("text")).alias("opening"))


def chunk_fixed_window(s, d):
    windows = ch.fixed_windows(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.posexplode(windows).alias("pos", "chunk")).withColumn("pos", F.col("pos").cast("long"))


def chunk_documents(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(ch.chunks(F.col("text"))).alias("pos", "chunk"))


def _topic() -> Column:
    """A phrase that some documents hold: the last characters, or none."""
    return F.when(F.col("doc_id") % 3 == 0, F.upper(F.substring("text", -12, 8))).when(F.col("doc_id") % 3 == 1, F.substring("text", 3, 9))


def kb_select_chunks(s, d):
    parts = ch.fixed_windows(F.col("text"))
    picked = table(s, d, "documents").select("doc_id", ch.select_chunks(parts, _topic(), F.when(F.col("doc_id") % 2 == 0, ch.opening(F.col("text"))), 600).alias("c"))
    return picked.select("doc_id", F.size("c").cast("long").alias("n"), F.array_join("c", "|").alias("chunks"))


def kb_section_chunks(s, d):
    firsts = ch.first_chunks(F.transform(ch.body_sections(F.col("sections")), lambda x: x["text"]))
    return _pages(s, d).select("page_id", F.array_join(ch.section_chunks(F.col("summary"), firsts), "|").alias("chunks"))


def _checked(s, d):
    k = F.col("page_id")
    return table(s, d, "pages").select(
        F.concat(F.lit("t"), (k % 50).cast("string")).alias("term"),
        F.floor(k / 50).cast("long").alias("ord"),
        F.col("url").alias("title"),
        F.when(k % 7 == 0, "disambiguation").when(k % 5 == 0, "missing").otherwise("ok").alias("status"),
        F.when(k % 3 == 0, " YES ").when(k % 3 == 1, "yes!").otherwise(None).alias("response"),
    )


def kb_title_relevance(s, d):
    return kb.relevant(_checked(s, d), F.col("response")).select("term", "ord", "title")


def kb_ambiguity(s, d):
    return kb.resolve(_checked(s, d))


def kb_ambiguous_terms(s, d):
    return kb.ambiguous(_checked(s, d))


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _scored(s, d):
    v = table(s, d, "embeddings")
    firsts = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    return v.join(firsts, "label").select(
        F.concat(F.lit("l"), _str("label")).alias("term"), F.col("vec_id").alias("ord"), F.concat(F.lit("v"), _str("vec_id")).alias("title"),
        F.round(_cosine(F.col("embedding"), F.col("anchor")), 6).alias("score"),
    )


def kb_entity_band(s, d):
    return kb.entity_band(_scored(s, d))


def kb_ranked_lookup(s, d):
    scored = kb.entity_band(_scored(s, d))
    return kb.best_topic(scored.withColumn("topic_score", F.round(F.col("score"), 1)).drop("score")).select("term", "ord", "title", "topic_score")


def _looked_up(s, d):
    pages = _pages(s, d)
    titles = pages.groupBy("title").agg(F.min("page_id").alias("page_id"))
    found = kb.search(pages.select(F.lower("title").alias("term")), pages, 5).join(titles, "title")
    k = F.col("page_id")
    # at most five rows a term, which three joins use: searched for once
    checked = cut(found.select("term", F.col("ord").cast("long").alias("ord"), "title", F.when(k % 7 == 0, "disambiguation").when(k % 5 == 0, "missing").otherwise("ok").alias("status"), F.when(k % 4 == 0, "no").otherwise("yes").alias("response")))
    kept = kb.relevant(checked, F.col("response"))
    picked = tx.let(ch.body_text(F.col("summary"), F.col("sections")), lambda body: ch.select_chunks(ch.fixed_windows(body), F.lit("the"), ch.opening(body, 300), 300))
    # pages are shuffled as their few chunks, and these, as a generator's output, are not made again by the filter on them
    parts = pages.select("page_id", "title", F.explode(F.array(picked)).alias("chunks")).join(titles, ["title", "page_id"], "left_semi").drop("page_id")
    chosen = kb.first_success(kb.resolve(kept).join(parts, "title").where(F.size("chunks") > 0))
    return (
        pages.select(F.lower("title").alias("term")).distinct().join(kb.ambiguous(kept), "term", "left").join(chosen, "term", "left")
        .select("term", "title", "chunks", F.coalesce("is_ambiguous", F.lit(False)).alias("is_ambiguous"))
    )


def kb_lookup_chunks(s, d):
    return _looked_up(s, d).select("term", "title", F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n"), "is_ambiguous")


def kb_lookup_summary(s, d):
    return _looked_up(s, d).select("term", kb.summary(F.col("chunks")).alias("summary"), "is_ambiguous")


def kb_pdf_like_lookup(s, d):
    k = F.col("doc_id")
    said = F.when(k % 5 == 0, " None ").when(k % 5 == 1, "1").when(k % 5 == 2, "99").when(k % 5 == 3, "the first")
    return table(s, d, "documents").select("doc_id", ch.pdf_passage(ch.fixed_windows(F.col("text")), F.coalesce(_topic(), F.lit("zqzq")), said, 200).alias("passage"))


# growth


def describe_pending_terms(s, d):
    known = text_triplets(s, d).where("doc_id % 2 = 0").select(F.col("head").alias("name"), F.when(F.col("pos") % 2 == 0, F.col("sentence")).alias("description"))
    return grow.pending(text_triplets(s, d), known)


def describe_prompts(s, d):
    rows = document_terms(s, d).join(table(s, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    grounded = F.when(F.col("fact_checked") == "Yes", F.substring("description", 1, 80))
    return rows.select("doc_id", grow.describe_prompt(F.col("name"), grounded, F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("source")).alias("prompt"))


def describe_results(s, d):
    said = F.when(F.col("doc_id") % 4 == 0, "  ").when(F.col("doc_id") % 4 == 1, None).otherwise(F.concat(F.lit(" about "), "name", F.lit("\n")))
    out = document_terms(s, d).select("doc_id", grow.described(said, F.when(F.col("fact_checked") == "Yes", F.col("name"))).alias("r"))
    return out.select("doc_id", "r.description", "r.grounded")


def expand_gate(s, d):
    names = table(s, d, "documents").select(F.concat(F.lit("doc "), _str("doc_id")).alias("name"))
    return grow.gate(names, _terms(s, d))


def expand_frontier(s, d):
    terms = document_terms(s, d).withColumn("description", F.when(F.col("doc_id") % 6 == 0, FAILED).when(F.col("doc_id") % 6 == 1, None).otherwise(F.col("description")))
    return grow.gate(terms.where(grow.usable(F.col("description"))), terms).select("name")


def expand_branch_cap(s, d):
    said = triples.clean(text_triplets(s, d)).withColumn("key", _str("doc_id"))
    return grow.branches(said, SEQ2SEQ.branch_cap).select("doc_id", F.col("pos").cast("long").alias("pos"), "head", "relation", "tail")


def _extract(texts: DataFrame) -> DataFrame:
    said = positional_triplets(sentence_rows(texts, F.col("text"), "key")).drop("sentence")
    return triples.dedup_undirected(triples.clean(said), ["key"], ["pos"])


def _describe(terms: DataFrame) -> DataFrame:
    """Stand-in descriptions: sentences about the term; those of terms without an ``s`` are grounded."""
    about = F.concat("name", F.lit(" is part of "), F.coalesce("parent", F.lit("all")), F.lit(". "), "name", F.lit(" has x"), "name", F.lit("."))
    return terms.select("name", about.alias("description"), (~F.contains("name", F.lit("s"))).alias("grounded"))


def _grown(s, d, profile, depth):
    empty = s.createDataFrame([], "name string, description string, fact_checked string"), s.createDataFrame([], "src string, rel string, dst string")
    return grow.from_seeds(g.KnowledgeGraph(*empty), seeds(s, d), _extract, _describe, profile, depth)


def expand_depth1(s, d):
    return _grown(s, d, CHAT, 1).terms


def expand_depth2(s, d):
    return _grown(s, d, CHAT, 2).terms


def kg_from_conversations(s, d):
    return _grown(s, d, SEQ2SEQ, 2).edges


def seed_responses(s, d):
    rows = seeds(s, d).withColumn("response", F.when(F.col("ord") % 3 == 0, None).otherwise(F.col("response")))
    return rows.select("ord", tx.prompt_clean(F.col("prompt")).alias("prompt"), F.coalesce("response", F.lit(FAILED)).alias("response"))


# questions and answers


def _prompted(s, d, f):
    paths = _detailed(s, d)
    names = F.transform("nodes", lambda n: n["name"])
    return paths.select(F.array_join(names, " > ").alias("path"), f(F.col("nodes"), F.col("rels"), F.lit("trade")).alias("prompt"))


def qa_prompts(s, d):
    return _prompted(s, d, qa.forward_prompt)


def qa_prompts_reverse(s, d):
    return _prompted(s, d, qa.reverse_prompt)


def qa_validation_prompts(s, d):
    def f(nodes, rels, topic):
        return qa.validation_prompt(F.concat(F.lit("Where is "), F.get(nodes, F.lit(0))["name"], F.lit("?")), F.get(nodes, F.lit(2))["name"], nodes, rels, topic)

    return _prompted(s, d, f)


def _qa_texts(s, d):
    k = F.col("ord")
    said = F.concat(
        F.when(k % 5 == 0, "").otherwise("question: "), F.regexp_replace("prompt", "\n", " "), F.lit("\nAnswer:  "),
        F.when(k % 7 == 0, " ").otherwise(F.substring("response", 1, 40)), F.lit("\nend"),
    )
    return seeds(s, d).select("ord", said.alias("response"))


def qa_parse_open(s, d):
    return _qa_texts(s, d).select("ord", qa.parse_open(F.col("response")).alias("p")).where("p is not null").select("ord", "p.question", "p.answer")


def _mcq(s, d):
    k = F.col("c_custkey")
    said = F.concat(
        F.lit("Question: Who is in segment "), "c_mktsegment", F.lit("?\nA) "), F.lower("c_name"), F.lit("\nB) b"), _str("c_nationkey"),
        F.lit("\nC) "), F.when(k % 6 == 0, " ").otherwise("c"), F.lit("\nd) other\ncorrect answer: "), F.when(k % 3 == 0, "b").when(k % 3 == 1, "A").otherwise("E"),
    )
    return table(s, d, "customer").select("c_custkey", "c_name", said.alias("response"))


def qa_parse_mcq(s, d):
    return _mcq(s, d).select("c_custkey", qa.parse_mcq(F.col("response")).alias("p")).where("p is not null").select("c_custkey", "p.*")


def qa_reverse_parse(s, d):
    parsed = _mcq(s, d).select("c_custkey", "c_name", qa.parse_mcq(F.col("response")).alias("p")).where("p is not null")
    right = parsed.where(F.lower(qa.keyed_option(F.col("p"))) == F.lower("c_name"))
    return right.select("c_custkey", "p.question", "p.key")


def _answer(df: DataFrame) -> DataFrame:
    """A stand-in model: answers with the path's end, multiple choice with its start."""
    names = F.transform("nodes", lambda n: n["name"])
    start, end = F.get(names, F.lit(0)), F.element_at(names, -1)
    open_ = F.concat(F.lit("Question: Where does "), start, F.lit(" lead in "), F.size("rels").cast("string"), F.lit(" steps?\nAnswer: "), end)
    mcq = F.concat(F.lit("Question: What leads to "), end, F.lit("?\nA) "), start, F.lit("\nB) x\nC) y\nD) z\nCorrect Answer: A"))
    return df.withColumn("response", F.when(F.contains("prompt", F.lit("four options")), mcq).otherwise(open_))


def _judge(df: DataFrame) -> DataFrame:
    n = F.length("answer")
    said = F.concat(F.lit("Grammar Fluency: yes\nAnswerable From Source: "), F.when(n % 2 == 0, "YES").otherwise("no"), F.lit("\nTopic Relevant: N/A\nEthics Privacy Safe: YES"))
    return df.withColumn("response", F.when(n % 5 != 0, said))


def qa_forward(s, d):
    return plan.forward(_detailed(s, d), _answer).select("id", "question", "answer", "source_type", F.col("complexity").cast("long").alias("complexity"))


def qa_reverse(s, d):
    return plan.reverse(_detailed(s, d), _answer).select("id", "question", "correct_answer_key", F.element_at("options", "A").alias("option_a"), "source_type")


def _trade(s, d):
    kg = star_graph(s, d)
    return g.KnowledgeGraph(kg.terms, kg.edges.where("rel in ('BASED_IN', 'LOCATED_IN', 'PART_OF')"))


def qa_limit(s, d):
    out = plan.generate(_trade(s, d), _answer, limit=50, skip_validation=True)
    return out.select("question", "answer", F.col("complexity").cast("long").alias("complexity"))


def qa_end_to_end(s, d):
    out = plan.generate(_trade(s, d), _answer, _judge, path_limit=None, generate_reverse=True, topic="trade")
    return out.select("question", "answer", "source_type", F.col("complexity").cast("long").alias("complexity"))


def qa_structural_filter(s, d):
    rows = seeds(s, d).select("ord", F.col("prompt").alias("question"), F.col("response").alias("answer"), F.when(F.col("ord") % 4 != 0, "x").alias("source_details"))
    return validate.structural(rows).select("ord")


def _verdicts(s, d):
    k = F.col("c_custkey")
    said = F.concat(
        F.lit("Grammar Fluency: YES\ngrammar_fluency : "), F.when(k % 4 == 0, "no").otherwise("yes"), F.lit("\nAnswerable From Source: YES: sure\nanswerable from source: yes"),
        F.when(k % 3 == 0, "\nTopic Relevant: NO").when(k % 3 == 1, "\nTopic Relevant: N/A").otherwise(""), F.lit("\nEthics Privacy Safe: "), F.when(k % 7 == 0, "NO").otherwise("Yes"),
    )
    return table(s, d, "customer").select("c_custkey", F.when(k % 11 == 0, None).when(k % 11 == 1, "").otherwise(said).alias("response"))


def qa_parse_verdict(s, d):
    return _verdicts(s, d).select("c_custkey", qa.parse_verdict(F.col("response")).alias("v")).select("c_custkey", "v.*")


def qa_validate(s, d):
    return _verdicts(s, d).where(validate.accepted(F.col("response"))).select("c_custkey")


def qa_sample_validation(s, d):
    return validate.sample(table(s, d, "customer").select(F.col("c_custkey").alias("id")), 0.15).select("id", "sampled")


def qa_acceptance_stats(s, d):
    rows = seeds(s, d).select(F.length("prompt").between(10, 200).alias("sound"), (F.col("ord") % 3 != 0).alias("accepted"))
    return validate.stats(rows)
