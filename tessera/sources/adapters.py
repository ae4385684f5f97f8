"""Tables of the test schema as graphs, texts, pages and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import once, sentences
from tessera.lineage import cut
from tessera.operators.graph import KnowledgeGraph, supported_edges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flag(yes: Column, no: Column) -> Column:
    return F.when(yes, "Yes").when(no, "No")


def star_graph(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    """Customers, suppliers, nations, regions, orders and parts as typed terms and edges."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c).cast("string"))
    nation, region = t("nation"), t("region")
    by_nation = nation.select("n_nationkey", F.lower("n_name").alias("dst"))
    edge = lambda df, src, rel, dst: df.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))
    edges = [
        edge(t("customer").join(by_nation, F.col("c_nationkey") == F.col("n_nationkey")), key("customer", "c_custkey"), "LOCATED_IN", F.col("dst")),
        edge(t("supplier").join(by_nation, F.col("s_nationkey") == F.col("n_nationkey")), key("supplier", "s_suppkey"), "BASED_IN", F.col("dst")),
        edge(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), F.lower("n_name"), "PART_OF", F.lower("r_name")),
        edge(t("orders"), key("order", "o_orderkey"), "PLACED_BY", key("customer", "o_custkey")),
        edge(t("lineitem").select("l_partkey", "l_suppkey").distinct(), key("part", "l_partkey"), "SUPPLIED_BY", key("supplier", "l_suppkey")),
    ]
    none = F.lit(None).cast("string")
    term = lambda df, name, text, flag: df.select(name.alias("name"), text.alias("description"), flag.alias("fact_checked"))
    terms = [
        term(region, F.lower("r_name"), none, none),
        term(nation, F.lower("n_name"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")), F.lit("Yes")),
        term(t("customer"), key("customer", "c_custkey"), F.col("c_mktsegment"), _flag(F.col("c_acctbal") > 5000, F.col("c_acctbal") > 0)),
        term(t("supplier"), key("supplier", "s_suppkey"), F.col("s_name"), _flag(F.col("s_acctbal") > 5000, F.col("s_acctbal") > 0)),
        term(t("orders"), key("order", "o_orderkey"), F.col("o_orderpriority"), _flag(F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")),
        term(t("part"), key("part", "p_partkey"), F.col("p_type"), _flag(F.col("p_size") > 30, F.col("p_size") > 10)),
    ]
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return KnowledgeGraph(union(terms), union(edges))


def sentence_rows(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """``keep`` columns with ``pos`` and ``sentence``."""
    return docs.select(*keep, F.posexplode(sentences(text)).alias("pos", "sentence"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def positional_triplets(rows: DataFrame) -> DataFrame:
    """First word, second word and last word of each sentence of three words or more.

    A deterministic stand-in for an extraction model.
    """
    kept = [c for c in rows.columns if c != "sentence"]
    return (
        rows.select(*kept, "sentence", once(words(F.col("sentence"))).alias("w"))
        .where(F.size("w") >= 3)
        .select(*kept, "sentence", F.get("w", F.lit(0)).alias("head"), F.get("w", F.lit(1)).alias("relation"), F.element_at("w", -1).alias("tail"))
    )


def text_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, pos, sentence, head, relation, tail)`` of all documents."""
    return positional_triplets(sentence_rows(table(spark, sf_dir, "documents"), F.col("text"), "doc_id", "lang"))


def text_edges(spark: SparkSession, sf_dir: str, support: int) -> DataFrame:
    """Edges that ``support`` sentences or more state, read from the texts once: few beside them, and path searches use them again and again."""
    return cut(supported_edges(text_triplets(spark, sf_dir), support))


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, name, description, fact_checked)``: flags from the quality labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    return docs.select(
        "doc_id",
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"),
        F.col("text").alias("description"),
        _flag(F.col("quality") == 1, F.col("quality") == 0).alias("fact_checked"),
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ord, prompt, response)``: user turns with the assistant's next turn.

    An equi-join on the next turn's number, so that a very long conversation isn't sorted in one task.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return asked.join(said, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "prompt", "response")


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, title, summary, sections)`` of the web pages: paragraphs as sections, some titled as appendices."""
    html = F.col("html")
    paragraphs = F.regexp_extract_all(html, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    sections = F.transform(
        paragraphs,
        lambda p, i: F.struct(
            F.when(i % 4 == 1, "References").when(i % 4 == 2, " See also ").otherwise(F.concat(F.lit("Section "), i.cast("string"))).alias("title"),
            p.alias("text"),
        ),
    )
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(html, r"(?s)<h1>(.*?)</h1>", 1).alias("summary"),
        sections.alias("sections"),
    )
