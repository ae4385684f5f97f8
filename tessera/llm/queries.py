"""The ``opN_<name>`` queries: operators applied to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, embeddings, langid, licences, mixing, pii, secrets, simhash, suffix, tokens
from tessera.llm.common import ship, table

TOKENIZER = "byte_bpe_50k.json"
#: The key of a production run comes from its secret store; this one serves the synthetic tables.
PII_KEY = "synthetic-tables"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), PII_KEY).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [
        op1_simhash_dedup,
        op2_license_scan,
        op3_decontaminate,
        op4_embedding_dedup,
        op5_secret_scan,
        op6_token_counts,
        op7_language_id,
        op8_source_mix,
        op9_suffix_dedup,
        op10_pii_surrogates,
    ]
    named = {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}
    return {name: _shipped(f) for name, f in named.items()}


def _licence_sql() -> str:
    def value(kind: str, licence: str, k: int, t: str) -> str:
        bs = licences.bigrams(t)
        listed = lambda xs: f"[{', '.join(repr(x) for x in xs)}]"
        return f"('{kind}', '{licence}', {k}, {listed(bs)}, {listed(sorted(set(licences.words(t))))})"

    rows = [value("short", n, k, t) for n, ts in sorted(licences.TEMPLATES.items()) for k, t in enumerate(ts)]
    rows += [value("whole", n, len(licences.TEMPLATES.get(n, ())), t) for n, t in sorted(licences.TEXTS.items())]
    norm = "string_split(trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"""
    WITH t(kind, licence, template, tb, tw) AS (VALUES {', '.join(rows)}),
    l AS (SELECT doc_id, 'line' AS unit, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS unit_no FROM documents),
    p AS (SELECT doc_id, 'paragraph' AS unit, unnest(string_split_regex(coalesce(text, ''), '\\n[ \\t]*\\n')) AS raw,
                 generate_subscripts(string_split_regex(coalesce(text, ''), '\\n[ \\t]*\\n'), 1) - 1 AS unit_no FROM documents),
    lw AS (SELECT doc_id, unit_no, list_filter({norm}, lambda x: x <> '') AS w FROM l),
    m AS (SELECT doc_id, licence, unit_no, w, len(list_filter(w, lambda x: list_contains(tw, x))) * 5 >= len(w) * 3 AS mine FROM lw, t WHERE kind = 'whole' AND len(w) > 0),
    g AS (SELECT *, count(*) FILTER (NOT mine) OVER (PARTITION BY doc_id, licence ORDER BY unit_no) AS run FROM m),
    r AS (SELECT doc_id, min(unit_no) AS unit_no, flatten(list(w ORDER BY unit_no)) AS w FROM g WHERE mine GROUP BY doc_id, licence, run),
    u AS (SELECT doc_id, 'short' AS kind, unit, unit_no, {norm} AS w FROM (SELECT * FROM l UNION ALL SELECT * FROM p WHERE contains(raw, chr(10)))
          UNION ALL SELECT doc_id, 'whole', 'passage', unit_no, w FROM r),
    b AS (SELECT doc_id, kind, unit, unit_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM u WHERE len(w) > 1),
    s AS (SELECT doc_id, unit, unit_no, licence, template, len(list_intersect(b, tb)) AS shared,
                 2.0::DOUBLE * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice
          FROM b JOIN t ON b.kind = t.kind AND len(b) BETWEEN len(tb) * 0.8 / 1.2 - 1e-9 AND len(tb) * 1.2 / 0.8 + 1e-9)
    SELECT doc_id, unit, CAST(unit_no AS BIGINT) AS unit_no, licence, CAST(template AS BIGINT) AS template,
           CAST(shared AS BIGINT) AS shared, dice
    FROM s WHERE dice >= 0.8
    QUALIFY row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, licence, template) = 1
    """


_EMBEDDING_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
    c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
    FROM embeddings LEFT JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": _licence_sql(), "op4_embedding_dedup": _EMBEDDING_SQL}
