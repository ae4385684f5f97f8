"""SQL with the same results as the queries, for tests."""

from __future__ import annotations

from tessera.schema import FAILED, NOT_AVAILABLE, PLACEHOLDER

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
strip = _STRIP.format
_SENTENCES = r"list_filter(list_transform(regexp_extract_all({0}, '[^.!?\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def flag(yes: str, no: str) -> str:
    return f"CASE WHEN {yes} THEN 'Yes' WHEN {no} THEN 'No' END"


_STAR = f"""
star_edges AS (
  SELECT 'customer ' || c_custkey AS src, 'LOCATED_IN' AS rel, lower(n_name) AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier ' || s_suppkey, 'BASED_IN', lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT lower(n_name), 'PART_OF', lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'order ' || o_orderkey, 'PLACED_BY', 'customer ' || o_custkey FROM orders
  UNION ALL SELECT DISTINCT 'part ' || l_partkey, 'SUPPLIED_BY', 'supplier ' || l_suppkey FROM lineitem),
star_terms AS (
  SELECT lower(r_name) AS name, NULL::VARCHAR AS description, NULL::VARCHAR AS fact_checked FROM region
  UNION ALL SELECT lower(n_name), 'nation ' || n_nationkey, 'Yes' FROM nation
  UNION ALL SELECT 'customer ' || c_custkey, c_mktsegment, {flag('c_acctbal > 5000', 'c_acctbal > 0')} FROM customer
  UNION ALL SELECT 'supplier ' || s_suppkey, s_name, {flag('s_acctbal > 5000', 's_acctbal > 0')} FROM supplier
  UNION ALL SELECT 'order ' || o_orderkey, o_orderpriority, {flag("o_orderstatus = 'F'", "o_orderstatus = 'O'")} FROM orders
  UNION ALL SELECT 'part ' || p_partkey, p_type, {flag('p_size > 30', 'p_size > 10')} FROM part)"""
_TRADE = """
trade AS (SELECT a.src AS n0, a.rel AS r0, a.dst AS n1, b.rel AS r1, b.dst AS n2 FROM star_edges a JOIN star_edges b ON a.dst = b.src
  WHERE a.rel IN ('BASED_IN', 'LOCATED_IN') AND b.rel = 'PART_OF')"""
_SENT = f"""
sent AS (SELECT doc_id, lang, unnest({_SENTENCES.format('text')}) AS sentence, generate_subscripts({_SENTENCES.format('text')}, 1) - 1 AS pos FROM documents),
trip AS (SELECT doc_id, lang, pos, sentence, w[1] AS head, w[2] AS relation, w[-1] AS tail FROM (SELECT *, {_WORDS.format('sentence')} AS w FROM sent) WHERE len(w) >= 3)"""
_DOCTERMS = f"""
docterms AS (SELECT d.doc_id, 'doc ' || d.doc_id AS name, text AS description, {flag('quality = 1', 'quality = 0')} AS fact_checked
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_SEEDS = """
seeds AS (SELECT conv_id * 1000 + turn AS ord, text AS prompt, response FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""
_PAGES = r"""
para AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS summary,
  regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS ps FROM pages),
sections AS (SELECT page_id, i, CASE WHEN i % 4 = 1 THEN 'References' WHEN i % 4 = 2 THEN ' See also ' ELSE 'Section ' || i END AS title, txt AS text
  FROM (SELECT page_id, unnest(ps) AS txt, generate_subscripts(ps, 1) - 1 AS i FROM para)),
bodies AS (SELECT p.page_id, p.title, p.summary, array_to_string(list_filter(list_concat([p.summary], coalesce(s.texts, [])), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''), chr(10)) AS body
  FROM para p LEFT JOIN (SELECT page_id, list(text ORDER BY i) AS texts FROM sections WHERE i % 4 NOT IN (1, 2) GROUP BY page_id) s ON p.page_id = s.page_id)"""
_WINDOWS = "list_transform(range(CAST(greatest(1, ceil((length({0}) - 100) / 900.0)) AS BIGINT)), lambda i: substring({0}, i * 900 + 1, 1000))"
_TOPIC = "CASE WHEN doc_id % 3 = 0 THEN upper(replace(substring(right(text, 12), 1, 8), 'ß', 'ss')) WHEN doc_id % 3 = 1 THEN substring(text, 3, 9) END"


def _star(query: str) -> str:
    return f"WITH {_STAR} {query}"


def _trip(query: str, *more: str) -> str:
    return f"WITH {', '.join([_SENT, *more])} {query}"


def _paths(support: int, low: int, high: int, source: str | None = None, limit: str = "") -> str:
    edges = source or f"SELECT head AS src, relation AS rel, tail AS dst FROM trip GROUP BY ALL HAVING count(*) >= {support}"
    head = _STAR if source else _SENT
    return f"""WITH RECURSIVE {head},
    e AS (SELECT *, row_number() OVER (ORDER BY src, rel, dst) AS id FROM ({edges})),
    p(ns, rs, ids, reached) AS (
      SELECT [src, dst], [rel], [id], dst FROM e
      UNION ALL SELECT list_append(ns, e.dst), list_append(rs, e.rel), list_append(ids, e.id), e.dst FROM p JOIN e ON e.src = p.reached
      WHERE len(ids) < {high} AND NOT list_contains(ids, e.id))
    SELECT array_to_string(ns, ' > ') AS nodes, array_to_string(rs, ' > ') AS rels, CAST(len(rs) AS BIGINT) AS complexity
    FROM p WHERE len(rs) >= {low} AND ns[1] <> reached {limit}"""


def _merge(old: str, new: str, extra: str = "") -> str:
    return f"""{extra} SELECT coalesce(n.name, o.name) AS name, coalesce(n.description, o.description) AS description, coalesce(n.fact_checked, o.fact_checked) AS fact_checked
    FROM ({old}) o FULL JOIN ({new}) n ON o.name = n.name"""


def _clean_description(c: str) -> str:
    return strip(f"replace(replace({c}, '''', '\\'''), chr(10), ' ')")


def _name_first(c: str) -> str:
    return f"replace(lower({strip(f'replace({c}, chr(10), chr(32))')}), '_', ' ')"


def _name_second(c: str) -> str:
    one_line = f"replace({c}, chr(10), chr(32))"
    squeezed = f"regexp_replace({one_line}, '\\s+', ' ', 'g')"
    return f"lower({strip(squeezed)})"


_RESPONSES = """
resp AS (SELECT doc_id, pos, CASE (doc_id + pos) % 6
    WHEN 0 THEN 'Here: {"triplets": [' || whole || ', ' || whole || ']} done'
    WHEN 1 THEN 'Here: {"triplets": [{"head": "' || head || '", "relation": "' || relation || '", "tail": null}, ' || whole || ']} done'
    WHEN 2 THEN 'Here: {"triplets": [{"head": "' || head || '", "relation": "' || relation || '"}, {"head": "' || head || '", "relation": "' || relation || '", "tail": 5}]} done'
    WHEN 3 THEN '''head'': ''' || head || ''', ''relation'' : ''' || relation || ''',''tail'':''' || tail || ''''
    WHEN 4 THEN '{"triplets": [' || whole || '}' ELSE 'no triplet' END AS response
  FROM (SELECT *, '{"head": "' || head || '", "relation": "' || relation || '", "tail": "' || tail || '"}' AS whole FROM trip)),
body AS (SELECT doc_id, pos, response, substring(response, strpos(response, '{'), length(response) - strpos(reverse(response), '}') + 2 - strpos(response, '{')) AS b FROM resp
  WHERE strpos(response, '{') > 0 AND strpos(response, '}') > 0),
elem AS (SELECT doc_id, pos, x, i - 1 AS i, json_type(x, '$.head') = 'VARCHAR' AND json_type(x, '$.relation') = 'VARCHAR' AND coalesce(json_type(x, '$.tail'), '') = 'VARCHAR' AS ok
  FROM (SELECT doc_id, pos, unnest(json_extract(b, '$.triplets[*]')) AS x, generate_subscripts(json_extract(b, '$.triplets[*]'), 1) AS i FROM (SELECT * FROM body WHERE json_valid(b)))),
good AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, pos ORDER BY i) - 1 AS ord, x->>'$.head' AS head, x->>'$.relation' AS relation, x->>'$.tail' AS tail FROM elem WHERE ok),
rx AS (SELECT doc_id, pos, unnest(regexp_extract_all(response, pat, 1)) AS head, unnest(regexp_extract_all(response, pat, 2)) AS relation, unnest(regexp_extract_all(response, pat, 3)) AS tail,
  generate_subscripts(regexp_extract_all(response, pat, 1), 1) - 1 AS ord
  FROM (SELECT *, '["'']head["'']\\s*:\\s*["'']([^"'']+)["'']\\s*,\\s*["'']relation["'']\\s*:\\s*["'']([^"'']+)["'']\\s*,\\s*["'']tail["'']\\s*:\\s*["'']([^"'']+)["'']' AS pat FROM resp))"""

_CHECKED = """
checked AS (SELECT 't' || (page_id % 50) AS term, CAST(page_id // 50 AS BIGINT) AS ord, url AS title,
  CASE WHEN page_id % 7 = 0 THEN 'disambiguation' WHEN page_id % 5 = 0 THEN 'missing' ELSE 'ok' END AS status, CASE page_id % 3 WHEN 0 THEN ' YES ' WHEN 1 THEN 'yes!' END AS response FROM pages)"""
_SEARCH = r"""
tw AS (SELECT term, unnest(list_distinct(regexp_extract_all(lower(term), '[\p{L}\p{N}]+'))) AS word FROM (SELECT DISTINCT lower(title) AS term FROM para)),
pw AS (SELECT title, unnest(list_distinct(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'))) AS word FROM (SELECT DISTINCT title FROM para)),
rare AS (SELECT term, word FROM tw JOIN (SELECT word, count(*) AS df FROM pw GROUP BY word) USING (word) QUALIFY row_number() OVER (PARTITION BY term ORDER BY df, word) <= 3),
met AS (SELECT DISTINCT term, title FROM rare JOIN pw USING (word)),
cand AS (SELECT * FROM (SELECT term, title, score, row_number() OVER (PARTITION BY term ORDER BY score DESC, title) - 1 AS ord
  FROM (SELECT m.term, m.title, count(*) AS score FROM met m JOIN tw ON tw.term = m.term JOIN pw ON pw.title = m.title AND pw.word = tw.word GROUP BY ALL)) WHERE ord < 5)"""
_LOOKED = f"""
titles AS (SELECT title, min(page_id) AS page_id FROM para GROUP BY title),
kept AS (SELECT term, ord, title, CASE WHEN page_id % 7 = 0 THEN 'disambiguation' WHEN page_id % 5 = 0 THEN 'missing' ELSE 'ok' END AS status FROM cand JOIN titles USING (title) WHERE page_id % 4 <> 0),
amb AS (SELECT term, bool_or(ord = 0 AND status = 'disambiguation') AS is_ambiguous FROM kept GROUP BY term),
parts AS (SELECT title, {_WINDOWS.format('body')} AS parts, substring({strip('body')}, 1, 300) AS entity FROM bodies JOIN titles USING (title, page_id)),
top AS (SELECT title, substring({strip('entity')}, 1, 300) AS entity, substring({strip("list_filter(parts, lambda c: contains(lower(c), 'the'))[1]")}, 1, 300) AS about FROM parts),
chosen AS (SELECT title, CASE WHEN about IS NOT NULL AND NOT (entity <> '' AND contains(entity, about)) THEN
   CASE WHEN entity <> '' AND NOT contains(about, entity) THEN [about, entity] ELSE [about] END WHEN entity <> '' THEN [entity] ELSE [] END AS chunks FROM top),
won AS (SELECT k.term, k.title, c.chunks FROM kept k JOIN chosen c USING (title) JOIN amb a USING (term) WHERE NOT a.is_ambiguous AND k.status = 'ok' AND len(c.chunks) > 0
  QUALIFY row_number() OVER (PARTITION BY k.term ORDER BY k.ord) = 1),
looked AS (SELECT t.term, w.title, w.chunks, coalesce(a.is_ambiguous, false) AS is_ambiguous FROM (SELECT DISTINCT lower(title) AS term FROM para) t LEFT JOIN amb a USING (term) LEFT JOIN won w USING (term))"""
_SCORED = """
scored AS (SELECT 'l' || v.label AS term, v.vec_id AS ord, 'v' || v.vec_id AS title,
  round(list_inner_product(v.embedding::DOUBLE[], a.anchor::DOUBLE[]) / (sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_inner_product(a.anchor::DOUBLE[], a.anchor::DOUBLE[]))), 6) AS score
  FROM embeddings v JOIN (SELECT label, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY label) a ON v.label = a.label),
band AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY term) AS best FROM scored) WHERE score >= best - 0.15::DOUBLE)"""

_ENDS = f"""'Path: (' || n0 || ')-[:' || r0 || ']->(' || n1 || ')-[:' || r1 || ']->(' || n2 || ')' || chr(10) || 'From: ' || n0 || ' = ' || coalesce(nullif(a.description, ''), '{PLACEHOLDER}')
  || chr(10) || 'To: ' || n2 || ' = ' || coalesce(nullif(z.description, ''), '{PLACEHOLDER}')"""
_TRADE_TERMS = "trade JOIN star_terms a ON a.name = n0 LEFT JOIN star_terms z ON z.name = n2"

_QA_TEXTS = """
said AS (SELECT ord, CASE WHEN ord % 5 = 0 THEN '' ELSE 'question: ' END || replace(prompt, chr(10), ' ') || chr(10) || 'Answer:  ' || CASE WHEN ord % 7 = 0 THEN ' ' ELSE substring(response, 1, 40) END || chr(10) || 'end' AS r FROM seeds)"""
_MCQ = """
said AS (SELECT c_custkey, c_name, 'Question: Who is in segment ' || c_mktsegment || '?' || chr(10) || 'A) ' || lower(c_name) || chr(10) || 'B) b' || c_nationkey || chr(10) || 'C) ' || CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE 'c' END
  || chr(10) || 'd) other' || chr(10) || 'correct answer: ' || CASE c_custkey % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'A' ELSE 'E' END AS r FROM customer),
parsed AS (SELECT c_custkey, c_name, nullif(trim(regexp_extract(r, '(?i)question:[ ]*(.*)', 1)), '') AS question, nullif(trim(regexp_extract(r, '(?i)\\nA\\)\\s*(.*)', 1)), '') AS a, nullif(trim(regexp_extract(r, '(?i)\\nB\\)\\s*(.*)', 1)), '') AS b,
  nullif(trim(regexp_extract(r, '(?i)\\nC\\)\\s*(.*)', 1)), '') AS c, nullif(trim(regexp_extract(r, '(?i)\\nD\\)\\s*(.*)', 1)), '') AS d, upper(nullif(regexp_extract(r, '(?i)\\nCorrect Answer:\\s*([A-D])', 1), '')) AS key FROM said),
ok AS (SELECT * FROM parsed WHERE question IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL AND key IS NOT NULL)"""
_VERDICTS = """
said AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN '' ELSE 'Grammar Fluency: YES' || chr(10) || 'grammar_fluency : ' || CASE WHEN c_custkey % 4 = 0 THEN 'no' ELSE 'yes' END || chr(10) || 'Answerable From Source: YES: sure' || chr(10)
  || 'answerable from source: yes' || CASE c_custkey % 3 WHEN 0 THEN chr(10) || 'Topic Relevant: NO' WHEN 1 THEN chr(10) || 'Topic Relevant: N/A' ELSE '' END || chr(10) || 'Ethics Privacy Safe: ' || CASE WHEN c_custkey % 7 = 0 THEN 'NO' ELSE 'Yes' END END AS r FROM customer),
lines AS (SELECT c_custkey, i, l FROM (SELECT c_custkey, unnest(string_split(trim(r), chr(10))) AS l, generate_subscripts(string_split(trim(r), chr(10)), 1) AS i FROM said WHERE r <> '') WHERE contains(l, ':')),
kv AS (SELECT c_custkey, i, replace(lower(trim(substring(l, 1, strpos(l, ':') - 1))), ' ', '_') AS k, upper(trim(substring(l, strpos(l, ':') + 1))) AS v FROM lines),
lastv AS (SELECT c_custkey, k, arg_max(v, i) AS v FROM kv GROUP BY ALL),
verdict AS (SELECT s.c_custkey, r, coalesce(bool_or(k = 'grammar_fluency' AND v = 'YES'), false) AS grammar, coalesce(bool_or(k = 'answerable_from_source' AND v = 'YES'), false) AS answerable,
  coalesce(r <> '', false) AND NOT coalesce(bool_or(k = 'topic_relevant' AND v = 'NO'), false) AS topic, coalesce(bool_or(k = 'ethics_privacy_safe' AND v = 'YES'), false) AS ethics
  FROM said s LEFT JOIN lastv USING (c_custkey) GROUP BY s.c_custkey, r)"""

_OPEN = "'Where does ' || n0 || ' lead in ' || k || ' steps?'"
_TRADE12 = """
two AS (SELECT src AS n0, dst AS nz, 1 AS k, [src, dst] AS ns, [rel] AS rs FROM star_edges WHERE rel IN ('BASED_IN', 'LOCATED_IN', 'PART_OF')
  UNION ALL SELECT n0, n2, 2, [n0, n1, n2], [r0, r1] FROM trade)"""


def _said(source: str) -> str:
    """Cleaned triplets of ``(key, text)``, the first of each undirected one: the stand-in extractor."""
    sentence = _SENTENCES.format("text")
    return rf"""(SELECT key, pos, head, relation, tail FROM (
      SELECT key, pos, w[1] AS head, CASE WHEN regexp_matches(w[2], '^\p{{Nd}}') THEN '_' ELSE '' END || w[2] AS relation, w[-1] AS tail
      FROM (SELECT key, pos, {_WORDS.format('sentence')} AS w FROM (SELECT key, unnest({sentence}) AS sentence, generate_subscripts({sentence}, 1) - 1 AS pos FROM ({source}))) WHERE len(w) >= 3)
      QUALIFY row_number() OVER (PARTITION BY key, least(head, tail), greatest(head, tail), relation ORDER BY pos) = 1)"""


def _grown(depth: int, chat: bool, result: str) -> str:
    """The levels of growth from conversations, unrolled."""
    name = _name_first("lower(prompt)") if chat else _name_second("lower(prompt)")
    parts = [
        _SEEDS.strip(),
        f"named AS (SELECT ord, {name} AS name, {_clean_description('response')} AS description FROM seeds)",
        "firsts AS (SELECT * FROM named" + (" QUALIFY ord = min(ord) OVER (PARTITION BY description))" if chat else ")"),
        f"terms0 AS (SELECT name, arg_max(description, ord) AS description, '{'Yes' if chat else 'No'}' AS fact_checked FROM firsts GROUP BY name)",
        f"level1 AS (SELECT x.*, {strip('lower(prompt)')} AS parent FROM {_said('SELECT ord::VARCHAR AS key, response AS text FROM seeds')} x JOIN seeds ON key = ord::VARCHAR)",
    ]
    for k in range(1, depth + 1):
        about = "n.name || ' is part of ' || coalesce(parent, 'all') || '. ' || n.name || ' has x' || n.name || '.'"
        parts.append(f"""new{k} AS (SELECT n.name, {_clean_description(about)} AS description, CASE WHEN contains(n.name, 's') THEN 'No' ELSE 'Yes' END AS fact_checked
          FROM (SELECT head AS name FROM level{k} UNION SELECT tail FROM level{k}) n LEFT JOIN (SELECT tail, min(parent) AS parent FROM level{k} GROUP BY tail) p ON p.tail = n.name
          WHERE n.name NOT IN (SELECT name FROM terms{k - 1} WHERE description IS NOT NULL))""")
        parts.append(f"terms{k} AS (SELECT * FROM terms{k - 1} WHERE name NOT IN (SELECT name FROM new{k}) UNION ALL SELECT * FROM new{k})")
        if k < depth:
            done = " ".join(f"AND tail NOT IN (SELECT tail FROM level{j})" for j in range(1, k))
            gate = "AND fact_checked = 'Yes'" if chat else ""
            texts = f"SELECT name AS key, description AS text FROM terms{k} WHERE name IN (SELECT tail FROM level{k} WHERE true {done}) {gate} AND description <> ''"
            parts.append(f"level{k + 1} AS (SELECT *, key AS parent FROM {_said(texts)} QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) <= {2 if chat else 3})")
    parent = strip("replace(parent, '_', ' ')") if chat else "parent"
    both = " UNION ALL ".join(f"SELECT {parent} AS src, relation, tail AS dst FROM level{k} UNION ALL SELECT head, relation, tail FROM level{k}" for k in range(1, depth + 1))
    parts.append(f"edges AS (SELECT DISTINCT src, upper(replace(relation, 'ß', 'ss')) AS rel, dst FROM ({both}) WHERE src IN (SELECT name FROM terms{depth}) AND dst IN (SELECT name FROM terms{depth}))")
    return f"WITH {', '.join(parts)} {result}"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["kg_all_triples"] = _star("SELECT src AS subject, rel AS predicate, dst AS object FROM star_edges")
    q["kg_all_nodes"] = _star("SELECT * FROM star_terms")
    q["kg_merge_nodes"] = f"WITH {_DOCTERMS} " + _merge(
        "SELECT name, description, fact_checked FROM docterms WHERE fact_checked IS NOT NULL",
        "SELECT DISTINCT name, NULL::VARCHAR AS description, NULL::VARCHAR AS fact_checked FROM (SELECT name FROM docterms UNION ALL SELECT 'conv ' || conv_id FROM conversations)",
    )
    q["kg_seed_nodes"] = f"""WITH {_SEEDS}, n AS (SELECT ord, {_name_first('prompt')} AS name, {_clean_description('response')} AS description FROM seeds),
      f AS (SELECT * FROM n QUALIFY ord = min(ord) OVER (PARTITION BY description))
      SELECT name, arg_max(description, ord) AS description, 'Yes' AS fact_checked FROM f GROUP BY name"""
    q["kg_seed_nodes_seq2seq"] = f"""WITH {_SEEDS}, n AS (SELECT ord, {_name_second('prompt')} AS name, {_clean_description('response')} AS description FROM seeds)
      SELECT name, arg_max(description, ord) AS description, 'No' AS fact_checked FROM n GROUP BY name"""
    q["kg_merge_descriptions"] = f"WITH {_DOCTERMS} " + _merge(
        "SELECT name, description, fact_checked FROM docterms",
        "SELECT 'doc ' || doc_id AS name, 'it\\''s summary ' || doc_id AS description, CASE WHEN toxic = 0 THEN 'Yes' ELSE 'No' END AS fact_checked FROM labels WHERE doc_id % 5 <> 0",
    )
    q["kg_build_edges"] = _trip(
        r"""SELECT DISTINCT src, rel, dst FROM b WHERE src IN (SELECT name FROM names) AND dst IN (SELECT name FROM names)""",
        r"""s AS (SELECT 'lang ' || lang AS parent, head, CASE WHEN pos % 7 = 0 THEN '' ELSE replace(relation, 'ß', 'ss') END AS relation, tail FROM trip WHERE pos % 11 <> 0)""",
        r"""names AS (SELECT head AS name FROM trip UNION SELECT 'lang ' || lang FROM documents)""",
        r"""b AS (SELECT parent AS src, upper(CASE WHEN relation = '' THEN 'HAS_TERM' WHEN regexp_matches(relation, '^\p{Nd}') THEN '_' || relation ELSE relation END) AS rel, tail AS dst FROM s
          UNION ALL SELECT head, upper(CASE WHEN regexp_matches(relation, '^\p{Nd}') THEN '_' || relation ELSE relation END), tail FROM s WHERE relation <> '')""",
    )
    q["kg_point_lookup"] = _star("""SELECT n.name, description, fact_checked FROM (SELECT 'part ' || l_partkey AS name FROM lineitem UNION SELECT 'customer ' || user_id FROM events) n
      LEFT JOIN star_terms t ON n.name = t.name""")
    q["kg_related_terms"] = _star("SELECT rel AS relation, dst AS related_term FROM star_edges WHERE src = 'part 1'")
    q["kg_prune"] = f"WITH {_DOCTERMS} SELECT name, CASE WHEN fact_checked = 'No' THEN NULL ELSE description END AS description, fact_checked FROM docterms"
    q["kg_prune_count"] = f"WITH {_DOCTERMS} SELECT count(*) FILTER (fact_checked = 'No' AND description IS NOT NULL) AS pruned, count(*) FILTER (fact_checked = 'No') AS flagged FROM docterms"
    q["kg_description_dedup"] = f"SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY {_clean_description('text')}) AS kept FROM documents"
    q["kg_grounding_stats"] = """SELECT count(*) FILTER (quality = 1) AS grounded, count(*) FILTER (quality <> 1) AS model_only, round(100.0::DOUBLE * count(*) FILTER (quality = 1) / count(*), 1) AS grounded_pct
      FROM labels WHERE doc_id % 9 <> 0"""
    q["paths_exact1"] = _paths(2, 1, 1)
    q["paths_exact2"] = _paths(2, 2, 2)
    q["paths_exact3"] = _paths(2, 3, 3)
    q["paths_max2"] = _paths(2, 1, 2)
    q["paths_max3"] = _paths(3, 1, 3)
    q["paths_limited"] = _paths(2, 1, 2, limit="ORDER BY ns, rs LIMIT 1000")
    q["paths_star_max2"] = _paths(0, 1, 2, "SELECT DISTINCT src, rel, dst FROM star_edges")
    d = lambda t, n: f"{n} || '/' || coalesce({t}.description, '-') || '/' || coalesce({t}.fact_checked, '-')"
    q["paths_with_details"] = f"""WITH {_STAR}, {_TRADE} SELECT {d('a', 'n0')} || ' > ' || {d('m', 'n1')} || ' > ' || {d('z', 'n2')} AS nodes, r0 || ' > ' || r1 AS rels
      FROM {_TRADE_TERMS} JOIN star_terms m ON m.name = n1"""
    q["text_sentences"] = _trip("SELECT doc_id, pos, sentence FROM sent")
    q["text_sentence_batches"] = _trip("SELECT doc_id, pos // 3 AS pos, string_agg(sentence, ' ' ORDER BY pos) AS batch FROM sent GROUP BY doc_id, pos // 3")
    raw, rel = "(' ' || chr(9) || p_type || '_X' || chr(10) || p_size || '  ')", "(p_size || 'st ' || p_brand)"
    squeeze = lambda x: rf"regexp_replace({x}, '\s+', ' ', 'g')"
    relation = lambda x: rf"CASE WHEN regexp_matches({x}, '^\p{{Nd}}') THEN '_' ELSE '' END || regexp_replace({x}, '[^\p{{L}}\p{{N}}_]', '_', 'g')"
    q["text_normalisers"] = f"""SELECT p_partkey, replace(lower({strip(raw)}), '_', ' ') AS s1, {strip(squeeze(f"replace(lower({raw}), '_', ' ')"))} AS s2, {relation(f'lower({rel})')} AS s3,
      upper({relation(rel)}) AS s4, {_name_first(raw)} AS s5, {_name_second(raw)} AS s6, lower({strip(f"replace({raw}, '_', ' ')")}) AS s7a, lower({strip(raw)}) AS s7b,
      {_clean_description("('it''s' || chr(10) || p_name)")} AS s8, {strip(squeeze(raw))} AS s9, {strip(f'lower({raw})')} AS s10 FROM part"""
    norm_rel = r"CASE WHEN regexp_matches(relation, '^\p{Nd}') THEN '_' ELSE '' END || relation"
    cleaned = f"c AS (SELECT doc_id, pos, head, {norm_rel} AS relation, tail FROM trip)"
    q["triplet_clean"] = _trip("SELECT * FROM c", cleaned)
    q["triplet_dedup_undirected"] = _trip(
        f"""SELECT doc_id, pos, head, relation, tail FROM c
        QUALIFY row_number() OVER (PARTITION BY doc_id, least(head, tail), greatest(head, tail), {norm_rel} ORDER BY pos) = 1""",
        cleaned,
    )
    q["triplet_grounded_in_sentence"] = _trip("""SELECT doc_id, count(*) AS n FROM (SELECT *, CASE WHEN pos % 3 = 0 THEN tail || 'q' ELSE tail END AS t FROM trip)
      WHERE contains(lower(sentence), head) AND contains(lower(sentence), t) GROUP BY doc_id""")
    q["triplet_model_validate"] = _trip("SELECT doc_id, count(*) AS n FROM trip WHERE pos % 3 = 0 GROUP BY doc_id")
    q["triplet_well_formed"] = _trip("SELECT doc_id, pos, ord, head, relation, tail FROM good", _RESPONSES)
    q["triplet_malformed_counts"] = _trip("SELECT doc_id, pos, count(*) FILTER (ok) AS usable, count(*) FILTER (NOT ok) AS malformed FROM elem GROUP BY doc_id, pos", _RESPONSES)
    q["triplet_regex_fallback"] = _trip("SELECT doc_id, pos, ord, head, relation, tail FROM rx", _RESPONSES)
    q["triplet_json_parse"] = _trip(
        "SELECT doc_id, pos, ord, head, relation, tail FROM good UNION ALL SELECT doc_id, pos, ord, head, relation, tail FROM rx WHERE (doc_id, pos) NOT IN (SELECT (doc_id, pos) FROM good)", _RESPONSES
    )
    q["triplet_marker_parse"] = _trip("""SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, pos ORDER BY k) - 1 AS ord, h AS head, r AS relation, t AS tail FROM (
      SELECT doc_id, pos, 0 AS k, head AS h, relation AS r, tail AS t FROM trip
      UNION ALL SELECT doc_id, pos, 1, head, 'part of', relation FROM trip WHERE (doc_id + pos) % 4 <> 0
      UNION ALL SELECT doc_id, pos, 2, tail, 'in', head FROM trip)""")
    q["kb_candidates"] = f"WITH {_PAGES}, {_SEARCH} SELECT term, ord, title, score FROM cand"
    q["kb_body_sections"] = f"WITH {_PAGES} SELECT page_id, title, text FROM sections WHERE i % 4 NOT IN (1, 2)"
    q["kb_body_text"] = f"WITH {_PAGES} SELECT page_id, body FROM bodies"
    q["kb_opening_window"] = f"SELECT doc_id, substring({strip('text')}, 1, 1000) AS opening FROM documents"
    q["chunk_fixed_window"] = f"SELECT doc_id, unnest({_WINDOWS.format('text')}) AS chunk, generate_subscripts({_WINDOWS.format('text')}, 1) - 1 AS pos FROM documents"
    q["kb_select_chunks"] = f"""WITH x AS (SELECT doc_id, {_WINDOWS.format('text')} AS parts, {_TOPIC} AS topic, CASE WHEN doc_id % 2 = 0 THEN substring({strip('text')}, 1, 1000) END AS lead FROM documents),
      y AS (SELECT doc_id, CASE WHEN topic <> '' THEN substring({strip("list_filter(parts, lambda c: contains(lower(c), lower(topic)))[1]")}, 1, 600) END AS about, substring({strip("coalesce(nullif(lead, ''), parts[1])")}, 1, 600) AS entity FROM x),
      z AS (SELECT doc_id, CASE WHEN about IS NOT NULL AND NOT (entity <> '' AND contains(entity, about)) THEN CASE WHEN entity <> '' AND NOT contains(about, entity) THEN [about, entity] ELSE [about] END WHEN entity <> '' THEN [entity] ELSE [] END AS c FROM y)
      SELECT doc_id, CAST(len(c) AS BIGINT) AS n, array_to_string(c, '|') AS chunks FROM z"""
    q["kb_section_chunks"] = f"""WITH {_PAGES}, c AS (SELECT page_id, -1 AS i, {strip('summary')} AS t FROM para UNION ALL SELECT page_id, i, {strip("regexp_extract(regexp_replace(text, ' +', ' ', 'g'), '(?s)^(.{0,1000})(?: |$)', 1)")} FROM sections WHERE i % 4 NOT IN (1, 2)),
      k AS (SELECT * FROM c WHERE t <> '' AND NOT EXISTS (SELECT 1 FROM c e WHERE e.page_id = c.page_id AND e.i < c.i AND contains(e.t, c.t)))
      SELECT p.page_id, coalesce(string_agg(t, '|' ORDER BY i), '') AS chunks FROM para p LEFT JOIN k ON p.page_id = k.page_id GROUP BY p.page_id"""
    q["kb_title_relevance"] = f"WITH {_CHECKED} SELECT term, ord, title FROM checked WHERE lower(trim(response)) = 'yes'"
    q["kb_ambiguity"] = f"WITH {_CHECKED} SELECT term, ord, title FROM checked WHERE status = 'ok' AND term NOT IN (SELECT term FROM checked WHERE ord = 0 AND status = 'disambiguation')"
    q["kb_ambiguous_terms"] = f"WITH {_CHECKED} SELECT term, bool_or(ord = 0 AND status = 'disambiguation') AS is_ambiguous FROM checked GROUP BY term"
    q["kb_entity_band"] = f"WITH {_SCORED} SELECT term, ord, title, score FROM band"
    q["kb_ranked_lookup"] = f"WITH {_SCORED} SELECT term, ord, title, round(score, 1) AS topic_score FROM band QUALIFY row_number() OVER (PARTITION BY term ORDER BY round(score, 1) DESC, ord) = 1"
    q["kb_lookup_chunks"] = f"WITH {_PAGES}, {_SEARCH}, {_LOOKED} SELECT term, title, CAST(coalesce(len(chunks), 0) AS BIGINT) AS n, is_ambiguous FROM looked"
    q["kb_lookup_summary"] = f"WITH {_PAGES}, {_SEARCH}, {_LOOKED} SELECT term, nullif(array_to_string(chunks, chr(10) || chr(10)), '') AS summary, is_ambiguous FROM looked"
    q["kb_pdf_like_lookup"] = f"""WITH x AS (SELECT doc_id, {_WINDOWS.format('text')} AS parts, coalesce({_TOPIC}, 'zqzq') AS topic FROM documents)
      SELECT doc_id, substring(coalesce(list_filter(parts, lambda c: contains(lower(c), lower(topic)))[1],
        CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 AND len(parts) > 1 THEN parts[2] WHEN doc_id % 5 = 2 AND len(parts) > 99 THEN parts[100] ELSE parts[1] END), 1, 200) AS passage FROM x"""
    q["describe_pending_terms"] = _trip("""SELECT DISTINCT name FROM (SELECT head AS name FROM trip UNION ALL SELECT tail FROM trip)
      WHERE name NOT IN (SELECT head FROM trip WHERE doc_id % 2 = 0 AND pos % 2 = 0)""")
    q["describe_prompts"] = f"""WITH {_DOCTERMS} SELECT t.doc_id, CASE WHEN fact_checked = 'Yes' AND description <> '' THEN 'Describe ''' || name || ''' from this text alone: ' || substring(description, 1, 80)
      ELSE 'Describe ''' || name || ''' briefly.' || CASE WHEN t.doc_id % 2 = 0 THEN ' It was mentioned with ''' || lang || '''.' ELSE '' END || ' Context: ' || source END AS prompt
      FROM docterms t JOIN documents d ON t.doc_id = d.doc_id"""
    q["describe_results"] = f"""WITH {_DOCTERMS} SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN '{NOT_AVAILABLE}' ELSE 'about ' || name END AS description,
      coalesce(doc_id % 4 NOT IN (0, 1) AND fact_checked = 'Yes', false) AS grounded FROM docterms"""
    q["expand_gate"] = f"WITH {_DOCTERMS} SELECT name FROM docterms WHERE fact_checked = 'Yes'"
    q["expand_frontier"] = f"WITH {_DOCTERMS} SELECT name FROM docterms WHERE fact_checked = 'Yes' AND doc_id % 6 NOT IN (0, 1) AND description <> ''"
    q["expand_branch_cap"] = _trip("SELECT doc_id, pos, head, relation, tail FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 3", cleaned)
    q["expand_depth1"] = _grown(1, True, "SELECT name, description, fact_checked FROM terms1")
    q["expand_depth2"] = _grown(2, True, "SELECT name, description, fact_checked FROM terms2")
    q["kg_from_conversations"] = _grown(2, False, "SELECT src, rel, dst FROM edges")
    q["seed_responses"] = rf"""WITH {_SEEDS} SELECT ord, {strip(r"regexp_replace(prompt, '\s+', ' ', 'g')")} AS prompt, CASE WHEN ord % 3 = 0 THEN '{FAILED}' ELSE response END AS response FROM seeds"""
    path = "n0 || ' > ' || n1 || ' > ' || n2 AS path"
    q["qa_prompts"] = f"""WITH {_STAR}, {_TRADE} SELECT {path}, 'Write one question whose answer needs every step of the path, and answer it.' || chr(10) || 'Keep to the topic: trade.' || chr(10) || {_ENDS}
      || chr(10) || 'Reply with two lines, Question: and Answer:' AS prompt FROM {_TRADE_TERMS}"""
    q["qa_prompts_reverse"] = f"""WITH {_STAR}, {_TRADE} SELECT {path}, 'Write one question with four options A) to D); the right option is ''' || n0 || '''.' || chr(10) || 'Keep to the topic: trade.' || chr(10) || {_ENDS}
      || chr(10) || 'Reply with Question:, the four options and Correct Answer: on lines of their own' AS prompt FROM {_TRADE_TERMS}"""
    q["qa_validation_prompts"] = f"""WITH {_STAR}, {_TRADE} SELECT {path}, 'Judge this pair by the source alone.' || chr(10) || 'Question: Where is ' || n0 || '?' || chr(10) || 'Answer: ' || n2 || chr(10) || 'Topic: trade' || chr(10) || {_ENDS}
      || chr(10) || 'Reply with four lines: grammar, answerable, topic, ethics' AS prompt FROM {_TRADE_TERMS}"""
    q["qa_parse_open"] = f"""WITH {_SEEDS}, {_QA_TEXTS}, p AS (SELECT ord, nullif({strip("regexp_extract(r, '(?i)Question:[ ]*(.*)', 1)")}, '') AS question, nullif({strip(r"regexp_extract(r, '(?i)Answer:\s*(.*)', 1)")}, '') AS answer FROM said)
      SELECT * FROM p WHERE question IS NOT NULL AND answer IS NOT NULL"""
    q["qa_parse_mcq"] = f"WITH {_MCQ} SELECT c_custkey, question, a, b, c, d, key FROM ok"
    q["qa_reverse_parse"] = f"WITH {_MCQ} SELECT c_custkey, question, key FROM ok WHERE lower(CASE key WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c ELSE d END) = lower(c_name)"
    ident = lambda kind: f"sha256(concat_ws(chr(31), '{kind}', n0, n1, n2, r0, r1))"
    q["qa_forward"] = f"""WITH {_STAR}, {_TRADE} SELECT {ident('multi_hop_path_open')} AS id, 'Where does ' || n0 || ' lead in 2 steps?' AS question, n2 AS answer, 'multi_hop_path_open' AS source_type, 2::BIGINT AS complexity FROM trade"""
    q["qa_reverse"] = f"""WITH {_STAR}, {_TRADE} SELECT {ident('multi_hop_path_mcq_reverse')} AS id, 'What leads to ' || n2 || '?' AS question, 'A' AS correct_answer_key, n0 AS option_a, 'multi_hop_path_mcq_reverse' AS source_type FROM trade"""
    q["qa_limit"] = f"WITH {_STAR}, {_TRADE}, {_TRADE12} SELECT {_OPEN} AS question, nz AS answer, k::BIGINT AS complexity FROM two ORDER BY ns, rs LIMIT 50"
    q["qa_end_to_end"] = f"""WITH {_STAR}, {_TRADE}, {_TRADE12} SELECT {_OPEN} AS question, nz AS answer, 'multi_hop_path_open' AS source_type, k::BIGINT AS complexity FROM two
      WHERE length({_OPEN}) BETWEEN 10 AND 200 AND (length(nz) % 5 = 0 OR length(nz) % 2 = 0)"""
    q["qa_structural_filter"] = f"WITH {_SEEDS} SELECT ord FROM seeds WHERE length(prompt) BETWEEN 10 AND 200 AND length(response) >= 1 AND ord % 4 <> 0"
    q["qa_parse_verdict"] = f"WITH {_VERDICTS} SELECT c_custkey, grammar, answerable, topic, ethics FROM verdict"
    q["qa_validate"] = f"WITH {_VERDICTS} SELECT c_custkey FROM verdict WHERE r IS NULL OR (grammar AND answerable AND topic AND ethics)"
    q["qa_sample_validation"] = """SELECT c_custkey AS id, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR), c_custkey) <= greatest(1, CAST(floor(count(*) OVER () * 0.15) AS BIGINT)) AS sampled FROM customer"""
    q["qa_acceptance_stats"] = f"""WITH {_SEEDS}, x AS (SELECT length(prompt) BETWEEN 10 AND 200 AS sound, ord % 3 <> 0 AS accepted FROM seeds)
      SELECT count(*) FILTER (NOT sound) AS rejected, count(*) FILTER (sound) AS submitted, count(*) FILTER (sound AND accepted) AS accepted,
        round(100.0::DOUBLE * count(*) FILTER (sound AND accepted) / nullif(count(*) FILTER (sound), 0), 1) AS accepted_pct FROM x"""
    return q
