"""Every query against its SQL on the smallest tables, and a few that SQL can't express."""

import pytest

from tessera import catalogue
from tests.oracle import compare, connect

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, scale, spark):
    folder = f"/root/testdata/sf{scale}"
    assert compare(QUERIES[name](spark, folder), connect(folder), SQL[name]) == ""


def _sentences(text):
    import re

    return [s.strip() for s in re.findall(r"[^.!?\n]+", text) if s.strip()]


def _said(text):
    """Triplets of the stand-in extractor, cleaned and deduplicated."""
    import re

    out, seen = [], set()
    for s in _sentences(text):
        w = re.findall(r"[^\W_]+", s.lower())
        if len(w) >= 3:
            h, r, t = w[0], ("_" if w[1][0].isdigit() else "") + w[1], w[-1]
            if (key := (min(h, t), max(h, t), r)) not in seen:
                seen.add(key)
                out.append((h, r, t))
    return out


def _grow(seeds, depth, seed_flag, gated, cap, dedup):
    """The original's recursion as a breadth-first walk, in plain Python."""
    terms, edges, seen_descriptions = {}, set(), set()
    one_line = lambda d: d.replace("'", "\\'").replace("\n", " ").strip()
    level, by_name = [], {}
    for n, prompt, response in sorted(seeds):
        name, text = prompt.replace("\n", " ").lower().strip(), one_line(response)
        name = name.replace("_", " ") if dedup else " ".join(name.split())
        if dedup and text in seen_descriptions:
            continue
        seen_descriptions.add(text)
        by_name[name] = text
    for name, text in by_name.items():
        terms[name] = (text, seed_flag)
    for _, prompt, response in seeds:
        level += [(prompt.lower().strip(), *t) for t in _said(response)]
    done = set()
    for d in range(1, max(1, depth) + 1):
        for _, h, _, t in level:
            terms.setdefault(h, (None, None))
            terms.setdefault(t, (None, None))
        parents = {}
        for p, _, _, t in level:
            parents[t] = min(parents.get(t, p), p)
        for x in {x for _, h, _, t in level for x in (h, t)}:
            if terms[x][0] is None:
                terms[x] = (one_line(f"{x} is part of {parents.get(x, 'all')}. {x} has x{x}."), "No" if "s" in x else "Yes")
        for p, h, r, t in level:
            end = p.replace("_", " ") if dedup else p
            edges |= {(a, r.upper(), t) for a in (end.strip(), h) if a in terms}
        if d >= depth:
            break
        tails = {t for _, _, _, t in level} - done
        done |= tails
        level = [(t, *x) for t in tails if not gated or terms[t][1] == "Yes" for x in _said(terms[t][0])[:cap]]
    return terms, edges


@pytest.mark.parametrize(("name", "depth"), [("expand_depth1", 1), ("expand_depth2", 2)])
def test_expansion(name, depth, spark, sf):
    from tessera.sources.adapters import seeds

    rows = [tuple(r) for r in seeds(spark, sf).collect()]
    terms, _ = _grow(rows, depth, "Yes", True, 2, True)
    assert {r["name"]: (r["description"], r["fact_checked"]) for r in QUERIES[name](spark, sf).collect()} == terms


def test_graph_from_conversations(spark, sf):
    from tessera.sources.adapters import seeds

    rows = [tuple(r) for r in seeds(spark, sf).collect()]
    _, edges = _grow(rows, 2, "No", False, 3, False)
    assert {tuple(r) for r in QUERIES["kg_from_conversations"](spark, sf).collect()} == edges


def test_chunks_cover_documents(spark, sf):
    """Chunks of a document hold all its words in order, within the size, and begin in the one before or after it."""
    got = {}
    for r in QUERIES["chunk_documents"](spark, sf).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text, at, reach = r["text"].split(), 0, 0
        for chunk in got[r["doc_id"]]:
            assert len(chunk) <= 1000
            own = chunk.split()
            starts = [k for k in range(at, reach + 1) if text[k : k + len(own)] == own]
            assert starts, chunk[:50]
            at, reach = starts[-1], max(reach, starts[-1] + len(own))
        assert reach == len(text)


def test_section_chunks(spark, sf):
    from tessera.functions.chunks import split_text
    from tessera.sources.adapters import page_rows

    want = {}
    for p in page_rows(spark, sf).collect():
        kept = [p["summary"].strip()] if p["summary"].strip() else []
        for x in p["sections"]:
            if x["title"].strip().lower() in ("references", "see also"):
                continue
            c = next(iter(split_text(x["text"])), "")
            if c and not any(c in k for k in kept):
                kept.append(c)
        want[p["page_id"]] = "|".join(kept)
    assert {r["page_id"]: r["chunks"] for r in QUERIES["kb_section_chunks"](spark, sf).collect()} == want


def test_three_hops_take_the_edges_of_the_others(spark, sf):
    from tessera.operators.paths import find_paths
    from tessera.sources.adapters import text_edges

    assert QUERIES["paths_exact3"](spark, sf).count() == find_paths(text_edges(spark, sf, 2), exact_length=3).count()
