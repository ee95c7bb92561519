"""Registered queries over all rows of larger tables, beside their SQL; chains, blocks of queries and message texts."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_queries import rows_of

from quern import catalog
from quern.functions.text import message_text
from quern.operators import governance, search

LARGER = "/root/testdata/sf0.01"  # the smallest tables have few candidates
WHOLE = ["admission", "novelty", "novelty_matches", "dedup_prefilter", "vector_search", "bm25_search", "rrf_fuse", "recall_hybrid", "noise_filter", "score_text", "should_capture", "conversation_value", "cluster_merge_votes", "similar_pairs_of_scope", "supersession_chain"]


@pytest.mark.skipif(not Path(LARGER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables(spark, name):
    con = duckdb.connect()
    for f in Path(LARGER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    frame = catalog.queries()[name](spark, LARGER)
    want = con.execute(catalog.oracle_sql()[name])
    got = frame.collect()
    assert got and rows_of(frame.columns, got) == rows_of([c[0] for c in want.description], want.fetchall())


def test_more_queries_than_a_block(spark):
    r = np.random.default_rng(7)
    vectors = r.standard_normal((search.MOST_QUERIES + 100, 4))
    rows = spark.createDataFrame([(f"m{i}", f"word{i} other", v.tolist()) for i, v in enumerate(vectors)], "id string, text string, vector array<double>").withColumns({c: search.F.lit(None).cast("string") for c in ("l0", "l1", "l2")})
    asked = spark.createDataFrame([(i, f"word{i}", v.tolist()) for i, v in enumerate(vectors)] + [(-1, None, None), (-2, "", [])], "qid bigint, query string, vector array<double>")
    for found in (search.vector_search(rows, asked, 1), search.bm25_search(rows, asked, 1), search.lexical_search(rows, asked, 1)):
        assert {(x.qid, x.id) for x in found.collect()} == {(i, f"m{i}") for i in range(len(vectors))}


def test_message_text(spark):
    cases = {"plain": "plain", "[1] note": "[1] note", '[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]': "a\nb", '[{"type":"text","te': "", "[]": ""}
    frame = spark.createDataFrame([(c,) for c in cases], "content string")
    assert {r.content: r.t for r in frame.select("content", message_text(search.F.col("content")).alias("t")).collect()} == cases


def test_chains_of_all_entries(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE memories AS SELECT 'm' || i AS id, 's' || i % 2 AS scope, i AS entry_index, TIMESTAMP '2026-01-01' AS loaded_at FROM range(900) t(i)")
    con.execute(f"COPY memories TO '{tmp_path}/memories.parquet'")
    frame = catalog.queries()["supersession_chain"](spark, str(tmp_path))
    want = con.execute(catalog.oracle_sql()["supersession_chain"])
    got = frame.collect()
    assert len(got) == 900 and rows_of(frame.columns, got) == rows_of([c[0] for c in want.description], want.fetchall())


def test_long_chains(spark):
    frame = spark.createDataFrame([(f"v{i:05d}", f"v{i - 1:05d}" if i % 5000 else None) for i in range(10_000)], "id string, supersedes string")
    got = {r.id: (r.root, r.depth) for r in governance.version_chains(frame).collect()}
    assert got == {f"v{i:05d}": (f"v{i // 5000 * 5000:05d}", i % 5000) for i in range(10_000)}


def lexical_by_hand(rows, asked, k):
    """The scores of the token search in plain loops, of rows (id, text, l0) and queries of lower-case words."""
    out = []
    for qid, query in asked:
        want, best = set(query.lower().split()), {}
        for i, text, l0 in rows:
            for weight, t in ((1.0, text), (0.98, l0 if l0 != text else None)):
                low = (t or "").strip().lower()
                matched = len(want & set("".join(c if c.isalnum() else " " for c in low).split()))
                score = 0.5 + 0.42 * matched / len(want)
                score = max(score, 0.88) if query.strip().lower() in low else score
                score = min(0.95, max(score, 0.92) if matched == len(want) else score) * weight
                if matched and score > best.get(i, 0):
                    best[i] = score
        ranked = sorted(best, key=lambda i: (-best[i], i))[:k]
        out += [(qid, i, round(best[i], 9), n + 1) for n, i in enumerate(ranked)]
    return sorted(out)


def test_token_search_writes_no_pairs(spark, monkeypatch):
    """Rows and queries that share a word are not joined; slices, blocks, passes, fields and literal hits change nothing."""
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    said = lambda n: " ".join(r.choice(words, n))
    rows = [(f"m{i:03d}", said(8), said(8) if i % 3 else None) for i in range(300)] + [("n0", "xw1 w2 w3x", "xw1 w2 w3x"), ("n1", None, "w1 w2"), (None, "w1", None)]
    asked = [(i, said(1 + i % 9)) for i in range(60)] + [(100, " W1 w2 w3 "), (101, "w39 w1"), (102, " "), (103, None)]
    frame = spark.createDataFrame(rows, "id string, text string, l0 string").withColumns({c: search.F.lit(None).cast("string") for c in ("l1", "l2")})
    queries = spark.createDataFrame(asked, "qid bigint, query string")
    want = lexical_by_hand([x for x in rows if x[0] and x[1]], [x for x in asked if (x[1] or "").strip()], 4)
    found = search.lexical_search(frame, queries, 4)
    assert sorted((x.qid, x.id, round(x.score, 9), x["rank"]) for x in found.collect()) == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(search, "MOST_QUERIES", 7), monkeypatch.setattr(search, "MOST_ROWS", 32), monkeypatch.setattr(search, "MOST_SUMS", 50), monkeypatch.setattr(search, "MOST_AT_ONCE", 20)
    assert sorted((x.qid, x.id, round(x.score, 9), x["rank"]) for x in search.lexical_search(frame, queries, 4).collect()) == want
