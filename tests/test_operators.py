import random

import numpy as np
import pyarrow as pa
import pytest

from quern.functions import numbers
from quern.functions.batches import ragged, whole_groups
from quern.operators import governance, greedy, pairs, store


def test_groups_are_never_cut():
    r = random.Random(1)
    keys = sorted(r.choice("abcdefgh") for _ in range(200)) + ["z"] * 90
    batches, at = [], 0
    while at < len(keys):
        n = r.randint(0, 9)
        batches.append(pa.RecordBatch.from_pydict({"k": keys[at : at + n]}, pa.schema([("k", pa.string())])))
        at += n
    seen = [t.column("k").to_pylist() for t in whole_groups(batches, "k", least_rows=20)]
    assert [k for part in seen for k in part] == keys
    assert len({k for part in seen for k in set(part)}) == sum(len(set(part)) for part in seen)
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def _vectors(n, dims=6, seed=0):
    r = np.random.default_rng(seed)
    return [(r.standard_normal(dims) if i % 3 else r.integers(-1, 2, dims)).astype(float).tolist() for i in range(n)]


@pytest.mark.parametrize("block", [4096, 7])
def test_similar_pairs(spark, block):
    vecs = _vectors(60)
    rows = [(f"i{i:02d}", ["a", None, "b"][i % 3] if i % 4 else "a", v) for i, v in enumerate(vecs)] + [("n", "a", None), ("s", "a", [1.0]), ("z", "a", [0.0] * 6), (None, "a", vecs[0])]
    got = {(r.id_a, r.id_b) for r in pairs.similar_pairs(spark.createDataFrame(rows, "id string, scope string, vector array<double>"), 0.61, 6, block=block).collect()}
    want = set()
    for i, a, v in rows[:60]:
        for j, b, w in rows[:60]:
            n = np.linalg.norm(v) * np.linalg.norm(w)
            if i < j and (a or "") == (b or "") and n and float(np.dot(v, w)) / n >= 0.61:
                want.add((i, j))
    assert got == want


def test_seed_clusters(spark):
    r = np.random.default_rng(4)
    rows = [(f"i{i:03d}", "ab"[i % 2], r.standard_normal(5).tolist(), float(r.integers(0, 4)) / 4) for i in range(40)]
    got = {}
    for x in pairs.seed_clusters(spark.createDataFrame(rows, "id string, scope string, vector array<double>, importance double"), 0.6, 5).collect():
        got.setdefault(x.seed, set()).add(x.id)
    used, want = set(), {}
    for i, s, v, _ in sorted(rows, key=lambda x: (-x[3], x[0])):
        if i in used:
            continue
        near = {j for j, t, w, _ in rows if j != i and j not in used and t == s and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.6}
        used |= {i} | near
        if near:
            want[i] = {i} | near
    assert got == want


def test_diversity_puts_repeats_last(spark):
    rows = [(1, "a", 0.9, [1.0, 0.0]), (1, "b", 0.8, [1.0, 0.01]), (1, "c", 0.7, [0.0, 1.0]), (1, "d", 0.6, None), (1, "e", 0.5, [0.0, 0.0])]
    out = greedy.diversify(spark.createDataFrame(rows, "qid bigint, id string, score double, vector array<double>")).orderBy("place").collect()
    assert [r.id for r in out] == ["a", "c", "d", "e", "b"]


def test_batch_dedup(spark):
    rows = [(1, 0, "a", [1.0, 0.0], 0), (1, 1, "b", [1.0, 0.1], 0), (1, 2, "c", [0.0, 1.0], 0), (1, 3, "d", None, 0), (2, 0, "e", [1.0, 0.0], 0), (1, 1, "b", [1.0, 0.1], 1), (None, 0, "f", [1.0, 0.0], 0)]
    frame = spark.createDataFrame(rows, "batch_id bigint, index int, cand_id string, vector array<double>, created_at int")
    assert [(r.cand_id, r.duplicate_of) for r in greedy.batch_dedup(frame).collect()] == [("b", "a")]
    assert greedy.batch_dedup(frame.where("batch_id = 2")).count() == 0


def test_budget(spark):
    rows = [(1, 1, "a", "[x] ", "12345"), (1, 2, "b", "[x] ", "67890" * 3), (1, 3, "c", "[x] ", "1")]
    out = greedy.within_budget(spark.createDataFrame(rows, "qid bigint, place int, id string, prefix string, summary string"), 5, 20).collect()
    assert [(r.id, r.line) for r in out] == [("a", "[x] 12345"), ("b", "[x] 678906")]


def test_compress_session(spark):
    lines = [("first", 0.4, "x"), ("tool_use here", 1.0, "tool_call"), ("result", 0.4, "x"), ("ok", 0.1, "acknowledgment"), ("long " * 10, 0.7, "substantive"), ("last", 0.4, "x")]
    frame = spark.createDataFrame([("s", i, *x) for i, x in enumerate(lines)], "session string, pos bigint, text string, score double, reason string")
    # first and last (9 signs), the call (13) with its result (6), then what still fits
    assert sorted(r.pos for r in greedy.compress_session(frame, 30).collect()) == [0, 1, 2, 3, 5]
    assert greedy.compress_session(frame, 1000).count() == 6


def test_chunks_cover_the_text(spark):
    text = "One sentence here. " * 200 + "x" * 3000 + " 你好。" * 300
    out = greedy.chunks(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "short")], "doc_id bigint, text string")).orderBy("doc_id", "chunk").collect()
    own = [r for r in out if r.doc_id == 1]
    assert own[0].start == 0 and own[-1].stop == len(text) and all(a.stop >= b.start and b.stop > a.stop for a, b in zip(own, own[1:], strict=False))
    assert [r.text for r in out if r.doc_id == 4] == ["short"] and {r.doc_id for r in out} == {1, 4}


def test_merge_keeps_lines_once(spark):
    rows = [("c", 1, "A line\nother", 0.4, "fact", "s"), ("c", 2, "a LINE\nthird", 1.4, "decision", "s"), ("c", 3, None, 0.2, "decision", "s"), ("d", 1, None, 0.1, "fact", "t")]
    got = {r.cluster: r for r in governance.merged_clusters(spark.createDataFrame(rows, "cluster string, pos int, text string, importance double, category string, scope string")).collect()}
    assert got["c"].text == "A line\nother\nthird" and got["c"].importance == 1.0 and got["c"].category == "decision" and got["c"].source_count == 3
    assert got["d"].text == ""


def test_support(spark):
    rows = [("1", "we moved the ledger", "no\nwe moved the ledger to the harbor"), ("2", None, "x"), ("3", "other words", None)]
    got = {r.id: r for r in governance.support(spark.createDataFrame(rows, "id string, said string, heard string")).collect()}
    assert got["1"].coverage == 1.0 and round(got["1"].best, 4) == round(2 * (4 / 7) / (1 + 4 / 7), 4)
    assert got["2"].score == 0.0 and got["3"].score == 0.0


def test_version_chains(spark):
    rows = [(f"v{i}", f"v{i - 1}" if i else None) for i in range(40)] + [("x", "y"), ("y", "x")]
    got = {r.id: (r.root, r.depth) for r in governance.version_chains(spark.createDataFrame(rows, "id string, supersedes string")).collect()}
    assert got == {f"v{i}": ("v0", i) for i in range(40)}


def test_store_rules(spark):
    rows = spark.createDataFrame([("aaaaaaaa-1", "g"), ("aaaaaaaa-2", None), ("bbbbbbbb-1", "h")], "id string, scope string")
    assert store.by_id_or_prefix(rows, "bbbbbbbb").count() == 1 and store.by_id_or_prefix(rows, "bbbb").count() == 0
    with pytest.raises(ValueError):
        store.by_id_or_prefix(rows, "aaaaaaaa")
    assert rows.where(store.scope_filter(["g"])).count() == 2 and rows.where(store.scope_filter([])).count() == 0 and rows.where(store.scope_filter(None)).count() == 3
    with pytest.raises(ValueError):
        store.bulk_delete(rows)


def test_clamps(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-1.0,), (0.5,), (3.0,)], "x double")
    assert [r[0] for r in rows.select(numbers.clamp01(F.col("x"), 0.7)).collect()] == [0.7, 0.7, 0.7, 0.0, 0.5, 1.0]
    assert [r[0] for r in rows.select(numbers.count_of(F.col("x"))).collect()] == [0, 0, 0, 0, 0, 3]
    assert spark.range(1).select(numbers.round_half_up(F.lit(-2.5))).head()[0] == -2
