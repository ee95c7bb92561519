import numpy as np
import pytest

from quern.llm import clusters as c
from quern.llm import neighbours as n

SCHEMA = "id string, vector array<float>, scope string, entry_index bigint, cell int, block string"


def memories(count=300, seed=2):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((count // 6, 64))
    rows = []
    for i in range(count):
        v = centres[r.integers(len(centres))] + 0.25 * r.standard_normal(64) if i % 2 else r.standard_normal(64)
        rows.append((f"id{i:04d}", [float(x) * 3 for x in v], ["a", "b", None, ""][i % 4] if i % 3 else "a", i, 1, "x"))
    bad = [None, [], [1.0] * 48, [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] + [1.0] * 63]
    return [*rows, *((f"bad{i}", v, "a", 1000 + i, None, None) for i, v in enumerate(bad)), rows[0], ("lonely", rows[0][1], "only", 2000, 0, "")]


def good(rows):
    out = {}
    for i, v, s, e, *_ in rows:
        if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0):
            out[i] = (s or "global", e, np.array(v, dtype=np.float32).astype(float) / np.linalg.norm(np.array(v, dtype=np.float32).astype(float)))
    return out


@pytest.mark.parametrize("block_rows", [n.BLOCK_ROWS, 40])
def test_neighbours(spark, block_rows):
    rows, want = memories(), set()
    by = good(rows)
    for i, (s, _, v) in by.items():
        others = sorted(((-float(v @ w), j) for j, (t, _, w) in by.items() if t == s and j != i))[:5]
        want |= {(min(i, j), max(i, j)) for _, j in others}
    got = [tuple(r) for r in n.nearest(spark.createDataFrame(rows, SCHEMA), block_rows=block_rows).collect()]
    assert len(got) == len(set(got))
    assert len(want & set(got)) >= 0.97 * len(want) and len(want & set(got)) >= 0.97 * len(got)


def test_tree_reaches_the_calibrated_recall():
    x = np.random.default_rng(0).standard_normal((6000, 64)).astype(np.float32)
    x[:3000] = x[:500].repeat(6, axis=0) + 0.3 * x[:3000]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = n._block_tree(x, 5, 0.95)
    some = np.arange(0, 6000, 20)
    got, _ = tree.search(x[some], 5, some)
    full = x[some] @ x.T
    full[np.arange(len(some)), some] = -2
    true = np.argsort(-full, axis=1)[:, :5]
    assert (got[:, :, None] == true[:, None, :]).any(axis=1).mean() >= 0.9


@pytest.mark.parametrize("block_rows", [n.BLOCK_ROWS, 40])
def test_clusters_of_cliques(spark, block_rows):
    rows = memories()
    by, want = good(rows), {}
    for i, (s, e, v) in by.items():
        like = [j for j, (t, _, w) in by.items() if t == s and float(v @ w) >= 0.85]
        want[e] = like
    frame = c.clusters(spark.createDataFrame(rows, SCHEMA), block_rows=block_rows).collect()
    of = {r.entry_index: r.pivot for r in frame}
    index = {i: e for i, (_, e, _) in by.items()}
    assert len(of) == len(frame)
    # members are similar to their medoid; in a clique all are together; rows without neighbours are alone
    vec = {e: v for _, e, v in by.values()}
    assert all(float(vec[e] @ vec[p]) >= 0.85 - 1e-6 for e, p in of.items())
    for e, like in want.items():
        mates = {index[j] for j in like}
        if len(mates) == 1:
            assert e not in of
        elif all({index[j] for j in want[m]} == mates for m in mates):
            assert {of[m] for m in mates} == {of[e]}


def at_angles(degrees, start=0):
    """Rows of one scope at these angles in a plane."""
    return [(f"g{start + i}", [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))] + [0.0] * 62, "g", start + i, 1, "x") for i, d in enumerate(degrees)]


@pytest.mark.parametrize("block_rows", [n.BLOCK_ROWS, 8])
def test_no_member_is_lost_in_groups_that_are_no_cliques(spark, block_rows):
    """A dense core, one row between, and an outlier similar to the one between only; every numbering of them."""
    for shift in range(0, 14 if block_rows == n.BLOCK_ROWS else 1):
        degrees = np.roll([*np.linspace(-2, 2, 12), 30, 60], shift)
        got = {r.entry_index: r for r in c.clusters(spark.createDataFrame(at_angles(degrees), SCHEMA), block_rows=block_rows).collect()}
        assert set(got) == set(range(14))
        for e, r in got.items():
            mates = [k for k, x in got.items() if x.pivot == r.pivot and k != e]
            assert any(np.cos(np.radians(degrees[e] - degrees[k])) >= 0.85 for k in mates)
            assert abs(r.sim - np.cos(np.radians(degrees[e] - degrees[r.pivot]))) < 1e-4


def walk(x, least):
    """Pivots one by one in the order of the rows, then the closest pivot; plain loops."""
    near = x @ x.T
    pivots, taken = [], set()
    for i in range(len(x)):
        if i not in taken:
            pivots.append(i)
            taken |= {j for j in range(len(x)) if near[i, j] >= least}
    to = {i: max((p for p in pivots if near[i, p] >= least), key=lambda p: (round(near[i, p], 6), -p), default=i) if i not in pivots else i for i in range(len(x))}
    alone = [p for p in pivots if list(to.values()).count(p) == 1]
    moved = {p: to[max((j for j in range(len(x)) if j not in pivots and near[p, j] >= least), key=lambda j: (round(near[p, j], 6), -j))] for p in alone if (np.delete(near[p], p) >= least).any()}
    return to | moved


@pytest.mark.parametrize("batch", [1024, 7])
def test_pivots_are_those_of_a_walk(batch):
    r = np.random.default_rng(5)
    for spread in (0.15, 0.35, 0.6):
        x = r.standard_normal((8, 64))[r.integers(0, 8, 90)] + spread * r.standard_normal((90, 64))
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        want = walk(x.astype(float), 0.85)
        pivots, row, pivot, _ = c.pivot_links(x, 0.85, batch)
        assert set(pivots) >= {p for p in want.values()} and not np.isin(row, pivots).any() and np.isin(pivot, pivots).all()
        medoid = c.pivot_clusters(x)
        assert {frozenset(np.flatnonzero(medoid == m)) for m in set(medoid)} == {frozenset(k for k in want if want[k] == p) for p in set(want.values())}
        for m in set(medoid):
            own = np.flatnonzero(medoid == m)
            total = (x[own] @ x[own].T).sum(axis=1)
            assert m in own and total[list(own).index(m)] >= total.max() - 1e-4


def test_a_scope_in_many_blocks_has_the_same_clusters(spark, monkeypatch):
    monkeypatch.setattr(c, "RECALL", 1.0)
    r = np.random.default_rng(7)
    x = r.standard_normal((10, 64))[r.integers(0, 10, 240)] + 0.4 * r.standard_normal((240, 64))
    rows = [(f"i{i:03d}", [float(v) for v in x[i]], "s" if i % 3 else "t", i, 1, "x") for i in range(240)]
    whole, cut = (sorted((q.entry_index, q.pivot, round(q.sim, 4)) for q in c.clusters(spark.createDataFrame(rows, SCHEMA), block_rows=b).collect()) for b in (c.BLOCK_ROWS, 40))
    assert whole == cut and len(whole) > 100


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert n.nearest(empty).count() == 0 and c.clusters(empty).count() == 0
