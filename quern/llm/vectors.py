"""Usable vectors of a scope, cut into blocks that a task can hold; shared by problems 2 and 4.

A scope with more than ``BLOCK_ROWS`` rows is divided by a k-means tree that is
fitted on a bounded sample of its rows (``SAMPLE_PER_CELL`` for each cell); every
row is then assigned to a cell, its home.  A row that looks for others in its scope
visits the cells whose centres are most similar to it; how many is calibrated for
each scope on a sample of its rows compared with all rows (``visits_needed``).

There are at most about ``MOST_CELLS`` cells in all: beyond, the blocks grow.  So
what is sent to all tasks (centres, calibrated numbers, samples) has a bound.

Defined results: usable are vectors of ``DIMS`` finite numbers that are not all
zero; null and empty scopes count as ``global``; rows of one id count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.batches import whole_groups
from quern.session import partitions

DIMS = 64
BLOCK_ROWS = 32_768
SAMPLE_PER_CELL = 32
MOST_CELLS = 4096
#: Rows of a scope that are compared with all its rows for calibration, and of all scopes together.
CALIBRATE, CALIBRATE_ALL = 256, 8192
BRANCHES = 16


def unit_rows(lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors as 32-bit floats, which rows are usable) of lists of DIMS numbers."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIMS)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x.astype(np.float32), ok


def kmeans(x: np.ndarray, k: int, seed: int, steps: int = 5) -> np.ndarray:
    """Unit centres; a centre that loses all its rows keeps its place."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = np.argmax(x @ centres.T, axis=1)
        for c in np.unique(near):
            total = x[near == c].sum(axis=0)
            size = np.linalg.norm(total)
            if size > 0:
                centres[c] = total / size
    return centres


def tree_nodes(x: np.ndarray, most: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows in the order of the leaves, [start, stop] of each node in it, each node's parent) of a k-means tree.

    Node 0 is the root; leaves have at most ``most`` rows; a node comes after its parent.
    """
    order = np.arange(len(x))
    spans, parents, at = [(0, len(x))], [-1], 0
    while at < len(spans):
        lo, hi = spans[at]
        if hi - lo > most:
            rows = order[lo:hi]
            k = min(BRANCHES, max(2, -(-len(rows) // most)))
            pick = rows[:: max(1, len(rows) // (64 * k))]
            near = np.argmax(x[rows] @ kmeans(x[pick], k, seed).T, axis=1)
            size = np.bincount(near, minlength=k)
            if size.max() == len(rows):  # rows that are all alike are halved
                near = (np.arange(len(rows)) * 2 // len(rows)).astype(np.int64)
                size = np.bincount(near)
            order[lo:hi] = rows[np.argsort(near, kind="stable")]
            edge = lo + np.concatenate(([0], np.cumsum(size)))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b > a:
                    spans.append((int(a), int(b)))
                    parents.append(at)
        at += 1
    return order, np.array(spans, dtype=np.int64).reshape(-1, 2), np.array(parents, dtype=np.int64)


def tree_leaves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a k-means tree whose leaves have at most ``most`` rows."""
    order, spans, parents = tree_nodes(x, most)
    inner = np.zeros(len(spans), dtype=bool)
    inner[parents[1:]] = True
    return [order[a:b] for a, b in spans[~inner]]


def usable(memories: DataFrame, *more: str) -> DataFrame:
    """id, scope, vector and the named columns of rows whose vector has the right length."""
    scope = F.when(F.coalesce(F.col("scope"), F.lit("")) == "", "global").otherwise(F.col("scope"))
    return memories.where(F.col("id").isNotNull() & (F.size("vector") == DIMS)).select("id", scope.alias("scope"), F.col("vector").cast("array<float>").alias("vector"), *more)


def cells_of_large_scopes(rows: DataFrame, block_rows: int) -> dict[str, np.ndarray]:
    """Centres of the cells of every scope with more than ``block_rows`` rows, or than what ``MOST_CELLS`` blocks need."""
    sizes = rows.groupBy("scope").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    total = sizes.agg(F.sum("n")).head()[0]
    if not total:
        return {}
    block_rows = max(block_rows, -(-2 * total // MOST_CELLS))
    large = sizes.where(F.col("n") > block_rows)  # at most MOST_CELLS / 2 scopes
    found = {r["scope"]: r["n"] for r in large.collect()}
    if not found:
        return {}
    share = large.select("scope", F.least(F.lit(1.0), SAMPLE_PER_CELL * F.ceil(F.col("n") * 2 / block_rows) / F.col("n")).alias("share"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000.0
    sample = rows.join(F.broadcast(share), "scope").where(draw < F.col("share")).select("scope", "vector").toArrow()
    x, ok = unit_rows(sample.column(1)) if sample.num_rows else (np.zeros((0, DIMS), np.float32), np.zeros(0, bool))
    names = np.array(sample.column(0).to_pylist(), dtype=object)
    out = {}
    for scope, n in found.items():
        own = x[ok & (names == scope)]
        if not len(own):
            continue
        leaves = tree_leaves(own, max(1, int(len(own) * block_rows / 2 / n)))
        centres = np.stack([own[leaf].sum(axis=0) for leaf in leaves])
        out[scope] = (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return out


def in_scopes(rows: DataFrame, cells: dict[str, np.ndarray], inside: bool = True) -> DataFrame:
    """The rows of the scopes that have cells, or the others."""
    if not cells:
        return rows.where(F.lit(not inside))
    names = rows.sparkSession.createDataFrame([(s,) for s in cells], "scope string")
    return rows.join(F.broadcast(names), "scope", "left_semi" if inside else "left_anti")


def once_usable(rows: DataFrame) -> DataFrame:
    """Rows of one id once, of those that are usable."""
    fine = F.forall("vector", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    return rows.where(fine).dropDuplicates(["id"])


def visits_needed(homes: DataFrame, cells: dict[str, np.ndarray], recall: float, k: int | None = None, least: float | None = None) -> dict[str, int]:
    """For each scope the number of cells to visit (the home included) so that a sample of its rows finds its k nearest, or all of ``least`` similarity, to a share of ``recall``.

    homes: scope, cell, id, unit.  The sample is compared with all rows of its scope.
    """
    each = max(16, min(CALIBRATE, CALIBRATE_ALL // len(cells)))
    sizes = homes.groupBy("scope").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1_000_000)) / 1_000_000.0
    sample = homes.join(F.broadcast(sizes), "scope").where(draw < each / F.col("n")).select("scope", "id", "unit").toArrow()
    units = np.frombuffer(b"".join(sample.column(2).to_pylist()), dtype=np.float32).reshape(-1, DIMS)
    names, ids = np.array(sample.column(0).to_pylist(), dtype=object), np.array(sample.column(1).to_pylist(), dtype=object)
    asked = {s: (np.flatnonzero(names == s), units[names == s]) for s in cells}
    sent = homes.sparkSession.sparkContext.broadcast((asked, ids))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ids = sent.value
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        counts: dict[tuple[int, int], int] = {}
        for batch in batches:
            scopes, cell = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy()
            row_ids = np.array(batch.column(2).to_pylist(), dtype=object)
            x = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.float32).reshape(-1, DIMS)
            for scope in set(scopes.tolist()):
                at, q = asked[scope]
                if not len(at):
                    continue
                own = np.flatnonzero(scopes == scope)
                s = q @ x[own].T
                s[ids[at][:, None] == row_ids[own][None, :]] = -2
                if least is not None:
                    i, j = np.nonzero(s >= least)
                    for key in zip(at[i].tolist(), cell[own[j]].tolist(), strict=True):
                        counts[key] = counts.get(key, 0) + 1
                    continue
                sims, where = best.get(scope, (np.full((len(at), k), -2, np.float32), np.zeros((len(at), k), np.int32)))
                sims, where = np.concatenate((sims, s), axis=1), np.concatenate((where, np.broadcast_to(cell[own], s.shape)), axis=1)
                top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                best[scope] = np.take_along_axis(sims, top, axis=1), np.take_along_axis(where, top, axis=1)
        out = [(q, c, 1.0, n) for (q, c), n in counts.items()]
        for scope, (sims, where) in best.items():
            at = asked[scope][0]
            out += [(int(at[i]), int(where[i, j]), float(sims[i, j]), 1) for i, j in zip(*np.nonzero(sims > -2), strict=True)]
        if out:
            q, c, s, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int32()), pa.array(s, pa.float64()), pa.array(n, pa.int64())], names=["q", "cell", "sim", "n"])

    found = homes.select("scope", "cell", "id", "unit").mapInArrow(compare, "q bigint, cell int, sim double, n bigint")
    if k is not None:
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim")))).where(F.col("rank") <= k)
    need: dict[str, list[tuple[int, int]]] = {s: [] for s in cells}
    for r in found.groupBy("q", "cell").agg(F.sum("n").alias("n")).collect():  # the sample times the cells at most
        scope = names[r["q"]]
        s = units[r["q"]] @ cells[scope].T
        need[scope].append((int((s > s[r["cell"]]).sum()) + 1, r["n"]))
    out = {}
    for scope, ranks in need.items():
        ranks.sort()
        total, seen, visits = sum(n for _, n in ranks), 0, 1
        for rank, n in ranks:
            if seen >= recall * total:
                break
            seen, visits = seen + n, rank
        out[scope] = min(len(cells[scope]), max(2, visits))
    return out


def visited(x: np.ndarray, centres: np.ndarray, visits: int) -> np.ndarray:
    """The cells that each row visits besides its home, best first."""
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, 1:visits]


def blocks(rows: DataFrame, cells: dict[str, np.ndarray]) -> DataFrame:
    """``rows`` with their block's key, partitioned and sorted by it."""
    if cells:
        sent = rows.sparkSession.sparkContext.broadcast(cells)
        at = rows.columns.index("scope"), rows.columns.index("vector")

        def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, ok = unit_rows(batch.column(at[1]))
                cell = np.zeros(len(x), dtype=np.int32)
                scopes = np.array(batch.column(at[0]).to_pylist(), dtype=object)
                for scope in set(scopes.tolist()) & sent.value.keys():
                    own = ok & (scopes == scope)
                    if own.any():
                        cell[own] = np.argmax(x[own] @ sent.value[scope].T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

        rows = rows.mapInArrow(assign, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", cell int")
    else:
        rows = rows.withColumn("cell", F.lit(0))
    keyed = rows.withColumn("block", F.concat_ws("\x01", "scope", "cell"))
    return keyed.repartition(partitions(rows), "block").sortWithinPartitions("block")


def block_tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table a block; rows that aren't usable and repeated ids are gone, with the unit vectors beside."""
    for table in whole_groups(batches, "block", least_rows=1):
        keys = table.column("block").combine_chunks()
        runs = pa.array(keys).dictionary_encode().indices.to_numpy()
        edge = np.concatenate(([0], np.flatnonzero(runs[1:] != runs[:-1]) + 1, [len(runs)]))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            part = table.slice(a, b - a)
            x, ok = unit_rows(part.column("vector"))
            ids = np.array(part.column("id").to_pylist(), dtype=object)
            _, first = np.unique(ids.astype(str), return_index=True)
            keep = np.zeros(len(ids), dtype=bool)
            keep[first] = True
            # of repeated rows one that is usable counts
            if (~ok).any():
                good = np.flatnonzero(ok)
                _, first = np.unique(ids[good].astype(str), return_index=True)
                keep[:] = False
                keep[good[first]] = True
            rows = np.flatnonzero(keep)
            if len(rows):
                yield part.take(pa.array(rows)), x[rows]
