"""Problem 4: clusters of mutually similar vectors inside each scope.

Method: parallel pivot correlation clustering.  Rows are ordered by a hash of
their key.  In each round every open row that comes before all its open similar
neighbours becomes a pivot, and pivots absorb their open neighbours.  Then each
member goes to the most similar of the pivots that it is similar to, and each
cluster's medoid (the member with the greatest total similarity to the others) is
recomputed; it describes the cluster.  The pivots depend on the order and the
similarities alone, so it makes no difference whether a block finds them by a walk
in that order or many blocks do in rounds.

Similar pairs among members are never listed: only those of a row and a pivot
are, so a group of alike rows costs its size, not its square.  Inside a block
rows are compared with pivots by matrix products, completely.  In a scope of
several blocks a row is compared with those of its home and of the cells that it
visits, whose number is calibrated to find a share of ``RECALL`` of all similar
pairs of a sample (``vectors.visits_needed``).

Defined results: as for usable vectors; a row alone is no cluster; a pivot all of
whose neighbours are closer to other pivots goes with the closest of them; ties go
to the earlier row by hash, then by key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.batches import whole_groups
from quern.llm.vectors import BLOCK_ROWS, DIMS, block_tables, blocks, cells_of_large_scopes, in_scopes, once_usable, usable, visited, visits_needed
from quern.session import cut_lineage, partitions, table

LEAST = 0.85
RECALL = 0.99
TILE = 2048
MEMBER = "scope string, entry_index bigint, pivot bigint, sim float"


def similar(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the similar pairs of x with y, tile by tile; what is near the limit is computed again in 64 bits."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for a in range(0, len(x), TILE):
        for b in range(0, len(y), TILE):
            s = x[a : a + TILE] @ y[b : b + TILE].T
            i, j = np.nonzero(s >= least - 1e-5)
            s = s[i, j]
            close = np.flatnonzero(s < least + 1e-5)
            if len(close):
                exact = np.einsum("nd,nd->n", x[a + i[close]].astype(np.float64), y[b + j[close]].astype(np.float64))
                keep = np.ones(len(i), dtype=bool)
                keep[close] = exact >= least - 1e-7
                i, j, s = i[keep], j[keep], s[keep]
            found.append((i + a, j + b, s))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def pivots_of(near: np.ndarray) -> np.ndarray:
    """Which rows are pivots, given the matrix of similar pairs of rows in their order."""
    before = np.tril(near, -1)
    waits, pivot = np.ones(len(near), dtype=bool), np.zeros(len(near), dtype=bool)
    while waits.any():
        new = waits & ~(before & waits[None, :]).any(axis=1)
        pivot |= new
        waits &= ~new
        waits &= ~near[:, new].any(axis=1)
    return pivot


def pivot_links(x: np.ndarray, least: float, batch: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pivots, then row, its pivot, similarity of every row similar to a pivot) of rows in their order."""
    n = len(x)
    is_open, absorbed, is_pivot = np.ones(n, dtype=bool), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    links = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for a in range(0, n, batch):
        own = np.flatnonzero(is_open[a : a + batch]) + a
        if not len(own):
            continue
        i, j, _ = similar(x[own], x[own], least)
        near = np.zeros((len(own), len(own)), dtype=bool)
        near[i, j] = i != j
        new = own[pivots_of(near)]
        is_pivot[new] = True
        # pivots are similar to no other pivot, so only the rest can be theirs
        rest = np.flatnonzero((is_open | absorbed) & ~is_pivot)
        p, r, s = similar(x[new], x[rest], least)
        links.append((rest[r], new[p], s))
        absorbed[rest[r]] = True
        is_open[rest[r]] = False
        is_open[new] = False
    return (np.flatnonzero(is_pivot), *(np.concatenate(f) for f in zip(*links, strict=True)))


def pivot_clusters(x: np.ndarray, least: float = LEAST) -> np.ndarray:
    """The medoid of each row's cluster, rows alone being their own; rows stand in their order."""
    n = len(x)
    _, row, pivot, sim = pivot_links(x, least)
    to = np.arange(n)
    best = np.lexsort((pivot, -sim, row))
    first = np.ones(len(best), dtype=bool)
    first[1:] = row[best][1:] != row[best][:-1]
    to[row[best[first]]] = pivot[best[first]]
    # a pivot left alone goes with the closest of its neighbours
    alone = np.bincount(to, minlength=n)[pivot] == 1
    best = np.lexsort((row[alone], -sim[alone], pivot[alone]))
    p, r = pivot[alone][best], row[alone][best]
    first = np.ones(len(best), dtype=bool)
    first[1:] = p[1:] != p[:-1]
    to[p[first]] = to[r[first]]
    # medoids: the total similarity to the others is the product with the cluster's sum
    order = np.argsort(to, kind="stable")
    edge = np.concatenate(([0], np.flatnonzero(to[order][1:] != to[order][:-1]) + 1)) if n else np.zeros(0, np.int64)
    sums = np.zeros((n, x.shape[1]))
    if n:
        sums[to[order][edge]] = np.add.reduceat(x[order].astype(np.float64), edge, axis=0)
    total = np.round(np.einsum("nd,nd->n", x.astype(np.float64), sums[to]), 5)
    best = np.lexsort((np.arange(n), -total, to))
    medoid = np.arange(n)
    if n:
        medoid[to[best[edge]]] = best[edge]
    return medoid[to]


def _clusters_in_blocks(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in block_tables(batches):
            if len(x) < 2:
                continue
            key, rank = (part.column(c).to_numpy() for c in ("entry_index", "rank"))
            order = np.lexsort((key, rank))
            key, x = key[order], x[order]
            medoid = pivot_clusters(x, least)
            out = np.flatnonzero(np.bincount(medoid, minlength=len(x))[medoid] > 1)
            near = np.einsum("nd,nd->n", x[out].astype(np.float64), x[medoid[out]].astype(np.float64))
            scope = part.column("scope").combine_chunks().take(pa.array(order[out]))
            yield pa.RecordBatch.from_arrays([scope, pa.array(key[out]), pa.array(key[medoid[out]]), pa.array(near.astype(np.float32))], names=["scope", "entry_index", "pivot", "sim"])

    return run


def _in_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, unit vectors) of each block, members before guests, each in its order, keys once."""
    for whole in whole_groups(batches, "block", least_rows=1):
        names = np.array(whole.column("block").to_pylist(), dtype=object)
        edge = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            part = whole.slice(a, b - a)
            key, rank, guest = (part.column(c).to_numpy() for c in ("key", "rank", "guest"))
            part = part.take(pa.array(np.lexsort((key, rank, guest))))
            yield part, np.frombuffer(b"".join(part.column("unit").to_pylist()), dtype=np.float32).reshape(-1, DIMS)


def _first_open(least: float):
    """key, first: the place in the order (rank and key) of the first open neighbour that a block knows of; only of rows that have one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _in_blocks(batches):
            key, rank, guest = (part.column(c).to_numpy() for c in ("key", "rank", "guest"))
            members = int((guest == 0).sum())
            place = np.empty(len(key), dtype=np.int64)
            by_place = np.lexsort((key, rank))
            place[by_place] = np.arange(len(key))
            first = np.full(len(key), len(key), dtype=np.int64)
            for a in range(0, len(x), TILE):
                i, j, _ = similar(x[a : a + TILE], x[:members], least)
                i, ok = i + a, i + a != j
                np.minimum.at(first, i[ok], place[j[ok]])
                np.minimum.at(first, j[ok], place[i[ok]])
            has = np.flatnonzero(first < len(key))
            to = by_place[first[has]]
            yield pa.RecordBatch.from_arrays([pa.array(key[has]), pa.array(rank[to]), pa.array(key[to])], names=["key", "first_rank", "first_key"])

    return run


def _links_of_new(least: float):
    """key, pivot, sim of the rows similar to the new pivots of this round."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _in_blocks(batches):
            key, guest, new = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "guest", "new"))
            mine = guest == 0
            for p, r in ((np.flatnonzero(new), np.flatnonzero(~new & mine)), (np.flatnonzero(new & mine), np.flatnonzero(~new & ~mine))):
                i, j, s = similar(x[p], x[r], least)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(key[r[j]]), pa.array(key[p[i]]), pa.array(s)], names=["key", "pivot", "sim"])

    return run


def _rank(c: Column) -> Column:
    """The place in the order: a hash of the key; the key itself decides between equal ones."""
    return F.xxhash64(c)


def _routed(homes: DataFrame, cells: dict[str, np.ndarray], visits: dict[str, int]) -> DataFrame:
    """block, guest, key, rank, unit: every row in its home and, as a guest, in the cells that it visits."""
    sent = homes.sparkSession.sparkContext.broadcast((cells, visits))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, visits = sent.value
        for batch in batches:
            scopes, cell = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy()
            x = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.float32).reshape(-1, DIMS)
            for scope in sorted(set(scopes.tolist())):
                own = np.flatnonzero(scopes == scope)
                to = np.concatenate((cell[own][:, None], visited(x[own], cells[scope], visits[scope])), axis=1)
                take = pa.array(np.repeat(own, to.shape[1]))
                guest = np.tile(np.arange(to.shape[1]) > 0, len(own)).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array([f"{scope}\x01{c}" for c in to.ravel()], pa.string()), pa.array(guest), *(batch.column(c).take(take) for c in (2, 3, 4))], names=["block", "guest", "key", "rank", "unit"])

    return homes.select("scope", "cell", "key", "rank", "unit").mapInArrow(spread, "block string, guest tinyint, key bigint, rank bigint, unit binary")


def _clusters_in_cells(rows: DataFrame, cells: dict[str, np.ndarray], least: float) -> DataFrame:
    """The same for scopes of several blocks, in rounds of joins."""
    kept = blocks(rows, cells)

    def units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in block_tables(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in ("scope", "cell", "id", "entry_index", "rank")), pa.array([v.tobytes() for v in x], pa.binary())], names=["scope", "cell", "id", "key", "rank", "unit"])

    homes = cut_lineage(kept.mapInArrow(units, "scope string, cell int, id string, key bigint, rank bigint, unit binary"))
    routed = cut_lineage(_routed(homes, cells, visits_needed(homes, cells, RECALL, least=least)))

    def compared(some: DataFrame, how, schema: str) -> DataFrame:
        return some.repartition(partitions(rows), "block").sortWithinPartitions("block").mapInArrow(how, schema)

    firsts = lambda some: compared(some, _first_open(least), "key bigint, first_rank bigint, first_key bigint").groupBy("key").agg(F.min(F.struct(F.col("first_rank").alias("rank"), F.col("first_key").alias("key"))).alias("first"))
    first = cut_lineage(firsts(routed))
    # rows without neighbours take no further part
    status = first.select("key")
    routed = cut_lineage(routed.join(status, "key", "left_semi"))
    is_open, links = cut_lineage(status), None
    while True:  # at least the first open row becomes a pivot in every round
        ranked = is_open.join(first, "key", "left").where(F.col("first").isNull() | (F.struct(_rank(F.col("key")).alias("rank"), "key") < F.col("first")))
        new = cut_lineage(ranked.select("key"))
        others = status.join(new, "key", "left_anti")
        asked = routed.join(others.select("key", F.lit(False).alias("new")).unionByName(new.select("key", F.lit(True).alias("new"))), "key")
        found = cut_lineage(compared(asked, _links_of_new(least), "key bigint, pivot bigint, sim float").distinct())
        links = found if links is None else links.unionByName(found)
        is_open = cut_lineage(is_open.join(new, "key", "left_anti").join(found.select("key").distinct(), "key", "left_anti"))
        status = cut_lineage(others)  # pivots are done: no other pivot is similar to them
        if is_open.isEmpty():
            break
        first = cut_lineage(firsts(routed.join(is_open, "key", "left_semi")))
    links = cut_lineage(links)
    # to the closest pivot; a pivot left alone goes with the closest of its neighbours
    order = lambda c: F.struct((-F.col("sim")).alias("far"), _rank(F.col(c)).alias("h"), F.col(c).alias("key"))
    to = links.groupBy("key").agg(F.min(order("pivot")).alias("b")).select("key", F.col("b.key").alias("pivot"))
    taken = to.select("pivot").distinct()
    lone = links.join(taken, "pivot", "left_anti").groupBy("pivot").agg(F.min(order("key")).alias("b")).select(F.col("pivot").alias("lone"), F.col("b.key").alias("key"))
    moved = lone.join(to, "key").select(F.col("lone").alias("key"), "pivot")
    at = cut_lineage(to.unionByName(taken.select(F.col("pivot").alias("key"), "pivot")).unionByName(moved).join(homes.select("scope", "key", "rank", "unit"), "key"))
    # the cluster's sums, added up in the tasks before the exchange
    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pivot = batch.column(0).to_numpy()
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(-1, DIMS).astype(np.float64)
            some, where = np.unique(pivot, return_inverse=True)
            by = np.argsort(where, kind="stable")
            sums = np.add.reduceat(x[by], np.searchsorted(where[by], np.arange(len(some))), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c) for c in sums.T.copy())], names=["pivot", *(f"d{i}" for i in range(DIMS))])

    parts = at.select("pivot", "unit").mapInArrow(gather, "pivot bigint, " + ", ".join(f"d{i} double" for i in range(DIMS)))
    sums = parts.groupBy("pivot").agg(F.array(*(F.sum(f"d{i}") for i in range(DIMS))).alias("total"))

    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.float32).reshape(-1, DIMS).astype(np.float64)
            s = batch.column(5).flatten().to_numpy().reshape(-1, DIMS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.round(np.einsum("nd,nd->n", x, s), 5))], names=["scope", "key", "rank", "pivot", "unit", "total"])

    scored = cut_lineage(at.join(sums, "pivot").select("scope", "key", "rank", "pivot", "unit", "total").mapInArrow(totals, "scope string, key bigint, rank bigint, pivot bigint, unit binary, total double"))
    medoids = scored.groupBy("pivot").agg(F.min(F.struct((-F.col("total")).alias("t"), "rank", "key", "unit")).alias("m")).select("pivot", F.col("m.key").alias("medoid"), F.col("m.unit").alias("centre"))

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.float32).reshape(-1, DIMS).astype(np.float64) for c in (3, 4))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.einsum("nd,nd->n", x, y).astype(np.float32))], names=["scope", "entry_index", "pivot", "sim"])

    return scored.join(medoids, "pivot").select("scope", F.col("key").alias("entry_index"), F.col("medoid").alias("pivot"), "unit", "centre").mapInArrow(near, MEMBER)


def clusters(memories: DataFrame, least: float = LEAST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """scope, entry_index, pivot (the medoid's entry_index), sim of every member of clusters of two or more."""
    rows = usable(memories, "entry_index").where("entry_index is not null").withColumn("rank", _rank(F.col("entry_index").cast("bigint")))
    cells = cells_of_large_scopes(rows, block_rows)
    out = blocks(in_scopes(rows, cells, inside=False) if cells else rows, {}).mapInArrow(_clusters_in_blocks(least), MEMBER)
    return out.unionByName(_clusters_in_cells(once_usable(in_scopes(rows, cells)), cells, least)) if cells else out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = clusters(table(spark, sf_dir, "memories"))
    first = members.groupBy("pivot").agg(F.min("entry_index").alias("first_index"))
    return members.join(first, "pivot").select("first_index", "entry_index")


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a cluster: its size, its mean similarity to the medoid, and its three most typical members."""
    members = clusters(table(spark, sf_dir, "memories"))
    top = members.withColumn("n", F.row_number().over(Window.partitionBy("pivot").orderBy(F.desc("sim"), "entry_index")))
    return top.groupBy("scope", "pivot").agg(
        F.min("entry_index").alias("first_index"), F.count("*").alias("size"), F.round(F.avg("sim"), 4).alias("mean_similarity"), F.sort_array(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "entry_index")))).alias("t"),
    ).select("scope", "first_index", "size", "mean_similarity", F.transform("t", lambda x: x["entry_index"]).alias("typical"))
