"""Problem 2: the most similar vectors of every vector, inside its scope.

Method: a hierarchical k-means tree with best-bin-first search.  Each block of a
scope is divided down to leaves of at most ``LEAF`` rows.  A query keeps a priority
queue of nodes, by a promise computed from a node's mean and spread; the best nodes
are taken out, inner ones put their children in, leaves are compared, in widening
steps, until the number of better rows to be expected in the queue falls under a
limit.  The limit is calibrated in each block: the largest one with which a sample
of queries reaches ``RECALL`` against comparing all rows.  Queries of one step are
handled together, node by node.

Queries of a scope with several blocks search their home first, then as many other
cells as the sample of ``visits_needed`` asks for, again to ``RECALL``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.batches import whole_groups
from quern.llm.vectors import BLOCK_ROWS, DIMS, block_tables, blocks, cells_of_large_scopes, in_scopes, once_usable, tree_nodes, usable, visited, visits_needed
from quern.session import cut_lineage, partitions, table

K = 5
LEAF = 128
RECALL = 0.98
CALIBRATE = 128
LIMITS = (1.0, 0.5, 0.25, 0.1, 0.05, 0.02, 0.0)
#: Visitors of a block before its members are copied for another task, in blocks.
MOST_VISITORS = 8


def _tail(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution above z, to a few per cent."""
    up = np.maximum(z, 0)
    high = 0.5 * np.exp(-0.717 * up - 0.416 * up * up)
    return np.where(z >= 0, high, 1 - 0.5 * np.exp(0.717 * np.minimum(z, 0) - 0.416 * np.minimum(z, 0) ** 2))


class Tree:
    """A block's vectors in a k-means tree, searched best bin first."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.rows, self.span, parent = tree_nodes(x, leaf)
        self.x = np.ascontiguousarray(x[self.rows])
        total = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(self.x, axis=0, dtype=np.float64)))
        self.size = np.diff(self.span, axis=1)[:, 0].astype(np.float32)
        self.mean = ((total[self.span[:, 1]] - total[self.span[:, 0]]) / self.size[:, None]).astype(np.float32)
        self.spread = np.sqrt(np.maximum(1 - (self.mean**2).sum(axis=1), 1e-4) / DIMS).astype(np.float32)
        # children follow each other, so a node's are a range
        self.child = np.zeros((len(parent), 2), dtype=np.int64)
        for node in range(1, len(parent)):
            if not self.child[parent[node], 1]:
                self.child[parent[node], 0] = node
            self.child[parent[node], 1] = node + 1
        self.limit = 0.0

    def calibrate(self, k: int, recall: float, sample: int) -> None:
        if len(self.size) == 1 or recall >= 1:
            return
        pick = np.linspace(0, len(self.x) - 1, min(sample, len(self.x))).astype(np.int64)
        own = self.rows[pick]
        q = self.x[pick]
        true, _ = self.search(q, k, own, limit=0.0)
        for limit in LIMITS:
            got, _ = self.search(q, k, own, limit=limit)
            hits = (got[:, :, None] == true[:, None, :]).any(axis=1)
            if hits[true >= 0].mean() >= recall:
                self.limit = limit
                return

    def search(self, q: np.ndarray, k: int, own: np.ndarray | None = None, floor: np.ndarray | None = None, limit: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, similarities) of the k best rows of each query, -1 where there are fewer.

        own: a row of the block that is the query itself.  floor: a similarity
        that a row must exceed.
        """
        limit = self.limit if limit is None else limit
        rows, sims = np.full((len(q), k), -1, dtype=np.int64), np.full((len(q), k), -np.inf, dtype=np.float32)
        place = np.full(int(self.rows.max()) + 1, -1, dtype=np.int64)
        place[self.rows] = np.arange(len(self.rows))
        step = max(64, min(2048, (1 << 21) // len(self.size)))  # so that the queues stay small
        for a in range(0, len(q), step):
            b = min(len(q), a + step)
            mine = place[own[a:b]] if own is not None else np.full(b - a, -1, dtype=np.int64)
            at, s = self._search(np.ascontiguousarray(q[a:b]), k, mine, np.full(b - a, -np.inf, np.float32) if floor is None else floor[a:b].astype(np.float32), limit)
            rows[a:b], sims[a:b] = np.where(at >= 0, self.rows[np.maximum(at, 0)], -1), s
        return rows, sims

    def _search(self, q, k, mine, floor, limit):
        n, nodes = len(q), len(self.size)
        at, sims = np.full((n, k), -1, dtype=np.int64), np.full((n, k), -np.inf, dtype=np.float32)
        # the queues: promise of every node that waits, -inf for others
        queue, mu = np.full((n, nodes), -np.inf, dtype=np.float32), np.zeros((n, nodes), dtype=np.float32)
        queue[:, 0] = 0
        active, width = np.arange(n), 1
        while len(active):
            width = min(width, nodes)
            top = np.argpartition(-queue[active], width - 1, axis=1)[:, :width] if width < nodes else np.broadcast_to(np.arange(nodes), (len(active), nodes))
            who, node = np.repeat(active, top.shape[1]), top.ravel()
            waits = queue[who, node] > -np.inf
            who, node = who[waits], node[waits]
            queue[who, node] = -np.inf
            by_node = np.argsort(node, kind="stable")
            who, node = who[by_node], node[by_node]
            some, first = np.unique(node, return_index=True)
            bar = np.maximum(sims[:, k - 1], floor)
            found = []
            for this, a, b in zip(some, first, np.append(first[1:], len(node)), strict=True):
                own = who[a:b]
                lo, hi = self.child[this]
                if hi:  # an inner node puts its children into the queue
                    m = q[own] @ self.mean[lo:hi].T
                    mu[own, lo:hi], queue[own, lo:hi] = m, m + 3 * self.spread[lo:hi]
                    continue
                lo, hi = self.span[this]
                s = q[own] @ self.x[lo:hi].T
                if hi - lo > 2 * k:  # no row under the leaf's own k + 1 best can count (one may be the query)
                    best = np.partition(s, hi - lo - k - 1, axis=1)[:, hi - lo - k - 1] if np.isneginf(bar[own]).any() else None
                    hit = s > bar[own][:, None] if best is None else s >= np.maximum(bar[own], best)[:, None]
                else:
                    hit = s > bar[own][:, None]
                r, c = np.nonzero(hit)
                if len(r):
                    found.append((own[r], c + lo, s[r, c]))
            if found:
                w, c, s = (np.concatenate(f) for f in zip(*found, strict=True))
                ok = (c != mine[w]) & (s > floor[w])
                w, c, s = w[ok], c[ok], s[ok]
                touched = np.unique(w)
                w = np.concatenate((w, np.repeat(touched, k)))
                c, s = np.concatenate((c, at[touched].ravel())), np.concatenate((s, sims[touched].ravel()))
                rank = np.lexsort((c, -s, w))
                w, c, s = w[rank], c[rank], s[rank]
                pick = np.searchsorted(w, touched)[:, None] + np.arange(k)
                at[touched], sims[touched] = c[pick], s[pick]
            waiting = queue[active] > -np.inf
            go = waiting.any(axis=1)
            if limit > 0:
                bar = np.maximum(sims[active, k - 1], floor[active])
                more = np.where(waiting, self.size * _tail((np.where(np.isfinite(bar), bar, -1)[:, None] - mu[active]) / self.spread), 0).sum(axis=1)
                go &= ~(np.isfinite(bar) & (more < limit))
            active = active[go]
            width *= 2
        return at, sims


def _pairs(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    q, c = np.nonzero(rows >= 0)
    a, b = ids[q], ids[rows[q, c]]
    swap = a > b
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    both = sorted(set(zip(a.tolist(), b.tolist(), strict=True)))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in both], pa.string()), pa.array([x[1] for x in both], pa.string())], names=["id_a", "id_b"])


def _block_tree(x: np.ndarray, k: int, recall: float) -> Tree:
    tree = Tree(x)
    tree.calibrate(k, recall, CALIBRATE)
    return tree


def nearest(memories: DataFrame, k: int = K, recall: float = RECALL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id_a, id_b of the pairs in which one is among the k most similar of the other."""
    rows = usable(memories)
    cells = cells_of_large_scopes(rows, block_rows)

    def single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in block_tables(batches):
            if len(x) > 1:
                found, _ = _block_tree(x, k, recall).search(x, min(k, len(x) - 1), np.arange(len(x)))
                yield _pairs(np.array(part.column("id").to_pylist(), dtype=object), found)

    small = in_scopes(rows, cells, inside=False) if cells else rows
    # scopes don't overlap and a block's pairs are distinct, so no further exchange
    out = blocks(small, {}).mapInArrow(single, "id_a string, id_b string")
    return out.unionByName(_nearest_in_cells(once_usable(in_scopes(rows, cells)), cells, k, recall, block_rows)) if cells else out


def _nearest_in_cells(rows: DataFrame, cells: dict[str, np.ndarray], k: int, recall: float, block_rows: int) -> DataFrame:
    """The same for scopes of several blocks, whose queries also visit other cells."""
    ahead = "scope string, cell int, id string, unit binary, near array<string>, sims array<float>"

    def home(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in block_tables(batches):
            ids = np.array(part.column("id").to_pylist(), dtype=object)
            found, sims = _block_tree(x, k, recall).search(x, k, np.arange(len(x)))
            near = [[ids[j] for j in r if j >= 0] for r in found]
            kept = [[float(s) for j, s in zip(r, t, strict=True) if j >= 0] for r, t in zip(found, sims, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("scope").combine_chunks(), part.column("cell").combine_chunks(), pa.array(ids, pa.string()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(near, pa.list_(pa.string())), pa.array(kept, pa.list_(pa.float32()))], names=["scope", "cell", "id", "unit", "near", "sims"])

    first = cut_lineage(blocks(rows, cells).mapInArrow(home, ahead))
    visits = visits_needed(first, cells, recall, k=k)
    sent = rows.sparkSession.sparkContext.broadcast((cells, visits))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, visits = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                scopes = np.array(batch.column(0).to_pylist(), dtype=object)
                x = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.float32).reshape(-1, DIMS)
                bar = np.array([s[k - 1] if len(s) >= k else -1.0 for s in batch.column(5).to_pylist()], dtype=np.float32)
                for scope in sorted(set(scopes.tolist())):
                    own = np.flatnonzero(scopes == scope)
                    to = visited(x[own], cells[scope], visits[scope])
                    at = np.repeat(own, to.shape[1])
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{scope}\x01{c}" for c in to.ravel()], pa.string()), batch.column(2).take(take), batch.column(3).take(take), pa.array(bar[at])], names=["block", "id", "unit", "bar"])

    guests = cut_lineage(first.mapInArrow(route, "block string, id string, unit binary, bar float"))
    # a block that many visit is copied, so that no task gets an unbounded number; copies are a share of the visits
    crowds = guests.groupBy("block").agg(F.ceil(F.count("*") / (MOST_VISITORS * block_rows)).cast("int").alias("chunks"))  # a row for each cell
    members = first.select(F.concat_ws("\x01", "scope", "cell").alias("block"), "id", "unit").join(F.broadcast(crowds), "block")
    members = members.select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("query"), "id", "unit", F.lit(0.0).cast("float").alias("bar"))
    asking = guests.join(F.broadcast(crowds), "block").select("block", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("query"), "id", "unit", "bar")
    routed = members.unionByName(asking).withColumn("block", F.concat_ws("\x01", "block", "chunk")).drop("chunk")

    def abroad(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "block", least_rows=1):
            blocks_of = np.array(part.column("block").to_pylist(), dtype=object)
            asks = np.array(part.column("query").to_pylist(), dtype=bool)
            ids, units, bars = np.array(part.column("id").to_pylist(), dtype=object), part.column("unit").to_pylist(), part.column("bar").to_numpy()
            for block in sorted(set(blocks_of.tolist())):
                q, m = (np.flatnonzero((blocks_of == block) & (asks == side)) for side in (True, False))
                if not len(q) or not len(m):
                    continue
                qx, mx = (np.frombuffer(b"".join(units[i] for i in side), dtype=np.float32).reshape(-1, DIMS) for side in (q, m))
                found, sims = _block_tree(mx, k, recall).search(qx, k, None, bars[q])
                r, c = np.nonzero(found >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[r]], pa.string()), pa.array(ids[m[found[r, c]]], pa.string()), pa.array(sims[r, c])], names=["id", "other", "sim"])

    foreign = routed.repartition(partitions(rows), "block").sortWithinPartitions("block").mapInArrow(abroad, "id string, other string, sim float")
    own = first.select("id", F.explode(F.arrays_zip("near", "sims")).alias("z")).select("id", F.col("z.near").alias("other"), F.col("z.sims").alias("sim"))
    best = own.unionByName(foreign).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))).where(F.col("n") <= k)
    return best.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "memories"))
