"""Pairs of similar vectors within a group, by tiles.

A group is cut into blocks of about ``BLOCK`` rows; every two blocks meet in one
task, which multiplies their matrices.  No task holds more than two blocks, so a
group may be as large as it likes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.batches import borders, whole_groups
from quern.session import partitions

BLOCK = 4096


def unit_matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Unit rows; rows that aren't finite or are zero become zero, which is similar to nothing."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x[~np.isfinite(x).all(axis=1)] = 0
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def similar_pairs(rows: DataFrame, threshold: float, dims: int, group: str = "scope", block: int = BLOCK) -> DataFrame:
    """group, id_a, id_b, similarity (id_a < id_b) of rows (id, group, vector) with that cosine or more.

    Vectors of another length are left out; rows without a group form one of their own.
    """
    kept = rows.where(F.col("id").isNotNull() & (F.size("vector") == dims)).select("id", F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"), F.col("vector").cast("array<double>").alias("vector"))
    large = {r[0]: -(-r[1] // block) for r in kept.groupBy("grp").count().where(F.col("count") > block).collect()}  # at most rows/block groups
    blocks = F.lit(1)
    for name, n in large.items():
        blocks = F.when(F.col("grp") == name, n).otherwise(blocks)
    placed = kept.withColumn("n", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    keyed = met.select(F.concat_ws("\x01", "grp", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "grp", (F.col("own") > F.col("other")).alias("second"), (F.col("own") == F.col("other")).alias("whole"), "id", "vector")

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "key", least_rows=1):
            codes = part.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
            edge = borders(codes)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                own = part.slice(a, b - a)
                x = unit_matrix(own.column("vector").combine_chunks(), dims)
                ids = np.array(own.column("id").to_pylist(), dtype=object)
                side = own.column("second").combine_chunks().to_numpy(zero_copy_only=False)
                if own.column("whole")[0].as_py():
                    left = right = np.arange(len(x))
                else:
                    left, right = np.flatnonzero(~side), np.flatnonzero(side)
                for at in range(0, len(left), 1024):
                    rows_at = left[at : at + 1024]
                    s = x[rows_at] @ x[right].T
                    i, j = np.nonzero(s >= threshold)
                    p, q = ids[rows_at[i]], ids[right[j]]
                    ok = p < q if left is right else np.ones(len(p), dtype=bool)
                    p, q, sim = p[ok], q[ok], s[i, j][ok]
                    if len(p):
                        swap = p > q
                        lo, hi = np.where(swap, q, p), np.where(swap, p, q)
                        yield pa.RecordBatch.from_arrays([pa.array([own.column("grp")[0].as_py()] * len(p)), pa.array(lo, pa.string()), pa.array(hi, pa.string()), pa.array(sim)], names=["grp", "id_a", "id_b", "similarity"])

    width = partitions(rows)
    return keyed.repartition(width, "key").sortWithinPartitions("key").mapInArrow(multiply, "grp string, id_a string, id_b string, similarity double").withColumnRenamed("grp", group)


def seed_clusters(rows: DataFrame, threshold: float = 0.88, dims: int = 64) -> DataFrame:
    """scope, seed, id: clusters around seeds, the most important row first, ties by id.

    The walk over all rows is the same as rounds in which every open row that comes
    before all its open neighbours becomes a seed and takes those of its open
    neighbours that no earlier open row can reach; here pairs come from tiles, and
    rounds go on until no pair of open rows is left.  Rows alone are left out.
    """
    from quern.session import cut_lineage

    pairs = similar_pairs(rows, threshold, dims)
    rank = rows.select("id", F.struct((-F.coalesce("importance", F.lit(0.0))).alias("i"), "id").alias("r"))
    both = pairs.select("scope", F.col("id_a").alias("src"), F.col("id_b").alias("dst")).unionByName(pairs.select("scope", F.col("id_b").alias("src"), F.col("id_a").alias("dst")))
    live = cut_lineage(both.join(rank.select(F.col("id").alias("src"), F.col("r").alias("rs")), "src").join(rank.select(F.col("id").alias("dst"), F.col("r").alias("rd")), "dst").select("scope", "src", "dst", "rs", "rd"))
    out = None
    while True:  # at least the first open row becomes a seed in every round
        seeds = live.groupBy("scope", "src", "rs").agg(F.min("rd").alias("first")).where("rs < first").select("scope", F.col("src").alias("seed"), F.col("rs").alias("rank"))
        # an open row goes to the earliest seed that it is similar to, which is earlier than itself
        taken = live.join(seeds.select(F.col("seed").alias("dst")), "dst", "left_semi").groupBy("scope", "src").agg(F.min("rd").alias("by")).select("scope", F.col("by.id").alias("seed"), F.col("src").alias("id"))
        # rows whose earliest open neighbour is no seed of this round must wait, for that one may become an earlier seed
        wait = live.where("rd < rs").groupBy("src").agg(F.min("rd").alias("first")).join(seeds.select(F.col("seed").alias("s")), F.col("first.id") == F.col("s"), "left_anti").select(F.col("src").alias("id"))
        new = cut_lineage(taken.join(wait, "id", "left_anti").select("scope", "seed", "id"))
        out = new if out is None else out.unionByName(new)
        # a seed is done once none of its open neighbours waits; till then it stays, so that they can come to it
        gone = new.select("id")
        rest = live.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
        live = cut_lineage(rest.select("scope", "src", "dst", "rs", "rd"))
        if live.isEmpty():
            break
    seeds = out.select("scope", "seed", F.col("seed").alias("id")).distinct()
    return out.unionByName(seeds)
