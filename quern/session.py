"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only where the cluster names none (tests, a laptop) a temporary folder of
    this machine is set, since there driver and executors share one disk.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quern-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy.

    A lost executor then costs a read, not a recomputation of all steps before.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions set for this session, which follow the input's size."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
