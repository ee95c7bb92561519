"""Scans, lookups and changes of the table of memories."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import clamp01
from quern.functions.text import trimmed

LIST_COLUMNS = ("id", "text", "category", "scope", "importance", "timestamp", "metadata")


def scope_filter(scopes: list[str] | None) -> Column:
    """Rows of the scopes, and those without one; no scopes at all match nothing, ``None`` everything."""
    if scopes is None:
        return F.lit(True)
    if not scopes:
        return F.lit(False)
    return F.col("scope").isin(*scopes) | F.col("scope").isNull()


def all_of(conditions: list[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def time_range(low: int | None = None, high: int | None = None) -> Column:
    return all_of([F.col("timestamp") >= low if low is not None else None, F.col("timestamp") < high if high is not None else None])


def list_newest(rows: DataFrame, scopes: list[str] | None = None, category: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first, ties by id."""
    kept = rows.where(all_of([scope_filter(scopes), F.col("category") == category if category else None]))
    return kept.orderBy(F.desc("timestamp"), "id").offset(offset).limit(limit)


def by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the ids; the plan broadcasts the smaller side where statistics say that it is small."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def by_id_or_prefix(rows: DataFrame, ref: str) -> DataFrame:
    """The row of an id, or the one row whose id starts with at least eight hexadecimal signs."""
    exact = rows.where(F.col("id") == ref)
    if not re.fullmatch(r"[0-9a-fA-F-]{8,}", ref):
        return exact
    hits = rows.where(F.col("id").startswith(ref.lower()))
    n = hits.limit(2).count()
    if n > 1 and exact.isEmpty():
        raise ValueError(f"{ref} is the start of several ids")
    return hits if n == 1 else exact


def present(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """id, found for every asked id."""
    return ids.select("id").distinct().join(rows.select("id", F.lit(True).alias("found")).distinct(), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def legacy_columns(rows: DataFrame) -> DataFrame:
    """Columns that older tables lack, with their defaults."""
    for name, value in (("scope", F.lit("global")), ("timestamp", F.col("createdAt").cast("bigint") if "createdAt" in rows.columns else F.lit(0).cast("bigint")), ("metadata", F.lit("{}"))):
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    return rows


def mapped(rows: DataFrame) -> DataFrame:
    """Rows as a reader sees them: defaults, and 0 for vector entries that aren't finite."""
    value = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double"))
    return rows.select(
        "id", "text", F.transform(F.coalesce("vector", F.array().cast("array<float>")), value).alias("vector"), "category", F.coalesce("scope", F.lit("global")).alias("scope"),
        F.coalesce("importance", F.lit(0.0)).alias("importance"), F.coalesce("timestamp", F.lit(0)).alias("timestamp"), F.when(F.coalesce("metadata", F.lit("")) == "", "{}").otherwise(F.col("metadata")).alias("metadata"),
    )


def importable(rows: DataFrame, now: int) -> DataFrame:
    """Rows of an import that are valid: two characters or more, known category, bounded importance, a time."""
    known = ("preference", "fact", "decision", "entity", "other", "reflection")
    return rows.where(F.length(trimmed(F.col("text"))) >= 2).select(
        "id", trimmed(F.col("text")).alias("text"), F.when(F.col("category").isin(*known), F.col("category")).otherwise("other").alias("category"),
        clamp01(F.col("importance"), 0.7).alias("importance"), F.when(F.col("timestamp") > 0, F.col("timestamp")).otherwise(F.lit(now)).cast("bigint").alias("timestamp"),
    )


def new_only(incoming: DataFrame, rows: DataFrame) -> DataFrame:
    return incoming.join(rows.select("id"), "id", "left_anti")


def upsert(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` replace rows of the same id and add the others; of several the last ``seq`` counts."""
    if "seq" in changes.columns:
        changes = changes.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).where("_n = 1").drop("_n", "seq")
    return rows.join(changes.select("id"), "id", "left_anti").unionByName(changes.select(*rows.columns))


def bulk_delete(rows: DataFrame, scopes: list[str] | None = None, before: int | None = None) -> DataFrame:
    """What stays; at least one condition is needed."""
    if scopes is None and before is None:
        raise ValueError("deleting needs scopes or a time")
    gone = all_of([F.col("scope").isin(*scopes) if scopes is not None else None, F.col("timestamp") < before if before is not None else None])
    return rows.where(~F.coalesce(gone, F.lit(False)))


def supersede(rows: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """Versions: each change (old_id, id, text) ends the old row and adds a new one that is valid from now.

    rows: normalised rows. The result has both, with the relation in both directions.
    """
    asked = changes.select("old_id", F.col("id").alias("new_id"), F.col("text").alias("new_text"))
    hit = rows.join(asked, rows.id == asked.old_id, "inner")
    ended = hit.withColumn("invalidated_at", F.lit(now).cast("bigint")).withColumn("superseded_by", F.col("new_id")).select(*rows.columns)
    fresh = (
        hit.withColumn("supersedes", F.col("old_id")).withColumn("id", F.col("new_id")).withColumn("text", F.col("new_text")).withColumn("l0", F.col("new_text")).withColumn("timestamp", F.lit(now).cast("bigint"))
        .withColumn("valid_from", F.lit(now).cast("bigint")).withColumn("superseded_by", F.lit(None).cast("string")).withColumn("invalidated_at", F.lit(None).cast("bigint")).select(*rows.columns)
    )
    return rows.join(asked.select(F.col("old_id").alias("id")), "id", "left_anti").unionByName(ended).unionByName(fresh)


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """id, keep_id of rows that say the same under one category: the newest stays."""
    key = F.concat_ws(":", "memory_category", F.lower(trimmed(F.regexp_replace("l0", r"\s+", " "))))
    w = Window.partitionBy("key").orderBy(F.desc("timestamp"), "id")
    ranked = rows.withColumn("key", key).where(trimmed(F.col("l0")) != "").withColumn("n", F.row_number().over(w)).withColumn("keep_id", F.first("id").over(w))
    return ranked.where("n > 1").select("id", "keep_id")
