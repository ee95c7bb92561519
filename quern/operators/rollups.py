"""Counts and summaries for dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import MS_PER_DAY, round_half_up
from quern.functions.text import reason_key


def store_stats(rows: DataFrame, now: int) -> DataFrame:
    """kind, key, n: counts by scope, category, memory category and layer, and of all, in one pass."""
    day = lambda n: F.count_if(F.col("timestamp") >= now - n * MS_PER_DAY)
    sets = rows.select("scope", "category", "memory_category", "layer", "timestamp", "bad_recall_count", "confidence")
    exploded = sets.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k), F.lit("(none)")).alias("key")) for k in ("scope", "category", "memory_category", "layer")))).alias("x"))
    counts = exploded.groupBy("x.kind", "x.key").agg(F.count("*").alias("n"))
    total = sets.agg(F.count("*").alias("total"), day(1).alias("new_24h"), day(7).alias("new_7d"), day(30).alias("new_30d"), F.count_if(F.col("bad_recall_count") > 0).alias("bad_recall"), F.count_if(F.col("confidence") < 0.4).alias("low_confidence"))
    names = total.columns
    flat = total.select(F.explode(F.array(*(F.struct(F.lit("all").alias("kind"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in names))).alias("x")).select("x.*")
    return counts.unionByName(flat)


def traces(telemetry: DataFrame) -> DataFrame:
    """One row per trace, the first recorded."""
    return telemetry.withColumn("_n", F.row_number().over(Window.partitionBy("trace_id").orderBy("recorded_at"))).where("_n = 1").drop("_n")


def retrieval_stats(telemetry: DataFrame) -> DataFrame:
    """One row: queries, empty results, mean and 95th-percentile latency, mean results."""
    return traces(telemetry).selectExpr(
        "count(*) AS queries", "count_if(final_count = 0) AS zero_results", "cast(floor(avg(total_ms) + 0.5) AS bigint) AS avg_ms",
        "cast(percentile_disc(0.95) WITHIN GROUP (ORDER BY total_ms) AS bigint) AS p95_ms", "floor(avg(final_count) * 10 + 0.5) / 10 AS avg_results",
        "count_if(exists(coalesce(stages, array()), s -> s.name = 'rerank')) AS reranked",
    )


def by_source(telemetry: DataFrame) -> DataFrame:
    return traces(telemetry).groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count("*").alias("queries"), F.count_if(F.col("final_count") == 0).alias("zero_results"), round_half_up(F.avg("total_ms")).alias("avg_ms"))


def drops(telemetry: DataFrame) -> DataFrame:
    """stage, dropped, traces: rows lost in each stage over all traces, where any were."""
    s = traces(telemetry).select("trace_id", F.explode("stages").alias("s")).select("trace_id", F.col("s.name").alias("stage"), (F.col("s.input_count") - F.col("s.output_count")).alias("lost"))
    return s.where("lost > 0").groupBy("stage").agg(F.sum("lost").alias("dropped"), F.count_distinct("trace_id").alias("traces"))


def drop_summary(telemetry: DataFrame) -> DataFrame:
    """trace_id, stage, before, after, dropped, place: each trace's losses, the greatest first."""
    s = traces(telemetry).select("trace_id", F.posexplode("stages").alias("pos", "s"))
    lost = s.select("trace_id", "pos", F.col("s.name").alias("stage"), F.col("s.input_count").alias("before"), F.col("s.output_count").alias("after"), (F.col("s.input_count") - F.col("s.output_count")).alias("dropped")).where("dropped > 0")
    return lost.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("dropped"), "pos"))).drop("pos")


def duration_summary(telemetry: DataFrame) -> DataFrame:
    """Per source: mean, nearest-rank percentiles, least and greatest duration, share of empty results."""
    return traces(telemetry).groupBy(F.coalesce("source", F.lit("(none)")).alias("path")).agg(
        F.expr("floor(avg(total_ms) * 10 + 0.5) / 10").alias("avg_ms"), F.expr("cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY total_ms) AS bigint)").alias("p50_ms"), F.expr("cast(percentile_disc(0.95) WITHIN GROUP (ORDER BY total_ms) AS bigint)").alias("p95_ms"),
        F.min("total_ms").alias("min_ms"), F.max("total_ms").alias("max_ms"), F.expr("round(count_if(final_count = 0) / count(*), 3)").alias("zero_rate"),
    )


def regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Paths whose 95th percentile is over 1.25 times and over 5 ms more than the baseline's."""
    base = baseline.select("path", F.col("p95_ms").alias("base_ms"))
    return current.select("path", "p95_ms").join(base, "path").where((F.col("base_ms") > 0) & (F.col("p95_ms") > F.greatest(F.col("base_ms") * 1.25, F.col("base_ms") + 5)))


def top_reasons(rows: DataFrame, reason: str, order: str, n: int = 5) -> DataFrame:
    """The most frequent reasons; numbers in them don't count, the first wording stands for all."""
    keyed = rows.where(F.col(reason).isNotNull()).groupBy(reason_key(F.col(reason)).alias("key")).agg(F.count("*").alias("n"), F.min_by(reason, order).alias("label"))
    return keyed.orderBy(F.desc("n"), "label").limit(n).select("label", "n")


def scope_kinds(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("scope") == "global", "global").when(F.contains(F.col("scope"), F.lit(":")), F.substring_index("scope", ":", 1)).otherwise("other")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("scope").alias("scopes"))


def legacy_counts(rows: DataFrame) -> DataFrame:
    """category, n of rows whose metadata names no memory category."""
    lacks = F.try_variant_get(F.try_parse_json("metadata"), "$.memory_category", "string").isNull()
    return rows.where(lacks).groupBy(F.coalesce("category", F.lit("(none)")).alias("category")).agg(F.count("*").alias("n"))


def role_counts(messages: DataFrame) -> DataFrame:
    return messages.dropDuplicates(["msg_id"]).where("type = 'message'").groupBy(F.lower(F.trim(F.coalesce("role", F.lit("")))).alias("role")).agg(F.count("*").alias("n"))


def adapted_priors(observed: DataFrame, priors: DataFrame, least: int = 10, rate: float = 0.1, most: float = 0.15) -> DataFrame:
    """category, prior: moved by the share of admitted candidates, within bounds."""
    share = F.col("admitted") / F.col("total")
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(F.col("prior") - most, F.least(F.col("prior") + most, F.col("prior") + rate * (share - 0.5)))))
    return priors.join(observed, "category", "left").select("category", F.when(F.col("total") >= least, moved).otherwise(F.col("prior")).alias("prior"))
