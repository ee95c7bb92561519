"""Scores of memories: decay, half-lives, boosts and confidence.

Every function takes the clock as an argument and works on normalised rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import MS_PER_DAY, clamp01

LN2 = 0.6931471805599453


def days_since(at: Column, now: int) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(now) - at) / MS_PER_DAY)


def decay(rows: DataFrame, now: int, half_life: float = 30.0, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), modulation: float = 1.5, betas: tuple[float, float, float] = (0.8, 1.0, 1.3), multipliers: tuple[float, float] = (3.0, 0.7)) -> DataFrame:
    """Adds recency, frequency, intrinsic and composite.

    Recency is a stretched exponential whose half-life grows with importance and
    by kind of memory; frequency saturates and counts less for wide gaps.
    """
    last = F.when(F.col("access_count") > 0, F.col("last_accessed_at")).otherwise(F.col("timestamp"))
    base = F.when(F.col("temporal_type") == "dynamic", half_life / 3).otherwise(half_life)
    base = base * F.when(F.col("memory_type") == "knowledge", multipliers[0]).when(F.col("memory_type") == "experience", multipliers[1]).otherwise(1.0)
    weight = clamp01(F.col("importance"), 0.7)
    beta = F.when(F.col("tier") == "core", betas[0]).when(F.col("tier") == "peripheral", betas[2]).otherwise(betas[1])
    recency = F.exp(-LN2 / (base * F.exp(modulation * weight)) * F.pow(days_since(last, now), beta))
    n = F.col("access_count").cast("double")
    span = F.greatest(F.lit(1.0), (last - F.col("timestamp")) / MS_PER_DAY)
    bonus = F.exp(-(span / F.greatest(n - 1, F.lit(1.0))) / 30)
    frequency = F.when(n <= 1, 1 - F.exp(-n / 5)).otherwise((1 - F.exp(-n / 5)) * (0.5 + 0.5 * bonus))
    out = rows.withColumns({"recency": recency, "frequency": frequency, "intrinsic": weight * F.col("confidence")})
    return out.withColumn("composite", weights[0] * F.col("recency") + weights[1] * F.col("frequency") + weights[2] * F.col("intrinsic"))


def decay_boost(score: Column, composite: Column, tier: Column) -> Column:
    floor = F.when(tier == "core", 0.9).when(tier == "working", 0.7).otherwise(0.5)
    return score * F.greatest(F.lit(0.3), F.least(F.lit(1.0), 0.3 + 0.7 * F.greatest(floor, composite)))


def effective_half_life(base: float, access_count: Column, last_accessed_at: Column, now: int, factor: float = 0.5, most: float = 3.0) -> Column:
    """Half-life lengthened by fresh accesses, at most ``most`` times."""
    fresh = F.exp(-days_since(last_accessed_at, now) * (LN2 / 30))
    longer = F.least(F.lit(base) + base * factor * F.log1p(access_count * fresh), F.lit(base * most))
    return F.when((F.lit(factor) == 0) | (access_count <= 0), base).otherwise(longer)


def time_decay(score: Column, age_days: Column, half_life: Column) -> Column:
    return score * (0.5 + 0.5 * F.exp(-age_days / half_life))


def fallback_score(score: Column, importance: Column, age_days: Column, half_life: float = 14.0) -> Column:
    if half_life <= 0:
        return score
    return score * (0.5 + 0.5 * F.exp(-age_days / half_life)) * (0.7 + 0.3 * importance)


def recency_composite(score: Column, importance: Column, age_days: Column, half_life: Column, effective: Column) -> Column:
    return score * F.pow(F.lit(2.0), -age_days / half_life) * (0.7 + 0.3 * importance) * (0.5 + 0.5 * F.exp(-age_days / effective))


def length_norm(score: Column, text: Column, anchor: int = 500) -> Column:
    """Texts longer than the anchor count less; short ones count no more."""
    if anchor <= 0:
        return score
    ratio = F.log2(F.greatest(F.length(text) / F.lit(float(anchor)), F.lit(1.0)))
    return clamp01(score / (1 + 0.5 * ratio))


def confidence(score: Column, now: int) -> Column:
    """Confidence of a result from its score, age, accesses and own confidence."""
    age = (F.lit(now) - F.col("timestamp")) / MS_PER_DAY
    value = clamp01(score) * 0.5 + F.exp(-0.693 * age / 30) * 0.2 + F.least(F.lit(1.0), F.log2(1 + F.col("access_count")) / 3.32) * 0.15 + F.when(F.col("confidence") == 0, 0.7).otherwise(F.col("confidence")) * 0.15
    return clamp01(value)


def _where_any(value: Column) -> Column:
    """Rows that have a value, with it.

    A filter on the value would be pushed below the scores and repeat their long
    expressions there until they no longer compile; a generator is not.
    """
    return F.explode(F.filter(F.array(value), lambda x: x.isNotNull()))


def tier_transitions(scored: DataFrame, now: int) -> DataFrame:
    """id, from_tier, to_tier of rows with a composite that change their tier."""
    age = (F.lit(now) - F.col("timestamp")) / MS_PER_DAY
    n, c, i = F.col("access_count"), F.col("composite"), F.col("importance")
    to = (
        F.when((F.col("tier") == "peripheral") & ((i >= 0.95) & (n >= 1) | (n >= 3) & (c >= 0.4)), "working")
        .when((F.col("tier") == "working") & (n >= 10) & (c >= 0.7) & (i >= 0.8), "core")
        .when((F.col("tier") == "working") & ((c < 0.15) | (age > 60) & (n < 3)), "peripheral")
        .when((F.col("tier") == "core") & (c < 0.15) & (n < 3), "working")
    )
    return scored.select("id", F.col("tier").alias("from_tier"), _where_any(to).alias("to_tier"))


def archive_reasons(scored: DataFrame, now: int, threshold: float = 0.15) -> DataFrame:
    """id, reason of rows that the life cycle would archive, the first reason that applies."""
    from quern.functions.metadata import expired

    bad, c = F.col("bad_recall_count"), F.col("composite")
    reason = (
        F.when(expired(now), "expired").when(F.col("superseded_by").isNotNull(), F.when(F.col("compacted"), "superseded_fragment").otherwise("superseded"))
        .when((bad >= 3) & (c < max(threshold, 0.3)), "bad_recall").when(F.col("compacted") & (F.col("source_count") == 0), "duplicate_cluster_source").when(F.col("noise"), "noise")
        .when((c < threshold) & (F.col("tier") == "peripheral") & (F.col("access_count") == 0), "stale_unaccessed").when((bad >= 5) & (c < 0.5) & (F.col("tier") != "core"), "bad_recall")
    )
    skip = (F.col("state") == "archived") | (F.col("layer") == "archive") | (F.col("source") == "session-summary")
    return scored.where(~skip).select("id", _where_any(reason).alias("reason"))


def contradictions(rows: DataFrame) -> DataFrame:
    """id, newest_id of active facts that a newer, no less confident one of the same key and scope contradicts."""
    from pyspark.sql import Window

    w = Window.partitionBy("scope", "fact_key").orderBy(F.desc("timestamp"), F.desc("confidence"), "id")
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    keyed = rows.where(F.col("fact_key").isNotNull() & F.col("memory_category").isin("preferences", "entities") & (F.col("state") != "archived"))
    seen = keyed.withColumns({"newest_id": first("id"), "newest_l0": first("l0"), "newest_conf": first("confidence")})
    return seen.where((F.col("id") != F.col("newest_id")) & (F.col("l0") != F.col("newest_l0")) & (F.col("newest_conf") >= F.col("confidence"))).select("id", "newest_id")


def contradiction_plan(rows: DataFrame) -> DataFrame:
    """id, newest_id of preferences, entities and patterns that a newer, no less confident row of their scope and topic contradicts.

    The topic is the fact's key, else the standing rule that a text states, else the
    canonical id. The newest of a topic contradicts an older row of the same fact
    with another abstract, of an opposite rule, or of the same canonical id.
    """
    from quern.functions.lines import conflicting, governance_rule

    c = F.col("memory_category")
    rule = F.when(c.isin("patterns", "preferences"), governance_rule(F.col("l0")))
    named = F.when(c.isin("patterns", "preferences"), F.col("canonical_id"))
    keyed = rows.where(c.isin("preferences", "entities", "patterns") & (F.col("state") != "archived")).withColumn("rule", rule)
    topic = F.coalesce(F.when(c.isin("preferences", "entities"), F.col("fact_key")), F.col("rule")["topic"], named)
    keyed = keyed.withColumn("topic", topic).where("topic is not null")
    w = Window.partitionBy("scope", "topic").orderBy(F.desc("timestamp"), F.desc("confidence"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    new = F.first(F.struct("id", "l0", "confidence", "fact_key", "canonical_id", "rule")).over(w)
    both = keyed.withColumn("new", new).where((F.col("id") != F.col("new.id")) & F.col("superseded_by").isNull() & (F.col("new.confidence") >= F.col("confidence")))
    other = F.col("l0") != F.col("new.l0")
    same_fact = c.isin("preferences", "entities") & (F.col("fact_key") == F.col("new.fact_key")) & other
    same_id = ~c.isin("patterns", "preferences") & (F.col("canonical_id") == F.col("new.canonical_id")) & other
    hit = F.coalesce(same_fact, F.lit(False)) | (c.isin("patterns", "preferences") & conflicting(F.col("rule"), F.col("new.rule"))) | F.coalesce(same_id, F.lit(False))
    return both.where(hit).select("id", F.col("new.id").alias("newest_id"))


def reflection_score(age_days: Column, midpoint: Column, k: Column, weight: Column, quality: Column, fallback: Column) -> Column:
    """Logistic decay around a midpoint of days."""
    return 1 / (1 + F.exp(k * (age_days - midpoint))) * weight * quality * F.when(fallback, 0.75).otherwise(1.0)


def derived_line_quality(n: Column) -> Column:
    return F.when(n <= 0, 0.2).otherwise(F.least(F.lit(1.0), 0.55 + 0.075 * F.least(F.lit(6), n)))
