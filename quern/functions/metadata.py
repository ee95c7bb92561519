"""The open metadata of a memory as a fixed set of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import clamp01, count_of, finite
from quern.functions.text import ascii_borders, fact_key, non_empty

# The enumerations of the store.
CATEGORIES = ("profile", "preferences", "entities", "events", "cases", "patterns")
STORE_CATEGORIES = ("preference", "fact", "decision", "entity", "other", "reflection")
TIERS = ("core", "working", "peripheral")
STATES = ("pending", "confirmed", "archived")
SOURCES = ("manual", "auto-capture", "reflection", "session-summary", "legacy")
LAYERS = ("durable", "working", "reflection", "archive")
PROFILE_WORDS = r"(?i)\b(my |i am |i'm |name is |叫我|我的|我是)\b"


def one_of(c: Column, names: tuple[str, ...], default: Column | str) -> Column:
    return F.when(c.isin(*names), c).otherwise(default if isinstance(default, Column) else F.lit(default))


def memory_category_of(category: Column, text: Column) -> Column:
    """The six-way category that an older store category stands for."""
    fact = F.when(text.rlike(ascii_borders(PROFILE_WORDS)) & (F.length(text) < 200), "profile").otherwise("cases")
    return F.when(category == "preference", "preferences").when(category == "entity", "entities").when(category == "decision", "events").when(category == "fact", fact).otherwise("patterns")


def store_category_of(memory_category: Column) -> Column:
    known = {"profile": "fact", "preferences": "preference", "entities": "entity", "events": "decision", "cases": "fact", "patterns": "other"}
    out = F.lit("other")
    for name, store in known.items():
        out = F.when(memory_category == name, store).otherwise(out)
    return out


def default_importance(memory_category: Column) -> Column:
    out = F.lit(0.5)
    for name, value in {"profile": 0.9, "preferences": 0.8, "entities": 0.7, "events": 0.6, "cases": 0.8, "patterns": 0.85}.items():
        out = F.when(memory_category == name, value).otherwise(out)
    return out


def memory_type_of(memory_category: Column, category: Column) -> Column:
    return (
        F.when(memory_category.isin("profile", "preferences", "entities", "patterns"), "knowledge").when(memory_category.isin("events", "cases"), "experience")
        .when(category.isin("preference", "entity", "fact"), "knowledge").when(category.isin("decision", "reflection"), "experience").otherwise("knowledge")
    )


def normalized(memories: DataFrame) -> DataFrame:
    """One row per id (the first loaded) with its metadata as columns, defaults filled in.

    Broken or odd metadata counts as empty; null scopes and empty ones read as
    ``global``; null numbers of the row itself read as 0.
    """
    rows = memories
    if "loaded_at" in memories.columns:
        first = F.row_number().over(Window.partitionBy("id").orderBy("loaded_at"))
        rows = memories.withColumn("_n", first).where("_n = 1").drop("_n")
    rows = rows.withColumn("_v", F.try_parse_json("metadata"))
    get = lambda name, kind="string": F.try_variant_get("_v", f"$.{name}", kind)
    positive = lambda name: F.when(finite(get(name, "double")) > 0, F.floor(get(name, "double"))).cast("bigint")
    text, stamp = F.coalesce("text", F.lit("")), F.coalesce(F.col("timestamp").cast("bigint"), F.lit(0))
    source_default = F.when(get("type") == "session-summary", "session-summary").when(get("type").isin("memory-reflection", "memory-reflection-item"), "reflection").otherwise("legacy")
    scope = F.when(F.coalesce("scope", F.lit("")) == "", "global").otherwise(F.col("scope"))
    base = rows.select(
        "id", text.alias("text"), "vector", "category", scope.alias("scope"), F.coalesce("importance", F.lit(0.0)).alias("importance"), stamp.alias("timestamp"), "metadata", "_v",
        memory_category_of(F.col("category"), text).alias("_cat"), one_of(F.coalesce(get("source"), source_default), SOURCES, "legacy").alias("source"), F.coalesce(non_empty(get("l0_abstract")), text).alias("l0"),
        F.coalesce(positive("valid_from"), stamp).alias("valid_from"), positive("invalidated_at").alias("_inv"),
    )
    base = base.withColumn("state", one_of(F.coalesce(get("state"), F.when(F.col("source") == "session-summary", "archived").otherwise("confirmed")), STATES, "confirmed"))
    layer = F.when(F.col("source").isin("reflection", "session-summary"), "reflection").when(F.col("state") == "archived", "archive").when(F.col("_cat").isin("profile", "preferences", "events"), "durable").otherwise("working")
    base = base.withColumn("memory_category", F.coalesce(get("memory_category"), F.col("_cat")))
    return base.select(
        "id", "text", "vector", "category", "scope", "importance", "timestamp", "metadata", "source", "state", "l0", "valid_from", "memory_category",
        F.when(get("memory_layer").isNull(), layer).otherwise(one_of(get("memory_layer"), LAYERS, "working")).alias("layer"),
        F.coalesce(non_empty(get("l1_overview")), F.concat(F.lit("- "), F.col("l0"))).alias("l1"), F.coalesce(non_empty(get("l2_content")), F.col("text")).alias("l2"),
        F.when(get("memory_type").isin("knowledge", "experience"), get("memory_type")).otherwise(memory_type_of(F.col("memory_category"), F.col("category"))).alias("memory_type"),
        one_of(get("tier"), TIERS, "working").alias("tier"), count_of(get("access_count", "double")).alias("access_count"), clamp01(get("confidence", "double"), 0.7).alias("confidence"),
        count_of(get("last_accessed_at", "double"), F.col("timestamp")).alias("last_accessed_at"), F.when(F.col("_inv") >= F.col("valid_from"), F.col("_inv")).alias("invalidated_at"), positive("valid_until").alias("valid_until"),
        F.when(get("memory_temporal_type").isin("static", "dynamic"), get("memory_temporal_type")).alias("temporal_type"), F.coalesce(non_empty(get("fact_key")), fact_key(F.col("memory_category"), F.col("l0"))).alias("fact_key"),
        non_empty(get("supersedes")).alias("supersedes"), non_empty(get("superseded_by")).alias("superseded_by"), non_empty(get("canonical_id")).alias("canonical_id"), get("source_session").alias("source_session"),
        count_of(get("injected_count", "double")).alias("injected_count"), count_of(get("bad_recall_count", "double")).alias("bad_recall_count"), count_of(get("suppressed_until_turn", "double")).alias("suppressed_until_turn"),
        get("suppressed_session_key").alias("suppressed_session_key"), positive("suppressed_until_at").alias("suppressed_until_at"), (F.coalesce(get("compacted", "boolean"), F.lit(False))).alias("compacted"), count_of(get("source_count", "double"), -1).alias("source_count"), F.coalesce(get("noise", "boolean"), F.lit(False)).alias("noise"),
    )


def active_at(at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return (F.col("valid_from") <= at) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > at))


def expired(at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.coalesce(F.col("valid_until") <= at, F.lit(False))


def patched(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """Normalised rows with the given columns of ``patches`` (id and others) laid over; of several patches the last ``seq`` wins."""
    order = Window.partitionBy("id").orderBy(F.desc("seq"))
    last = patches.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "seq")
    names = [c for c in last.columns if c != "id"]
    over = last.select("id", *(F.col(c).alias(f"_{c}") for c in names))
    out = rows.join(over, "id", "left")
    for c in names:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.drop(*(f"_{c}" for c in names))
