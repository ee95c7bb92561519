"""The registered queries of the store, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import classify, metadata, numbers, text
from quern.operators import greedy, pairs, rollups, scoring, search, store
from quern.plans.reference_sql import DECAY, NOW, with_mem
from quern.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = numbers.MS_PER_DAY
ONCE = "(SELECT * FROM memories QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def once(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows, each id once."""
    rows = table(spark, d, "memories")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("loaded_at"))).where("_n = 1").drop("_n", "loaded_at")


def mem(spark: SparkSession, d: str) -> DataFrame:
    return metadata.normalized(table(spark, d, "memories"))


def decayed(spark: SparkSession, d: str) -> DataFrame:
    return scoring.decay(mem(spark, d), NOW)


def r6(c) -> F.Column:
    return F.round(c, 6)


# ---- scans and lookups


@query(f"SELECT id, text, category, scope, importance, timestamp, metadata FROM {ONCE} WHERE scope IN ('agent:main', 'global') OR scope IS NULL ORDER BY timestamp DESC NULLS LAST, id LIMIT 50 OFFSET 10")
def store_list_newest(spark, d):
    return store.list_newest(once(spark, d), ["agent:main", "global"], limit=50, offset=10).select(*store.LIST_COLUMNS)


@query(f"SELECT id, text, category, scope, importance, timestamp, metadata FROM {ONCE}")
def scan_list(spark, d):
    return once(spark, d).select(*store.LIST_COLUMNS)


@query(f"WITH ask AS (SELECT DISTINCT id FROM memories WHERE entry_index % 17 = 0) SELECT id, text, scope FROM {ONCE} WHERE id IN (SELECT id FROM ask)")
def store_get_by_ids(spark, d):
    rows = once(spark, d)
    return store.by_ids(rows, rows.where("entry_index % 17 = 0")).select("id", "text", "scope")


@query(f"SELECT id, text FROM {ONCE} WHERE id = (SELECT min(id) FROM memories)")
def store_find_by_prefix(spark, d):
    rows = once(spark, d)
    ref = rows.agg(F.min("id")).head()[0]
    return store.by_id_or_prefix(rows, ref).select("id", "text")


@query("WITH ask AS (SELECT cand_id AS id FROM extraction_candidates UNION SELECT id FROM memories WHERE entry_index < 100) SELECT id, id IN (SELECT id FROM memories) AS found FROM ask")
def store_has_ids(spark, d):
    asked = table(spark, d, "extraction_candidates").select(F.col("cand_id").alias("id")).unionByName(once(spark, d).where("entry_index < 100").select("id"))
    return store.present(once(spark, d), asked)


@query(f"SELECT count(*) AS n, count(*) FILTER (scope = 'agent:main') AS own, count(*) FILTER (timestamp >= {NOW - 90 * DAY} AND timestamp < {NOW}) AS recent FROM {ONCE}")
def store_count_rows(spark, d):
    return once(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("scope") == "agent:main").alias("own"), F.count_if(store.time_range(NOW - 90 * DAY, NOW)).alias("recent"))


@query(f"SELECT id, timestamp FROM {ONCE} WHERE timestamp < {NOW - 7 * DAY} AND (scope = 'agent:main' OR scope IS NULL) ORDER BY timestamp, id LIMIT 200")
def scan_for_compaction(spark, d):
    rows = once(spark, d).where(store.time_range(high=NOW - 7 * DAY) & store.scope_filter(["agent:main"]))
    return rows.orderBy("timestamp", "id").limit(200).select("id", "timestamp")


@query(f"SELECT id, coalesce(scope, 'global') AS scope, coalesce(importance, 0.0) AS importance, coalesce(timestamp, 0) AS timestamp, CASE WHEN coalesce(metadata, '') = '' THEN '{{}}' ELSE metadata END AS metadata, coalesce(len(vector), 0) AS dims FROM {ONCE}")
def row_mapped(spark, d):
    return store.mapped(once(spark, d)).select("id", "scope", "importance", "timestamp", "metadata", F.size("vector").cast("bigint").alias("dims"))


@query("SELECT r_regionkey AS id, r_name AS text, 'global' AS scope, 0::BIGINT AS timestamp, '{}' AS metadata FROM region")
def legacy_add_columns(spark, d):
    return store.legacy_columns(table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("text"))).withColumn("timestamp", F.col("timestamp").cast("bigint"))


@query("SELECT count(*) AS n FROM memories WHERE false")
def scope_deny_all(spark, d):
    return table(spark, d, "memories").where(store.scope_filter([])).agg(F.count("*").alias("n"))


# ---- normalised metadata and projections


@query(with_mem("SELECT id, scope, source, state, layer, memory_category, memory_type, tier, access_count, round(confidence, 6) AS confidence, valid_from, last_accessed_at FROM mem"))
def normalize_metadata(spark, d):
    return mem(spark, d).select("id", "scope", "source", "state", "layer", "memory_category", "memory_type", "tier", "access_count", r6(F.col("confidence")).alias("confidence"), "valid_from", "last_accessed_at")


@query(with_mem("SELECT category, CASE category WHEN 'preference' THEN 'preferences' WHEN 'entity' THEN 'entities' WHEN 'decision' THEN 'events' WHEN 'fact' THEN CASE WHEN regexp_matches(text, '(?i)\\b(my |i am |i''m |name is |叫我|我的|我是)\\b') AND length(text) < 200 THEN 'profile' ELSE 'cases' END ELSE 'patterns' END AS memory_category, count(*) AS n FROM mem GROUP BY 1, 2"))
def reverse_map_category(spark, d):
    return mem(spark, d).groupBy("category", metadata.memory_category_of(F.col("category"), F.col("text")).alias("memory_category")).agg(F.count("*").alias("n"))


@query(with_mem("SELECT memory_category, CASE memory_category WHEN 'profile' THEN 'fact' WHEN 'preferences' THEN 'preference' WHEN 'entities' THEN 'entity' WHEN 'events' THEN 'decision' WHEN 'cases' THEN 'fact' ELSE 'other' END AS category, CASE memory_category WHEN 'profile' THEN 0.9 WHEN 'preferences' THEN 0.8 WHEN 'entities' THEN 0.7 WHEN 'events' THEN 0.6 WHEN 'cases' THEN 0.8 WHEN 'patterns' THEN 0.85 ELSE 0.5 END::DOUBLE AS importance FROM (SELECT DISTINCT memory_category FROM mem)"))
def map_to_store_category(spark, d):
    c = F.col("memory_category")
    return mem(spark, d).select(c).distinct().select(c, metadata.store_category_of(c).alias("category"), metadata.default_importance(c).alias("importance"))


FACT_KEY = r"""trim(regexp_replace(regexp_replace(lower(CASE WHEN regexp_extract(b, '^(.{1,120}?)[：:]', 1) <> '' THEN regexp_extract(b, '^(.{1,120}?)[：:]', 1) WHEN regexp_extract(b, '^(.{1,120}?)(\s*->|\s*=>)', 1) <> '' THEN regexp_extract(b, '^(.{1,120}?)(\s*->|\s*=>)', 1) ELSE b END), '\s+', ' ', 'g'), '[。.!?]+$', '', 'g'))"""
KEYED = rf"keyed AS (SELECT *, CASE WHEN memory_category IN ('preferences', 'entities') AND {FACT_KEY} <> '' THEN memory_category || ':' || {FACT_KEY} END AS fact_key FROM (SELECT *, regexp_replace(regexp_replace(l0, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '') AS b FROM mem))"


@query(with_mem("SELECT id, fact_key FROM keyed WHERE fact_key IS NOT NULL", KEYED))
def derive_fact_key(spark, d):
    return mem(spark, d).where("fact_key is not null").select("id", "fact_key")


@query(with_mem(f"SELECT memory_category, count(*) FILTER (valid_from <= {NOW - 60 * DAY}) AS active_then, count(*) FILTER (valid_from <= {NOW}) AS active_now FROM mem GROUP BY 1"))
def active_at(spark, d):
    return mem(spark, d).groupBy("memory_category").agg(F.count_if(metadata.active_at(NOW - 60 * DAY)).alias("active_then"), F.count_if(metadata.active_at(NOW)).alias("active_now"))


@query(with_mem("SELECT id FROM mem WHERE state = 'confirmed' AND layer NOT IN ('archive', 'reflection')"))
def governance_eligible(spark, d):
    return mem(spark, d).where((F.col("state") == "confirmed") & ~F.col("layer").isin("archive", "reflection")).select("id")


@query(with_mem("SELECT id, CASE WHEN source = 'reflection' THEN 'reflection:' || scope ELSE coalesce(category, '') || ':' || scope END AS tag FROM mem"))
def display_category_tag(spark, d):
    return mem(spark, d).select("id", F.concat(F.when(F.col("source") == "reflection", "reflection").otherwise(F.coalesce("category", F.lit(""))), F.lit(":"), F.col("scope")).alias("tag"))


@query(with_mem("SELECT id, to_json({'state': state, 'tier': tier, 'source': source}) AS patched FROM (SELECT id, 'archived' AS state, tier, source FROM mem WHERE access_count = 0 UNION ALL SELECT id, state, tier, source FROM mem WHERE access_count <> 0)"))
def patch_metadata(spark, d):
    rows = mem(spark, d)
    patches = rows.where("access_count = 0").select("id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("pending").alias("state")), F.struct(F.lit(2).alias("seq"), F.lit("archived").alias("state")))).alias("p")).select("id", "p.*")
    return metadata.patched(rows, patches).select("id", F.to_json(F.struct("state", "tier", "source")).alias("patched"))


# ---- changes


@query(f"SELECT id, text, category, importance, timestamp FROM (SELECT id, text, category, importance, timestamp FROM {ONCE} WHERE coalesce(entry_index % 5, 1) <> 0 UNION ALL SELECT id, 'replaced' AS text, category, importance, timestamp FROM {ONCE} WHERE entry_index % 5 = 0 UNION ALL SELECT cand_id AS id, abstract AS text, category, 0.5 AS importance, 0 AS timestamp FROM (SELECT * FROM extraction_candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY created_at) = 1))")
def upsert(spark, d):
    rows = once(spark, d).select("id", "text", "category", "importance", "timestamp", "entry_index")
    mine = rows.where("entry_index % 5 = 0").withColumn("text", F.lit("replaced")).drop("entry_index").withColumn("seq", F.lit(1))
    new = table(spark, d, "extraction_candidates").dropDuplicates(["cand_id"]).select(F.col("cand_id").alias("id"), F.col("abstract").alias("text"), "category", F.lit(0.5).alias("importance"), F.lit(0).cast("bigint").alias("timestamp"), F.lit(1).alias("seq"))
    return store.upsert(rows.drop("entry_index"), mine.unionByName(new))


@query(f"SELECT scope, count(*) AS n FROM {ONCE} WHERE NOT coalesce(scope IN ('agent:main') AND timestamp < {NOW - 120 * DAY}, false) GROUP BY 1")
def bulk_delete(spark, d):
    return store.bulk_delete(once(spark, d), ["agent:main"], NOW - 120 * DAY).groupBy("scope").agg(F.count("*").alias("n"))


@query(with_mem(f"SELECT id, coalesce(superseded_by, '') AS superseded_by, coalesce(supersedes, '') AS supersedes, coalesce(invalidated_at, 0) AS invalidated_at, valid_from FROM (SELECT id, CASE WHEN tier = 'core' THEN 'new-' || id END AS superseded_by, NULL AS supersedes, CASE WHEN tier = 'core' THEN {NOW} END AS invalidated_at, valid_from FROM mem UNION ALL SELECT 'new-' || id, NULL, id, NULL, {NOW} FROM mem WHERE tier = 'core')"))
def supersede(spark, d):
    rows = mem(spark, d)
    changes = rows.where("tier = 'core'").select(F.col("id").alias("old_id"), F.concat(F.lit("new-"), "id").alias("id"), F.concat("text", F.lit(" (again)")).alias("text"))
    out = store.supersede(rows, changes, NOW)
    return out.select("id", F.coalesce("superseded_by", F.lit("")).alias("superseded_by"), F.coalesce("supersedes", F.lit("")).alias("supersedes"), F.coalesce("invalidated_at", F.lit(0)).alias("invalidated_at"), "valid_from")


@query(with_mem(r"SELECT id, keep_id FROM (SELECT id, first(id) OVER w AS keep_id, row_number() OVER w AS n FROM (SELECT *, memory_category || ':' || lower(trim(regexp_replace(l0, '\s+', ' ', 'g'))) AS key FROM mem WHERE regexp_replace(l0, '[\s\p{Z}]+', '', 'g') <> '') WINDOW w AS (PARTITION BY key ORDER BY timestamp DESC, id)) WHERE n > 1"))
def exact_dup_compact(spark, d):
    return store.exact_duplicates(mem(spark, d))


@query("SELECT cand_id AS id, trim(abstract) AS text, CASE WHEN category IN ('preference','fact','decision','entity','other','reflection') THEN category ELSE 'other' END AS category, 0.7::DOUBLE AS importance, " + str(NOW) + r" AS timestamp FROM (SELECT * FROM extraction_candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY created_at) = 1) WHERE length(regexp_replace(regexp_replace(abstract, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')) >= 2")
def import_rows(spark, d):
    rows = table(spark, d, "extraction_candidates").dropDuplicates(["cand_id"]).select(F.col("cand_id").alias("id"), F.col("abstract").alias("text"), "category", F.lit(None).cast("double").alias("importance"), F.lit(None).cast("bigint").alias("timestamp"))
    return store.new_only(store.importable(rows, NOW), once(spark, d))


# ---- scores


@query(with_mem("SELECT id, round(recency, 6) AS recency, round(frequency, 6) AS frequency, round(intrinsic, 6) AS intrinsic, round(composite, 6) AS composite FROM decayed", DECAY))
def decay_score(spark, d):
    return decayed(spark, d).select("id", *(r6(F.col(c)).alias(c) for c in ("recency", "frequency", "intrinsic", "composite")))


@query(with_mem("SELECT id, round(greatest(0.3, least(1.0, 0.3 + 0.7 * greatest(CASE tier WHEN 'core' THEN 0.9 WHEN 'working' THEN 0.7 ELSE 0.5 END, composite))), 6) AS boosted FROM decayed", DECAY))
def decay_boost(spark, d):
    return decayed(spark, d).select("id", r6(scoring.decay_boost(F.lit(1.0), F.col("composite"), F.col("tier"))).alias("boosted"))


@query(with_mem("SELECT id, round(composite, 6) AS composite FROM decayed WHERE composite < 0.3", DECAY))
def stale_memories(spark, d):
    return decayed(spark, d).where("composite < 0.3").select("id", r6(F.col("composite")).alias("composite"))


@query(with_mem(f"SELECT id, round(CASE WHEN access_count <= 0 THEN 60.0 ELSE least(60.0 + 30.0 * ln(1 + access_count * exp(-greatest(0.0, ({NOW} - last_accessed_at) / 86400000.0) * (0.6931471805599453 / 30))), 180.0) END, 6) AS half_life FROM mem"))
def effective_half_life(spark, d):
    return mem(spark, d).select("id", r6(scoring.effective_half_life(60.0, F.col("access_count"), F.col("last_accessed_at"), NOW)).alias("half_life"))


@query(with_mem("SELECT id, round(greatest(0.0, least(1.0, 1 / (1 + 0.5 * log2(greatest(length(text) / 500.0, 1.0))))), 6) AS factor FROM mem"))
def length_norm(spark, d):
    return mem(spark, d).select("id", r6(scoring.length_norm(F.lit(1.0), F.col("text"))).alias("factor"))


@query(with_mem(f"SELECT id, round(0.8 * (0.5 + 0.5 * exp(-a / 60.0)), 6) AS timed, round(0.8 * (0.5 + 0.5 * exp(-a / 14.0)) * (0.7 + 0.3 * importance), 6) AS fallback, round(0.8 * pow(2.0, -a / 14.0) * (0.7 + 0.3 * importance) * (0.5 + 0.5 * exp(-a / 60.0)), 6) AS recent FROM (SELECT *, greatest(0.0, ({NOW} - timestamp) / 86400000.0) AS a FROM mem)"))
def recency_scores(spark, d):
    age, score = scoring.days_since(F.col("timestamp"), NOW), F.lit(0.8)
    return mem(spark, d).select(
        "id", r6(scoring.time_decay(score, age, F.lit(60.0))).alias("timed"), r6(scoring.fallback_score(score, F.col("importance"), age)).alias("fallback"),
        r6(scoring.recency_composite(score, F.col("importance"), age, F.lit(14.0), F.lit(60.0))).alias("recent"),
    )


@query(with_mem(f"SELECT id, round(greatest(0.0, least(1.0, 0.8 * 0.5 + exp(-0.693 * (({NOW} - timestamp) / 86400000.0) / 30) * 0.2 + least(1.0, log2(1 + access_count) / 3.32) * 0.15 + CASE WHEN confidence = 0 THEN 0.7 ELSE confidence END * 0.15)), 6) AS confidence FROM mem"))
def result_confidence(spark, d):
    return mem(spark, d).select("id", r6(scoring.confidence(F.lit(0.8), NOW)).alias("confidence"))


TIERS_SQL = f"""SELECT id, tier AS from_tier, to_tier FROM (SELECT *, CASE
 WHEN tier = 'peripheral' AND (importance >= 0.95 AND access_count >= 1 OR access_count >= 3 AND composite >= 0.4) THEN 'working'
 WHEN tier = 'working' AND access_count >= 10 AND composite >= 0.7 AND importance >= 0.8 THEN 'core'
 WHEN tier = 'working' AND (composite < 0.15 OR ({NOW} - timestamp) / 86400000.0 > 60 AND access_count < 3) THEN 'peripheral'
 WHEN tier = 'core' AND composite < 0.15 AND access_count < 3 THEN 'working' END AS to_tier FROM decayed) WHERE to_tier IS NOT NULL"""


@query(with_mem(TIERS_SQL, DECAY))
def tier_transitions(spark, d):
    return scoring.tier_transitions(decayed(spark, d), NOW)


# facts of the life cycle that the tables lack, by the entry's number, so that each reason comes about
FACTS = "facts AS (SELECT x.*, CASE WHEN n % 13 = 1 THEN timestamp + 1 END AS valid_until, CASE WHEN n % 13 IN (2, 3) THEN 'x' END AS superseded_by, n % 13 IN (3, 4) AS compacted, CASE WHEN n % 13 = 4 THEN 0 ELSE -1 END AS source_count, n % 13 = 5 AS noise, CASE WHEN n % 13 = 6 THEN 3 WHEN n % 13 = 7 THEN 6 ELSE 0 END AS bad FROM (SELECT decayed.*, d.entry_index AS n FROM decayed JOIN d USING (id)) x)"
LIFE = f"""SELECT id, reason FROM (SELECT id, CASE WHEN valid_until <= {NOW} THEN 'expired' WHEN superseded_by IS NOT NULL AND compacted THEN 'superseded_fragment' WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN bad >= 3 AND composite < 0.3 THEN 'bad_recall'
 WHEN compacted AND source_count = 0 THEN 'duplicate_cluster_source' WHEN noise THEN 'noise' WHEN composite < 0.15 AND tier = 'peripheral' AND access_count = 0 THEN 'stale_unaccessed' WHEN bad >= 5 AND composite < 0.5 AND tier <> 'core' THEN 'bad_recall' END AS reason
 FROM facts WHERE NOT (state = 'archived' OR layer = 'archive' OR source = 'session-summary')) WHERE reason IS NOT NULL"""


@query(with_mem(LIFE, DECAY, FACTS))
def lifecycle_archive(spark, d):
    n = F.col("n") % 13
    rows = decayed(spark, d).join(once(spark, d).select("id", F.col("entry_index").alias("n")), "id")
    facts = {
        "valid_until": F.when(n == 1, F.col("timestamp") + 1), "superseded_by": F.when(n.isin(2, 3), "x"), "compacted": n.isin(3, 4), "source_count": F.when(n == 4, 0).otherwise(-1),
        "noise": n == 5, "bad_recall_count": F.when(n == 6, 3).when(n == 7, 6).otherwise(0),
    }
    return scoring.archive_reasons(rows.withColumns(facts), NOW)


@query(with_mem("SELECT id, newest_id FROM (SELECT id, l0, confidence, first(id) OVER w AS newest_id, first(l0) OVER w AS nl, first(confidence) OVER w AS nc FROM keyed WHERE fact_key IS NOT NULL AND state <> 'archived' WINDOW w AS (PARTITION BY scope, fact_key ORDER BY timestamp DESC, confidence DESC, id)) WHERE id <> newest_id AND l0 <> nl AND nc >= confidence", KEYED))
def contradiction_plan(spark, d):
    return scoring.contradictions(mem(spark, d))


@query("SELECT i AS n, CASE WHEN i <= 0 THEN 0.2 ELSE least(1.0, 0.55 + 0.075 * least(6, i)) END::DOUBLE AS quality, round(1 / (1 + exp(0.2 * (i * 3.0 - 20))) * 0.9 * 0.8 * CASE WHEN i % 2 = 0 THEN 0.75 ELSE 1 END, 6) AS score FROM range(0, 12) r(i)")
def reflection_scores(spark, d):
    n = F.col("id")
    return spark.range(12).select(n.alias("n"), scoring.derived_line_quality(n).alias("quality"), r6(scoring.reflection_score(n * 3.0, F.lit(20), F.lit(0.2), F.lit(0.9), F.lit(0.8), n % 2 == 0)).alias("score"))


# ---- text rules


#: The text of every message, each once: of repeats the first one loaded, with text before none.
TEXTS = r"""(SELECT msg_id, session_id, content, regexp_replace(regexp_replace(content, '^[\s\p{Z}\x{FEFF}]+', ''), '[\s\p{Z}\x{FEFF}]+$', '') AS t FROM (
 SELECT msg_id, session_id, loaded_at, CASE WHEN regexp_matches(content, '^\s*\[\s*(\{|\]|$)') THEN CASE WHEN json_valid(content) THEN coalesce(array_to_string(list_transform(list_filter(json_extract(content, '$[*]'),
  lambda b: json_extract_string(b, '$.type') = 'text' AND json_extract_string(b, '$.text') IS NOT NULL), lambda b: json_extract_string(b, '$.text')), chr(10)), '') ELSE '' END ELSE content END AS content
 FROM session_messages WHERE type = 'message' AND content IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY content = '', loaded_at, content) = 1)"""


def said(spark: SparkSession, d: str) -> DataFrame:
    """The text of every message, each once; of repeats the first one loaded, with text before none."""
    rows = table(spark, d, "session_messages").where("type = 'message' and content is not null")
    parsed = rows.select("msg_id", F.lower(F.trim("session_id")).alias("session"), text.message_text(F.col("content")).alias("text"), "loaded_at")
    return parsed.groupBy("msg_id").agg(F.min_by(F.struct("session", "text"), F.struct(F.col("text") == "", "loaded_at", "text")).alias("m")).select("msg_id", "m.session", "m.text")


def _in_duckdb(pattern: str) -> str:
    """The same pattern with borders that are ASCII there by default, as a literal."""
    import re

    return "'" + re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: chr(int(m[1], 16)), pattern).replace("'", "''") + "'"


# the patterns of noise written out a second time, for the check
NOISE_SQL = (
    r"i don''?t have (any )?(information|data|memory|record)|i''?m not sure about|i don''?t recall|i don''?t remember|it looks like i don''?t|i wasn''?t able to find|no (relevant )?memories found|i don''?t have access to|我没有找到|我不确定|没有相关记忆|抱歉[，,]?我不记得|我无法确认|没有找到相关|我不太清楚",
    r"\bdo you (remember|recall|know about)\b|\bcan you (remember|recall)\b|\bdid i (tell|mention|say|share)\b|\bhave i (told|mentioned|said)\b|\bwhat did i (tell|say|mention)\b|如果你知道.+只回复|如果不知道.+只回复\s*none|只回复精确代号|只回复\s*none|你还?记得|记不记得|还记得.*吗|你[知晓]道.+吗|我(?:之前|上次|以前)(?:说|提|讲).*(?:吗|呢|？|\?)",
    r"^(hi|hello|hey|good morning|good evening|greetings)|^fresh session|^new session|^HEARTBEAT",
    r"\bquery\s*->\s*(none|no explicit solution|unknown|not found)\b|\buser asked for\b.*\b(none|no explicit solution|unknown|not found)\b|\bno explicit solution\b",
)


def NOISY(t: str) -> str:  # noqa: N802  stands in SQL texts
    """SQL for whether a text is noise."""
    bare = rf"regexp_replace(regexp_replace({t}, '^[\s\p{{Z}}\x{{FEFF}}]+', ''), '[\s\p{{Z}}\x{{FEFF}}]+$', '')"
    return f"(length({bare}) < 5 OR " + " OR ".join(f"regexp_matches({bare}, '(?i){p}')" for p in NOISE_SQL) + rf" OR regexp_matches({bare}, '(?m)^reflection-event\s*·'))"


@query(f"SELECT DISTINCT msg_id, {NOISY('t')} AS noise FROM {TEXTS}")
def noise_filter(spark, d):
    return said(spark, d).select("msg_id", text.is_noise(F.col("text")).alias("noise")).distinct()


# hours until what a text says is over, written out for the check
OVER = (("后天|(?i:day after tomorrow)", 48), ("明天|(?i:\\btomorrow\\b)", 24), ("下周|(?i:\\bnext week\\b)", 7 * 24), ("这周|(?i:\\bthis week\\b)", 3 * 24), ("下个月|(?i:\\bnext month\\b)", 30 * 24), ("这个月|(?i:\\bthis month\\b)", 15 * 24), ("今晚|(?i:\\btonight\\b)", 12), ("今天|(?i:\\btoday\\b)", 18))
WHEN_SAID = "(?i)\\b(today|yesterday|tomorrow|recently|currently|right now|this week|this month|last week|next week|this morning|tonight|later)\\b|今天|昨天|明天|最近|正在|刚才|刚刚|这周|这个月|上周|下周|目前|现在|今晚|今早|稍后|待会"


@query(with_mem(f"SELECT id, CASE WHEN regexp_matches(text, '{WHEN_SAID}') THEN 'dynamic' ELSE 'static' END AS kind, CASE {' '.join(f"WHEN regexp_matches(text, '{words}') THEN {NOW} + {hours} * 3600000" for words, hours in OVER)} END AS expires FROM mem"))
def temporal_rules(spark, d):
    return mem(spark, d).select("id", classify.temporal_type(F.col("text")).alias("kind"), classify.expiry(F.col("text"), NOW).alias("expires"))


@query(with_mem(r"""SELECT id, CASE WHEN regexp_matches(low, 'prefer|radši|like|love|hate|want|偏好|喜歡|喜欢|討厭|讨厌|不喜歡|不喜欢|愛好|爱用|習慣|习惯') THEN 'preference'
 WHEN regexp_matches(low, 'rozhodli|decided|we decided|will use|we will use|we''?ll use|switch(ed)? to|migrate(d)? to|going forward|from now on|budeme|決定|决定|選擇了|选择了|改用|換成|换成|以後用|以后用|規則|流程|sop') THEN 'decision'
 WHEN regexp_matches(low, '\+\d{10,}|@[\w.-]+\.\w+|is called|jmenuje se|我的\S+是|叫我|稱呼|称呼') THEN 'entity' WHEN regexp_matches(low, '\b(is|are|has|have|je|má|jsou)\b|總是|总是|從不|从不|一直|每次都|老是') THEN 'fact' ELSE 'other' END AS category FROM (SELECT id, lower(text) AS low FROM mem)"""))
def detect_category(spark, d):
    return mem(spark, d).select("id", classify.detected_category(F.col("text")).alias("category"))


@query(f"""SELECT reason, count(*) AS n FROM (SELECT DISTINCT msg_id, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, {_in_duckdb(classify.TOOL_CALL)}) THEN 'tool_call'
 WHEN regexp_matches(t, {_in_duckdb(classify.CORRECTION)}) THEN 'correction' WHEN regexp_matches(t, {_in_duckdb(classify.DECISION)}) THEN 'decision' WHEN regexp_matches(t, {_in_duckdb(classify.ACKNOWLEDGMENT)}) THEN 'acknowledgment'
 WHEN length(t) > CASE WHEN regexp_matches(t, {_in_duckdb(classify.CJK)}) THEN 30 ELSE 80 END THEN CASE WHEN regexp_matches(t, '^<[a-z-]+>') AND regexp_matches(t, '</[a-z-]+>\\s*$') THEN 'system_xml' ELSE 'substantive' END
 WHEN contains(t, '?') OR contains(t, '？') THEN 'short_question' ELSE 'short_statement' END AS reason FROM {TEXTS}) GROUP BY 1""")
def score_text(spark, d):
    rows = said(spark, d).select("msg_id", classify.line_reason(F.col("text")).alias("reason")).distinct()
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""SELECT DISTINCT msg_id, length(t) >= CASE WHEN regexp_matches(t, {_in_duckdb(classify.CJK)}) THEN 4 ELSE 10 END AND length(t) <= 500 AND NOT contains(t, '<relevant-memories>') AND NOT (starts_with(t, '<') AND contains(t, '</')) AND NOT (contains(t, '**') AND contains(t, chr(10) || '-'))
 AND NOT regexp_matches(t, {_in_duckdb(classify.EXCLUDED)}) AND regexp_matches(t, {_in_duckdb(classify.TRIGGERS)}) AS capture FROM {TEXTS}""")
def should_capture(spark, d):
    return said(spark, d).select("msg_id", classify.worth_capturing(F.col("text")).alias("capture")).distinct()


@query("SELECT cand_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(abstract, '')), '\\p{Han}|[\\p{Latin}\\p{N}]+'))) AS tokens FROM (SELECT * FROM extraction_candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY created_at) = 1)")
def admission_tokens(spark, d):
    return table(spark, d, "extraction_candidates").dropDuplicates(["cand_id"]).select("cand_id", F.array_sort(F.array_distinct(text.admission_tokens(F.col("abstract")))).alias("tokens"))


@query("SELECT item_id, len(list_distinct(list_concat([substr(q, i, 2) FOR i IN range(1, greatest(length(q), 1))], [substr(q, i, 3) FOR i IN range(1, greatest(length(q) - 1, 1))]))) AS grams FROM (SELECT item_id, lower(query) AS q FROM eval_items WHERE length(query) > 3)")
def ngram_counts(spark, d):
    return table(spark, d, "eval_items").where("length(query) > 3").select("item_id", F.size(F.array_distinct(text.ngrams(F.col("query")))).cast("bigint").alias("grams"))


# one example of each shape, put behind every memory's text by its number
EXAMPLES = (
    "Bearer abc.def-123==", "sk-" + "a1" * 12, "sk-proj-" + "b_2" * 9, "sk-ant-" + "c-3" * 9, "ghp_" + "d4" * 20, "gho_" + "e5" * 20, "ghu_" + "f6" * 20, "ghs_" + "g7" * 20, "github_pat_" + "h8" * 14, "xoxb-12345-abcdef",
    "AIza" + "j9" * 14, "AKIA" + "AB12" * 4, "npm_" + "k1" * 20, "password: hunter22x", "-----BEGIN RSA PRIVATE KEY----- zz zz -----END RSA PRIVATE KEY-----", "https://jo:pass@host.example/x", "/home/jo/notes.md", "/Users/jo/x", r"C:\\Users\\jo", "jo.x@mail.example", "nothing",
)
REDACT_SQL = (
    ("\\bsk-[A-Za-z0-9]{20,}\\b", ""), ("\\bsk-proj-[A-Za-z0-9_-]{20,}\\b", ""), ("\\bsk-ant-[A-Za-z0-9_-]{20,}\\b", ""), ("\\bgh[pous]_[A-Za-z0-9]{36,}\\b", ""), ("\\bgithub_pat_[A-Za-z0-9_]{22,}\\b", ""), ("\\bxox[baprs]-[A-Za-z0-9-]{10,}\\b", ""), ("\\bAIza[0-9A-Za-z_-]{20,}\\b", ""),
    ("\\bAKIA[0-9A-Z]{16}\\b", ""), ("\\bnpm_[A-Za-z0-9]{36,}\\b", ""), ("(?i)\\b(?:token|api[_-]?key|secret|password)\\s*[:=]\\s*[\"'']?[^\\s\"'',;)}\\]]{6,}[\"'']?\\b", ""),
    ("-----BEGIN\\s+(?:RSA\\s+|EC\\s+|DSA\\s+|OPENSSH\\s+)?PRIVATE\\s+KEY-----(?s:.*?)-----END\\s+(?:RSA\\s+|EC\\s+|DSA\\s+|OPENSSH\\s+)?PRIVATE\\s+KEY-----", ""), ("(://)[^@\\s]+:[^@\\s]+(@)", "12"),
    ("/home/[^\\s\"'',;)}\\]]+", ""), ("/Users/[^\\s\"'',;)}\\]]+", ""), ("[A-Z]:\\\\[^\\s\"'',;)}\\]]+", ""), ("[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}", ""),
)


def _redact_sql(t: str) -> str:
    t = f"regexp_replace({t}, 'Bearer\\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'g')"
    for p, groups in REDACT_SQL:
        t = f"regexp_replace({t}, '{p}', '{chr(92) + '1[REDACTED]' + chr(92) + '2' if groups else '[REDACTED]'}', 'g')"
    return t


@query(with_mem(f"SELECT id, {_redact_sql('t')} AS redacted FROM (SELECT mem.id, mem.text || ' see ' || [{', '.join(chr(39) + e + chr(39) for e in EXAMPLES)}][1 + entry_index % {len(EXAMPLES)}] || ' there' AS t FROM mem JOIN d USING (id))"))
def redact_all(spark, d):
    example = F.element_at(F.array(*map(F.lit, EXAMPLES)), (F.col("entry_index") % len(EXAMPLES) + 1).cast("int"))
    rows = once(spark, d).select("id", F.concat(F.coalesce("text", F.lit("")), F.lit(" see "), example, F.lit(" there")).alias("t"))
    return rows.select("id", text.redact(F.col("t")).alias("redacted"))


# ---- search


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The searches: every evaluation item with the vector of one memory, and every memory whose entry_index is divisible by 100.

    An item's qid is its item_id, a memory's ``-1 - entry_index``.
    """
    items = table(spark, d, "eval_items").where("query is not null").dropDuplicates(["item_id"]).select(F.col("item_id").alias("qid"), "query")
    stored = once(spark, d).select("entry_index", "text", "vector")
    vectors = _searchable(stored).select("entry_index", "vector")
    most = items.agg(F.max("qid")).first()[0] or 0  # of a table of fixed size
    ranked = vectors.orderBy("entry_index").limit(most).withColumn("qid", F.row_number().over(Window.orderBy("entry_index")).cast("bigint")).drop("entry_index")
    own = stored.where("entry_index % 100 = 0").select((-1 - F.col("entry_index")).alias("qid"), F.col("text").alias("query"), F.when(_usable_vector(), F.col("vector")).alias("vector"))
    return items.join(F.broadcast(ranked), "qid", "left").unionByName(own)


ASKED = "items AS (SELECT item_id AS qid, query FROM eval_items WHERE query IS NOT NULL), vecs AS (SELECT row_number() OVER (ORDER BY entry_index) AS qid, vector AS qv FROM (SELECT * FROM d WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 ORDER BY entry_index)), asked AS (SELECT i.qid, query, qv FROM items i JOIN vecs USING (qid) UNION ALL SELECT -1 - entry_index, text, vector FROM d WHERE entry_index % 100 = 0)"
GOOD = "good AS (SELECT * FROM mem WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"
DOT = "list_inner_product(qv::DOUBLE[], vector::DOUBLE[]) / (sqrt(list_inner_product(qv::DOUBLE[], qv::DOUBLE[])) * sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])))"
VEC = f"vec AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, 1 / (2 - {DOT}) AS score FROM good, asked) WHERE score >= 0.3)"


def _usable_vector() -> F.Column:
    bad = F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size("vector") == 64) & ~bad & F.exists("vector", lambda x: x != 0)


def _searchable(rows: DataFrame) -> DataFrame:
    return rows.where(_usable_vector())


@query(with_mem("SELECT qid, id, round(score, 6) AS score, rank FROM vec WHERE rank <= 5", ASKED, GOOD, VEC))
def vector_search(spark, d):
    return search.vector_search(_searchable(mem(spark, d)), _asked(spark, d)).select("qid", "id", r6(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


TOK = r"regexp_extract_all(lower({0}), '\p{{Han}}|[\p{{Latin}}\p{{N}}]+')"
BM25 = f"""words AS (SELECT id, {TOK.format('text')} AS t FROM mem), stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM words),
ask AS (SELECT DISTINCT qid, unnest({TOK.format('query')}) AS w FROM asked),
post AS (SELECT id, len, w, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS w FROM words) WHERE w IN (SELECT w FROM ask) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM post GROUP BY 1),
raw AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS raw FROM post JOIN df USING (w) JOIN ask USING (w), stats GROUP BY 1, 2),
kw AS (SELECT qid, id, 1 / (1 + exp(-raw / 5)) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(1 / (1 + exp(-raw / 5)), 9) DESC, id) AS rank FROM raw)"""


@query(with_mem("SELECT qid, id, round(score, 6) AS score, rank FROM kw WHERE rank <= 5", ASKED, BM25))
def bm25_search(spark, d):
    return search.bm25_search(mem(spark, d), _asked(spark, d)).select("qid", "id", r6(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


FUSED = """both2 AS (SELECT coalesce(v.qid, b.qid) AS qid, coalesce(v.id, b.id) AS id, v.score AS vs, b.score AS bs, coalesce(0.6 / (60 + v.rank), 0) + coalesce(0.4 / (60 + b.rank), 0) AS raw
  FROM (SELECT * FROM vec WHERE rank <= 20) v FULL JOIN (SELECT * FROM kw WHERE rank <= 20) b ON v.qid = b.qid AND v.id = b.id),
fused AS (SELECT qid, id, greatest(0.0, least(1.0, greatest(CASE WHEN vs IS NULL THEN bs ELSE 0.35 * raw / max(raw) OVER (PARTITION BY qid) + 0.65 * ((coalesce(vs * 0.6, 0) + coalesce(bs * 0.4, 0)) / (CASE WHEN vs IS NULL THEN 0 ELSE 0.6 END + CASE WHEN bs IS NULL THEN 0 ELSE 0.4 END)) END,
  CASE WHEN bs >= 0.75 THEN bs * 0.92 ELSE 0 END))) AS score FROM both2)"""


@query(with_mem("SELECT qid, id, round(score, 6) AS score FROM fused", ASKED, GOOD, VEC, BM25, FUSED))
def rrf_fuse(spark, d):
    rows, asked = mem(spark, d), _asked(spark, d)
    return search.fuse(search.vector_search(_searchable(rows), asked, 20), search.bm25_search(rows, asked, 20)).select("qid", "id", r6(F.col("score")).alias("score"))


HYBRID = f"""live AS (SELECT * FROM mem WHERE valid_from <= {NOW} AND len(vector) = 64 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"""


@query(
    with_mem(
        f"""SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM (
 SELECT qid, f.id, greatest(0.0, least(1.0, s * (0.5 + 0.5 * exp(-greatest(0.0, ({NOW} - timestamp) / 86400000.0) / 60.0)))) AS score
 FROM (SELECT qid, id, timestamp, greatest(0.0, least(1.0, score / (1 + 0.5 * log2(greatest(length(text) / 500.0, 1.0))))) AS s FROM fused JOIN live USING (id) WHERE score >= 0.3) f WHERE s >= 0.35)) WHERE rank <= 5""",
        ASKED, HYBRID, VEC.replace("FROM good, asked", "FROM live, asked").replace("score >= 0.3", "score >= 0.1"), BM25.replace("FROM mem)", "FROM live)"), FUSED,
    )
)
def recall_hybrid(spark, d):
    found = search.hybrid(_searchable(mem(spark, d)), _asked(spark, d), NOW)
    return found.select("qid", "id", r6(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(with_mem("SELECT a.id AS id_a, b.id AS id_b FROM small a JOIN small b ON a.scope = b.scope AND a.id < b.id WHERE list_inner_product(a.vector::DOUBLE[], b.vector::DOUBLE[]) / (sqrt(list_inner_product(a.vector::DOUBLE[], a.vector::DOUBLE[])) * sqrt(list_inner_product(b.vector::DOUBLE[], b.vector::DOUBLE[]))) >= 0.88", GOOD, "small AS (SELECT * FROM good)"))
def similar_pairs_of_scope(spark, d):
    return pairs.similar_pairs(_searchable(mem(spark, d)), 0.88, 64).select("id_a", "id_b")


UNIT = "list_transform({0}::DOUBLE[], lambda x: x / sqrt(list_inner_product({0}::DOUBLE[], {0}::DOUBLE[])))"
SEEDS = f"""sg AS (SELECT good.id, good.scope, good.text, good.importance, good.category, d.entry_index AS n, {UNIT.format('good.vector')} AS v FROM good JOIN d USING (id)),
nb AS (SELECT a.scope, a.id, list(b.id) AS near FROM sg a JOIN sg b ON a.scope = b.scope AND a.id <> b.id AND list_inner_product(a.v, b.v) >= 0.88 GROUP BY 1, 2),
od AS (SELECT nb.*, row_number() OVER (PARTITION BY nb.scope ORDER BY sg.importance DESC, nb.id) AS i FROM nb JOIN sg USING (id)),
sw AS (SELECT DISTINCT scope, 0::BIGINT AS i, []::VARCHAR[] AS taken, NULL::VARCHAR AS seed, []::VARCHAR[] AS members FROM od
 UNION ALL SELECT scope, i, CASE WHEN new THEN list_concat(taken, members) ELSE taken END, CASE WHEN new THEN id END, members FROM (SELECT *, NOT list_contains(taken, id) AND len(members) > 1 AS new FROM (SELECT od.scope, od.i, od.id, sw.taken, list_concat([od.id], list_filter(od.near, lambda x: NOT list_contains(sw.taken, x))) AS members FROM sw JOIN od ON od.scope = sw.scope AND od.i = sw.i + 1))),
seeds AS (SELECT scope, seed, unnest(members) AS id FROM sw WHERE seed IS NOT NULL)"""


def walking(body: str, *more: str) -> str:
    return with_mem(body, *more).replace("WITH ", "WITH RECURSIVE ", 1)


@query(walking("SELECT scope, seed, id FROM seeds", GOOD, SEEDS))
def seed_clusters(spark, d):
    return pairs.seed_clusters(_searchable(mem(spark, d))).select("scope", "seed", "id")


# ---- rollups

TR = "(SELECT * FROM retrieval_telemetry QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY recorded_at) = 1)"


@query(with_mem("SELECT kind, key, count(*) AS n FROM (SELECT unnest([{'kind': 'scope', 'key': scope}, {'kind': 'category', 'key': coalesce(category, '(none)')}, {'kind': 'memory_category', 'key': memory_category}, {'kind': 'layer', 'key': layer}], recursive := true) FROM mem) GROUP BY 1, 2 " + f"UNION ALL SELECT 'all', unnest(['total', 'new_24h', 'new_7d', 'new_30d', 'bad_recall', 'low_confidence']), unnest([count(*), count(*) FILTER (timestamp >= {NOW - DAY}), count(*) FILTER (timestamp >= {NOW - 7 * DAY}), count(*) FILTER (timestamp >= {NOW - 30 * DAY}), 0, count(*) FILTER (confidence < 0.4)]) FROM mem"))
def store_stats(spark, d):
    return rollups.store_stats(mem(spark, d), NOW)


@query(f"SELECT count(*) AS queries, count(*) FILTER (final_count = 0) AS zero_results, floor(avg(total_ms) + 0.5)::BIGINT AS avg_ms, quantile_disc(total_ms, 0.95)::BIGINT AS p95_ms, floor(avg(final_count) * 10 + 0.5) / 10 AS avg_results, count(*) FILTER (len(list_filter(stages, lambda s: s.name = 'rerank')) > 0) AS reranked FROM {TR}")
def retrieval_stats(spark, d):
    return rollups.retrieval_stats(table(spark, d, "retrieval_telemetry"))


@query(f"SELECT coalesce(source, '(none)') AS source, count(*) AS queries, count(*) FILTER (final_count = 0) AS zero_results, floor(avg(total_ms) + 0.5)::BIGINT AS avg_ms FROM {TR} GROUP BY 1")
def retrieval_by_source(spark, d):
    return rollups.by_source(table(spark, d, "retrieval_telemetry"))


LOST = f"lost AS (SELECT trace_id, pos, s.name AS stage, s.input_count AS before, s.output_count AS after, s.input_count - s.output_count AS dropped FROM (SELECT trace_id, unnest(stages) AS s, generate_subscripts(stages, 1) AS pos FROM {TR}) WHERE s.input_count > s.output_count)"


@query(f"WITH {LOST} SELECT stage, sum(dropped)::BIGINT AS dropped, count(DISTINCT trace_id) AS traces FROM lost GROUP BY 1")
def retrieval_drops(spark, d):
    return rollups.drops(table(spark, d, "retrieval_telemetry"))


@query(f"WITH {LOST} SELECT trace_id, stage, before, after, dropped, row_number() OVER (PARTITION BY trace_id ORDER BY dropped DESC, pos)::INT AS place FROM lost")
def drop_summary(spark, d):
    return rollups.drop_summary(table(spark, d, "retrieval_telemetry"))


DUR = f"SELECT coalesce(source, '(none)') AS path, floor(avg(total_ms) * 10 + 0.5) / 10 AS avg_ms, quantile_disc(total_ms, 0.5)::BIGINT AS p50_ms, quantile_disc(total_ms, 0.95)::BIGINT AS p95_ms, min(total_ms) AS min_ms, max(total_ms) AS max_ms, round(count(*) FILTER (final_count = 0) / count(*), 3) AS zero_rate FROM {TR} GROUP BY 1"


@query(DUR)
def duration_summary(spark, d):
    return rollups.duration_summary(table(spark, d, "retrieval_telemetry"))


@query(f"WITH s AS ({DUR}) SELECT path, p95_ms, p50_ms AS base_ms FROM s WHERE p50_ms > 0 AND p95_ms > greatest(p50_ms * 1.25, p50_ms + 5)")
def baseline_regressions(spark, d):
    now = rollups.duration_summary(table(spark, d, "retrieval_telemetry"))
    return rollups.regressions(now, now.withColumn("p95_ms", F.col("p50_ms")))


@query(with_mem("SELECT CASE WHEN scope = 'global' THEN 'global' WHEN contains(scope, ':') THEN split_part(scope, ':', 1) ELSE 'other' END AS kind, count(*) AS n, count(DISTINCT scope) AS scopes FROM mem GROUP BY 1"))
def scope_kinds(spark, d):
    return rollups.scope_kinds(mem(spark, d))


@query(f"SELECT coalesce(category, '(none)') AS category, count(*) AS n FROM {ONCE} WHERE CASE WHEN json_valid(metadata) AND json_type(metadata) = 'OBJECT' THEN json_extract_string(metadata, '$.memory_category') END IS NULL GROUP BY 1")
def count_legacy(spark, d):
    return rollups.legacy_counts(once(spark, d))


@query("SELECT session_key, count(DISTINCT msg_id) AS n, count(DISTINCT CASE WHEN type = 'message' THEN msg_id END) AS messages, count(DISTINCT lower(trim(session_id))) AS sessions FROM session_messages GROUP BY 1")
def channel_counts(spark, d):
    m = table(spark, d, "session_messages")
    return m.groupBy("session_key").agg(F.count_distinct("msg_id").alias("n"), F.count_distinct(F.when(F.col("type") == "message", F.col("msg_id"))).alias("messages"), F.count_distinct(F.lower(F.trim("session_id"))).alias("sessions"))


@query("SELECT label, n FROM (SELECT trim(regexp_replace(regexp_replace(lower(query), '\\d+(?:\\.\\d+)?', '#', 'g'), '\\s+', ' ', 'g')) AS key, count(*) AS n, arg_min(query, trace_id) AS label FROM " + TR + " WHERE query IS NOT NULL GROUP BY 1) ORDER BY n DESC, label LIMIT 5")
def top_reasons(spark, d):
    return rollups.top_reasons(rollups.traces(table(spark, d, "retrieval_telemetry")), "query", "trace_id")


@query("WITH o AS (SELECT category, count(*) AS total, count(*) FILTER (vector IS NOT NULL) AS admitted FROM (SELECT * FROM extraction_candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY created_at) = 1) WHERE category IS NOT NULL GROUP BY 1), p(category, prior) AS (VALUES ('profile', 0.95), ('preferences', 0.9), ('entities', 0.75), ('events', 0.45), ('cases', 0.8), ('patterns', 0.85)) SELECT p.category, round(CASE WHEN total >= 10 THEN greatest(0.0, least(1.0, greatest(prior - 0.15, least(prior + 0.15, prior + 0.1 * (admitted / total - 0.5))))) ELSE prior END, 6)::DOUBLE AS prior FROM p LEFT JOIN o USING (category)")
def adapted_priors(spark, d):
    c = table(spark, d, "extraction_candidates").dropDuplicates(["cand_id"])
    observed = c.where("category is not null").groupBy("category").agg(F.count("*").alias("total"), F.count("vector").alias("admitted"))
    priors = spark.createDataFrame([("profile", 0.95), ("preferences", 0.9), ("entities", 0.75), ("events", 0.45), ("cases", 0.8), ("patterns", 0.85)], "category string, prior double")
    return rollups.adapted_priors(observed, priors).select("category", r6(F.col("prior")).alias("prior"))


# ---- greedy operators: results depend on order; the SQL walks lists or places

KEEP = "list_reduce(list_concat([list_slice(cs, 1, 0)], list_transform(cs, lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: len(y.v) = len(x[1].v) AND list_inner_product(y.v, x[1].v) > 0.85)) > 0 THEN acc ELSE list_concat(acc, x) END)"
BATCHES = f"""WITH c AS (SELECT batch_id, index, cand_id, {UNIT.format('vector')} AS v FROM (SELECT * FROM extraction_candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY created_at, index) = 1)
  WHERE batch_id IS NOT NULL AND cand_id IS NOT NULL AND len(vector) > 0 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
k AS (SELECT batch_id, {KEEP} AS kept FROM (SELECT batch_id, list({{'id': cand_id, 'v': v}} ORDER BY index, cand_id) AS cs FROM c GROUP BY 1))
SELECT c.cand_id, c.batch_id, list_filter(kept, lambda y: len(y.v) = len(c.v) AND list_inner_product(y.v, c.v) > 0.85)[1].id AS duplicate_of FROM c JOIN k USING (batch_id) WHERE len(list_filter(kept, lambda y: y.id = c.cand_id)) = 0"""


@query(BATCHES)
def batch_dedup(spark, d):
    return greedy.batch_dedup(table(spark, d, "extraction_candidates"))


SPREAD = f"pool AS (SELECT vec.*, {UNIT.format('vector')} AS v FROM vec JOIN good USING (id) WHERE rank <= 20), kk AS (SELECT qid, {KEEP} AS kept FROM (SELECT qid, list({{'id': id, 'v': v}} ORDER BY score DESC, id) AS cs FROM pool GROUP BY 1))"


@query(with_mem("SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY len(list_filter(kept, lambda y: y.id = pool.id)) DESC, score DESC, id) AS place FROM pool JOIN kk USING (qid)", ASKED, GOOD, VEC, SPREAD))
def mmr_diversity(spark, d):
    rows = _searchable(mem(spark, d))
    found = search.vector_search(rows, _asked(spark, d), 20)
    return greedy.diversify(found.join(rows.select("id", "vector"), "id")).select("qid", "id", r6(F.col("score")).alias("score"), "place")


BUDGET = r"""lines AS (SELECT qid, rank AS place, id, prefix, CASE WHEN length(s) > 180 THEN substr(s, 1, 179) || '…' ELSE s END AS summary FROM (SELECT qid, rank, id, '[' || memory_category || ':' || scope || '] ' AS prefix, regexp_replace(regexp_replace(regexp_replace(l0, '\s+', ' ', 'g'), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') AS s FROM kw JOIN mem USING (id) WHERE rank <= 10)),
walk AS (SELECT DISTINCT qid, 0::BIGINT AS place, 0::BIGINT AS used, 0::BIGINT AS n, false AS stop, NULL::VARCHAR AS id, NULL::VARCHAR AS line FROM lines
 UNION ALL SELECT qid, place, CASE WHEN fits THEN used + gap + length(prefix || summary) ELSE used END, CASE WHEN fits THEN n + 1 ELSE n END, room <= 0 OR (NOT fits AND short <> ''), id, CASE WHEN room <= 0 THEN NULL WHEN fits THEN prefix || summary WHEN short <> '' THEN prefix || short END
 FROM (SELECT *, length(prefix || summary) <= room AS fits, CASE WHEN room > length(prefix) THEN trim(substr(summary, 1, (room - length(prefix))::BIGINT)) ELSE '' END AS short FROM (SELECT l.*, w.used, w.n, CASE WHEN w.n > 0 THEN 1 ELSE 0 END AS gap, 800 - w.used - CASE WHEN w.n > 0 THEN 1 ELSE 0 END AS room FROM walk w JOIN lines l ON l.qid = w.qid AND l.place = w.place + 1 WHERE NOT w.stop AND w.n < 6)))"""


@query(with_mem("SELECT qid, id, line FROM walk WHERE line IS NOT NULL", ASKED, BM25, BUDGET).replace("WITH ", "WITH RECURSIVE ", 1))
def recall_within_budget(spark, d):
    rows = mem(spark, d)
    found = search.bm25_search(rows, _asked(spark, d), 10).join(rows.select("id", "l0", "scope", "memory_category"), "id")
    lines = found.select("qid", F.col("rank").alias("place"), "id", F.concat(F.lit("["), "memory_category", F.lit(":"), "scope", F.lit("] ")).alias("prefix"), text.one_line(F.col("l0"), 180).alias("summary"))
    return greedy.within_budget(lines, 6, 800)


GRAMS = "list_concat([substr({0}, i, 2) FOR i IN range(1, greatest(length({0}), 1))], [substr({0}, i, 3) FOR i IN range(1, greatest(length({0}) - 1, 1))])"
GRAM_SEARCH = f"""words AS (SELECT id, {GRAMS.format('low')} AS t FROM (SELECT id, lower(text) AS low FROM mem)), stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM words),
ask AS (SELECT DISTINCT qid, unnest({GRAMS.format('low')}) AS w FROM (SELECT qid, lower(query) AS low FROM asked WHERE qid > 0)),
post AS (SELECT id, len, w, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS w FROM words) WHERE w IN (SELECT w FROM ask) GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM post GROUP BY 1),
raw AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS raw FROM post JOIN df USING (w) JOIN ask USING (w), stats GROUP BY 1, 2),
kw AS (SELECT qid, id, raw, row_number() OVER (PARTITION BY qid ORDER BY round(1 / (1 + exp(-raw / 5)), 9) DESC, id) AS rank FROM raw)"""


@query(with_mem("SELECT qid, id, round(1 / (1 + exp(-raw / 5)), 6) AS score, rank FROM kw WHERE rank <= 5", ASKED, GRAM_SEARCH))
def bm25_grams(spark, d):
    """Keyword search over runs of two and three signs, for the evaluation items."""
    found = search.bm25_search(mem(spark, d), _asked(spark, d).where("qid > 0"), grams=True)
    return found.select("qid", "id", r6(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query()
def compress_sessions(spark, d):
    rows = said(spark, d).where("session is not null")
    reason = classify.line_reason(F.col("text"))
    lines = rows.select("session", F.col("msg_id").alias("pos"), "text", reason.alias("reason")).withColumn("score", classify.line_score(F.col("reason")))
    return greedy.compress_session(lines, 600)


@query()
def chunk_documents(spark, d):
    return greedy.chunks(table(spark, d, "documents"))
