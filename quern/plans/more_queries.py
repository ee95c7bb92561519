"""Registered queries of admission, merging, evidence, access, state over events, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import classify, numbers, text
from quern.operators import governance, greedy, pairs, search
from quern.plans.queries import ASKED, DAY, GOOD, ONCE, SEEDS, TEXTS, _asked, _in_duckdb, _searchable, mem, once, query, r6, said, walking
from quern.plans.reference_sql import NOW, with_mem
from quern.session import table
from quern.streaming import state

CAND = "(SELECT * FROM extraction_candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY created_at) = 1)"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("cand_id").orderBy("created_at")
    return table(spark, d, "extraction_candidates").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def asked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All candidates with usable vectors, as a set of queries."""
    return _searchable(candidates(spark, d)).select(F.col("cand_id").alias("qid"), F.col("abstract").alias("query"), "vector", "category")


ASK = f"ask AS (SELECT cand_id AS qid, category AS own, vector AS qv FROM {CAND} WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"
NEAR = "near AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, 1 / (2 - list_inner_product(qv::DOUBLE[], vector::DOUBLE[]) / (sqrt(list_inner_product(qv::DOUBLE[], qv::DOUBLE[])) * sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])))) AS score FROM good, ask))"


@query(with_mem("SELECT qid, id, round(score, 6) AS score FROM near WHERE score >= 0.55 AND rank <= 10", GOOD, ASK, NEAR))
def dedup_prefilter(spark, d):
    found = search.vector_search(_searchable(mem(spark, d)), asked_candidates(spark, d), 10, 0.55)
    return found.select("qid", "id", r6(F.col("score")).alias("score"))


@query(with_mem("SELECT qid, round(1 - greatest(0, max(2 - 1 / score)), 6) AS novelty FROM near GROUP BY 1", GOOD, ASK, NEAR))
def novelty(spark, d):
    found = search.vector_search(_searchable(mem(spark, d)), asked_candidates(spark, d), 1, 0.0)
    return found.select("qid", r6(1 - F.greatest(F.lit(0.0), 2 - 1 / F.col("score"))).alias("novelty"))


@query(with_mem("SELECT qid, id FROM (SELECT n.qid, n.id, m.memory_category = a.own AS same, max((m.memory_category = a.own)::INT) OVER (PARTITION BY n.qid) AS any_same FROM near n JOIN mem m USING (id) JOIN ask a ON a.qid = n.qid WHERE rank <= 8) WHERE any_same = 0 OR any_same IS NULL OR same", GOOD, ASK, NEAR))
def novelty_matches(spark, d):
    rows, asked = _searchable(mem(spark, d)), asked_candidates(spark, d)
    found = search.vector_search(rows, asked, 8, 0.0).join(rows.select("id", F.col("memory_category").alias("category")), "id").select(F.col("qid").alias("id"), F.col("id").alias("match"), "category")
    out = governance.novelty_matches(asked.select(F.col("qid").alias("id"), "category"), found)
    return out.select(F.col("id").alias("qid"), F.col("match").alias("id"))


ADMIT = f"""ADMITTED AS (SELECT qid AS id, greatest(0.0, least(1.0, 0.15 * 0.5 + 0.15 * 0.5 + 0.15 * (1 - nearest) + 0.15 * CASE WHEN latest <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - exp(-0.6931471805599453 / 14.0 * greatest(0.0, ({NOW} - latest) / 86400000.0)))) END
 + 0.4 * CASE own WHEN 'profile' THEN 0.95 WHEN 'preferences' THEN 0.9 WHEN 'entities' THEN 0.75 WHEN 'events' THEN 0.45 WHEN 'cases' THEN 0.8 WHEN 'patterns' THEN 0.85 ELSE 0.5 END)) AS score, nearest
 FROM (SELECT n.qid, any_value(a.own) AS own, max(greatest(0.0, 2 - 1 / score)) AS nearest, max(m.timestamp) AS latest FROM near n JOIN mem m USING (id) JOIN ask a ON a.qid = n.qid WHERE rank <= 8 GROUP BY 1))"""


@query(with_mem("SELECT id, round(score, 6) AS score, CASE WHEN score < 0.45 THEN 'reject' ELSE 'pass_to_dedup' END AS decision, CASE WHEN score < 0.45 THEN NULL WHEN score >= 0.6 AND nearest < 0.55 THEN 'add' ELSE 'update_or_merge' END AS hint FROM ADMITTED", GOOD, ASK, NEAR, ADMIT))
def admission(spark, d):
    rows, asked = _searchable(mem(spark, d)), asked_candidates(spark, d)
    found = search.vector_search(rows, asked, 8, 0.0).join(rows.select("id", "timestamp"), "id").select(F.col("qid").alias("id"), (2 - 1 / F.col("score")).alias("similarity"), "timestamp")
    cands = asked.select(F.col("qid").alias("id"), "category", F.lit(0.5).alias("support"), F.lit(0.5).alias("utility"))
    return governance.admission(cands, found, NOW).withColumn("score", r6(F.col("score")))


@query()
def confidence_support(spark, d):
    c = candidates(spark, d).select(F.col("cand_id").alias("id"), F.col("abstract").alias("said"), F.col("overview").alias("heard"))
    return governance.support(c).select("id", *(r6(F.col(x)).alias(x) for x in ("best", "coverage", "score")))


MERGED = r"""mb AS (SELECT seeds.seed AS cluster, sg.*, row_number() OVER (PARTITION BY seeds.seed ORDER BY sg.id <> seeds.seed, sg.n) AS pos FROM seeds JOIN sg USING (id)),
lines AS (SELECT cluster, pos, n2, regexp_replace(regexp_replace(line, '^[\s\p{Z}\x{FEFF}]+', ''), '[\s\p{Z}\x{FEFF}]+$', '') AS line FROM (SELECT cluster, pos, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n2 FROM mb)),
kept AS (SELECT * FROM lines WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY cluster, lower(line) ORDER BY pos, n2) = 1),
votes AS (SELECT cluster, first(category ORDER BY n DESC, seen) AS category FROM (SELECT cluster, category, count(*) AS n, min(pos) AS seen FROM mb GROUP BY 1, 2) GROUP BY 1)"""


@query(walking("SELECT mb.cluster, coalesce(any_value(t.text), '') AS text, least(1.0, max(importance)) AS importance, any_value(votes.category) AS category, arg_min(mb.scope, pos) AS scope, count(*) AS source_count FROM mb LEFT JOIN (SELECT cluster, string_agg(line, chr(10) ORDER BY pos, n2) AS text FROM kept GROUP BY 1) t ON t.cluster = mb.cluster LEFT JOIN votes ON votes.cluster = mb.cluster GROUP BY 1", GOOD, SEEDS, MERGED))
def compaction(spark, d):
    """Clusters around seeds, merged into one record each: the seed first, then the others in the order of the input."""
    rows = _searchable(mem(spark, d))
    clusters = pairs.seed_clusters(rows)
    placed = rows.select("id", "text", "importance", "category", "scope").join(once(spark, d).select("id", "entry_index"), "id")
    w = Window.partitionBy("cluster").orderBy(F.col("id") != F.col("cluster"), "entry_index")
    members = clusters.select(F.col("seed").alias("cluster"), "id").join(placed, "id").withColumn("pos", F.row_number().over(w))
    return governance.merged_clusters(members)


@query(
    f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY entry_index) AS pos FROM (SELECT coalesce(scope, '') AS scope, entry_index, text, importance, category FROM {ONCE} WHERE text IS NOT NULL AND importance IS NOT NULL AND category IS NOT NULL)),
 v AS (SELECT scope, category, count(*) AS votes, min(pos) AS seen FROM m GROUP BY 1, 2), c AS (SELECT scope, first(category ORDER BY votes DESC, seen) AS category FROM v GROUP BY 1)
 SELECT m.scope AS cluster, least(1.0, max(importance)) AS importance, any_value(c.category) AS category, count(*) AS source_count FROM m JOIN c USING (scope) GROUP BY 1"""
)
def cluster_merge_votes(spark, d):
    rows = once(spark, d).where("text is not null and importance is not null and category is not null").withColumn("scope", F.coalesce("scope", F.lit("")))
    members = rows.withColumn("pos", F.row_number().over(Window.partitionBy("scope").orderBy("entry_index"))).withColumn("cluster", F.col("scope"))
    return governance.merged_clusters(members).select("cluster", "importance", "category", "source_count")


EVIDENCE = f"""WITH e AS (SELECT id, category, lower(substr(text, 1, 12)) AS rule, coalesce(scope, '') AS session, coalesce(timestamp, 0) AS ts, 0.5 + (entry_index % 5) / 10.0 AS confidence FROM {ONCE} WHERE text IS NOT NULL AND category IS NOT NULL),
s AS (SELECT session FROM e GROUP BY 1 ORDER BY max(ts) DESC, session LIMIT 15),
g AS (SELECT category, rule, count(*) AS evidence_count, count(DISTINCT session) AS sessions, avg(confidence) AS mean, arg_max(confidence, (ts, id)) AS newest FROM e WHERE session IN (SELECT session FROM s) GROUP BY 1, 2)
SELECT category, rule, evidence_count, sessions, round(least(1.0, least(1.0, sessions / greatest(2, evidence_count)) * 0.45 + mean * 0.55), 6) AS stability, round(greatest(newest, mean), 6) AS confidence FROM g"""


@query(EVIDENCE)
def evidence_aggregate(spark, d):
    rows = once(spark, d).where("text is not null and category is not null").select("id", "category", F.lower(F.substring("text", 1, 12)).alias("rule"), F.coalesce("scope", F.lit("")).alias("session"), F.coalesce("timestamp", F.lit(0)).alias("timestamp"), (0.5 + (F.col("entry_index") % 5) / 10.0).alias("confidence"))
    out = governance.evidence(rows, 15)
    return out.select("category", "rule", "evidence_count", "sessions", r6(F.col("stability")).alias("stability"), r6(F.col("confidence")).alias("confidence"))


@query(with_mem("SELECT agent, count(*) AS n FROM (SELECT 'main' AS agent, id FROM mem WHERE scope IN ('global', 'agent:main', 'reflection:agent:main') UNION ALL SELECT 'guest', id FROM mem WHERE scope IN ('agent:belullo', 'reflection:agent:guest')) GROUP BY 1"))
def scope_access(spark, d):
    grants = spark.createDataFrame([("main", None), ("guest", "agent:belullo")], "agent string, scope string")
    return governance.accessible(mem(spark, d).select("id", "scope"), grants).groupBy("agent").agg(F.count("*").alias("n"))


CHAINS = f"WITH RECURSIVE v AS (SELECT scope AS s, id, lag(id) OVER (PARTITION BY scope ORDER BY entry_index) AS up FROM {ONCE} WHERE scope IS NOT NULL), r AS (SELECT id, id AS root, 0::BIGINT AS depth FROM v WHERE up IS NULL UNION ALL SELECT v.id, r.root, r.depth + 1 FROM v JOIN r ON v.up = r.id) SELECT id, root, depth FROM r"


@query(CHAINS)
def supersession_chain(spark, d):
    w = Window.partitionBy("scope").orderBy("entry_index")
    rows = once(spark, d).where("scope is not null")
    return governance.version_chains(rows.select("id", F.lag("id").over(w).alias("supersedes")))


# ---- state over events

EVENTS = "SELECT event_id, user_id, event_type, epoch_ns(ts) // 1000000 AS at_ms FROM events"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "ts")


@query(f"WITH e AS ({EVENTS}) SELECT event_id, seen, seen <= 3 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY at_ms RANGE BETWEEN {30 * DAY} PRECEDING AND CURRENT ROW) AS seen FROM e)")
def rate_limit(spark, d):
    return state.rate_limited(events(spark, d), 3, "user_id", 30 * DAY).select("event_id", "seen", "allowed")


@query(f"WITH e AS ({EVENTS}) SELECT event_id FROM (SELECT event_id, at_ms, lag(at_ms) OVER (PARTITION BY user_id, event_type ORDER BY at_ms, event_id) AS last FROM e) WHERE last IS NULL OR at_ms - last > {DAY}")
def hook_dedup(spark, d):
    return state.first_of_repeats(events(spark, d), ["user_id", "event_type"], DAY).select("event_id")


@query("WITH e AS (SELECT user_id AS session, event_type AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) SELECT session, id, turn, last IS NULL OR turn - last >= 4 AS fresh FROM (SELECT *, lag(turn) OVER (PARTITION BY session, id ORDER BY turn) AS last FROM e)")
def recall_history(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("id"), F.row_number().over(w).cast("bigint").alias("turn"))
    return state.not_repeated(rows, 4)


@query("SELECT event_type, epoch_ns(ts) // 86400000000000 AS day, count(*) AS n FROM events GROUP BY 1, 2")
def admitted_window(spark, d):
    out = state.window_counts(table(spark, d, "events"), "ts", "event_type", "24 hours", "24 hours")
    return out.select("event_type", F.expr("unix_millis(cast(start as timestamp)) div 86400000").alias("day"), "n")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(epoch_ns(ts) // 1000000) AS last FROM events GROUP BY 1")
def access_sums(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last"))


# ---- sets, tails and texts


@query("SELECT id FROM (SELECT cand_id AS id FROM extraction_candidates WHERE vector IS NOT NULL UNION SELECT id FROM memories WHERE vector IS NOT NULL)")
def union_of_ids(spark, d):
    return table(spark, d, "extraction_candidates").where("vector is not null").select(F.col("cand_id").alias("id")).unionByName(table(spark, d, "memories").where("vector is not null").select("id")).distinct()


@query("SELECT DISTINCT id FROM memories WHERE vector IS NOT NULL AND id NOT IN (SELECT id FROM memories WHERE text IS NULL OR trim(text) = '')")
def ghost_difference(spark, d):
    rows = table(spark, d, "memories")
    return rows.where("vector is not null").select("id").join(rows.where("text is null or trim(text) = ''").select("id"), "id", "left_anti").distinct()


@query("SELECT session_id, msg_id FROM (SELECT lower(trim(session_id)) AS session_id, msg_id, row_number() OVER (PARTITION BY lower(trim(session_id)) ORDER BY msg_id DESC) AS n FROM (SELECT DISTINCT session_id, msg_id FROM (SELECT lower(trim(session_id)) AS session_id, msg_id FROM session_messages WHERE session_id IS NOT NULL))) WHERE n <= 3")
def last_messages(spark, d):
    rows = table(spark, d, "session_messages").where("session_id is not null").select(F.lower(F.trim("session_id")).alias("session_id"), "msg_id").distinct()
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("msg_id")))).where("n <= 3").drop("n")


LINES = TEXTS.replace("(SELECT msg_id, session_id,", "(SELECT lower(trim(session_id)) AS session, msg_id,", 1)


@query(f"""WITH l AS (SELECT DISTINCT session, msg_id, t, content FROM {LINES} WHERE session IS NOT NULL),
g AS (SELECT session, max(regexp_matches(t, {_in_duckdb(classify.MEMORY_INTENT)})::INT) AS intent, max((regexp_matches(t, {_in_duckdb(classify.CORRECTION)}) OR regexp_matches(t, {_in_duckdb(classify.DECISION)}))::INT) AS turn, max(regexp_matches(t, {_in_duckdb(classify.TOOL_CALL)})::INT) AS tool, sum(CASE WHEN length(t) > 20 THEN length(content) ELSE 0 END) AS chars, count(*) AS n FROM l GROUP BY 1)
SELECT session, least(1.0, round(0.5::DOUBLE * intent + 0.4 * tool + 0.3 * turn + CASE WHEN chars > 200 THEN 0.2 ELSE 0 END + CASE WHEN n > 6 THEN 0.1 ELSE 0 END, 6))::DOUBLE AS value FROM g""")
def conversation_value(spark, d):
    return governance.conversation_value(said(spark, d).where("session is not null"))


_SIGN = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]"
TOKENS = rf"list_distinct(flatten(list_transform(regexp_extract_all(lower({{0}}), '{_SIGN}+|[\p{{{{Latin}}}}\p{{{{Greek}}}}\p{{{{Cyrillic}}}}\p{{{{N}}}}]+'), lambda w: CASE WHEN regexp_matches(w, '^{_SIGN}') THEN list_concat(string_split(w, ''), list_transform(range(1, greatest(length(w), 2)), lambda i: substr(w, i::BIGINT, 2))) ELSE [w] END)))"
_BARE = r"regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}\x{{FEFF}}]+', ''), '[\s\p{{Z}}\x{{FEFF}}]+$', '')"
LEXICAL = f"""tk AS (SELECT id, text, unnest({TOKENS.replace("{{", "{").replace("}}", "}").replace("{0}", "text")}) AS w FROM mem), qt AS (SELECT qid, query, toks, unnest(toks) AS w FROM (SELECT qid, query, {TOKENS.replace("{{", "{").replace("}}", "}").replace("{0}", "query")} AS toks FROM asked)),
hits AS (SELECT qid, id, any_value(query) AS query, any_value(text) AS text, any_value(len(toks)) AS size, count(*) AS matched FROM tk JOIN qt USING (w) GROUP BY 1, 2),
lx AS (SELECT qid, id, least(0.95, greatest(0.5 + 0.42 * matched / size, CASE WHEN contains(lower({_BARE.format('text')}), lower({_BARE.format('query')})) THEN 0.88 ELSE 0 END, CASE WHEN matched = size THEN 0.92 ELSE 0 END)) AS score FROM hits)"""


@query(with_mem("SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM lx) WHERE rank <= 5", ASKED, LEXICAL))
def lexical_search(spark, d):
    return search.lexical_search(mem(spark, d), _asked(spark, d)).select("qid", "id", r6(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(with_mem("SELECT id, substr(CASE WHEN l > 80 THEN substr(s, 1, 79) || '…' ELSE s END, 1, 80) AS line FROM (SELECT id, s, length(s) AS l FROM (SELECT id, regexp_replace(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '') AS s FROM mem))"))
def recall_line(spark, d):
    return mem(spark, d).select("id", text.one_line(F.col("text"), 80).alias("line"))


@query(f"SELECT batch_id, round(a, 4) AS first_entry, b AS n FROM (SELECT batch_id, (sum(v * w) / sum(w)) AS a, count(*) AS b FROM (SELECT batch_id, vector[1]::DOUBLE AS v, CASE WHEN row_number() OVER (PARTITION BY batch_id ORDER BY index) = 1 THEN 1.2 WHEN row_number() OVER (PARTITION BY batch_id ORDER BY index) = count(*) OVER (PARTITION BY batch_id) THEN 1.1 ELSE 1.0 END AS w FROM {CAND} WHERE len(vector) = 64 AND isfinite(vector[1])) GROUP BY 1)")
def chunk_vector_mean(spark, d):
    """The first entry of each batch's weighted mean vector, beside the number of vectors."""
    rows = candidates(spark, d).where((F.size("vector") == 64) & ~F.isnan(F.col("vector")[0]) & (F.abs(F.col("vector")[0]) != float("inf")))
    g = rows.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "vector"))), lambda x: x["vector"]).alias("vs"))
    return g.select("batch_id", F.round(numbers.weighted_mean_vector(F.col("vs"))[0], 4).alias("first_entry"), F.size("vs").cast("bigint").alias("n"))


@query()
def embed_documents(spark, d):
    return greedy.embed(table(spark, d, "documents").where("doc_id is not null").select("doc_id", "text"), "text").select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))

