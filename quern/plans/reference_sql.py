"""SQL for DuckDB against which the queries are checked; ``{mem}`` stands for the normalised rows."""

NOW = 1_767_225_600_000

#: Normalised rows: the common start of most checks.
MEM = r"""
d AS (SELECT * FROM memories QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1),
j AS (SELECT *, CASE WHEN json_valid(metadata) AND json_type(metadata) = 'OBJECT' THEN metadata::JSON END AS m, coalesce(text, '') AS t,
        coalesce(timestamp, 0) AS ts FROM d),
c AS (SELECT *, CASE category WHEN 'preference' THEN 'preferences' WHEN 'entity' THEN 'entities' WHEN 'decision' THEN 'events'
        WHEN 'fact' THEN CASE WHEN regexp_matches(t, '(?i)\b(my |i am |i''m |name is |叫我|我的|我是)\b') AND length(t) < 200 THEN 'profile' ELSE 'cases' END
        ELSE 'patterns' END AS cat,
        coalesce(json_extract_string(m, '$.source'), CASE json_extract_string(m, '$.type') WHEN 'session-summary' THEN 'session-summary'
          WHEN 'memory-reflection' THEN 'reflection' WHEN 'memory-reflection-item' THEN 'reflection' ELSE 'legacy' END) AS src0 FROM j),
c1 AS (SELECT *, CASE WHEN src0 IN ('manual','auto-capture','reflection','session-summary','legacy') THEN src0 ELSE 'legacy' END AS src FROM c),
c2 AS (SELECT *, coalesce(json_extract_string(m, '$.state'), CASE WHEN src = 'session-summary' THEN 'archived' ELSE 'confirmed' END) AS state0,
        coalesce(json_extract_string(m, '$.memory_category'), cat) AS mcat FROM c1),
c3 AS (SELECT *, CASE WHEN state0 IN ('pending','confirmed','archived') THEN state0 ELSE 'confirmed' END AS st,
        coalesce(try_cast(json_extract_string(m, '$.access_count') AS DOUBLE), 0) AS ac, try_cast(json_extract_string(m, '$.confidence') AS DOUBLE) AS cf FROM c2),
mem AS (SELECT id, t AS text, vector, category, CASE WHEN coalesce(scope, '') = '' THEN 'global' ELSE scope END AS scope, coalesce(importance, 0) AS importance,
        ts AS timestamp, src AS source, st AS state, t AS l0, ts AS valid_from, mcat AS memory_category,
        CASE WHEN src IN ('reflection','session-summary') THEN 'reflection' WHEN st = 'archived' THEN 'archive'
             WHEN cat IN ('profile','preferences','events') THEN 'durable' ELSE 'working' END AS layer,
        CASE WHEN mcat IN ('profile','preferences','entities','patterns') THEN 'knowledge' WHEN mcat IN ('events','cases') THEN 'experience'
             WHEN category IN ('preference','entity','fact') THEN 'knowledge' WHEN category IN ('decision','reflection') THEN 'experience' ELSE 'knowledge' END AS memory_type,
        CASE WHEN json_extract_string(m, '$.tier') IN ('core','working','peripheral') THEN json_extract_string(m, '$.tier') ELSE 'working' END AS tier,
        CASE WHEN ac >= 0 THEN floor(ac)::BIGINT ELSE 0 END AS access_count, CASE WHEN cf IS NULL OR NOT isfinite(cf) THEN 0.7 ELSE greatest(0, least(1, cf)) END AS confidence, ts AS last_accessed_at FROM c3)
"""

#: Decay on top of the normalised rows.
DECAY = rf"""
k0 AS (SELECT *, CASE WHEN isfinite(importance) THEN greatest(0.0, least(1.0, importance)) ELSE 0.7 END AS w, CASE WHEN access_count > 0 THEN last_accessed_at ELSE timestamp END AS last FROM mem),
k1 AS (SELECT *, exp(-0.6931471805599453 / (30.0 * (CASE memory_type WHEN 'knowledge' THEN 3.0 ELSE 0.7 END) * exp(1.5 * w))
          * pow(greatest(0.0, ({NOW} - last) / 86400000.0), CASE tier WHEN 'core' THEN 0.8 WHEN 'peripheral' THEN 1.3 ELSE 1.0 END)) AS recency,
        CASE WHEN access_count <= 1 THEN 1 - exp(-access_count / 5.0)
             ELSE (1 - exp(-access_count / 5.0)) * (0.5 + 0.5 * exp(-(greatest(1.0, (last - timestamp) / 86400000.0) / greatest(access_count - 1, 1)) / 30)) END AS frequency,
        w * confidence AS intrinsic FROM k0),
decayed AS (SELECT *, 0.4 * recency + 0.3 * frequency + 0.3 * intrinsic AS composite FROM k1)
"""


def with_mem(body: str, *more: str) -> str:
    return "WITH " + ",".join([MEM, *more]) + body
