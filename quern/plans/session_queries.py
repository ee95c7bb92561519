"""Registered queries of notes in markdown, sentences about their writer, and what is kept for a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import lines, sections
from quern.functions.text import trimmed
from quern.operators import sessions
from quern.plans.queries import ONCE, TEXTS, once, query, said
from quern.plans.reference_sql import NOW
from quern.session import table

PAGES = "(SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)"
BARE = r"regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}\x{{FEFF}}]+', ''), '[\s\p{{Z}}\x{{FEFF}}]+$', '')"


@query(f"""WITH l AS (SELECT doc_id, list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: {BARE.format('x')}) AS ls FROM {PAGES}),
h AS (SELECT doc_id, ls, list_min(list_filter(range(1, len(ls) + 1), lambda i: lower(ls[i]) = '## summary')) AS a FROM l),
e AS (SELECT doc_id, ls, a, coalesce(list_min(list_filter(range(1, len(ls) + 1), lambda i: i > a AND starts_with(ls[i], '## ') AND lower(ls[i]) <> '## summary')), len(ls) + 1) AS b FROM h WHERE a IS NOT NULL)
SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(ls[a + 1:b - 1], lambda x: starts_with(x, '- ') OR starts_with(x, '* ')), lambda x: {BARE.format('substr(x, 3)')}), lambda x: x <> ''), chr(10)) AS bullets FROM e""")
def section_bullets(spark, d):
    pages = table(spark, d, "documents").where("text is not null and doc_id is not null").select("doc_id", "text").distinct()
    found = pages.withColumns({"there": F.exists(F.split("text", r"\r?\n"), lambda x: F.lower(trimmed(x)) == "## summary"), "b": sections.bullets(F.col("text"), "Summary")})
    return found.where("there").select("doc_id", F.array_join("b", "\n").alias("bullets"))


@query(rf"""SELECT line, CASE WHEN regexp_matches(line, '(?i)^(always|never|when\b|if\b|before\b|after\b|prefer\b|avoid\b|require\b|only\b|do not\b|must\b|should\b)|\b(must|should|never|always|prefer|avoid|required?)\b') THEN 'invariant'
 WHEN regexp_matches(line, '(?i)^(this run|next run|going forward|follow-up|re-check|retest|verify|confirm|avoid repeating|adjust|change|update|retry|keep|watch)\b|\b(this run|next run|delta|change|adjust|retry|re-check|retest|verify|confirm|avoid repeating|follow-up)\b') THEN 'derived'
 WHEN regexp_matches(line, '(?i)^(investigate|verify|confirm|re-check|retest|update|add|remove|fix|avoid|keep|watch|document)\b') THEN 'open' ELSE 'plain' END AS kind FROM (SELECT DISTINCT {BARE.format('line')} AS line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM {PAGES}))""")
def line_kinds(spark, d):
    pages = table(spark, d, "documents").where("text is not null and doc_id is not null")
    each = pages.select(F.explode(F.split("text", "\n")).alias("line")).select(trimmed(F.col("line")).alias("line")).distinct()
    return each.select("line", sections.line_kind(F.col("line")).alias("kind"))


SENTENCES = ("My name is 'Ada Lovelace', hello", "我叫李雷。", "The user calls themselves \"Grace\"", "请叫我小王，谢谢", "I want to be addressed as Captain, please", "no name here", "I really like oolong tea and the rye bread from Mill House", "they love pears from Orchard")
ANSWERS = (("Ada Lovelace", None), ("李雷", None), ("Grace", None), (None, "小王"), (None, "Captain"), (None, None), (None, None), (None, None))
LIKED = (None,) * 6 + ("millhouse: oolongtea, ryebread", "orchard: pears")


def _literal(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query(f"SELECT id, [{', '.join(_literal(n) for n, _ in ANSWERS)}][1 + entry_index % 8] AS name, [{', '.join(_literal(a) for _, a in ANSWERS)}][1 + entry_index % 8] AS address, [{', '.join(map(_literal, LIKED))}][1 + entry_index % 8] AS liked FROM {ONCE} WHERE entry_index IS NOT NULL")
def identity_sentences(spark, d):
    """Eight sentences dealt out to all entries; the SQL holds what each gives."""
    s = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.col("entry_index") % 8 + 1).cast("int"))
    rows = once(spark, d).where("entry_index is not null").select("id", s.alias("s"))
    liked = sections.liked_items(F.col("s"))
    return rows.select("id", sections.own_name(F.col("s")).alias("name"), sections.form_of_address(F.col("s")).alias("address"), F.concat(liked["brand"], F.lit(": "), F.array_join(liked["items"], ", ")).alias("liked"))


SIGNALS = "(SELECT user_id AS session, event_type || floor(value)::BIGINT AS signature, epoch_ns(ts) // 1000000 AS ms, event_id AS seq FROM events)"


@query(f"""WITH f AS (SELECT session, signature, min((ms, seq)) AS f FROM {SIGNALS} GROUP BY 1, 2), k AS (SELECT session, signature, f[1] AS ms, f[2] AS seq FROM f QUALIFY row_number() OVER (PARTITION BY session ORDER BY f[1] DESC, f[2] DESC) <= 30),
u AS (SELECT * FROM k WHERE seq > (session % 5) * 100) SELECT session, signature, ms AS at FROM u QUALIFY row_number() OVER (PARTITION BY session ORDER BY ms DESC, seq DESC) <= 3""")
def error_signals(spark, d):
    e = table(spark, d, "events")
    signals = e.select(F.col("user_id").alias("session"), F.concat("event_type", F.floor("value").cast("string")).alias("signature"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    shown = e.select(F.col("user_id").alias("session")).distinct().withColumn("upto", F.col("session") % 5 * 100)
    return sessions.pending_signals(signals, shown)


SHOWN = f"(SELECT 's' || entry_index % 40 AS session, entry_index // 40 AS turn, id FROM {ONCE} WHERE entry_index IS NOT NULL)"


def shown(spark, d):
    n = F.col("entry_index")
    return once(spark, d).where("entry_index is not null").select(F.concat(F.lit("s"), (n % 40).cast("string")).alias("session"), F.floor(n / 40).alias("turn"), "id")


@query(f"SELECT session, turn, id, row_number() OVER (PARTITION BY session ORDER BY turn DESC, id) AS place FROM {SHOWN} QUALIFY place <= 24")
def injected_ring(spark, d):
    return sessions.ring(shown(spark, d))


@query(f"SELECT s.session, s.id FROM (SELECT * FROM {SHOWN} QUALIFY row_number() OVER (PARTITION BY session ORDER BY turn DESC, id) <= 5) s JOIN {ONCE} m USING (id) WHERE coalesce(m.timestamp, 0) <= {NOW - 90 * 86_400_000}")
def stale_injected(spark, d):
    rows = once(spark, d).select("id", F.coalesce("timestamp", F.lit(0)).alias("timestamp"))
    return sessions.stale_shown(shown(spark, d), rows, NOW)


@query("SELECT user_id AS session, event_type AS id, count(*) AS bad_recall_count, CASE WHEN count(*) >= 2 THEN max(event_id % 50) + 12 END AS suppressed_until_turn FROM events WHERE event_id % 4 = 0 GROUP BY 1, 2")
def bad_recalls(spark, d):
    e = table(spark, d, "events").where("event_id % 4 = 0")
    return sessions.harmful(e.select(F.col("user_id").alias("session"), F.col("event_type").alias("id"), (F.col("event_id") % 50).alias("turn")))


@query(rf"""SELECT lesson, count(*) AS evidence, CASE WHEN count(*) >= 2 THEN 'confirmed' ELSE 'pending' END AS state, CASE WHEN count(*) >= 2 THEN 0.72::DOUBLE ELSE 0.45::DOUBLE END AS confidence FROM (
 SELECT substr({BARE.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '(?:[a-z]:)?(?:/[\w.\-]+){{2,}}', '<path>', 'g'), '\b0x[0-9a-f]+\b|\b[0-9a-f]{{8,}}\b', '<hex>', 'g'), '\d+', '#', 'g'), '\s+', ' ', 'g')".replace("{{", "{").replace("}}", "}"))}, 1, 240) AS lesson FROM {TEXTS}) WHERE lesson <> '' GROUP BY 1""")
def lesson_buffer(spark, d):
    return sessions.lessons(said(spark, d).select(trimmed(F.col("text")).alias("text"), F.col("msg_id").alias("at")))


@query(rf"""SELECT msg_id, array_to_string(list_slice(list_filter(list_transform(string_split_regex(t, '\n|[。！？!?]'), lambda x: {BARE.format('x')}), lambda x: length(x) >= 12 AND length(x) <= 180 AND (regexp_matches(x, '(?i)\b(?:run|check|verify|inspect|patch|update|compare|reproduce|test|store|compile|distill|prune|compact|archive|trace|review)\b') OR regexp_matches(x, '运行|检查|验证|排查|修复|更新|比较|复现|测试|记录|归档|蒸馏|裁剪|压缩'))), 1, 1), '') AS step FROM {TEXTS}""")
def reusable_steps(spark, d):
    """The first step of each message that may be used again."""
    return said(spark, d).select("msg_id", F.coalesce(F.get(lines.steps(trimmed(F.col("text"))), F.lit(0)), F.lit("")).alias("step"))


@query(f"SELECT session, string_agg('said: ' || t, chr(10) ORDER BY msg_id) AS recent FROM (SELECT lower(trim(session_id)) AS session, msg_id, t FROM {TEXTS} WHERE session_id IS NOT NULL AND t <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim(session_id)) ORDER BY msg_id DESC) <= 4) GROUP BY 1")
def recent_texts(spark, d):
    rows = said(spark, d).where("session is not null").select("session", F.col("msg_id").alias("seq"), F.lit("said").alias("role"), trimmed(F.col("text")).alias("text"))
    return sessions.recent_texts(rows, F.col("text") != "", 4)
