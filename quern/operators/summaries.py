"""Summaries over audits, runs, evidence, messages, lines and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import MS_PER_DAY
from quern.operators.scoring import reflection_score

# Names of the contexts that evidence is kept for.
CONTEXTS = {
    "早上": "morning", "上午": "morning", "早晨": "morning", "下午": "afternoon", "傍晚": "evening", "晚上": "evening", "深夜": "night", "夜晚": "night", "凌晨": "night", "工作日": "weekday", "平时": "weekday",
    "周末": "weekend", "假日": "weekend", "休息日": "weekend", "工作": "work", "上班": "work", "办公": "work", "休闲": "leisure", "放松": "leisure", "休息": "leisure", "夏天": "summer", "夏季": "summer", "冬天": "winter", "冬季": "winter", "旅行": "travel", "出差": "travel", "旅游": "travel",
}


def extraction_summary(runs: DataFrame) -> DataFrame:
    """One row over runs (ms, created, merged, skipped, rejected)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("created", "merged", "skipped", "rejected")]
    return runs.agg(F.count("*").alias("runs"), F.floor(F.avg("ms") + 0.5).cast("bigint").alias("avg_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").cast("bigint").alias("p95_ms"), *sums)


def category_breakdown(audits: DataFrame) -> DataFrame:
    """category, admitted, rejected, total, reject_rate of audits (category, admitted, at)."""
    g = audits.groupBy(F.coalesce("category", F.lit("(none)")).alias("category")).agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("rejected"), F.count("*").alias("total"))
    return g.withColumn("reject_rate", F.col("rejected") / F.col("total"))


def window_summary(audits: DataFrame, now: int, days: tuple[int, ...] = (1, 7)) -> DataFrame:
    """days, admitted, rejected, reject_rate of the audits of the last days, in one pass."""
    each = audits.select(F.explode(F.array(*(F.when(F.col("at") >= now - n * MS_PER_DAY, n) for n in days))).alias("days"), "admitted").where("days is not null")
    g = each.groupBy("days").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("rejected"))
    return g.withColumn("reject_rate", F.col("rejected") / (F.col("admitted") + F.col("rejected")))


def context_of(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    known = F.create_map(*(F.lit(x) for pair in CONTEXTS.items() for x in pair))
    return F.when(t == "", "general").otherwise(F.coalesce(F.try_element_at(known, t), t))


def support_stats(log: DataFrame, most: int = 8) -> DataFrame:
    """id, context, confirmations, contradictions, strength, last, and of the whole id total and global_strength.

    log: id, context, confirms, at. The ``most`` contexts seen last are kept; the
    whole counts those dropped as well.
    """
    g = log.groupBy("id", context_of(F.col("context")).alias("context")).agg(F.count_if("confirms").alias("confirmations"), F.count_if(~F.col("confirms")).alias("contradictions"), F.max("at").alias("last"))
    whole = Window.partitionBy("id")
    total = F.sum(F.col("confirmations") + F.col("contradictions")).over(whole)
    g = g.withColumns({"total": total, "global_strength": F.sum("confirmations").over(whole) / total, "n": F.row_number().over(whole.orderBy(F.desc("last"), "context"))})
    return g.where(F.col("n") <= most).drop("n").withColumn("strength", F.col("confirmations") / (F.col("confirmations") + F.col("contradictions")))


def role_counts(messages: DataFrame) -> DataFrame:
    """role, rows, of them plain texts and block lists, and the text blocks in these; messages: msg_id, role, content, each once."""
    listed = F.coalesce(F.col("content").rlike(r"^\s*\["), F.lit(False))
    blocks = F.from_json(F.when(listed, F.col("content")), "array<struct<type:string>>")
    rows = messages.select(F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown")).alias("role"), listed.alias("listed"), F.col("content").isNotNull().alias("there"), F.size(F.filter(F.coalesce(blocks, F.array().cast("array<struct<type:string>>")), lambda b: b["type"] == "text")).alias("texts"))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("there") & ~F.col("listed")).alias("plain"), F.count_if("listed").alias("lists"), F.sum("texts").alias("text_blocks"))


def ranked_lines(lines: DataFrame, now: int, most: int = 8, midpoint: float = 45.0, k: float = 0.22) -> DataFrame:
    """kind, place, line, score of lines (kind, line, at, weight, quality, fallback): the best of each kind.

    Lines that differ in case and blanks are one: their scores add up, the newest
    wording is shown.
    """
    key = F.lower(F.regexp_replace(F.trim("line"), r"\s+", " "))
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("at")) / MS_PER_DAY)
    each = lines.withColumn("score", reflection_score(age, F.lit(midpoint), F.lit(k), F.col("weight"), F.col("quality"), F.col("fallback")))
    g = each.groupBy("kind", key.alias("key")).agg(F.sum("score").alias("score"), F.max_by("line", F.struct("at", "line")).alias("line"), F.max("at").alias("latest"))
    w = Window.partitionBy("kind").orderBy(F.round("score", 9).desc(), F.desc("latest"), "line")
    return g.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most).select("kind", "place", "line", "score")


def evaluated(found: DataFrame, expected: DataFrame, forbidden: DataFrame) -> DataFrame:
    """qid, hits, misses, zero, passed of cases: results (qid, id) against expected and forbidden ids (qid, id)."""
    cases = expected.select("qid").unionByName(forbidden.select("qid")).distinct()
    mark = lambda rows, name: rows.select("qid", "id").distinct().withColumn(name, F.lit(True))
    both = found.select("qid", "id").distinct().join(mark(expected, "good"), ["qid", "id"], "left").join(mark(forbidden, "bad"), ["qid", "id"], "left")
    g = both.groupBy("qid").agg(F.count("*").alias("n"), F.count("good").alias("hits"), F.count("bad").alias("misses"))
    out = cases.join(g, "qid", "left").select("qid", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "hits", "misses")))
    return out.select("qid", "hits", "misses", (F.col("n") == 0).alias("zero"), ((F.col("hits") > 0) & (F.col("misses") == 0)).alias("passed"))


def traced(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """qid, place, stage, before, after, dropped, low, high of stages (name, rows of qid, id, score) of the same searches."""
    out, before = None, None
    for place, (name, rows) in enumerate(stages):
        g = rows.groupBy("qid").agg(F.count("*").alias("after"), F.min("score").alias("low"), F.max("score").alias("high"))
        g = g.withColumn("before", F.col("after")) if before is None else before.join(g, "qid", "left").withColumn("after", F.coalesce("after", F.lit(0)))
        part = g.select("qid", F.lit(place).alias("place"), F.lit(name).alias("stage"), "before", "after", (F.col("before") - F.col("after")).alias("dropped"), "low", "high")
        out = part if out is None else out.unionByName(part)
        before = g.select("qid", F.col("after").alias("before"))
    return out
