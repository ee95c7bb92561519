"""What is kept for a session: signals not yet shown, texts shown lately, memories that did harm, lessons seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import MS_PER_DAY
from quern.functions.text import lesson_text


def pending_signals(signals: DataFrame, shown: DataFrame, most: int = 3, keep: int = 30) -> DataFrame:
    """session, signature, at of the newest signals not yet shown.

    signals: session, signature, at, seq. A signature counts once in a session, at
    its first place; the last ``keep`` stay. shown: session, upto (a seq).
    """
    first = signals.groupBy("session", "signature").agg(F.min(F.struct("at", "seq")).alias("f")).select("session", "signature", "f.at", "f.seq")
    last = lambda n: F.row_number().over(Window.partitionBy("session").orderBy(F.desc("at"), F.desc("seq"))) <= n
    kept = first.withColumn("ok", last(keep)).where("ok").drop("ok")
    fresh = kept.join(shown, "session", "left").where(F.col("upto").isNull() | (F.col("seq") > F.col("upto")))
    return fresh.withColumn("ok", last(most)).where("ok").select("session", "signature", "at")


def ring(shown: DataFrame, most: int = 24) -> DataFrame:
    """The last texts shown in each session (session, turn, id), with their place from the newest."""
    w = Window.partitionBy("session").orderBy(F.desc("turn"), "id")
    return shown.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most)


def stale_shown(shown: DataFrame, rows: DataFrame, now: int, days: int = 90, most: int = 5) -> DataFrame:
    """session, id of the texts shown last whose row is older than so many days."""
    last = ring(shown, most).select("session", "id").distinct()
    return last.join(rows.select("id", "timestamp"), "id").where(F.col("timestamp") <= now - days * MS_PER_DAY).select("session", "id")


def harmful(bad: DataFrame, least: int = 2, turns: int = 12) -> DataFrame:
    """session, id, bad_recall_count, suppressed_until_turn of memories that were wrong (session, id, turn): from the second time on they are held back."""
    g = bad.groupBy("session", "id").agg(F.count("*").alias("bad_recall_count"), F.max("turn").alias("last"))
    return g.select("session", "id", "bad_recall_count", F.when(F.col("bad_recall_count") >= least, F.col("last") + turns).alias("suppressed_until_turn"))


def lessons(said: DataFrame, least: int = 2) -> DataFrame:
    """lesson, evidence, state, confidence of texts (text, at): what was seen before is confirmed. Texts count as one by paths, numbers and case left aside."""
    g = said.groupBy(lesson_text(F.col("text")).alias("lesson")).agg(F.count("*").alias("evidence")).where("lesson <> ''")
    sure = F.col("evidence") >= least
    return g.select("lesson", "evidence", F.when(sure, "confirmed").otherwise("pending").alias("state"), F.when(sure, 0.72).otherwise(0.45).alias("confidence"))


def recent_texts(messages: DataFrame, keep: Column, most: int) -> DataFrame:
    """session, recent: the last texts of each session (session, seq, role, text), oldest first, one a line."""
    w = Window.partitionBy("session").orderBy(F.desc("seq"))
    last = messages.where(keep).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    lines = F.array_sort(F.collect_list(F.struct("seq", F.concat("role", F.lit(": "), "text").alias("line"))))  # at most ``most``
    return last.groupBy("session").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("recent"))
