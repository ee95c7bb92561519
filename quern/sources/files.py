"""Readers and writers of JSON, JSONL, markdown notes and older tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.lines import skipped_message
from quern.functions.text import message_text, redact, trimmed
from quern.operators.sessions import recent_texts
from quern.operators.store import LIST_COLUMNS, importable, legacy_columns, new_only

TRACE = "kind string, recordedAt bigint, source string, trace struct<query:string,mode:string,startedAt:bigint,stages:array<struct<name:string,inputCount:int,outputCount:int,durationMs:int>>,finalCount:int,totalMs:bigint>"
REJECTION = "version string, rejected_at bigint, session_key string, target_scope string, candidate struct<category:string,abstract:string>, audit struct<decision:string,score:double,reason:string,max_similarity:double>"
TRANSCRIPT = "type string, timestamp string, message struct<role:string,content:string,timestamp:bigint>"
MEMORY = "id string, text string, category string, scope string, importance double, timestamp bigint, metadata string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSONL files; lines that cannot be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def last_rows(rows: DataFrame, time_col: str, n: int, key: str | None = None) -> DataFrame:
    """The last n rows, of every key where one is named."""
    if key is None:
        return rows.orderBy(F.desc(time_col)).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time_col)))).where(F.col("_n") <= n).drop("_n")


def export_json(rows: DataFrame, path: str) -> None:
    """Rows without vectors as JSONL."""
    rows.select(*LIST_COLUMNS).write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, rows: DataFrame, now: int) -> DataFrame:
    """Valid rows of an export whose id the table lacks."""
    return new_only(importable(spark.read.schema(MEMORY).json(path), now), rows)


def backup(rows: DataFrame, folder: str, day: str) -> str:
    """A day's rows without vectors in a folder of its own, so that old days can be dropped."""
    path = f"{folder.rstrip('/')}/day={day}"
    export_json(rows, path)
    return path


def markdown_bullets(spark: SparkSession, path: str, least: int = 5) -> DataFrame:
    """file, line, text, agent, day of the bullets in markdown notes; folders name the agent, files the day."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("file", F.input_file_name())
    each = lines.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    text = trimmed(F.regexp_extract("value", r"^\s*[-*+]\s+(.*)$", 1))
    found = each.select("file", "line", text.alias("text")).where(F.length("text") >= least)
    return found.select("file", "line", "text", F.nullif(F.regexp_extract("file", r"/agents/([^/]+)/", 1), F.lit("")).alias("agent"), F.nullif(F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})[^/]*\.md$", 1), F.lit("")).alias("day"))


def import_markdown(spark: SparkSession, path: str, rows: DataFrame, scope: str = "global") -> DataFrame:
    """Bullets as new rows, without those whose text the scope holds already."""
    found = markdown_bullets(spark, path)
    where = F.when(F.col("agent").isNotNull(), F.concat(F.lit("agent:"), "agent")).otherwise(F.lit(scope))
    new = found.select("text", where.alias("scope")).distinct()
    return new.join(rows.select("text", F.coalesce("scope", F.lit("global")).alias("scope")), ["text", "scope"], "left_anti").select(F.sha2(F.concat_ws("\x01", "scope", "text"), 256).alias("id"), "text", "scope")


def learnings(spark: SparkSession, path: str) -> DataFrame:
    """id, kind, status, priority, area, summary of the entries of learning files."""
    whole = spark.read.text(path, wholetext=True)
    entry = whole.select(F.explode(F.split("value", r"(?m)^(?=## \[(?:LRN|ERR)-)")).alias("e")).where(F.col("e").rlike(r"^## \[(LRN|ERR)-"))
    get = lambda name: F.nullif(trimmed(F.regexp_extract("e", rf"(?mi)^\*\*{name}\*\*\s*:?\s*(.*)$", 1)), F.lit(""))
    summary = trimmed(F.regexp_extract("e", r"(?s)### Summary\s*\n(.*?)(?:\n###|\z)", 1))
    return entry.select(F.regexp_extract("e", r"^## \[([^\]]+)\]", 1).alias("id"), F.regexp_extract("e", r"^## \[(LRN|ERR)", 1).alias("kind"), get("Status").alias("status"), get("Priority").alias("priority"), get("Area").alias("area"), F.nullif(summary, F.lit("")).alias("summary"))


def legacy_table(spark: SparkSession, path: str) -> DataFrame:
    """An older table with the columns of today."""
    rows = legacy_columns(spark.read.parquet(path))
    return rows.select("id", "text", F.col("vector").cast("array<float>").alias("vector"), "category", "scope", F.col("importance").cast("double").alias("importance"), F.col("timestamp").cast("bigint").alias("timestamp"), "metadata")


def transcript_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of transcripts as a stream; its checkpoint is the cursor."""
    return spark.readStream.schema(TRANSCRIPT).option("mode", "DROPMALFORMED").json(folder)


def drop_old_backups(spark: SparkSession, folder: str, keep: int = 7) -> list[str]:
    """Removes the oldest days of a backup folder, beyond the last ``keep``; gives the days removed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    days = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("day="))
    gone = days[: max(0, len(days) - keep)]
    for day in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, day), True)
    return [d.removeprefix("day=") for d in gone]


def transcripts(spark: SparkSession, path: str, most: int) -> DataFrame:
    """file, recent: the last user and assistant texts of each transcript, oldest first; files that hold none are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    parsed = lines.select("file", "n", F.from_json("line", "type string, message struct<role:string,content:string>").alias("j"))
    said = parsed.where("j.type = 'message'").select(F.col("file").alias("session"), F.col("n").alias("seq"), F.col("j.message.role").alias("role"), message_text(F.col("j.message.content")).alias("text"))
    keep = F.col("role").isin("user", "assistant") & ~skipped_message(F.col("role"), F.col("text"))
    return recent_texts(said.withColumn("text", redact(trimmed(F.col("text")))), keep, most).withColumnRenamed("session", "file")


def learning_counts(entries: DataFrame) -> DataFrame:
    """One row over entries of learning files: total, pending, urgent, promoted."""
    of = lambda c, *v: F.count_if(F.lower(c).isin(*v))
    return entries.agg(F.count("*").alias("total"), of("status", "pending").alias("pending"), of("priority", "high", "critical").alias("urgent"), F.count_if(F.startswith(F.lower("status"), F.lit("promoted"))).alias("promoted"))
