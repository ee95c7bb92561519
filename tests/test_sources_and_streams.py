import json

import pytest
from pyspark.sql import functions as F

from quern.operators.store import LIST_COLUMNS
from quern.sources import files
from quern.streaming import state

MEMORIES = "id string, text string, vector array<float>, category string, scope string, importance double, timestamp bigint, metadata string"


def test_json_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "first", [1.0], "fact", "global", 0.5, 10, "{}"), ("2", "second", None, "odd", None, None, None, None), ("3", "x", None, "fact", None, 0.1, 1, "{}")], MEMORIES)
    files.export_json(rows, f"{tmp_path}/out")
    got = {r.id: r for r in files.import_json(spark, f"{tmp_path}/out", rows.where("id = '1'"), 99).collect()}
    assert set(got) == {"2"} and got["2"].category == "other" and got["2"].importance == 0.7 and got["2"].timestamp == 99
    assert spark.read.json(files.backup(rows, str(tmp_path / "b"), "2026-01-01")).count() == 3 and "vector" not in LIST_COLUMNS


def test_jsonl_skips_broken_lines_and_keeps_the_last(spark, tmp_path):
    lines = [json.dumps({"kind": "retrieval", "recordedAt": i, "source": "cli", "trace": {"query": "q", "finalCount": i, "totalMs": 3}}) for i in range(5)]
    (tmp_path / "t.jsonl").write_text("\n".join([*lines[:2], "{broken", *lines[2:]]))
    rows = files.read_jsonl(spark, str(tmp_path / "t.jsonl"), files.TRACE)
    assert sorted(r.recordedAt for r in files.last_rows(rows, "recordedAt", 2).collect()) == [3, 4]
    assert files.last_rows(rows, "recordedAt", 1, "source").count() == 1


def test_markdown(spark, tmp_path):
    (tmp_path / "agents/otter/memory").mkdir(parents=True)
    (tmp_path / "MEMORY.md").write_text("# Notes\n- prefers oolong tea\n* ok\n+ keeps the ledger\nno bullet\n")
    (tmp_path / "agents/otter/memory/2026-01-02-x.md").write_text("- moved the harbor index\n")
    got = {(r.text, r.agent, r.day) for r in files.markdown_bullets(spark, str(tmp_path)).collect()}
    assert got == {("prefers oolong tea", None, None), ("keeps the ledger", None, None), ("moved the harbor index", "otter", "2026-01-02")}
    have = spark.createDataFrame([("prefers oolong tea", None)], "text string, scope string")
    assert {(r.text, r.scope) for r in files.import_markdown(spark, str(tmp_path), have).collect()} == {("keeps the ledger", "global"), ("moved the harbor index", "agent:otter")}


def test_learnings(spark, tmp_path):
    (tmp_path / "L.md").write_text("# Learnings\n\n## [LRN-20260101-001] insight\n\n**Priority**: high\n**Status**: pending\n\n### Summary\nUse the index.\n\n### Details\nx\n\n## [ERR-20260101-002] slow\n**Status**: promoted\n")
    got = [(r.id, r.kind, r.status, r.priority, r.summary) for r in files.learnings(spark, str(tmp_path / "L.md")).orderBy("id").collect()]
    assert got == [("ERR-20260101-002", "ERR", "promoted", None, None), ("LRN-20260101-001", "LRN", "pending", "high", "Use the index.")]


def test_legacy_table(spark, tmp_path):
    spark.createDataFrame([("1", "a", 0.5, "fact", 77, [1.0])], "id string, text string, importance double, category string, createdAt bigint, vector array<double>").write.parquet(f"{tmp_path}/old")
    row = files.legacy_table(spark, f"{tmp_path}/old").head()
    assert (row.timestamp, row.scope, row.metadata) == (77, "global", "{}")


def _drain(frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()


T0 = 1_750_000_000_000  # the watermark of a stream begins at 0


@pytest.fixture
def folder(tmp_path, spark):
    rows = [("s", T0), ("s", T0 + 3_600_000), ("s", T0 + 3_600_001), ("s", T0 + 3_600_001), ("t", T0 + 5)]
    spark.createDataFrame(rows, "session string, at bigint").coalesce(1).write.parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def test_rate_limit_is_the_same_on_a_stream(spark, folder):
    stream = spark.readStream.schema("session string, at bigint").parquet(folder)
    _drain(state.rate_limited_stream(stream, 1), "limited")
    rows = lambda frame: sorted((r.session, r.at, r.seen, r.allowed) for r in frame.collect())
    got = rows(spark.table("limited"))
    assert got == rows(state.rate_limited(spark.read.parquet(folder), 1)) and ("s", T0 + 3_600_001, 3, False) in got and len(got) == 5


def test_rate_limit_over_many_batches(spark, tmp_path):
    """Files one after the other: the state carries the times, and ends behind the watermark."""
    for i, at in enumerate([0, 1_800_000, 3_600_000, 3_700_000, 20_000_000]):
        spark.createDataFrame([("s", T0 + at), ("idle", T0 + at)][: 2 if i < 2 else 1], "session string, at bigint").coalesce(1).write.parquet(f"{tmp_path}/all/{i}")
    stream = spark.readStream.schema("session string, at bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all/*")
    _drain(state.rate_limited_stream(stream, 2), "limited_many")
    got = sorted((r.session, r.at - T0, r.seen) for r in spark.table("limited_many").collect())
    assert len(got) == 7 and got[-1] == ("s", 20_000_000, 1)


def test_capture_cursor(spark, tmp_path):
    spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 2, "b"), ("t", 1, "x")], "session string, seq bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/m")
    _drain(state.capture_stream(spark.readStream.schema("session string, seq bigint, text string").parquet(f"{tmp_path}/m")), "captured")
    assert sorted((r.session, r.seq, r.recent) for r in spark.table("captured").collect()) == [("s", 1, "a"), ("s", 2, "a\nb"), ("t", 1, "x")]


def test_repeats(spark):
    rows = spark.createDataFrame([(1, "k", 0), (2, "k", 50), (3, "k", 200), (4, "j", 10)], "event_id bigint, key string, at bigint")
    assert sorted(r.event_id for r in state.first_of_repeats(rows, ["key"], 60).collect()) == [1, 3, 4]
    turns = spark.createDataFrame([("s", "a", 1), ("s", "a", 4), ("s", "a", 20), ("s", "b", 4)], "session string, id string, turn bigint")
    assert state.not_repeated(turns).where(F.col("fresh")).count() == 3


def test_transcript_stream(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type": "message", "message": {"role": "user", "content": "hi"}}\nbroken\n')
    _drain(files.transcript_stream(spark, str(tmp_path)).select("type", "message.role"), "lines")
    assert [tuple(r) for r in spark.table("lines").collect()] == [("message", "user")]


def test_transcripts(spark, tmp_path):
    line = lambda role, content: json.dumps({"type": "message", "message": {"role": role, "content": content}})
    (tmp_path / "a.jsonl").write_text("\n".join([line("user", "first"), "broken", line("user", "/reset"), line("tool", "x"), line("assistant", [{"type": "text", "text": "mail a@b.example"}]), line("user", "last")]))
    (tmp_path / "b.jsonl").write_text("{}\n")
    got = {r.file.rsplit("/", 1)[1]: r.recent for r in files.transcripts(spark, str(tmp_path), 2).collect()}
    assert got == {"a.jsonl": "assistant: mail [REDACTED]\nuser: last"}


def test_old_backups_go(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", None, "fact", "s", 0.5, 1, "{}")], MEMORIES)
    for day in range(1, 5):
        files.backup(rows, str(tmp_path / "b"), f"2026-01-0{day}")
    assert files.drop_old_backups(spark, str(tmp_path / "b"), 2) == ["2026-01-01", "2026-01-02"] and files.drop_old_backups(spark, str(tmp_path / "b"), 2) == []


def test_learning_counts(spark):
    entries = spark.createDataFrame([("pending", "high"), ("Promoted", None), (None, "critical")], "status string, priority string")
    assert files.learning_counts(entries).head() == (3, 1, 2, 1)
