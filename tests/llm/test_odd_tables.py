"""Every operator on tables with nulls in any column, extra columns whose names it uses itself, ties, repeats, and no rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.llm import clusters, conversations, leaks, neardup, neighbours, personal, spam, tokens

CLASHING = ("sid", "mid", "flag", "grp", "own", "at", "words", "size", "han", "total", "share", "tokens", "c1", "c2", "num", "ids", "copies", "rank", "block", "cell", "key", "unit", "guest", "entity", "form", "draw", "start", "stop", "units", "n", "pivot", "sim", "first", "near", "parent", "depth", "top")
LONG = "a very long text of many words that goes on " * 3000


def widened(frame):
    """With extra columns named like the operators' own ones."""
    have = set(frame.columns)
    return frame.select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in have))


@pytest.fixture(scope="module")
def memories(spark):
    unit = [0.125] * 64
    rows = [("a", "s", unit, 1), ("b", "s", unit, 2), ("b", "s", unit, 2), ("c", None, unit, 3), ("d", "", [2.0 * x for x in unit], 4), (None, "s", unit, 5), ("e", "s", None, 6), ("f", "s", unit, None), ("g", "s", [None] * 64, 7), ("h", "t", unit, 8)]
    return widened(spark.createDataFrame(rows, "id string, scope string, vector array<float>, entry_index bigint"))


@pytest.mark.parametrize("block_rows", [100, 1])
def test_vectors(spark, memories, block_rows):
    pairs = {tuple(r) for r in neighbours.nearest(memories, block_rows=block_rows).collect()}
    assert pairs == {("a", "b"), ("a", "f"), ("b", "f"), ("c", "d")}
    members = {(r.scope, r.entry_index) for r in clusters.clusters(memories, block_rows=block_rows).collect()}
    assert members == {("s", 1), ("s", 2), ("global", 3), ("global", 4)}
    assert neighbours.nearest(memories.where("false")).count() == 0 == clusters.clusters(memories.where("false")).count()


def test_near_duplicates(spark):
    text = "one two three four five six seven eight nine"
    rows = [("memory", "1", text), ("memory", "1", text), ("memory", "2", text + " ten"), ("memory", None, text), ("memory", "3", None), ("memory", "4", ""), ("memory", "5", LONG), ("memory", "6", LONG), (None, "7", text)]
    frame = widened(spark.createDataFrame(rows, "src string, id string, text string"))
    assert {tuple(r) for r in neardup.similar_pairs(frame).collect()} == {("memory", "1", "2"), ("memory", "5", "6")}


def test_conversations(spark):
    when = dt.datetime(2026, 1, 1)
    rows = [(1, "k", "S", None, "message", "user", "hello there", 10**12, None, when), (2, "k", "s", 1, "message", "assistant", "hi", None, None, None), (2, "k", "s", 1, "message", "assistant", "hi", None, None, None), (None, "k", "s", 2, "message", "user", "x", None, None, when), (3, None, None, None, None, None, None, None, None, None), (4, None, "u", None, None, None, LONG, None, None, None), (5, "k", "v", 5, "message", "user", LONG, 0, 0, when)]
    frame = widened(spark.createDataFrame(rows, "msg_id bigint, session_key string, session_id string, parent_id bigint, type string, role string, content string, timestamp bigint, message_timestamp bigint, loaded_at timestamp"))
    for long_rows in (100, 0):
        assert {tuple(r) for r in conversations.conversations(frame, long_rows=long_rows).collect()} == {("s", 1, 1), ("s", 2, 2)}
    found = conversations.threads(frame).collect()
    assert len({r.msg_id for r in found}) == len(found) and conversations.threads(frame.where("false")).count() == 0
    assert conversations.stray_links(frame.where("false")).count() == 0


def test_documents(spark):
    rows = [(1, LONG, "en"), (1, LONG, "en"), (None, "some text", "en"), (None, "some text", None), (2, None, "en"), (3, "", None), (4, " \n\t", "zz"), (5, "x\x01y \x02 #tag http://a.b/c", "en"), (6, "\ud800 lone".encode("utf-8", "replace").decode(), "en")]
    docs = widened(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    ids = tokens.encode_corpus(docs.drop("ids")).collect()
    assert sorted(str(r.doc_id) for r in ids) == ["1", "2", "3", "4", "5", "6", "None", "None"] and all(r.ids == [] for r in ids if r.doc_id in (2, 3))
    assert {r.doc_id for r in spam.spam_pages(docs).collect()} <= {1, 5, 6, None} and spam.spam_pages(docs.where("false")).count() == 0
    items = widened(spark.createDataFrame([(1, LONG, None), (1, LONG, None), (None, LONG, "en"), (2, None, None), (3, "", "en"), (4, "too short", "en")], "item_id bigint, passage string, lang string"))
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items).where("run").collect()} == {(1, 1)}


def test_personal_data(spark):
    rows = [("memory", "1", "mail a.b@c.example now"), ("memory", "1", "mail a.b@c.example now"), ("memory", None, "mail a.b@c.example now"), (None, "2", "x"), ("memory", "3", None), ("memory", "4", ""), ("memory", "5", LONG + " call me on 555-0101 ")]
    frame = widened(spark.createDataFrame(rows, "src string, rec_id string, text string"))
    names = widened(spark.createDataFrame([(None, None), ("Ann", None), (None, "given"), ("Bo", "given")], "name string, part_of_name string"))
    assert {(r.rec_id, r.kind) for r in personal.spans(frame, personal._detector(frame, names)).collect()} == {("1", "email"), (None, "email"), ("5", "phone")}
    out = personal.redacted(frame, names, b"k", "surrogate").collect()
    assert {r.rec_id for r in out} >= {"1", "5"} and all("555-0101" not in r.text and "a.b@c" not in r.text for r in out)
