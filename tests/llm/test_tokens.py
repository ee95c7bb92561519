from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import tokens as t

FILE = Path(f"{t.TOKENIZERS}/byte_bpe_50k.tiktoken")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    own = t.encoder(FILE.read_bytes())
    return own, tiktoken.Encoding("check", pat_str=t.SPLIT, mergeable_ranks=own.vocabulary.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(both, text):
    own, other = both
    assert own.encode(text) == other.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 3000, "=" * 999, "\r\n\t  x", "<|endoftext|> [PAD]", "你好，世界" * 50, "é​﻿"])
def test_odd_texts_and_back(both, text):
    own, other = both
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text)
    assert b"".join(own.vocabulary.bytes_of[i] for i in ids).decode() == text


def test_appends_and_edits_are_exact(both):
    vocabulary = both[0].vocabulary
    table = t.PrefixTable(vocabulary, b"internatio")
    table.append(b"nalisation")
    assert table.tokens() == t.PrefixTable(vocabulary, b"internationalisation").tokens()
    table.replace(5, 13, b"xyz")
    assert table.tokens() == t.PrefixTable(vocabulary, table.data).tokens()
    assert all(table.tokens(n) == t.PrefixTable(vocabulary, table.data[:n]).tokens() for n in range(len(table.data)))


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "some text", "a"), (3, "some text", "a"), (4, "x" * 50_000, None)]
    got = {r.doc_id: r.ids for r in t.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()}
    assert got[1] == [] and got[2] == [] and len(got) == 4
    assert got[3] == t.encoder(FILE.read_bytes()).encode("some text")
    without = t.encode_corpus(spark.createDataFrame([(None, "x"), (None, "x"), (1, "y")], "doc_id bigint, text string"))
    assert sorted(str(r.doc_id) for r in without.collect()) == ["1", "None", "None"]
    assert t.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
