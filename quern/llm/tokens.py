"""Problem 6: token ids of every text by a public byte-pair tokenizer.

Method: prefix dynamic programming.  The byte-pair encoding of a prefix of a
word ends in exactly one token, and a token can follow another only if the pair
survives its own encoding.  So one table, the last token of every prefix, holds
the encodings of all prefixes; it is filled from left to right in linear time,
an append goes on where the table ends, and an edit keeps the part before it.

Defined results: null and empty texts give an empty list; strings that look like
special tokens are plain text; every row with a null id is kept, rows of one id
count once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import partitions, table

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the public vocabulary splits text into words before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's memory of words and pairs; beyond it starts anew.
REMEMBER = 1 << 18


class Vocabulary:
    """Ranks of a byte-pair vocabulary, with each token's last merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and self._made(a, rank) and self._made(b, rank) and self._survives(a, b):
                    self.parts[rank] = (a, b)
                    self.merged[a, b] = rank
                    break
        #: tokens that the merges can make at all
        self.reachable = {i for b, i in ranks.items() if len(b) == 1} | set(self.parts)
        self._matcher = self._build_matcher()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        return cls.parse(Path(path).read_bytes())

    @classmethod
    def parse(cls, content: bytes) -> Vocabulary:
        lines = content.split(b"\n")
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})

    def _made(self, token: int, rank: int) -> bool:
        """Whether a token is there before the merge of ``rank``; single bytes always are."""
        return len(self.bytes_of[token]) == 1 or token in self.parts and token < rank

    def follows(self, a: int, b: int) -> bool:
        """``_survives``, remembered."""
        ok = self._pairs.get((a, b))
        if ok is None:
            if len(self._pairs) >= REMEMBER:
                self._pairs.clear()
            ok = self._pairs[a, b] = self._survives(a, b)
        return ok

    def _survives(self, a: int, b: int) -> bool:
        """Whether the merges leave token a directly before token b as they are.

        Merges are undone from the last one back, always on the side that was
        made later.  At each step the two pieces at the border stand side by
        side; were there a merge of both before the next merge of either, it
        would have joined them.  Of equal merges the left one comes first.
        """
        parts, merged = self.parts, self.merged
        until_a = until_b = 1 << 60
        while True:
            joined = merged.get((a, b))
            if joined is not None and joined < until_a and joined <= until_b:
                return False
            made_a, made_b = (a if a in parts else -1), (b if b in parts else -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                until_a, a = a, parts[a][1]
            else:
                until_b, b = b, parts[b][0]

    def _build_matcher(self):
        try:
            import ahocorasick
        except ImportError:
            return None
        matcher = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if rank in self.reachable:
                matcher.add_word(token.decode("latin-1"), (rank, len(token)))
        matcher.make_automaton()
        return matcher

    def endings(self, data: bytes, start: int = 0) -> Iterator[tuple[int, int, int]]:
        """(end, token, its length) of each occurrence of a token that ends after ``start``, by end."""
        if self._matcher is not None:
            begin = max(0, start - 128)
            for last, (rank, size) in self._matcher.iter(data[begin:].decode("latin-1")):
                if begin + last >= start:
                    yield begin + last + 1, rank, size
            return
        for end in range(start + 1, len(data) + 1):
            for size in range(min(128, end), 0, -1):
                rank = self.ranks.get(data[end - size : end])
                if rank in self.reachable:
                    yield end, rank, size


class PrefixTable:
    """The last token of every prefix of one word."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: no entry for the bytes before changes."""
        start = len(self.data)
        self.data += more
        last, follows = self.last, self.vocabulary.follows
        last.extend([-1] * len(more))
        pairs = self.vocabulary._pairs
        for end, token, size in self.vocabulary.endings(self.data, start):
            if last[end] >= 0:
                continue
            before = end - size
            if before == 0:
                last[end] = token
                continue
            left = last[before]
            ok = pairs.get((left, token))
            if ok is None:
                ok = follows(left, token)
            if ok:
                last[end] = token

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Puts ``new`` in place of data[start:end]; the table before ``start`` is kept."""
        tail = new + self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(tail)

    def tokens(self, end: int | None = None) -> list[int]:
        at, out = len(self.data) if end is None else end, []
        size = self.vocabulary.bytes_of
        while at:
            out.append(self.last[at])
            at -= len(size[self.last[at]])
        return out[::-1]


class Encoder:
    """Texts to ids, remembering the words met before."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.split, self.known = vocabulary, regex.compile(SPLIT), {}

    def word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole in self.vocabulary.reachable else PrefixTable(self.vocabulary, data).tokens()
        if len(self.known) >= REMEMBER:
            self.known.clear()
        if len(data) < 256:
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for word in self.split.findall(text):
            ids = known.get(word)
            out.extend(ids if ids is not None else self.word(word))
        return out


_encoders: dict[bytes, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    """One encoder a worker and vocabulary."""
    key = hashlib.sha256(content).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary.parse(content))
    return _encoders[key]


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """One row per id with the token ids of its text, as ``ids``; rows without an id are kept, each for itself.

    The vocabulary file is read by the driver and sent to the workers; its size
    doesn't depend on the corpus.
    """
    sent = documents.sparkSession.sparkContext.broadcast(Path(f"{folder}/{vocabulary}.tiktoken").read_bytes())

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(sent.value)
        for batch in batches:
            # small steps, so that the lists of a step with very long texts stay small
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = [own.encode(x) if x else [] for x in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    rows = documents.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text"))
    once = rows.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    if documents.sparkSession.sparkContext.defaultParallelism > 1:
        once = once.repartition(partitions(documents), id_col)  # the same partitioning as dropDuplicates: no second exchange
    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>"
    return once.unionByName(rows.where(F.col(id_col).isNull())).mapInArrow(encode, schema)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))
