"""Problem 7: evaluation passages that stand in training texts.

Method: latent semantic retrieval.  Texts become rows of unit hashes (words; for
Chinese passages single signs, taken in pairs), cut into overlapping windows of
two blocks.  A distributed randomised SVD of the windows' TF-IDF matrix A over the
whole corpus gives a latent space: with a random matrix O of the fixed width
``WIDTH``, every partition adds up its part of A'(AO), Q is an orthogonal basis of
the sum, a second pass adds up (AQ)'(AQ), and its eigenvectors turn Q into the
right singular vectors of the ``RANK`` largest singular values, each divided by its
value.  Windows of
documents and of evaluation passages are compared by cosine in that space; what
comes near enough is checked for a common run, for the longest common subsequence
and for the answer words (the rarest of the passage's window).

Window lengths are chosen so that every run of the least length lies wholly in
one window of the document and one of the passage.  What is sent to all tasks
(basis, weights) has a fixed size; the held-out items are searched in blocks of
``ITEMS_AT_ONCE``, each in one pass over the documents' units, whatever their number.

Defined results: null texts, items with a null passage and passages too short to
hold a run have no leak; case, punctuation, spacing, line marks and invisible
signs are ignored; rows of one document count together.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.session import cut_lineage, partitions, table

#: Least run in words, and in signs for Chinese passages.
RUN = {"w": 14, "c": 26}
#: Window length and step: of documents, of passages.
DOC_WINDOW = {"w": (28, 14), "c": (52, 26)}
ITEM_WINDOW = {"w": (20, 6), "c": (36, 10)}
DIMS = 1 << 14
#: Width of the random projection, and singular vectors that are kept.
WIDTH, RANK = 80, 64
#: Least cosine of a candidate.
NEAR = 0.4
#: Least share of a passage's window that stands in order in a document's window, for a paraphrase.
REWORDED = 0.8
ITEMS_AT_ONCE = 4096
#: Numbers of a similarity matrix at once, and units of texts at once.
CELLS, UNITS = 1 << 23, 1 << 16
SEED = 20_260_101

UNIT = regex.compile(r"\p{Han}|[\p{L}\p{N}]+")
SIGN = regex.compile(r"[\p{L}\p{N}]")
HIDDEN = regex.compile(r"[\p{Cf}\p{Mn}]+")
HAN = regex.compile(r"\p{Han}")


def clean(text: str) -> str:
    return HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower()


class _Hashes(dict):
    """Hashes of the units met before; starts anew when it is full."""

    def __missing__(self, unit: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        value = self[unit] = zlib.crc32(unit.encode("utf-8", "surrogatepass"))
        return value


_hash_of = _Hashes()


def unit_hashes(text: str, kind: str) -> np.ndarray:
    """32-bit hashes of the words ('w') or signs ('c') of a cleaned text."""
    units = UNIT.findall(text) if kind == "w" else SIGN.findall(text)
    return np.array([_hash_of[u] for u in units], dtype=np.uint32)


def passage_kind(passage: str, lang: str | None) -> str:
    """'c' for Chinese passages, by their signs; the language column only decides a draw."""
    han, signs = len(HAN.findall(passage)), len(SIGN.findall(passage))
    if han * 2 == signs and signs:
        return "c" if (lang or "").lower().startswith("zh") else "w"
    return "c" if han * 2 > signs else "w"


def windows(n: int, length: int, step: int, least: int) -> list[tuple[int, int]]:
    """Windows over n units; a rest shorter than ``least`` holds no run of its own."""
    return [(at, min(n, at + length)) for at in range(0, max(1, n - least + 1), step)] if n else []


def features(hashes: np.ndarray, kind: str) -> np.ndarray:
    """Feature columns: words, or pairs of neighbouring signs."""
    if kind == "w":
        return (hashes % np.uint32(DIMS)).astype(np.int32)
    mixed = hashes[:-1].astype(np.uint64) * np.uint64(0x9E3779B1) + hashes[1:].astype(np.uint64) * np.uint64(0x85EBCA77)
    return ((mixed >> np.uint64(16)) % np.uint64(DIMS)).astype(np.int32)


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all runs of ``length`` units."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            out = (out ^ hashes[i : i + n].astype(np.uint64)) * np.uint64(0x100000001B3)
            out ^= out >> np.uint64(29)
    return out


def text_units(documents: DataFrame) -> DataFrame:
    """doc_id, kind, units: the unit hashes of every text, signs only where Chinese stands in it."""
    kind_of = documents.schema["doc_id"].dataType

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, kinds, arrays = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    text = clean(text)
                    words = unit_hashes(text, "w")
                    if len(words) >= RUN["w"]:
                        rows.append(i), kinds.append("w"), arrays.append(words)
                    if len(HAN.findall(text)) * 4 >= RUN["c"]:
                        signs = unit_hashes(text, "c")
                        if len(signs) >= RUN["c"]:
                            rows.append(i), kinds.append("c"), arrays.append(signs)
                offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
                flat = np.concatenate(arrays).view(np.int32) if arrays else np.zeros(0, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "kind", "units"])

    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    return rows.repartition(partitions(documents), F.xxhash64("doc_id")).mapInArrow(measure, f"doc_id {kind_of.simpleString()}, kind string, units array<int>")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[object, str, np.ndarray]]:
    lists = batch.column(2)
    flat, offsets = lists.values.to_numpy(zero_copy_only=False).view(np.uint32), lists.offsets.to_numpy()
    for i, (doc, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        yield doc, kind, flat[offsets[i] : offsets[i + 1]]


class Windows:
    """Windows of two blocks over the units of many texts, as rows of a TF-IDF matrix that is never made.

    Windows that share a block share its sum, so each unit is looked up once.
    """

    def __init__(self, texts: list[tuple[object, str, np.ndarray]], weight: np.ndarray | None = None):
        step = {k: DOC_WINDOW[k][1] for k in DOC_WINDOW}
        feats = [features(units, kind) for _, kind, units in texts]
        size = np.array([len(f) for f in feats], dtype=np.int64)
        per = np.array([step[k] for _, k, _ in texts], dtype=np.int64)
        many = np.array([len(windows(len(u), *DOC_WINDOW[k], RUN[k])) for _, k, u in texts], dtype=np.int64)
        has = np.maximum(-(-size // np.maximum(per, 1)), many) if len(texts) else size
        self.cols = np.concatenate(feats) if feats else np.zeros(0, np.int32)
        first_unit = np.concatenate(([0], np.cumsum(size)))[:-1] if len(texts) else size
        text = np.repeat(np.arange(len(texts)), has)
        number = np.arange(len(text)) - np.repeat(np.cumsum(has) - has, has)
        start = np.minimum(first_unit[text] + number * per[text], first_unit[text] + size[text])
        self.start, self.blocks = start, len(text)  # blocks lie one after the other; a last one may be empty
        self.filled = np.diff(np.append(start, len(self.cols))) > 0
        self.has_next = np.append(text[1:] == text[:-1], False) if len(text) else np.zeros(0, bool)
        self.at = np.flatnonzero(number < many[text])  # the first block of every window
        self.text = text[self.at]
        self.begin = number[self.at] * per[self.text]
        self.block_of = np.repeat(np.arange(self.blocks), np.diff(np.append(start, len(self.cols))))
        if weight is not None:
            square = np.bincount(self.block_of, weights=weight[self.cols] ** 2, minlength=self.blocks)
            self.norm = np.sqrt(np.maximum(self._pairs(square[:, None])[:, 0], 1e-12)).astype(np.float32)

    def _pairs(self, sums: np.ndarray) -> np.ndarray:
        """Sums of the windows from those of the blocks."""
        nxt = np.minimum(self.at + 1, max(0, self.blocks - 1))
        return sums[self.at] + np.where(self.has_next[self.at][:, None], sums[nxt], 0)

    def times(self, basis: np.ndarray) -> np.ndarray:
        """The matrix times a basis whose rows are weighted already."""
        sums = np.zeros((self.blocks, basis.shape[1]), dtype=np.float32)
        if len(self.cols):
            sums[self.filled] = np.add.reduceat(basis[self.cols], self.start[self.filled], axis=0)
        return self._pairs(sums) / self.norm[:, None]

    def transposed_times(self, y: np.ndarray, total: np.ndarray) -> None:
        """Adds the transposed matrix times y to total, but for the weights of its rows."""
        y = y / self.norm[:, None]
        blocks = np.zeros((self.blocks, y.shape[1]), dtype=np.float32)
        blocks[self.at] += y
        inner = self.has_next[self.at]
        blocks[self.at[inner] + 1] += y[inner]
        order = np.argsort(self.cols, kind="stable")
        own = self.cols[order]
        if len(own):
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            total[own[first]] += np.add.reduceat(blocks[self.block_of[order]], first, axis=0)


def _some_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[object, str, np.ndarray]]]:
    """Texts of about ``UNITS`` units at once."""
    for batch in batches:
        held, n = [], 0
        for t in _texts(batch):
            held.append(t)
            n += len(t[2])
            if n >= UNITS:
                yield held
                held, n = [], 0
        if held:
            yield held


def _summed(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    """Adds up the partitions' matrices block by block in the executors; one matrix of fixed size comes to the driver."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for b, row in zip(batch.column(0).to_pylist(), flat, strict=True):
                sums[b] = sums[b] + row if b in sums else row.astype(np.float64)
        if sums:
            size = len(next(iter(sums.values())))
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * size), pa.array(np.concatenate(list(sums.values()))))], names=["block", "part"])

    summed = parts.repartition(partitions(parts), "block").mapInArrow(add, "block int, part array<double>")
    got = sorted(summed.toLocalIterator(), key=lambda r: r[0])
    return np.array([r[1] for r in got]).reshape(rows, width) if got else np.zeros((rows, width))


def _in_parts(matrix: np.ndarray, blocks: int) -> pa.RecordBatch:
    flat = pa.array(matrix.reshape(-1))
    size = len(flat) // blocks
    return pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(blocks + 1, dtype=np.int32) * size), flat)], names=["block", "part"])


def latent_basis(units: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inverse document frequencies, right singular vectors over their values, singular values) of the windows of all texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIMS + 256, 1))
        for texts in _some_texts(batches):
            w = Windows(texts)
            once = np.unique(w.block_of * DIMS + w.cols) % DIMS
            total[:DIMS, 0] += np.bincount(once, minlength=DIMS)
            total[DIMS, 0] += w.blocks
        yield _in_parts(total, 65)

    counts = _summed(units.mapInArrow(count, "block int, part array<double>"), DIMS + 256, 1)[:, 0]
    weight = np.log((counts[DIMS] + 1) / (counts[:DIMS] + 1)) + 0.1
    random = np.random.default_rng(SEED).standard_normal((DIMS, WIDTH))
    context = units.sparkSession.sparkContext
    sent = context.broadcast((weight, (random * weight[:, None]).astype(np.float32)))

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, random = sent.value
        total = np.zeros((DIMS, WIDTH), dtype=np.float32)
        for texts in _some_texts(batches):
            w = Windows(texts, weight)
            if len(w.at):
                w.transposed_times(w.times(random), total)
        yield _in_parts(total * weight[:, None].astype(np.float32), 64)

    q, _ = np.linalg.qr(_summed(units.mapInArrow(multiply, "block int, part array<float>"), DIMS, WIDTH))
    sent_q = context.broadcast((weight, (q * weight[:, None]).astype(np.float32)))

    def gram(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, q = sent_q.value
        total = np.zeros((WIDTH, WIDTH))
        for texts in _some_texts(batches):
            w = Windows(texts, weight)
            if len(w.at):
                b = w.times(q)
                total += b.T @ b
        yield _in_parts(total, 1)

    values, vectors = np.linalg.eigh(_summed(units.mapInArrow(gram, "block int, part array<double>"), WIDTH, WIDTH))
    top = np.argsort(-values)[:RANK]
    singular = np.sqrt(np.maximum(values[top], 0))
    scale = np.maximum(singular, 1e-6 * max(singular.max(), 1e-9))  # what all windows share weighs no more than the rest
    return weight, (q @ vectors[:, top] / scale).astype(np.float32), singular


def common_subsequence(a: list[int], masks: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence of a with a text of ``size`` units whose places are bits of ``masks`` (Hyyrö)."""
    row = full = (1 << size) - 1
    for unit in a:
        here = row & masks.get(unit, 0)
        row = ((row + here) | (row - here)) & full
    return size - row.bit_count()


def item_windows(n: int, kind: str) -> list[tuple[int, int]]:
    """Windows of a passage, all of the same length; each run of the least length lies wholly in one."""
    length, step = ITEM_WINDOW[kind]
    if n <= length:
        return [(0, n)]
    return [(min(at, n - length), min(at, n - length) + length) for at in range(0, n - length + step, step)]


class Items:
    """A block of evaluation items, their windows in the latent space and their runs."""

    def __init__(self, rows: list, weight: np.ndarray, basis: np.ndarray):
        self.texts = []
        for item, passage, lang in rows:
            passage = clean(passage)
            kind = passage_kind(passage, lang)
            units = unit_hashes(passage, kind)
            if len(units) >= RUN[kind]:
                self.texts.append((item, kind, units))
        self.texts.sort(key=lambda t: t[1])
        self.runs = [np.unique(run_hashes(units, RUN[kind])) for _, kind, units in self.texts]
        self.units = [np.unique(units) for _, _, units in self.texts]
        self.parts = [[self._part(units[a:b], weight) for a, b in item_windows(len(units), kind)] for _, kind, units in self.texts]
        self.query, self.starts, self.of = {}, {}, {}
        for kind in "wc":
            own = [i for i, t in enumerate(self.texts) if t[1] == kind]
            vectors, owner = [], []
            for i in own:
                feats = features(self.texts[i][2], kind)
                for a, b in item_windows(len(self.texts[i][2]), kind):
                    part = feats[a : b if kind == "w" else b - 1]
                    vectors.append((weight[part][:, None] * basis[part]).sum(axis=0))
                    owner.append(i)
            if own:
                x = np.array(vectors, dtype=np.float32)
                self.query[kind] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
                owner = np.array(owner)
                self.starts[kind] = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                self.of[kind] = owner[self.starts[kind]]

    @staticmethod
    def _part(part: np.ndarray, weight: np.ndarray) -> tuple[list[int], set[int]]:
        """The units of a window of a passage, and the rarest of them: the answer words."""
        rare = part[np.argsort(-weight[features(part, "w")], kind="stable")[: max(1, len(part) // 8)]]
        return part.tolist(), set(rare.tolist())

    def found(self, texts: list, weight: np.ndarray, weighted: np.ndarray, near: float) -> Iterator[tuple]:
        """(document, item, cosine, run, kept, answered) of the windows of texts that hold a run or a paraphrase."""
        for kind in self.query:
            some = [t for t in texts if t[1] == kind]
            if not some:
                continue
            w = Windows(some, weight)
            x = w.times(weighted)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            length = DOC_WINDOW[kind][0]
            step = max(1, CELLS // len(self.query[kind]))
            for a in range(0, len(x), step):
                cosine = np.maximum.reduceat(x[a : a + step] @ self.query[kind].T, self.starts[kind], axis=1)
                i, j = np.nonzero(cosine >= near)
                if not len(i):
                    continue
                used, at = np.unique(i, return_inverse=True)
                places = [(int(w.text[a + u]), int(w.begin[a + u]), int(min(w.begin[a + u] + length, len(some[w.text[a + u]][2])))) for u in used]
                hashes = window_runs(some, places, kind)
                units = np.stack([np.pad(some[t][2][p:q].astype(np.int64), (0, length - (q - p)), constant_values=-1) for t, p, q in places])
                for item_at in np.unique(j):
                    item = int(self.of[kind][item_at])
                    mine = np.flatnonzero(j == item_at)
                    runs = self.runs[item]
                    spot = np.minimum(np.searchsorted(runs, hashes[at[mine]]), len(runs) - 1)
                    run = (runs[spot] == hashes[at[mine]]).any(axis=1)
                    shared = np.isin(units[at[mine]], self.units[item]).sum(axis=1)
                    for m in np.flatnonzero(run | (shared >= REWORDED * len(self.parts[item][0][0]))):
                        t, p, q = places[at[mine[m]]]
                        kept, answered = reworded(some[t][2][p:q].tolist(), self.parts[item])
                        if run[m] or (answered and kept >= REWORDED):
                            yield some[t][0], self.texts[item][0], float(cosine[i[mine[m]], item_at]), bool(run[m]), kept, answered


def leaks(documents: DataFrame, items: DataFrame, near: float = NEAR, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """doc_id, item_id, cosine, run, kept, answered of the documents that hold a run of an item's passage or a paraphrase.

    run: whether they hold a run of the least length. kept: the share of a window
    of the passage that stands in order in the document's window. answered: whether
    the rarest words of that window are there. A paraphrase keeps ``REWORDED`` and is answered.
    """
    spark = documents.sparkSession
    held = items.where("passage is not null and item_id is not null").select("item_id", "passage", "lang").dropDuplicates(["item_id"])
    id_type, item_type = documents.schema["doc_id"].dataType, items.schema["item_id"].dataType
    columns = (("doc_id", id_type), ("item_id", item_type), ("cosine", T.DoubleType()), ("run", T.BooleanType()), ("kept", T.DoubleType()), ("answered", T.BooleanType()))
    out = T.StructType([T.StructField(n, t) for n, t in columns])
    many = -(-held.count() // items_at_once)
    if not many:
        return spark.createDataFrame([], out)
    units = cut_lineage(text_units(documents))
    weight, basis, _ = latent_basis(units)
    sent = spark.sparkContext.broadcast((weight, (basis * weight[:, None]).astype(np.float32)))
    held = cut_lineage(held.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(many)))) if many > 1 else held.withColumn("block", F.lit(0))
    arrow = to_arrow_schema(out)
    hits = None
    for block in range(many):
        own = Items([tuple(r)[:3] for r in held.where(F.col("block") == block).collect()], weight, basis)
        if not own.texts:
            continue
        sent_items = spark.sparkContext.broadcast(own)

        def search(batches: Iterable[pa.RecordBatch], sent_items=sent_items) -> Iterator[pa.RecordBatch]:
            weight, weighted = sent.value
            for texts in _some_texts(batches):
                best: dict[tuple, tuple] = {}
                for doc, item, *facts in sent_items.value.found(texts, weight, weighted, near):
                    known = best.get((doc, item))
                    best[doc, item] = tuple(map(max, known, facts)) if known else tuple(facts)
                if best:
                    cols = list(zip(*((*k, *v) for k, v in best.items()), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        found = units.mapInArrow(search, out)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], out)
    return hits.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "run", "kept", "answered")))


def window_runs(texts: list, places: list[tuple[int, int, int]], kind: str) -> np.ndarray:
    """Hashes of the runs in each window, a row each; short windows repeat their first run."""
    length, _ = DOC_WINDOW[kind]
    each = length - RUN[kind] + 1
    rows = np.empty((len(places), length), dtype=np.uint32)
    count = np.empty(len(places), dtype=np.int64)
    for i, (t, a, b) in enumerate(places):
        rows[i, : b - a] = texts[t][2][a:b]
        rows[i, b - a :] = 0
        count[i] = b - a - RUN[kind] + 1
    out = np.zeros((len(places), each), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(RUN[kind]):
            out = (out ^ rows[:, i : i + each].astype(np.uint64)) * np.uint64(0x100000001B3)
            out ^= out >> np.uint64(29)
    return np.where(np.arange(each) < count[:, None], out, out[:, :1])


def reworded(window: list[int], parts: list[tuple[list[int], set[int]]]) -> tuple[float, bool]:
    """(share of a window of the passage that stands in order in the document's window, whether its rarest units are there), of the best one."""
    masks: dict[int, int] = {}
    for i, unit in enumerate(window):
        masks[unit] = masks.get(unit, 0) | 1 << i
    best = (0.0, False)
    for part, rare in parts:
        if sum(u in masks for u in part) >= best[0] * len(part):
            best = max(best, (common_subsequence(part, masks, len(window)) / len(part), rare <= masks.keys()))
    return best


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).where("run").select("doc_id", "item_id")


def p7_paraphrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold no run of the item's passage but a paraphrase of it."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).where("not run").select("doc_id", "item_id")
