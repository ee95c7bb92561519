"""Retrieval: vector, BM25 and lexical search, fusion, and the hybrid pipeline.

Queries come as a DataFrame (qid, query, vector), so that many are answered at
once.  Vectors and keywords of up to ``MOST_AT_ONCE`` queries are sent to all
tasks and held against slices of rows in blocks of ``MOST_QUERIES``; more queries
take more passes over the rows, each result being written before the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.batches import ragged
from quern.functions.metadata import active_at, expired
from quern.functions.numbers import clamp01
from quern.functions.text import ngrams, search_tokens, trimmed
from quern.operators.pairs import unit_matrix
from quern.operators.scoring import confidence, days_since, length_norm, time_decay
from quern.session import cut_lineage

#: Queries and rows whose vectors are multiplied at once.
MOST_QUERIES = 1000
MOST_ROWS = 4096
#: Queries of one pass over the rows.
MOST_AT_ONCE = 20_000
#: Sums of a keyword search at once.
MOST_SUMS = 1 << 22
#: Most rows that hold a rare word, in more than a million rows a thousandth of them, and most queries that share it.
RARE, MOST_SHARING = 1000, 10_000
#: Queries of few words of one pass over the rows.
MOST_SHORT = 1_000_000
WORDS = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"


def top_k(scored: DataFrame, k: int, by: str = "score", digits: int | None = None) -> DataFrame:
    """The k best of each query, with rank; each task keeps k of a query before the exchange.

    Sums come out a little different by the order of their parts: scores that
    agree in so many digits are ties, by id.
    """
    order = [F.desc(by) if digits is None else F.round(by, digits).desc(), F.col("id")]
    part = scored.withColumn("_p", F.spark_partition_id())
    local = part.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "_p").orderBy(*order))).where(F.col("_n") <= k).drop("_n", "_p")
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k)


def in_passes(queries: DataFrame, search: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """The results of ``search`` for blocks of at most about ``most`` queries."""
    passes = -(-queries.count() // most)
    if passes <= 1:
        return search(queries)
    kept, out = cut_lineage(queries.withColumn("_pass", F.pmod(F.xxhash64("qid"), F.lit(passes)))), None
    for i in range(passes):
        found = cut_lineage(search(kept.where(F.col("_pass") == i).drop("_pass")))
        out = found if out is None else out.unionByName(found)
    return out


def vector_search(rows: DataFrame, queries: DataFrame, k: int = 5, min_score: float = 0.3, now: int | None = None) -> DataFrame:
    """qid, id, score, rank by exact cosine; inactive rows are left out where a clock is given.

    Slices of rows are multiplied with one block of queries after the other and
    keep each query's k best, so that an exchange sees k rows a slice and query.
    """
    kept = rows.where(F.size("vector") > 0)
    if now is not None:
        kept = kept.where(active_at(now))
    kept = kept.select("id", F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.select("qid", F.col("vector").cast("array<double>").alias("qv")).where(F.size("qv") > 0)
    return in_passes(asked, lambda some: _vector_pass(kept, some, k, min_score), MOST_AT_ONCE)


def _vector_pass(kept: DataFrame, queries: DataFrame, k: int, min_score: float) -> DataFrame:
    asked = queries.toArrow().combine_chunks()
    qids, vectors = (asked.column(c).combine_chunks() for c in (0, 1))
    lengths = vectors.value_lengths().to_numpy()
    blocks: list[tuple[int, pa.Array, np.ndarray]] = []
    for dims in np.unique(lengths):
        of = np.flatnonzero(lengths == dims)
        for at in range(0, len(of), MOST_QUERIES):
            own = pa.array(of[at : at + MOST_QUERIES])
            q = vectors.take(own).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            blocks.append((int(dims), qids.take(own), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))
    sent = kept.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, MOST_ROWS):
                batch = whole.slice(start, MOST_ROWS)
                sizes = batch.column(1).value_lengths().to_numpy()
                units = {}
                for dims, of, q in sent.value:
                    if dims not in units:
                        own = np.flatnonzero(sizes == dims)
                        units[dims] = own, unit_matrix(batch.column(1).take(pa.array(own)), dims)
                    own, x = units[dims]
                    if not len(own):
                        continue
                    score = 1 / (2 - np.clip(q @ x.T, -1, 1))
                    least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(of), -np.inf)
                    i, j = np.nonzero((score >= least[:, None]) & (score >= min_score))
                    if len(i):
                        yield pa.RecordBatch.from_arrays([of.take(pa.array(i)), batch.column(0).take(pa.array(own[j])), pa.array(score[i, j])], names=["qid", "id", "score"])

    kind = dict(queries.dtypes)["qid"]
    return top_k(kept.mapInArrow(run, f"qid {kind}, id string, score double"), k)


def terms(c: Column, grams: bool = False) -> Column:
    """Hashes of the words of a text, or of its runs of two and three signs."""
    found = ngrams(c) if grams else F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(0))
    return F.transform(found, lambda w: F.xxhash64(w))


def bm25_search(rows: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75, grams: bool = False) -> DataFrame:
    """qid, id, score, rank: BM25 over words (or runs of two and three signs), through a logistic curve.

    Document frequencies and lengths cover all rows; frequencies are formed only
    of what a query holds. Slices of rows are held against one block of queries
    after the other and keep each query's k best, like vectors.
    """
    words = rows.select("id", terms(F.col("text"), grams).alias("t"))
    asked = queries.select("qid", F.array_distinct(terms(F.col("query"), grams)).alias("qt")).where(F.size("qt") > 0)
    n, average = words.agg(F.count("*"), F.avg(F.size("t"))).head()
    return in_passes(asked, lambda some: _keyword_pass(words, some, k, k1, b, n, average or 1.0), MOST_AT_ONCE)


def _keyword_pass(words: DataFrame, queries: DataFrame, k: int, k1: float, b: float, n: int, average: float) -> DataFrame:
    vocabulary = queries.select(F.explode("qt").alias("w")).distinct()
    df = words.select(F.explode(F.array_distinct("t")).alias("w")).join(vocabulary, "w", "left_semi").groupBy("w").agg(F.count("*").alias("df")).toArrow()
    word, count = df.column(0).to_numpy(), df.column(1).to_numpy()
    order = np.argsort(word)
    word, idf = word[order], np.log(1 + (n - count[order] + 0.5) / (count[order] + 0.5))
    asked = queries.select("qid", "qt").toArrow().combine_chunks()
    blocks = []
    for at in range(0, asked.num_rows, MOST_QUERIES):
        part = asked.slice(at, MOST_QUERIES)
        lists = part.column(1).combine_chunks()
        of = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
        place, there = _places(word, lists.flatten().to_numpy(zero_copy_only=False))
        of, place = of[there], place[there]
        by_word = np.argsort(place, kind="stable")
        blocks.append((part.column(0).combine_chunks(), of[by_word], np.searchsorted(place[by_word], np.arange(len(word) + 1))))
    sent = words.sparkSession.sparkContext.broadcast((word, idf, blocks))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, idf, blocks = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, MOST_ROWS):
                batch = whole.slice(start, MOST_ROWS)
                lists = batch.column(1)
                length = lists.value_lengths().fill_null(0).to_numpy().astype(np.float64)
                row = np.repeat(np.arange(batch.num_rows), length.astype(np.int64))
                place, there = _places(word, lists.flatten().to_numpy(zero_copy_only=False))
                pair, tf = np.unique(row[there] * max(1, len(word)) + place[there], return_counts=True)
                row, place = pair // max(1, len(word)), pair % max(1, len(word))
                weight = idf[place] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / average))
                for qids, of, edge in blocks:
                    yield from _best_of_slice(batch.column(0), row, place, weight, qids, of, edge, k)

    kind = dict(queries.dtypes)["qid"]
    raw = words.mapInArrow(run, f"qid {kind}, id string, raw double")
    return top_k(raw.select("qid", "id", (1 / (1 + F.exp(-F.col("raw") / 5))).alias("score")), k, digits=9)


def _places(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each value among the sorted ones, whether it is there)."""
    if not len(sorted_values):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    place = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return place, sorted_values[place] == values


def _best_of_slice(ids: pa.Array, row: np.ndarray, place: np.ndarray, weight: np.ndarray, qids: pa.Array, of: np.ndarray, edge: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each query among a slice, a part of the rows at a time."""
    many = edge[place + 1] - edge[place]
    total = np.cumsum(many)
    at = 0
    while at < len(row):
        # whole rows, until the sums are enough or the matrix is
        stop = int(np.searchsorted(total, (total[at - 1] if at else 0) + MOST_SUMS, side="right"))
        stop = min(max(stop, at + 1), int(np.searchsorted(row, row[at] + max(1, MOST_SUMS // len(qids)))))
        stop = int(np.searchsorted(row, row[max(stop - 1, at)], side="right")) if stop >= len(row) or row[stop] == row[stop - 1] else stop
        own = slice(at, stop)
        first, last = int(row[at]), int(row[stop - 1])
        q = of[ragged(edge[place[own]], many[own])]
        cell = (np.repeat(row[own], many[own]) - first) * len(qids) + q
        sums = np.bincount(cell, weights=np.repeat(weight[own], many[own]), minlength=(last - first + 1) * len(qids)).reshape(-1, len(qids)).T
        score = np.round(1 / (1 + np.exp(-sums / 5)), 9)  # what is a tie here is one in the end
        least = np.partition(score, -k, axis=1)[:, -k] if sums.shape[1] > k else np.zeros(len(qids))
        i, j = np.nonzero((score >= least[:, None]) & (sums > 0))
        if len(i):
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(i)), ids.take(pa.array(j + first)), pa.array(sums[i, j])], names=["qid", "id", "raw"])
        at = stop


def bm25_by_rare_words(rows: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75, rare: int = RARE) -> DataFrame:
    """``bm25_search`` for very many queries of few words, whose number grows with the rows.

    Rows that hold a rare word of a query are found by that word and get their whole
    score. For all others only the query's frequent words count: their k best are
    found once for all queries with the same ones. A row that is neither has k rows
    before it that score no less, so nothing is lost.
    """
    words = rows.select("id", terms(F.col("text")).alias("t"))
    asked = queries.select("qid", F.array_distinct(terms(F.col("query"))).alias("qt")).where(F.size("qt") > 0)
    n, average = words.agg(F.count("*"), F.avg(F.size("t"))).head()
    return in_passes(asked, lambda some: _rare_pass(words, some, k, k1, b, n, average or 1.0, rare), MOST_SHORT)


def _rare_pass(words: DataFrame, queries: DataFrame, k: int, k1: float, b: float, n: int, average: float, rare: int) -> DataFrame:
    spark = words.sparkSession
    asked = queries.toArrow().combine_chunks()
    qids, lists = asked.column(0).combine_chunks(), asked.column(1).combine_chunks()
    word, count = _frequencies(words, np.unique(lists.flatten().to_numpy(zero_copy_only=False)))
    idf = np.log(1 + (n - count + 0.5) / (count + 0.5))
    place, there = _places(word, lists.flatten().to_numpy(zero_copy_only=False))
    of, place = np.repeat(np.arange(len(qids)), lists.value_lengths().to_numpy())[there], place[there]
    edge_of = np.searchsorted(of, np.arange(len(qids) + 1))
    seldom = (count <= max(rare, n // 1000)) & (np.bincount(place, minlength=len(word)) <= MOST_SHARING)
    own = np.flatnonzero(seldom[place])
    own = own[np.argsort(place[own], kind="stable")]
    sent = spark.sparkContext.broadcast((word, idf, qids, place, edge_of, of[own], np.searchsorted(place[own], np.arange(len(word) + 1))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, idf, qids, asked_place, edge_of, of, edge = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, MOST_ROWS):
                batch = whole.slice(start, MOST_ROWS)
                held, tf, length = _held(batch.column(1), word)
                row, place = held // max(1, len(word)), held % max(1, len(word))
                weight = idf[place] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / average))
                many = edge[place + 1] - edge[place]
                pair = np.unique(np.repeat(row, many) * max(1, len(qids)) + of[ragged(edge[place], many)])
                row, q = pair // max(1, len(qids)), pair % max(1, len(qids))
                many = edge_of[q + 1] - edge_of[q]
                at, there = _places(held, np.repeat(row, many) * len(word) + asked_place[ragged(edge_of[q], many)])
                raw = np.bincount(np.repeat(np.arange(len(q)), many)[there], weights=weight[at[there]], minlength=len(q))
                if len(q):
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), batch.column(0).take(pa.array(row)), pa.array(raw)], names=["qid", "id", "raw"])

    kind = dict(queries.dtypes)["qid"]
    raw = words.mapInArrow(run, f"qid {kind}, id string, raw double")
    whole = top_k(raw.select("qid", "id", (1 / (1 + F.exp(-F.col("raw") / 5))).alias("score")), k, digits=9).select("qid", "id", "score")
    # the frequent words of each query, as the number of their set
    numbers: dict[tuple[int, ...], int] = {}
    often = np.flatnonzero(~seldom[place])
    often = often[np.lexsort((place[often], of[often]))]
    cuts = np.searchsorted(of[often], np.arange(len(qids) + 1))
    set_of = [numbers.setdefault(tuple(place[often[x:y]].tolist()), len(numbers)) if y > x else -1 for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    if not numbers:
        return top_k(whole, k, digits=9)
    sets = spark.createDataFrame([(i, word[list(places)].tolist()) for places, i in numbers.items()], "qid bigint, qt array<bigint>")
    best = in_passes(sets, lambda some: _keyword_pass(words, some, k, k1, b, n, average), MOST_AT_ONCE)
    asked_sets = spark.createDataFrame(pa.table({"qid": qids, "set": pa.array(set_of, pa.int64())})).where("set >= 0")
    alone = asked_sets.join(best.select(F.col("qid").alias("set"), "id", "score"), "set").select("qid", "id", "score")
    return top_k(whole.unionByName(alone).groupBy("qid", "id").agg(F.max("score").alias("score")), k, digits=9)


def _held(lists: pa.Array, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row and place of each of the sorted words that a row holds, as one ascending number, how often, words of each row)."""
    length = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    place, there = _places(word, lists.flatten().to_numpy(zero_copy_only=False))
    held, tf = np.unique(np.repeat(np.arange(len(length)), length)[there] * max(1, len(word)) + place[there], return_counts=True)
    return held, tf, length.astype(np.float64)


def _frequencies(words: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(those of the vocabulary's words that rows hold, ascending, in how many rows)."""
    sent = words.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), dtype=np.int64)
        for batch in batches:
            total += np.bincount(_held(batch.column(1), sent.value)[0] % max(1, len(total)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value[some], pa.int64()), pa.array(total[some])], names=["w", "df"])

    df = words.mapInArrow(run, "w bigint, df bigint").groupBy("w").agg(F.sum("df").alias("df")).toArrow()
    word, count = df.column(0).to_numpy(), df.column(1).to_numpy()
    order = np.argsort(word)
    return word[order], count[order]


def keyword_search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """qid, id, score, rank of the keyword search; queries that find nothing there are searched by their tokens."""
    found = bm25_search(rows, queries, k)
    rest = queries.join(found.select("qid").distinct(), "qid", "left_anti")
    return found.unionByName(lexical_search(rows, rest, k))


def lexical_score(matched: np.ndarray, size: np.ndarray, literal: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coverage of the query's tokens, with a bonus for a literal hit and for whole coverage."""
    score = 0.5 + 0.42 * matched / size
    score = np.where(literal, np.maximum(score, 0.88), score)
    score = np.where(matched == size, np.maximum(score, 0.92), score)
    return np.minimum(0.95, score) * weight


def lexical_search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """qid, id, score, rank over the text and its abstract, overview and content.

    Rows and queries meet on equal tokens; a field that repeats the text is left
    to the text, whose weight is the greatest. Slices of fields are held against
    one block of queries after the other and pass on what may be among a query's
    k best, so that no pair of a row and a query is written.
    """
    tokens = lambda c: F.transform(search_tokens(c), lambda w: F.xxhash64(w))
    plain = lambda c: F.lower(trimmed(c))
    asked = queries.select("qid", plain(F.col("query")).alias("q"), tokens(F.col("query")).alias("qt")).where("qid is not null and size(qt) > 0")
    field = lambda name, weight: F.struct(F.lit(weight).alias("weight"), F.col(name).alias("t"))
    kept = [F.array(field("text", 1.0)), *(F.when(F.col(n) != F.col("text"), F.array(field(n, w))).otherwise(F.array().cast("array<struct<weight:double,t:string>>")) for n, w in (("l0", 0.98), ("l1", 0.92), ("l2", 0.96)))]
    fields = rows.where("id is not null").select("id", F.explode(F.concat(*kept)).alias("f"))
    fields = fields.select("id", "f.weight", plain(F.col("f.t")).alias("t"), tokens(F.col("f.t")).alias("w"))
    return in_passes(asked, lambda some: _lexical_pass(fields, some, k), MOST_AT_ONCE)


def _lexical_pass(fields: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    asked = queries.toArrow().combine_chunks()
    word = np.unique(asked.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False))
    blocks = []
    for at in range(0, asked.num_rows, MOST_QUERIES):
        part = asked.slice(at, MOST_QUERIES)
        lists = part.column(2).combine_chunks()
        size = lists.value_lengths().to_numpy().astype(np.int64)
        place, _ = _places(word, lists.flatten().to_numpy(zero_copy_only=False))
        by_word = np.argsort(place, kind="stable")
        edge = np.searchsorted(place[by_word], np.arange(len(word) + 1))
        blocks.append((part.column(0).combine_chunks(), part.column(1).to_pylist(), size, np.repeat(np.arange(len(size)), size)[by_word], edge))
    sent = fields.sparkSession.sparkContext.broadcast((word, blocks))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, blocks = sent.value
        least = [np.zeros(len(b[0])) for b in blocks]  # of each query the score that k rows seen so far reach
        for whole in batches:
            for start in range(0, whole.num_rows, MOST_ROWS // 2):
                batch = whole.slice(start, MOST_ROWS // 2)
                weight, texts, lists = batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3)
                of_row = np.cumsum(weight == 1.0)  # a row's fields follow its text
                at = np.repeat(np.arange(len(weight)), lists.value_lengths().fill_null(0).to_numpy())
                place, there = _places(word, lists.flatten().to_numpy(zero_copy_only=False))
                at, place = at[there], place[there]
                for n, (qids, plain, size, of, edge) in enumerate(blocks):
                    i, j, matched = _matched(at, place, of, edge, len(weight), size, least[n])
                    literal = np.zeros(len(i), dtype=bool)
                    for x in np.flatnonzero((0.5 + 0.42 * matched / size[j] < 0.88) & (matched >= size[j] - 2)):
                        literal[x] = plain[j[x]] in texts[i[x]]
                    score = lexical_score(matched, size[j], literal, weight[i])
                    order = np.lexsort((-score, of_row[i], j))  # a row's best field
                    order = order[np.flatnonzero(np.diff(j[order] * (len(weight) + 1) + of_row[i[order]], prepend=-1))]
                    order = order[np.lexsort((-score[order], j[order]))]
                    i, j, score = i[order], j[order], score[order]
                    edges = np.searchsorted(j, np.arange(len(size) + 1))
                    full = np.flatnonzero(np.diff(edges) >= k)
                    least[n][full] = np.maximum(least[n][full], score[edges[full] + k - 1])
                    keep = score >= least[n][j]
                    if keep.any():
                        yield pa.RecordBatch.from_arrays([qids.take(pa.array(j[keep])), batch.column(0).take(pa.array(i[keep])), pa.array(score[keep])], names=["qid", "id", "score"])

    kind = dict(queries.dtypes)["qid"]
    found = fields.mapInArrow(run, f"qid {kind}, id string, score double")
    return top_k(found.groupBy("qid", "id").agg(F.max("score").alias("score")), k)


def _matched(at: np.ndarray, place: np.ndarray, of: np.ndarray, edge: np.ndarray, n: int, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(field, query, tokens in both) of those pairs that may reach ``least``.

    A literal hit shares all tokens of the query but its first and last word, so
    pairs with more tokens apart reach no more than their coverage.
    """
    many = edge[place + 1] - edge[place]
    total = np.cumsum(many)
    matched, begin = np.zeros(n * len(size), dtype=np.int64), 0
    while begin < len(place):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + MOST_SUMS // 2, side="right")))
        own = slice(begin, stop)
        matched += np.bincount(np.repeat(at[own], many[own]) * len(size) + of[ragged(edge[place[own]], many[own])], minlength=len(matched))
        begin = stop
    matched = matched.reshape(n, len(size))
    need = np.minimum(np.ceil((least - 0.5) / 0.42 * size - 1e-6), size - 2)
    i, j = np.nonzero(matched >= np.maximum(need, 1).astype(np.int64))
    return i, j, matched[i, j]


def fuse(vector: DataFrame, bm25: DataFrame, vector_weight: float = 0.6, bm25_weight: float = 0.4, k: int = 60) -> DataFrame:
    """qid, id, score: reciprocal ranks and scores of both lists; strong keyword hits keep a floor."""
    v = vector.select("qid", "id", F.col("score").alias("vs"), F.col("rank").alias("vr"))
    b = bm25.select("qid", "id", F.col("score").alias("bs"), F.col("rank").alias("br"))
    both = v.join(b, ["qid", "id"], "full_outer")
    raw = F.coalesce(vector_weight / (k + F.col("vr")), F.lit(0.0)) + F.coalesce(bm25_weight / (k + F.col("br")), F.lit(0.0))
    present = F.when(F.col("vs").isNotNull(), vector_weight).otherwise(0.0) + F.when(F.col("bs").isNotNull(), bm25_weight).otherwise(0.0)
    mean = (F.coalesce(F.col("vs") * vector_weight, F.lit(0.0)) + F.coalesce(F.col("bs") * bm25_weight, F.lit(0.0))) / present
    scored = both.withColumns({"raw": raw, "mean": mean}).withColumn("top", F.max("raw").over(Window.partitionBy("qid")))
    base = F.when(F.col("vs").isNull(), F.col("bs")).otherwise(0.35 * F.col("raw") / F.col("top") + 0.65 * F.col("mean"))
    floor = F.when(F.col("bs") >= 0.75, F.col("bs") * 0.92).otherwise(0.0)
    return scored.select("qid", "id", clamp01(F.greatest(base, floor), 0.1).alias("score"), "vs", "bs")


def hybrid(rows: DataFrame, queries: DataFrame, now: int, k: int = 5, pool: int = 20, min_score: float = 0.3, hard_min: float = 0.35, half_life: float = 60.0) -> DataFrame:
    """qid, id, score, confidence, rank: both searches, fusion, then the list of score stages.

    Only the pools (at most ``2 pool`` rows a query) go through the stages.
    """
    # read by both searches and for the stages: parsed once
    live = cut_lineage(rows.where(active_at(now) & ~expired(now)).select("id", "text", "vector", "timestamp", "access_count", "confidence", "temporal_type"))
    queries = cut_lineage(queries.select("qid", "query", "vector"))
    fused = fuse(vector_search(live, queries, pool, 0.1), bm25_search(live, queries, pool)).where(F.col("score") >= min_score)
    found = fused.select("qid", "id", "score").join(live.select("id", "text", "timestamp", "access_count", "confidence", "temporal_type"), "id")
    age = days_since(F.col("timestamp"), now)
    life = F.when(F.col("temporal_type") == "dynamic", half_life / 3).otherwise(half_life)
    staged = found.withColumn("score", length_norm(F.col("score"), F.col("text"))).where(F.col("score") >= hard_min)
    staged = staged.withColumn("score", clamp01(time_decay(F.col("score"), age, life)))
    return top_k(staged, k, digits=9).select("qid", "id", "score", confidence(F.col("score"), now).alias("confidence"), "rank")
