"""Problem 1: records that say nearly the same in nearly the same words.

Method: adaptive multi-match prefixes.  The distinct words of a text are ordered
from rare to frequent.  Two texts with Jaccard similarity t or more share at
least ``l`` words within their first ``n - ceil(t n) + l`` words, for any l.  With
l = 1 each prefix word is a key under which texts meet; where too many would meet
under a word, the texts that hold it lengthen their prefix by a word and the pair
of words becomes the key, then the triple, and so on.  What would still be too
many at ``MOST_MATCHES`` is cut into blocks that meet pairwise, so that no key
gathers an unbounded list.  So a document's prefix is lengthened by the estimated
cost of its own words, and only for those: a pair that shares one of its cheap
words is met there already.

The estimates are exact counts of the frequent words and of the frequent keys,
counted over all texts in the executors.  What is sent to all tasks are those
that at least one of ``MOST_LISTED`` equal shares of all words would make (a
bound whatever the corpus).  The counts only steer the cost: any order and any
choice of l, the same for all texts, gives the same pairs.  Under a key, texts
are compared by size, by position and by the distance of 128-bit images of their
word sets, which is never more than that of the sets; pairs that pass are
verified on the full sets.

Identical word sets form one class, named by 128 bits of their hash, and are
compared once.  Defined results: null texts and texts with fewer than
``least_words`` distinct words are left out; rows of one id count once; nothing is
joined across sources.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count as counting

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.batches import borders, ragged, whole_groups
from quern.session import partitions, shared_dir, table

#: Similarity as a fraction, so that bounds are exact integers.
T_NUM, T_DEN = 7, 10
LEAST_WORDS = 8
WORD = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"
#: Most words, and most keys of each length, whose counts are sent to all tasks.
MOST_LISTED = 1 << 18
#: Candidates under one key before it is lengthened; beyond about so many, comparing costs more than the extra keys.
MOST_MEETING = 8192
MOST_MATCHES = 5
#: Identical texts up to so many are paired with each other; more are all paired with the first one only.
MOST_COPIES = 200
_scratch = counting()


def word_sets(rows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """src, id, c1, c2, tokens of rows (src, id, text): hashes of the distinct words, and two hashes of their set.

    A word has another hash in each source, so that sources never meet.
    """
    words = rows.where("id is not null and text is not null").select("src", "id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("words"))
    hashed = words.where(F.size("words") >= least_words).select("src", "id", F.array_sort(F.transform("words", lambda w: F.xxhash64(F.col("src"), w))).alias("tokens"))
    return hashed.select("src", "id", F.xxhash64("src", "tokens").alias("c1"), F.xxhash64("tokens", F.lit("second")).alias("c2"), "tokens")


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quern-{name}-{spark.sparkContext.applicationId}-{next(_scratch)}"
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return spark.read.parquet(path)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ b.view(np.uint64)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x.view(np.int64)


class Counts:
    """Counts of the frequent values of a column; all others count as 0."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        order = np.argsort(values)
        self.values, self.counts = values[order], counts[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.values, keys), len(self.values) - 1)
        return np.where(self.values[at] == keys, self.counts[at], 0)


class Prefixes:
    """Keys of the texts of a batch, given the counts known so far.

    counts[0] counts words over all texts and sets the order, counts[l] the keys
    of l words that are to be lengthened.
    """

    def __init__(self, batch: pa.RecordBatch, counts: list[Counts]):
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        tokens = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        self.num, self.n = batch.column(0).to_numpy(zero_copy_only=False), np.diff(offsets)
        self.tokens, self.offsets = tokens, offsets
        doc = np.repeat(np.arange(len(self.n)), self.n)
        bit = ((tokens.view(np.uint64) >> np.uint64(40)) & np.uint64(127)).astype(np.int64)
        one = np.uint64(1) << (bit & 63).astype(np.uint64)
        self.image = [np.bitwise_or.reduceat(np.where((bit >> 6) == side, one, np.uint64(0)), offsets[:-1]) if len(tokens) else np.zeros(0, np.uint64) for side in (0, 1)]
        order = np.lexsort((tokens, counts[0].of(tokens), doc))
        self.doc, self.word = doc[order], tokens[order]
        self.at = np.arange(len(doc)) - np.repeat(offsets[:-1], self.n)  # from 0
        self.counts = counts

    def keys(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, key, place of the last word from 1, its index) of the keys of exactly ``level`` words that come about."""
        room = self.n - -(-T_NUM * self.n // T_DEN)  # words that a text may lack
        first = np.flatnonzero(self.at <= room[self.doc])
        doc, key, index = self.doc[first], self.word[first], first
        for l in range(2, level + 1):
            hot = self.counts[l - 1].of(key) > 0
            doc, key, index = doc[hot], key[hot], index[hot]
            last = self.offsets[doc] + np.minimum(room[doc] + l - 1, self.n[doc] - 1)
            more = np.maximum(last - index, 0)
            nxt = ragged(index + 1, more)
            doc, key = np.repeat(doc, more), _mix(np.repeat(key, more), self.word[nxt])
            index = nxt
        return doc, key, self.at[index] + 1, index


def _frequent(values: DataFrame, least: int) -> Counts:
    """Counts of the values of a column that come more than ``least`` times, of the ``MOST_LISTED`` most frequent ones at most."""
    counted = values.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > least)
    got = counted.orderBy(F.desc("n"), "v").limit(MOST_LISTED).toArrow()
    return Counts(got.column(0).to_numpy(), got.column(1).to_numpy())


def _keys_of(classes: DataFrame, counts: list[Counts], level: int) -> DataFrame:
    sent = classes.sparkSession.sparkContext.broadcast(counts)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(Prefixes(batch, sent.value).keys(level)[1])], names=["v"])

    return classes.select("num", "tokens").mapInArrow(emit, "v bigint")


def _allowed_distance(total: np.ndarray) -> np.ndarray:
    """Most words in just one of two sets of ``total`` words together."""
    need = -(-T_NUM * total // (T_NUM + T_DEN))
    return total - 2 * need


def _key_rows(sent, deepest: int, most_meeting: int):
    schema = pa.schema([("key", pa.int64()), ("num", pa.int64()), ("n", pa.int32()), ("most", pa.int32()), ("part", pa.int32()), ("i0", pa.int64()), ("i1", pa.int64())])

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                p = Prefixes(whole.slice(start, 4096), counts)
                if not len(p.n):
                    continue
                for level in range(1, deepest + 1):
                    doc, key, place, _ = p.keys(level)
                    meeting = counts[level].of(key)
                    part = np.full(len(key), -1, dtype=np.int32)
                    if level < deepest:
                        final = meeting == 0
                        doc, key, place, part = doc[final], key[final], place[final], part[final]
                    else:  # cut into blocks that meet pairwise
                        blocks = np.where(meeting > most_meeting, -(-meeting // most_meeting), 1)
                        own = (_mix(p.num[doc], key).view(np.uint64) % blocks.astype(np.uint64)).astype(np.int64)
                        times = blocks
                        doc, key, place, own = (np.repeat(x, times) for x in (doc, key, place, own))
                        other = ragged(np.zeros(len(times), dtype=np.int64), times)
                        cut = np.repeat(blocks > 1, times)
                        part = np.where(cut & (own != other), own, -1).astype(np.int32)
                        low, high = np.minimum(own, other), np.maximum(own, other)
                        key = np.where(cut, _mix(key, low * 1_000_003 + high + 1), key)
                    n = p.n[doc]
                    # most words of both together: what is left from here on must hold the overlap
                    most = (T_NUM + T_DEN) * (n - place + level) // T_NUM
                    keep = most >= n + -(-T_NUM * n // T_DEN)
                    doc, key, n, most, part = doc[keep], key[keep], n[keep], most[keep], part[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(p.num[doc]), pa.array(n.astype(np.int32)), pa.array(most.astype(np.int32)), pa.array(part), pa.array(p.image[0][doc].view(np.int64)), pa.array(p.image[1][doc].view(np.int64))], schema=schema)

    return emit


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes under the same key that sizes, places and images let pass."""
    for t in whole_groups(batches, "key"):
        key, num, n, most, part, i0, i1 = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "num", "n", "most", "part", "i0", "i1"))
        n, most = n.astype(np.int64), most.astype(np.int64)
        edge = borders(key)
        group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        order = np.lexsort((n, group))
        num, n, most, part, i0, i1 = (x[order] for x in (num, n, most, part, i0, i1))
        place = (group << 32) + n  # group is sorted already
        top = np.minimum(n * T_DEN // T_NUM, most - n)
        stop = np.searchsorted(place, (group << 32) + top, side="right")
        counts = np.maximum(stop - np.arange(len(n)) - 1, 0)
        i0, i1 = i0.view(np.uint64), i1.view(np.uint64)
        total = np.cumsum(counts)
        at = 0
        seen: list[np.ndarray] = []
        while at < len(n):
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + 2_000_000, side="right")))
            a = np.repeat(np.arange(at, end), counts[at:end])
            b = ragged(np.arange(at, end) + 1, counts[at:end])
            at = end
            both = n[a] + n[b]
            ok = both <= most[b]
            a, b, both = a[ok], b[ok], both[ok]
            apart = np.bitwise_count(i0[a] ^ i0[b]).astype(np.int64)
            allowed = _allowed_distance(both)
            ok = apart <= allowed
            a, b, apart, allowed = a[ok], b[ok], apart[ok], allowed[ok]
            ok = (apart + np.bitwise_count(i1[a] ^ i1[b]) <= allowed) & (num[a] != num[b]) & ((part[a] < 0) | (part[a] != part[b]))
            if ok.any():
                x, y = num[a[ok]], num[b[ok]]
                seen.append(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1))
        if seen:
            pairs = np.unique(np.concatenate(seen), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity of (a, b, tokens of a, tokens of b, ...); what follows the tokens is handed on."""
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            rows = batch.slice(start, 4096)
            sides, sizes = [], []
            for c in (2, 3):
                lists = rows.column(c)
                off = lists.offsets.to_numpy().astype(np.int64)
                flat = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
                sides.append((np.repeat(np.arange(rows.num_rows), np.diff(off)), flat))
                sizes.append(np.diff(off))
            row, tok = np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides])
            order = np.lexsort((tok, row))
            row, tok = row[order], tok[order]
            same = (row[1:] == row[:-1]) & (tok[1:] == tok[:-1])
            common = np.bincount(row[1:][same], minlength=rows.num_rows)
            union = sizes[0] + sizes[1] - common
            ok = pa.array(T_DEN * common >= T_NUM * union)
            kept = [rows.column(i).filter(ok) for i in (0, 1, *range(4, rows.num_columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(common / np.maximum(union, 1)).filter(ok)], names=["a", "b", *rows.schema.names[4:], "similarity"])


def similar_classes(sets: DataFrame, most_meeting: int = MOST_MEETING, most_copies: int = MOST_COPIES, most_matches: int = MOST_MATCHES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of classes, classes, members).

    classes: num, c1, c2, src, copies, ids (all ids of up to ``most_copies``, else the
    smallest one); pairs: a, b (num), src, ids_a, ids_b, similarity; members: src, id,
    c1, c2.
    """
    width = partitions(sets)
    members = sets.select("src", "id", "c1", "c2").distinct()
    sizes = members.groupBy("c1", "c2").agg(F.min("src").alias("src"), F.count("*").alias("copies"), F.min("id").alias("first"))
    few = members.join(sizes.where(f"copies between 2 and {int(most_copies)}").select("c1", "c2"), ["c1", "c2"]).groupBy("c1", "c2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    # every row of a class has the same tokens, so any one stands for it
    once = sets.select("c1", "c2", "tokens").dropDuplicates(["c1", "c2"]).join(sizes, ["c1", "c2"]).join(few, ["c1", "c2"], "left")
    classes = _written(once.select(F.monotonically_increasing_id().alias("num"), "c1", "c2", "src", "copies", F.coalesce("ids", F.array("first")).alias("ids"), "tokens"), "classes")
    words = classes.agg(F.sum(F.size("tokens"))).head()[0] or 0
    counts = [_frequent(classes.select(F.explode("tokens").alias("v")), max(1, words // MOST_LISTED))]
    deepest = 0
    while deepest < most_matches:
        deepest += 1
        counts.append(_frequent(_keys_of(classes, counts, deepest), most_meeting))
        if not len(counts[deepest].values):
            break
    schema = "key bigint, num bigint, n int, most int, part int, i0 bigint, i1 bigint"
    keyed = classes.select("num", "tokens").mapInArrow(_key_rows(sets.sparkSession.sparkContext.broadcast(counts), deepest, most_meeting), schema)
    met = keyed.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_meet, "a bigint, b bigint").distinct()
    left = classes.select(F.col("num").alias("a"), F.col("tokens").alias("ta"), "src", F.col("ids").alias("ids_a"))
    right = classes.select(F.col("num").alias("b"), F.col("tokens").alias("tb"), F.col("ids").alias("ids_b"))
    id_type = dict(sets.dtypes)["id"]
    pairs = met.join(left, "a").join(right, "b").select("a", "b", "ta", "tb", "src", "ids_a", "ids_b").mapInArrow(_verify, f"a bigint, b bigint, src string, ids_a array<{id_type}>, ids_b array<{id_type}>, similarity double")
    return pairs, classes.drop("tokens"), members


def similar_pairs(rows: DataFrame, most_copies: int = MOST_COPIES, most_meeting: int = MOST_MEETING) -> DataFrame:
    """src, id_a, id_b of rows (src, id, text) with similarity 0.7 or more.

    Rows with the same word set are all paired where they are at most
    ``most_copies``; a larger group is linked to its smallest id, which also
    stands for it beside other classes, so no link between different texts is lost.
    """
    pairs, classes, members = similar_classes(word_sets(rows), most_meeting, most_copies)
    alike = classes.where("size(ids) > 1").select("src", F.posexplode("ids").alias("i", "id_a"), "ids")
    same = alike.select("src", "id_a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("id_b"))
    many = classes.where(f"copies > {int(most_copies)}").select("c1", "c2", F.col("ids")[0].alias("first"))
    star = members.join(many, ["c1", "c2"]).where("id <> first").select("src", F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    cross = pairs.select("src", F.explode("ids_a").alias("x"), "ids_b").select("src", "x", F.explode("ids_b").alias("y")).select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return same.unionByName(star).unionByName(cross)


def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "memories").select(F.lit("memory").alias("src"), "id", "text")
    b = table(spark, sf_dir, "extraction_candidates").select(F.lit("candidate").alias("src"), F.col("cand_id").alias("id"), F.col("abstract").alias("text"))
    return a.unionByName(b)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(stored_texts(spark, sf_dir))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record: its class and the number of other classes that its class is linked to."""
    pairs, classes, members = similar_classes(word_sets(stored_texts(spark, sf_dir)))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("num")).groupBy("num").agg(F.count("*").alias("links"))
    linked = classes.join(ends, "num", "left").select("c1", "c2", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(linked, ["c1", "c2"]).select("src", "id", F.concat(F.hex("c1"), F.hex("c2")).alias("class_id"), "links")
