"""Problem 8: pages of repeated keywords, links or tags instead of writing.

Method: robust Mahalanobis distance.  A page is cut into segments (sentences and
lines, long ones every ``LONG`` words).  Five features of each segment (density of
links, density of tags, repetition of its words in the page, lack of function
words, shortness of its clauses) are held against the robust centre and scatter
of all segments of its language and script: medians, deviations from the median,
and correlations by the spread of sums and differences (Gnanadesikan and
Kettenring).  A segment is an outlier if its squared distance is over ``FAR`` and
it lies in a spam-directed direction: links, tags, or lack of function words with
short clauses, more than ``TOWARD`` robust deviations.  Repetition adds to the
distance only, since many alike sentences are writing.  A page is spam if more
than half of its characters stand in outlying segments.

All statistics cover all segments; only one small row of them per language and
script comes to the driver.  A group of fewer than ``LEAST_ROWS`` segments is held
against those of all languages of its script.  Defined results: null and blank
texts are no spam; a missing or odd language counts to the group of all; rows of
one id count once, a null id is an id of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import cut_lineage, partitions, table

FEATURES = ("links", "tags", "repeats", "unfunctional", "clipped")
#: Least segments of a language and script for statistics of its own.
LEAST_ROWS = 200
#: Least spread of a feature: most segments have no link and no tag at all.
LEAST_SPREAD = 0.05
#: Squared distance of the 97.5th percentile of chi-square with five degrees of freedom.
FAR = 12.83
#: The 95th percentile of a normal distribution.
TOWARD = 1.645
#: Words between white space of a segment at most, and the weight of the page in a segment's share of function words.
LONG = 60
PRIOR = 8

LINK = regex.compile(r"""(?i)<a\s[^>]*>|</?(?:li|a|ul|ol|br|p)\s*/?>|\]\([^)\s]*\)|(?:https?://|www\.)[^\s<>"')\]]+|(?<![\w@./-])(?:[a-z0-9-]+\.)+[a-z]{2,10}/[^\s<>"')\],]*""")
TAG = regex.compile(r"(?<![\w&/#])#[\p{L}\p{N}_][\p{L}\p{N}_-]*")
WORD = regex.compile(r"\p{Han}+|[\p{L}\p{N}]+")
HAN_CLAUSE = regex.compile(r"\p{Han}+|(?:(?!\p{Han})[\p{L}\p{N}])+(?: {1,2}(?:(?!\p{Han})[\p{L}\p{N}])+)*")
CLAUSE = re.compile(r"\w(?:[\w'’-]| {1,2}(?=\w))*")
# sentence ends need white space behind them, so that 12.99 and file.ts stay whole
PIECE = regex.compile(r"[\n\r]+|(?<=[.!?])\s+|(?<=[。！？])|\s{3,}")
# lines that notes have besides sentences: headings, settings, table rows, fences
PLAIN_LINE = regex.compile(r"""^\s*(?:#{1,6}\s|```|~~~|\|.*\|\s*$|[\w.\- "']{1,40}\s*[:=]\s*[\w."'\-]{0,40}\s*,?$|[-|:\s=_*]+$|[{}\[\]]+,?$)""")
# Frequent function words of English and German, function signs of Chinese.
FUNCTION_WORDS = frozenset(
    "the a an of to in on for and or is are was were be been by with from that this it its as at when whenever if only before after than then who whom whose which will would shall should could can "
    "may might must not no do does did has have had but because while until under over between within about into per since once both each every he she they we you i my our your their there what how why "
    "der die das den dem des ein eine einen einem einer eines und oder ist sind war waren wird werden wurde wurden hat haben mit von zu zum zur im in am an auf für nicht nach bei beim aus als vor bis soll auch "
    "noch nur wenn weil dass daß sich es er sie wir ihr ich um über unter ohne wegen sobald davon danach kann muss".split()
)
FUNCTION_SIGNS = frozenset("的了是在把就和与被不要由因并等从为若再后这那每到说占其会都还也将对让给向着过之而且或则但只没有")



def _function_hits(words: list[str]) -> tuple[int, int]:
    """Function words among the words, and all of them; a Chinese sign counts as a word."""
    if not any("㐀" <= w[0] for w in words):
        return sum(w in FUNCTION_WORDS for w in words), len(words)
    n = hits = 0
    for w in words:
        if "㐀" <= w[0] <= "鿿" or "\U00020000" <= w[0] <= "\U0003ffff":
            n += len(w)
            hits += 2 * sum(c in FUNCTION_SIGNS for c in w)  # signs carry less than words
        else:
            n += 1
            hits += w in FUNCTION_WORDS
    return hits, n


def _pieces(bare: str) -> Iterator[str]:
    """Sentences and lines, long ones in windows of ``LONG`` words; settings, headings and table rows are left out."""
    at = 0
    for m in (*PIECE.finditer(bare), None):
        piece = bare[at : m.end() if m else len(bare)]
        at = m.end() if m else at
        if not piece or piece.isspace() or PLAIN_LINE.match(piece.strip("\r\n")):
            continue
        words = piece.split()
        if len(words) <= LONG:
            yield piece
            continue
        for i in range(0, len(words), LONG):
            yield " ".join(words[i : i + LONG])


def segments(text: str) -> tuple[int, list[tuple[int, bool, float, float, float, float, float]]]:
    """Characters of a page, and (characters, Chinese or not, the five features) of each segment."""
    text = text.replace("\ufeff", "").replace("\u200b", "")
    # links and tags become as many signs that no text has
    bare = text.replace("\x01", " ").replace("\x02", " ")
    if "/" in bare or "<" in bare or "](" in bare or "www." in bare:
        bare = LINK.sub(lambda m: "\x01" * len(m.group().replace(" ", "")), bare)
    if "#" in bare:
        bare = TAG.sub(lambda m: "\x02" * len(m.group()), bare)
    counts: Counter[str] = Counter()
    parts = []
    for piece in _pieces(bare):
        words = WORD.findall(piece.lower())
        counts.update(words)
        parts.append((piece, words, *_function_hits(words)))
    prior = PRIOR * sum(p[2] for p in parts) / max(1, sum(p[3] for p in parts))
    out = []
    for piece, words, hits, n in parts:
        size = sum(map(len, piece.split()))
        letters = sum(map(len, words)) or 1
        repeats = sum(len(w) for w in words if counts[w] > 3) / letters
        han = sum(len(w) for w in words if "㐀" <= w[0] <= "鿿") * 2 > n
        clauses = len((HAN_CLAUSE if han else CLAUSE).findall(piece)) if n else 0
        clause = float(np.log2(n / clauses)) if clauses else float("nan")
        out.append((size, han, piece.count("\x01") / size, piece.count("\x02") / size, repeats, -(hits + prior) / (n + PRIOR), -clause))
    return sum(map(len, bare.split())), out


def features(documents: DataFrame) -> DataFrame:
    """doc_id, grp (the language's code), total and, a list each, the segments' sizes, scripts and features."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                pages = [segments(x) for x in batch.column(2).to_pylist()]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for _, p in pages]))).astype(np.int32))
                flat = [s for _, p in pages for s in p]
                cols = list(zip(*flat, strict=True)) if flat else [()] * (2 + len(FEATURES))
                kinds = (pa.int32(), pa.bool_(), *(pa.float64() for _ in FEATURES))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c, k)) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in pages], pa.int32()), *lists], names=["doc_id", "grp", "total", "size", "han", *FEATURES])

    code = F.regexp_extract(F.lower(F.trim(F.coalesce(F.col("lang"), F.lit("")))), r"^([a-z]{2,3})(?:$|[-_])", 1)
    rows = documents.where(F.col("text").isNotNull() & F.col("text").rlike(r"\S")).select("doc_id", F.when(code.isin("", "und"), "*").otherwise(code).alias("grp"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    once = rows.where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(partitions(documents), "doc_id")  # one exchange for both
    spread = once.unionByName(rows.where("doc_id is null"))
    return spread.mapInArrow(measure, f"doc_id {kind}, grp string, total int, size array<int>, han array<boolean>, " + ", ".join(f"{f} array<double>" for f in FEATURES))


def _median(c: Column) -> Column:
    return F.percentile_approx(c, 0.5, 2000)


def robust_scatter(pages: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Centre, spread and inverse correlation of the features by language and script ('en w', 'zh c'), '*' for all languages."""
    each = pages.select("grp", F.explode(F.arrays_zip("han", *FEATURES)).alias("s")).select(F.concat("grp", F.when(F.col("s.han"), " c").otherwise(" w")).alias("grp"), *(F.when(F.isnan(f"s.{f}"), None).otherwise(F.col(f"s.{f}")).alias(f) for f in FEATURES))
    rows = each.unionByName(each.where("not startswith(grp, '*')").withColumn("grp", F.concat(F.lit("*"), F.substring("grp", -2, 2))))
    at = {r["grp"]: r for r in rows.groupBy("grp").agg(F.count("*").alias("n"), *(_median(F.col(f)).alias(f) for f in FEATURES)).where((F.col("n") >= LEAST_ROWS) | F.startswith("grp", F.lit("*"))).collect()}
    names = sorted(at)
    if not names:
        return {}

    def pick(values: dict[str, float]) -> Column:
        out = F.lit(None).cast("double")
        for g in names:
            out = F.when(F.col("grp") == g, float(values[g])).otherwise(out)
        return out

    grouped = rows.where(F.col("grp").isin(*names))
    off = grouped.select("grp", *((F.col(f) - pick({g: at[g][f] or 0.0 for g in names})).alias(f) for f in FEATURES))
    spread = {r["grp"]: np.maximum([1.4826 * (r[f] or 0) for f in FEATURES], LEAST_SPREAD) for r in off.groupBy("grp").agg(*(_median(F.abs(F.col(f))).alias(f) for f in FEATURES)).collect()}
    z = off.select("grp", *((F.col(f) / pick({g: spread[g][i] for g in names})).alias(f) for i, f in enumerate(FEATURES)))
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i)]
    sums = [(_median(F.abs(F.col(FEATURES[i]) + s * F.col(FEATURES[j])))).alias(f"{i}_{j}_{s}") for i, j in pairs for s in (1, -1)]
    got = {r["grp"]: r for r in z.groupBy("grp").agg(*sums).collect()}
    out = {}
    for g in names:
        corr = np.eye(len(FEATURES))
        for i, j in pairs:
            a, b = ((got[g][f"{i}_{j}_{s}"] or 0.0) ** 2 for s in (1, -1))
            corr[i, j] = corr[j, i] = (a - b) / (a + b) if a + b > 0 else 0.0
        values, vectors = np.linalg.eigh(corr)
        out[g] = (np.array([at[g][f] or 0.0 for f in FEATURES], dtype=float), spread[g], (vectors / np.maximum(values, 0.2)) @ vectors.T)
    return out


def outlying(x: np.ndarray, centre: np.ndarray, spread: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, whether a segment is an outlier towards spam); a feature that is not there stands at the centre."""
    z = np.where(np.isnan(x), 0.0, (x - centre) / spread)
    far = np.einsum("ni,ij,nj->n", z, inverse, z)
    worded = (z[:, 3] + np.maximum(z[:, 4], 0)) / np.sqrt(2)
    return far, (far > FAR) & (np.maximum(np.maximum(z[:, 0], z[:, 1]), worded) > TOWARD)


def spam_pages(documents: DataFrame, least_share: float = 0.5) -> DataFrame:
    """doc_id, share of the characters in outlying segments and their greatest squared distance, of the spam pages."""
    rows = cut_lineage(features(documents))
    scatter = robust_scatter(rows)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(3).offsets.to_numpy().astype(np.int64)
            a, b = int(offsets[0]), int(offsets[-1])
            flat = [batch.column(3 + i).values.slice(a, b - a).to_numpy(zero_copy_only=False) for i in range(2 + len(FEATURES))]
            n = np.diff(offsets)
            page = np.repeat(np.arange(batch.num_rows), n)
            size, han, x = flat[0], flat[1].astype(bool), np.stack([f.astype(float) for f in flat[2:]], axis=1)
            codes = np.array(batch.column(1).to_pylist(), dtype=object)[page] if len(page) else np.zeros(0, dtype=object)
            names = np.array([f"{c} {'c' if h else 'w'}" for c, h in zip(codes, han, strict=True)], dtype=object)
            far, spam = np.zeros(len(page)), np.zeros(len(page), dtype=bool)
            for g in set(names):
                own = names == g
                far[own], spam[own] = outlying(x[own], *(scatter[g] if g in scatter else scatter["*" + g[-2:]]))
            total = batch.column(2).to_numpy().astype(float)
            share = np.bincount(page[spam], weights=size[spam], minlength=batch.num_rows) / np.maximum(total, 1)
            most = np.zeros(batch.num_rows)
            np.maximum.at(most, page[spam], far[spam])
            keep = share > least_share
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(share[keep]), pa.array(most[keep])], names=["doc_id", "share", "distance"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {kind}, share double, distance double")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents")).select("doc_id")
