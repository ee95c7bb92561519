"""The stages that a list of found memories goes through before it is shown, and the ways to find them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.metadata import active_at, expired
from quern.functions.numbers import clamp01
from quern.functions.recall_text import tags
from quern.functions.text import is_noise
from quern.operators import scoring
from quern.operators.search import bm25_by_rare_words, bm25_search, fuse, top_k, vector_search
from quern.session import cut_lineage


def kept_floor(score: Column, by_keyword: Column, returned: Column) -> Column:
    """The least score a result keeps when it is ranked again: strong keyword hits keep more."""
    bs = F.coalesce(by_keyword, F.lit(0.0))
    share = F.when(bs >= 0.75, F.when(returned, 0.95).otherwise(1.0)).when(bs >= 0.6, F.when(returned, 0.9).otherwise(0.95)).otherwise(F.when(returned, 0.5).otherwise(0.8))
    return clamp01(score * share, 0.0)


def reranked(found: DataFrame, judged: DataFrame) -> DataFrame:
    """Results (qid, id, score, bs) blended with scores from outside (qid, id, judged); those without one lose a fifth."""
    both = found.join(judged.select("qid", "id", "judged"), ["qid", "id"], "left")
    has = F.col("judged").isNotNull()
    blend = F.when(has, F.col("judged") * 0.6 + F.col("score") * 0.4).otherwise(F.col("score") * 0.8)
    return both.withColumn("score", F.greatest(kept_floor(F.col("score"), F.col("bs"), has), clamp01(blend, 0.0))).drop("judged")


def by_cosine(score: Column, cosine: Column, by_keyword: Column) -> Column:
    """Ranking again without a judge: the cosine, with the keyword score where there is one."""
    bs = F.coalesce(by_keyword, F.lit(0.0))
    return clamp01(F.when(bs > 0, bs * 0.3 + cosine * 0.7).otherwise(cosine), 0.0)


def hard_cut(found: DataFrame, least: float, keep_all: bool = False) -> DataFrame:
    """Results of at least ``least``; with ``keep_all`` a query whose results all fall under it keeps them."""
    if not keep_all:
        return found.where(F.col("score") >= least)
    best = F.max("score").over(Window.partitionBy("qid"))
    return found.withColumn("_best", best).where((F.col("score") >= least) | (F.col("_best") < least)).drop("_best")


def staged(found: DataFrame, k: int = 5, hard_min: float = 0.35, keep_all: bool = False, rank_again: bool = False) -> DataFrame:
    """Results (qid, id, score, bs, cosine and the row's text, composite, tier) through all stages: qid, id, score, rank.

    Length, noise, ranking again, the hard limit, decay, the k best. Each stage is
    a projection or filter of the pools; only the last one is an exchange.
    """
    out = found.withColumn("score", scoring.length_norm(F.col("score"), F.col("text"))).where(~is_noise(F.col("text")))
    if rank_again:
        out = out.withColumn("score", by_cosine(F.col("score"), F.col("cosine"), F.col("bs")))
    out = hard_cut(out, hard_min, keep_all)
    out = out.withColumn("score", clamp01(scoring.decay_boost(F.col("score"), F.col("composite"), F.col("tier")), 0.0))
    return top_k(out, k, digits=9).select("qid", "id", "score", "rank")


ROW = ("id", "text", "composite", "tier")


def recall_by_vector(rows: DataFrame, queries: DataFrame, now: int, k: int = 5, pool: int = 20, min_score: float = 0.3) -> DataFrame:
    """Vector search alone through the stages."""
    live = cut_lineage(rows.where(active_at(now) & ~expired(now)).select(*ROW, "vector"))
    found = vector_search(live, queries, pool, min_score).select("qid", "id", "score", F.lit(None).cast("double").alias("bs"), (2 - 1 / F.col("score")).alias("cosine"))
    return staged(found.join(live.select(*ROW), "id"), k)


def recall_by_tags(rows: DataFrame, queries: DataFrame, now: int, k: int = 5, pool: int = 20) -> DataFrame:
    """Keyword search of the queries that name tags; a result must hold all of them.

    Queries of the same text are asked once, under their text.
    """
    live = cut_lineage(rows.where(active_at(now) & ~expired(now)).select(*ROW))
    asked = cut_lineage(queries.select("qid", "query", tags(F.col("query")).alias("tags")).where(F.size("tags") > 0))
    texts = asked.select(F.col("query").alias("qid"), "query", "tags").dropDuplicates(["qid"])
    found = bm25_by_rare_words(live, texts, pool).select("qid", "id", "score", F.col("score").alias("bs"), F.lit(None).cast("double").alias("cosine"))
    held = found.join(live, "id").join(texts.select("qid", "tags"), "qid")
    # written, so that the stages read those alone and not all rows before the join
    held = cut_lineage(held.where(F.forall("tags", lambda t: F.contains(F.lower("text"), F.lower(t)))).drop("tags"))
    best = staged(held, k)
    return asked.select("qid", "query").join(best.withColumnRenamed("qid", "query"), "query").select("qid", "id", "score", "rank")


def recall(rows: DataFrame, queries: DataFrame, now: int, k: int = 5, pool: int = 20, min_score: float = 0.3, rank_again: bool = True) -> DataFrame:
    """Both searches, fusion, and the stages; where all results fall under the hard limit they are kept."""
    live = cut_lineage(rows.where(active_at(now) & ~expired(now)).select(*ROW, "vector"))
    queries = cut_lineage(queries.select("qid", "query", "vector"))
    fused = fuse(vector_search(live, queries, pool, 0.1), bm25_search(live, queries, pool)).where(F.col("score") >= min_score)
    near = fused.select("qid", "id", "score", "bs", F.when(F.col("vs").isNotNull(), 2 - 1 / F.col("vs")).otherwise(0.0).alias("cosine"))
    return staged(near.join(live.select(*ROW), "id"), k, keep_all=True, rank_again=rank_again)
