"""Admission of candidates, merging of clusters, evidence for rules, access rights and version chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import MS_PER_DAY, clamp01
from quern.functions.text import trimmed
from quern.session import cut_lineage

# How likely a candidate of a category is worth keeping, and the weights of the parts of its score.
PRIORS = {"profile": 0.95, "preferences": 0.9, "entities": 0.75, "events": 0.45, "cases": 0.8, "patterns": 0.85}
WEIGHTS = {"utility": 0.15, "support": 0.15, "novelty": 0.15, "recency": 0.15, "prior": 0.4}
# The stricter and the more generous preset, as (weights, priors, reject under, admit from, half-life in days).
PRESETS = {
    "balanced": (WEIGHTS, PRIORS, 0.45, 0.6, 14.0),
    "conservative": ({"utility": 0.16, "support": 0.16, "novelty": 0.18, "recency": 0.08, "prior": 0.42}, {"profile": 0.98, "preferences": 0.94, "entities": 0.78, "events": 0.28, "cases": 0.78, "patterns": 0.8}, 0.52, 0.68, 10.0),
}


def common_subsequence(a: list[str], b: list[str]) -> int:
    if not a or not b:
        return 0
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(t, len(codes)) for t in side]) for side in (a, b))
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for t in x:
        up = row.copy()
        up[1:] = np.maximum(up[1:], row[:-1] + (y == t))
        row = np.maximum.accumulate(up)
    return int(row[-1])


def support(pairs: DataFrame) -> DataFrame:
    """id, best, coverage, score of pairs (id, said: the candidate's text, heard: the conversation).

    best: the greatest F1 of the longest common subsequence with a line or sentence.
    """
    import re

    word = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W_㐀-䶿一-鿿豈-﫿]+")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                said, heard = word.findall((r.said or "").lower()), r.heard or ""
                if not said:
                    out.append((r.id, 0.0, 0.0, 0.0))
                    continue
                spans = {s.strip() for line in heard.split("\n") for s in (line, *(x for x in re.split(r"[。！？!?]+", line) if len(x.strip()) >= 4)) if s.strip()}
                best = 0.0
                for s in spans:
                    tokens = word.findall(s.lower())
                    n = common_subsequence(said, tokens)
                    if n:
                        p, q = n / len(said), n / len(tokens)
                        best = max(best, 2 * p * q / (p + q))
                own = set(said)
                coverage = len(own & set(word.findall(heard.lower()))) / len(own)
                out.append((r.id, best, coverage, min(1.0, max(0.0, 0.7 * best + 0.3 * coverage - 0.25 * (1 - coverage)))))
            yield pd.DataFrame(out, columns=["id", "best", "coverage", "score"])

    return pairs.select("id", "said", "heard").mapInPandas(run, "id string, best double, coverage double, score double")


def admission(candidates: DataFrame, matches: DataFrame, now: int, preset: str = "balanced", weights: dict[str, float] | None = None) -> DataFrame:
    """id, score, decision, hint for candidates (id, category, support, utility) and their matches (id, similarity, timestamp).

    Weights count in proportion to their sum; negative ones count as 0.
    """
    given, priors, reject_under, admit_from, half_life = PRESETS[preset]
    given = {k: max(0.0, v) for k, v in (weights or given).items()}
    share = {k: v / (sum(given.values()) or 1.0) for k, v in given.items()}
    m = matches.groupBy("id").agg(F.max(F.greatest(F.lit(0.0), "similarity")).alias("nearest"), F.max("timestamp").alias("latest"))
    gap = F.greatest(F.lit(0.0), (F.lit(now) - F.col("latest")) / MS_PER_DAY)
    recency = F.when(F.col("latest").isNull() | (F.col("latest") <= 0), 1.0).otherwise(clamp01(1 - F.exp(-0.6931471805599453 / half_life * gap), 1.0))
    prior = F.lit(0.5)
    for name, value in priors.items():
        prior = F.when(F.col("category") == name, value).otherwise(prior)
    joined = candidates.join(m, "id", "left").withColumn("nearest", F.coalesce("nearest", F.lit(0.0)))
    score = share["utility"] * F.col("utility") + share["support"] * F.col("support") + share["novelty"] * (1 - F.col("nearest")) + share["recency"] * recency + share["prior"] * prior
    scored = joined.withColumn("score", clamp01(score))
    return scored.select("id", "score", F.when(F.col("score") < reject_under, "reject").otherwise("pass_to_dedup").alias("decision"), F.when(F.col("score") < reject_under, None).when((F.col("score") >= admit_from) & (F.col("nearest") < 0.55), "add").otherwise("update_or_merge").alias("hint"))


def merged_clusters(members: DataFrame) -> DataFrame:
    """One row per cluster of members (cluster, pos, text, importance, category, scope): the merged record.

    Lines are kept once, whatever their case, in order; the most frequent category
    wins, the first seen of equals; importance is the greatest, at most 1.
    """
    lines = members.select("cluster", "pos", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    first = lines.withColumn("k", F.row_number().over(Window.partitionBy("cluster", F.lower("line")).orderBy("pos", "n"))).where("k = 1")
    text = first.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    votes = members.groupBy("cluster", "category").agg(F.count("*").alias("votes"), F.min("pos").alias("seen"))
    category = votes.groupBy("cluster").agg(F.min_by("category", F.struct((-F.col("votes")).alias("v"), "seen")).alias("category"))
    rest = members.groupBy("cluster").agg(F.least(F.lit(1.0), F.max("importance")).alias("importance"), F.min_by("scope", "pos").alias("scope"), F.count("*").alias("source_count"))
    return rest.join(category, "cluster").join(text, "cluster", "left").select("cluster", F.coalesce("text", F.lit("")).alias("text"), "importance", "category", "scope", "source_count")


def evidence(rows: DataFrame, most_sessions: int = 50) -> DataFrame:
    """category, rule, evidence_count, sessions, stability, confidence of rules (id, category, rule, session, timestamp, confidence).

    Only rows of the sessions seen last count; the newest row's confidence is the least one.
    """
    last = rows.groupBy("session").agg(F.max("timestamp").alias("at")).orderBy(F.desc("at"), "session").limit(most_sessions)
    kept = rows.join(F.broadcast(last.select("session")), "session", "left_semi")  # at most most_sessions rows
    g = kept.groupBy("category", "rule").agg(F.count("*").alias("evidence_count"), F.count_distinct("session").alias("sessions"), F.avg("confidence").alias("mean"), F.max_by("confidence", F.struct("timestamp", "id")).alias("newest"))
    stability = F.least(F.lit(1.0), clamp01(F.col("sessions") / F.greatest(F.lit(2), "evidence_count")) * 0.45 + clamp01(F.col("mean")) * 0.55)
    return g.select("category", "rule", "evidence_count", "sessions", stability.alias("stability"), F.greatest("newest", "mean").alias("confidence"))


def accessible(rows: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows beside every agent that may read them: granted scopes (agent, scope), else global, its own and its reflections."""
    agents = grants.select("agent").distinct()
    explicit = grants.where("scope is not null").select("agent", "scope")
    own = agents.select("agent", F.concat(F.lit("reflection:agent:"), "agent").alias("scope"))
    default = agents.join(explicit.select("agent").distinct(), "agent", "left_anti").select("agent", F.explode(F.array(F.lit("global"), F.concat(F.lit("agent:"), "agent"))).alias("scope"))
    return rows.join(explicit.unionByName(own).unionByName(default).distinct(), "scope")


def version_chains(edges: DataFrame) -> DataFrame:
    """id, root, depth of versions (id, supersedes): every row with the oldest one that it goes back to.

    Pointer doubling: a chain of n versions takes log2 n joins, so after that many
    rounds only rows in circles have a way left; they are left out.
    """
    rounds = max(1, edges.count()).bit_length() + 1
    state = cut_lineage(edges.select("id", F.col("supersedes").alias("up"), F.when(F.col("supersedes").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.coalesce("supersedes", "id").alias("root")))
    for _ in range(rounds):
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("root").alias("far"))
        state = cut_lineage(state.join(above, "up", "left").select("id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("far", "root").alias("root")))
        if state.where("up is not null").isEmpty():
            break
    return state.where("up is null").select("id", "root", "depth")


def novelty_matches(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Of the matches found for a candidate, those of its own category, if there are any."""
    both = found.join(candidates.select("id", F.col("category").alias("own")), "id")
    same = F.max((F.col("category") == F.col("own")).cast("int")).over(Window.partitionBy("id"))
    return both.withColumn("any", same).where("any = 0 or any is null or category = own").drop("any", "own")


def conversation_value(lines: DataFrame) -> DataFrame:
    """session, value: what a conversation is worth reading for, from its lines (session, text)."""
    from quern.functions.classify import CORRECTION, DECISION, MEMORY_INTENT, TOOL_CALL, matches

    t = F.col("text")
    flag = lambda p: F.max(matches(trimmed(t), p).cast("int"))
    g = lines.groupBy("session").agg(flag(MEMORY_INTENT).alias("intent"), flag(TOOL_CALL).alias("tool"), F.greatest(flag(CORRECTION), flag(DECISION)).alias("turn"), F.sum(F.when(F.length(trimmed(t)) > 20, F.length(t)).otherwise(0)).alias("chars"), F.count("*").alias("n"))
    value = 0.5 * F.col("intent") + 0.4 * F.col("tool") + 0.3 * F.col("turn") + F.when(F.col("chars") > 200, 0.2).otherwise(0.0) + F.when(F.col("n") > 6, 0.1).otherwise(0.0)
    return g.select("session", F.least(F.lit(1.0), F.round(value, 6)).alias("value"))

