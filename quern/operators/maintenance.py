"""Changes of the store as dataflows: what happens to incoming records, updates, deletes, patches, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.lines import enriched
from quern.functions.metadata import active_at
from quern.functions.numbers import MS_PER_DAY
from quern.functions.text import is_noise, trimmed
from quern.operators.search import vector_search


def nearest_of_kind(rows: DataFrame, new: DataFrame, same: tuple[str, ...] = ("scope",), pool: int = 50) -> DataFrame:
    """nid, id, cosine: the nearest row of every new one (nid, vector and the columns of ``same``), within the same scope and the like.

    Blocks of new vectors are compared with each group of rows; a task keeps its
    best, so an exchange sees few rows for each new one.
    """
    key = F.concat_ws("\x01", *same)
    found = vector_search_within(rows.withColumn("_k", key), new.withColumn("_k", key), pool)
    return found


def vector_search_within(rows: DataFrame, new: DataFrame, pool: int) -> DataFrame:
    """nid, id, cosine of the nearest row with the same ``_k``."""
    from collections.abc import Iterable, Iterator

    import numpy as np
    import pyarrow as pa

    from quern.functions.batches import borders, whole_groups
    from quern.operators.pairs import unit_matrix
    from quern.session import partitions

    width = partitions(rows)
    kept = rows.where(F.size("vector") > 0).select("_k", F.lit(False).alias("ask"), F.col("id").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    asks = new.where(F.size("vector") > 0).select("_k", F.lit(True).alias("ask"), F.col("nid").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    # a hot group is cut: its rows are spread over slices, its questions go to each of them; slices follow the group's size
    sizes = kept.groupBy("_k").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 32_768)).cast("int").alias("slices"))
    kept = kept.join(sizes, "_k").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    asks = asks.join(sizes, "_k").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    both = kept.unionByName(asks).withColumn("block", F.concat_ws("\x01", "_k", "slice")).select("block", "ask", "id", "vector")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, "block", least_rows=1):
            names = np.array(whole.column("block").to_pylist(), dtype=object)
            edge = borders(names)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                part = whole.slice(a, b - a).combine_chunks()
                ask = part.column("ask").to_numpy(zero_copy_only=False).astype(bool)
                vectors = part.column("vector").combine_chunks()
                sizes = vectors.value_lengths().to_numpy()
                ids = part.column("id").combine_chunks()
                for dims in np.unique(sizes):
                    q, r = (np.flatnonzero((sizes == dims) & (ask == side)) for side in (True, False))
                    if not len(q) or not len(r):
                        continue
                    r = r[np.argsort(np.array(ids.take(pa.array(r)).to_pylist(), dtype=object), kind="stable")]  # ties go to the smaller id
                    x = unit_matrix(vectors.take(pa.array(r)), dims)
                    for at in range(0, len(q), 1000):
                        own = q[at : at + 1000]
                        s = np.round(unit_matrix(vectors.take(pa.array(own)), dims) @ x.T, 12)
                        best = np.argmax(s, axis=1)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), ids.take(pa.array(r[best])), pa.array(s[np.arange(len(own)), best])], names=["nid", "id", "cosine"])

    found = both.repartition(width, "block").sortWithinPartitions("block").mapInArrow(run, "nid string, id string, cosine double")
    return found.groupBy("nid").agg(F.min_by(F.struct("id", "cosine"), F.struct((-F.col("cosine")).alias("c"), "id")).alias("b")).select("nid", "b.id", "b.cosine")


def stored(rows: DataFrame, incoming: DataFrame, duplicate: float = 0.98, supersede: float = 0.95) -> DataFrame:
    """nid, action, of_id of incoming records (nid, text, category, scope, vector).

    Noise is left out; what is nearly the same as a row of its scope is a
    duplicate; what is close to one of the same category replaces it; all else is
    created. Records without a vector are created.
    """
    near = nearest_of_kind(rows, incoming).select("nid", F.col("id").alias("any_id"), F.col("cosine").alias("any_cosine"))
    of_kind = nearest_of_kind(rows, incoming, ("scope", "category")).select("nid", F.col("id").alias("kind_id"), F.col("cosine").alias("kind_cosine"))
    all_ = incoming.select(F.col("nid").cast("string").alias("nid"), "text").join(near, "nid", "left").join(of_kind, "nid", "left")
    action = F.when(is_noise(F.col("text")), "noise").when(F.col("any_cosine") > duplicate, "duplicate").when((F.col("kind_cosine") > supersede) & (F.col("kind_cosine") <= duplicate), "supersede").otherwise("create")
    out = all_.select("nid", action.alias("action"), "any_id", "kind_id")
    return out.select("nid", "action", F.when(F.col("action") == "duplicate", F.col("any_id")).when(F.col("action") == "supersede", F.col("kind_id")).alias("of_id"))


def updated(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """id, text, superseded_by after changes of texts (id, new_text): preferences and entities are replaced by a new row, others changed in place."""
    both = rows.select("id", "text", "memory_category").join(changes, "id", "left")
    lasting = F.col("memory_category").isin("preferences", "entities") & F.col("new_text").isNotNull()
    old = both.select("id", F.when(lasting, F.col("text")).otherwise(F.coalesce("new_text", "text")).alias("text"), F.when(lasting, F.concat(F.lit("new-"), "id")).alias("superseded_by"))
    return old.unionByName(both.where(lasting).select(F.concat(F.lit("new-"), "id").alias("id"), F.col("new_text").alias("text"), F.lit(None).cast("string").alias("superseded_by")))


def deleted(rows: DataFrame, refs: DataFrame, scopes: list[str]) -> DataFrame:
    """The rows left after deleting by id or by a prefix (ref) of at least eight signs, within the scopes; a prefix of several rows deletes none."""
    hits = rows.select("id", "scope").join(F.broadcast(refs), (F.col("id") == F.col("ref")) | ((F.length("ref") >= 8) & F.startswith("id", F.col("ref"))))  # refs: what a user typed
    exact = F.max((F.col("id") == F.col("ref")).cast("int")).over(Window.partitionBy("ref"))
    many = F.count("*").over(Window.partitionBy("ref"))
    gone = hits.withColumns({"exact": exact, "many": many}).where(((F.col("exact") == 1) & (F.col("id") == F.col("ref"))) | ((F.col("exact") == 0) & (F.col("many") == 1)))
    return rows.join(gone.where(F.coalesce("scope", F.lit("global")).isin(*scopes)).select("id"), "id", "left_anti")


def forgotten(found: DataFrame, least: float = 0.9) -> DataFrame:
    """qid, action, ids of results (qid, id, score): a single strong hit is deleted, else the candidates are listed."""
    g = found.groupBy("qid").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.array_sort(F.collect_list("id")).alias("ids"))  # a search's few results
    return g.select("qid", F.when((F.col("n") == 1) & (F.col("best") > least), "deleted").otherwise("candidates").alias("action"), "ids")


def stale_summaries(rows: DataFrame, signs: int = 60) -> DataFrame:
    """id, l0, l1 of rows whose abstract doesn't begin like their text, rebuilt."""
    head = lambda c: F.left(trimmed(F.col(c)), F.lit(signs))
    new = rows.where(head("l0") != head("text")).select("id", enriched(F.col("text")).alias("e"))
    return new.select("id", "e.l0", "e.l1")


def too_long_pending(rows: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Ids of pending rows older than so many days."""
    return rows.where((F.col("state") == "pending") & (F.col("timestamp") < now - days * MS_PER_DAY)).select("id")


def suppressed(session: str, turn: int, now: int) -> Column:
    """Whether a row is held back in a session at a turn."""
    active = (F.col("suppressed_until_at") >= now) & F.col("suppressed_session_key").isNotNull() & (F.col("suppressed_until_turn") > 0)
    return F.coalesce(active & (F.col("suppressed_session_key") == session) & (F.col("suppressed_until_turn") >= turn), F.lit(False))


def relation_added(relations: Column, kind: Column, target: Column) -> Column:
    """An edge appended to a list of (type, target), unless it is there."""
    edge = F.struct(kind.alias("type"), target.alias("target"))
    there = F.exists(relations, lambda r: (r["type"] == kind) & (r["target"] == target))
    return F.when(F.coalesce(there, F.lit(False)), relations).otherwise(F.concat(F.coalesce(relations, F.array().cast("array<struct<type:string,target:string>>")), F.array(edge)))


def primers(rows: DataFrame, now: int, most: int = 4) -> DataFrame:
    """scope, place, id: the rows that open a session of a scope: preferences first, then the best decayed ones."""
    kept = rows.where(active_at(now) & (F.col("state") == "confirmed") & ~F.col("layer").isin("archive", "reflection"))
    first = F.col("memory_category").isin("preferences", "profile").cast("int")
    w = Window.partitionBy("scope").orderBy(first.desc(), F.round("composite", 9).desc(), "id")
    return kept.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most).select("scope", "place", "id")


def paged(rows: DataFrame, keep: Column, offset: int, limit: int) -> DataFrame:
    """A page of the rows that pass a filter, newest first: the filter comes before the page, so no scan has a limit."""
    return rows.where(keep).orderBy(F.col("timestamp").desc_nulls_last(), "id").offset(offset).limit(limit)


def quality_flags(now: int) -> Column:
    """What speaks against a row: bad_recall, suppressed, low_confidence, inactive."""
    held = (F.col("suppressed_until_at") >= now) & F.col("suppressed_session_key").isNotNull() & (F.col("suppressed_until_turn") > 0)
    off = (F.col("state") == "archived") | ~active_at(now)
    flags = (("bad_recall", F.col("bad_recall_count") > 0), ("suppressed", held), ("low_confidence", F.col("confidence") < 0.4), ("inactive", off))
    return F.filter(F.array(*(F.when(F.coalesce(hit, F.lit(False)), name) for name, hit in flags)), lambda f: f.isNotNull())


def shown_row(rows: DataFrame, now: int, most: int = 180) -> DataFrame:
    """id, preview, age, tier, flags: a row as it is listed, without secrets and personal data."""
    from quern.functions.lines import age_label
    from quern.functions.text import redact

    text = trimmed(F.regexp_replace(redact(F.col("text")), r"\s+", " "))
    preview = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)
    return rows.select("id", preview.alias("preview"), age_label(F.col("timestamp"), now).alias("age"), "tier", quality_flags(now).alias("flags"))


def recalls_for(session_key: Column, agent: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether memories are recalled for a session: never below another one; a list of agents wins over those left out."""
    wanted = agent.isin(*include) if include else ~agent.isin("cron", *exclude)
    return ~F.coalesce(session_key, F.lit("")).contains(":subagent:") & F.coalesce(wanted, F.lit(not include))


def manual_layer(category: Column) -> Column:
    return F.when(category.isin("preference", "decision", "fact"), "durable").otherwise("working")
