"""Operators whose result depends on the order of the rows: each runs over small, bounded groups.

A group is one result list, one batch of candidates or one session; none of them
grows with the table.  Clusters by seeds, which run over whole scopes, take the
pairs from a distributed join instead of gathering a scope in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.batches import borders, column, whole_groups
from quern.session import partitions


def _units(vectors: Iterable) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for v in vectors:
        v = None if v is None else np.asarray(v, dtype=np.float64)
        norm = 0.0 if v is None or not len(v) else float(np.linalg.norm(v))
        out.append(v / norm if norm > 0 and np.isfinite(norm) else None)
    return out


def diversify(results: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Results (qid, id, score, vector) reordered: those too like an earlier one go to the end. Adds ``place``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        units, taken, kept, late = _units(pdf["vector"]), [], [], []
        for i, u in enumerate(units):
            if u is not None and any(len(units[j]) == len(u) and float(units[j] @ u) > threshold for j in taken):
                late.append(i)
            else:
                kept.append(i)
                if u is not None:
                    taken.append(i)
        out = pdf.iloc[kept + late][["qid", "id", "score"]].copy()
        out["place"] = np.arange(1, len(out) + 1)
        return out

    kind = dict(results.dtypes)["qid"]
    return results.select("qid", "id", "score", "vector").groupBy("qid").applyInPandas(run, f"qid {kind}, id string, score double, place bigint")


def batch_dedup(candidates: DataFrame, threshold: float = 0.85) -> DataFrame:
    """cand_id, batch_id, duplicate_of of candidates that repeat an earlier one of their batch.

    Whole batches are handed over many at a time; in one, the candidates are walked
    in order: those too like one that is kept go with the first such, others are kept.
    """
    w = Window.partitionBy("cand_id").orderBy("created_at", "index")
    once = candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1 and batch_id is not null and cand_id is not null").select("batch_id", "index", "cand_id", F.col("vector").cast("array<double>").alias("vector"))
    schema = pa.schema([("batch_id", pa.int64()), ("cand_id", pa.string()), ("duplicate_of", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "batch_id"):
            of = column(t, "batch_id")
            edge = borders(of)
            ids, units = t.column("cand_id").to_pylist(), _units(t.column("vector").to_pylist())
            out: list[tuple[int, str, str]] = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                kept: dict[int, tuple[list[int], list[np.ndarray]]] = {}
                for i in range(a, b):
                    if units[i] is None:
                        continue
                    names, vectors = kept.setdefault(len(units[i]), ([], []))
                    near = np.flatnonzero(np.array(vectors) @ units[i] > threshold) if vectors else ()
                    if len(near):
                        out.append((int(of[i]), ids[i], ids[names[near[0]]]))
                    else:
                        names.append(i), vectors.append(units[i])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    sorted_rows = once.select(F.col("batch_id").cast("bigint").alias("batch_id"), "index", "cand_id", "vector").repartition(partitions(candidates), "batch_id").sortWithinPartitions("batch_id", "index", "cand_id")
    return sorted_rows.mapInArrow(run, "batch_id bigint, cand_id string, duplicate_of string")


def within_budget(lines: DataFrame, most_items: int, most_chars: int) -> DataFrame:
    """Lines (qid, place, id, prefix, summary) that fit a budget of characters, the last one cut."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = 0, []
        for r in pdf.sort_values("place").itertuples():
            if len(out) >= most_items:
                break
            gap = 1 if out else 0
            left = most_chars - used - gap
            if left <= 0:
                break
            line = r.prefix + r.summary
            if len(line) <= left:
                out.append((r.qid, r.id, line))
                used += gap + len(line)
                continue
            short = r.summary[: max(0, left - len(r.prefix))].strip() if left > len(r.prefix) else ""
            if not short:
                continue
            out.append((r.qid, r.id, r.prefix + short))
            break
        return pd.DataFrame(out, columns=["qid", "id", "line"])

    kind = dict(lines.dtypes)["qid"]
    return lines.groupBy("qid").applyInPandas(run, f"qid {kind}, id string, line string")


def compress_session(lines: DataFrame, most_chars: int, least_texts: int = 3, least_score: float = 0.3) -> DataFrame:
    """Lines (session, pos, text, score, reason) that stay within a budget: first, last, then the best."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        size, n = [len(t) for t in pdf["text"]], len(pdf)
        taken: set[int] = set(range(n)) if sum(size) <= most_chars else set()
        used = 0

        def take(i: int) -> bool:
            nonlocal used
            if i in taken or not 0 <= i < n or used + size[i] > most_chars:
                return False
            taken.add(i)
            used += size[i]
            return True

        if not taken:
            take(0)
            take(n - 1)
            partner: dict[int, int] = {}
            for i, reason in enumerate(pdf["reason"]):
                if reason == "tool_call" and i + 1 < n and i not in partner and i + 1 not in partner:
                    partner[i], partner[i + 1] = i + 1, i
            for i in sorted(range(1, n - 1), key=lambda i: (-pdf["score"][i], i)):
                if used >= most_chars:
                    break
                if take(i) and i in partner:
                    take(partner[i])
            if (pdf["score"] < least_score).all():
                for i in range(n - 1, -1, -1):
                    if len(taken) >= min(least_texts, n):
                        break
                    take(i)
        return pdf.iloc[sorted(taken)][["session", "pos"]]

    return lines.groupBy("session").applyInPandas(run, "session string, pos bigint")


def chunks(documents: DataFrame, size: int = 1000, overlap: int = 100, least: int = 200) -> DataFrame:
    """doc_id, chunk, start, stop, text of overlapping chunks cut at sentence, line or word ends."""
    import re

    end = re.compile(r"[.!?。！？]\s*")

    def cut(text: str) -> Iterator[tuple[int, int]]:
        at, n = 0, len(text)
        while at < n:
            stop = min(n, at + size)
            if stop < n:
                part = text[at + least : stop]
                ends = [m.end() for m in end.finditer(part)]
                for back in (ends[-1] if ends else 0, part.rfind("\n") + 1, part.rfind(" ") + 1):
                    if back > 0:
                        stop = at + least + back
                        break
            yield at, stop
            if stop >= n:
                return
            at = max(at + 1, stop - overlap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.doc_id, i, a, b, r.text[a:b]) for r in pdf.itertuples() if r.text for i, (a, b) in enumerate(cut(r.text))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "stop", "text"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.where("text is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, chunk bigint, start bigint, stop bigint, text string")


def embed(rows: DataFrame, text_col: str, embedder: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Adds ``vector`` by any function from texts to vectors; the default needs no service."""
    made = embedder or deterministic_vectors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pdf["vector"] = made([x or "" for x in pdf[text_col]])
            yield pdf

    return rows.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "vector") + ", vector array<double>")


def deterministic_vectors(texts: list[str], dims: int = 8) -> list[list[float]]:
    """Unit vectors from character codes, for tests and runs without a model."""
    out = []
    for text in texts:
        v = np.zeros(dims)
        for i, c in enumerate(text):
            v[i % dims] += (ord(c) % 23 - 11) / 11
        norm = np.linalg.norm(v)
        out.append((v / norm if norm > 0 else v).tolist())
    return out
