"""Arrow batches cut at group borders, for ``mapInArrow`` over sorted partitions.

``applyInPandas`` starts pandas once per group, about a millisecond each; with
hundreds of thousands of small groups that is most of the run.  These helpers
hand over many whole groups at once, so the work inside can be vectorised.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def column(table: pa.Table, name: str) -> np.ndarray:
    """A column without nulls as a numpy array."""
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def borders(values: np.ndarray) -> np.ndarray:
    """Start offsets of the runs of equal values, and the total length last."""
    n = len(values)
    if not n:
        return np.zeros(1, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [n]))


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, least_rows: int = 65_536) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key`` (which has no nulls).

    Each table has at least ``least_rows`` rows, unless it is the last one.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key)
        last = keys[rows - 1].as_py()
        tail = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        at = int(np.argmax(tail == last))
        cut = rows - batch.num_rows + at
        if at == 0 and (cut == 0 or keys[cut - 1].as_py() == last):
            continue  # the group began in an earlier batch: wait for its end
        yield whole.slice(0, cut)
        held = whole.slice(cut).combine_chunks().to_batches()
        rows -= cut
    if rows:
        yield pa.Table.from_batches(held)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... of counts[i] numbers each, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return first + np.arange(total)
