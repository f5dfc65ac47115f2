"""Sorted rows of one task as groups, without a pandas frame for each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Each run of equal ``keys`` (without nulls) as a table. A run may cross batches; only the run
    that is not over yet is kept."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in cols) != last
        starts = np.flatnonzero(change).tolist()
        begin = 0
        for s in starts:
            if s > begin:
                held.append(batch.slice(begin, s - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], s
        held.append(batch.slice(begin))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def rows_of_bytes(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long binary values as the rows of a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def rows_of_lists(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long lists as the rows of a matrix."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1)
