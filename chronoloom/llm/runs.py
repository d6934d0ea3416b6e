"""Groups of rows that Spark has sorted by a key, as whole runs in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold every row of each of their keys, and offsets of the keys' runs;
    a run that goes on in the next batch waits for it."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        starts = _starts(held, keys)
        if len(starts) > 1:
            yield held.slice(0, int(starts[-1])).combine_chunks(), starts
            held = held.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.append(_starts(held, keys), held.num_rows)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def run_pairs(at: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of rows of a run, i < j, about ``limit`` of them at a time."""
    size = np.diff(at)
    after = np.repeat(at[1:], size) - np.arange(at[0], at[-1]) - 1  # partners behind each row
    total = np.cumsum(after)
    i = 0
    while i < len(after):
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + limit, side="right")))
        n = after[i:j]
        left = np.repeat(np.arange(i, j), n) + at[0]
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        if len(left):
            yield left, right
        i = j
