"""Sorted Arrow batches as runs of equal keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LEAST_ROWS = 4096


def whole_runs(batches, names: tuple[str, ...], least: int = _LEAST_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches that hold whole runs of equal keys (rows come sorted by them); small ones are put together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = starts(batch, names)
        if held:
            new[0] = any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in names)
        last = np.flatnonzero(new)
        if len(last) and (int(last[-1]) + sum(b.num_rows for b in held)) >= least:
            cut = int(last[-1])
            done = held + ([batch.slice(0, cut)] if cut else [])
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def starts(batch, names: tuple[str, ...]) -> np.ndarray:
    """Where a key differs from the row before; not at the first row."""
    new = np.zeros(batch.num_rows, bool)
    for c in names:
        x = np.asarray(batch.column(c))
        new[1:] |= x[1:] != x[:-1]
    return new


def numbers(batch, names: tuple[str, ...]) -> np.ndarray:
    """The number of each row's run."""
    return np.cumsum(starts(batch, names))
