"""Groups of rows from Arrow batches that come sorted by their first columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, dict[str, pa.Array]]]:
    """(key, columns by name) of each group of two rows or more; holds one group and one batch at a time."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = [held.column(i).to_numpy() for i in range(n_keys)]
        new = np.zeros(held.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        held = held.combine_chunks()
        yield from _cut(held, keys, np.r_[0, starts])
        held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        held = held.combine_chunks()
        yield from _cut(held, [held.column(i).to_numpy() for i in range(n_keys)], np.array([0, held.num_rows]))


def _cut(table: pa.Table, keys: list[np.ndarray], bounds: np.ndarray) -> Iterator[tuple[tuple, dict[str, pa.Array]]]:
    columns = {name: table.column(name).chunk(0) for name in table.column_names}
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s > 1:
            yield tuple(k[s] for k in keys), {name: c.slice(s, e - s) for name, c in columns.items()}
