"""Arrow batches -> numpy blocks for per-task numeric work.

The feature vector ``x`` is an ``array<double>`` of the same length on every
row.  Its Arrow values buffer is already a row-major (rows x p) matrix, so
flattening the list column and reshaping it gives the block without building
one Python object per row (``np.vstack`` over a pandas column of arrays
does).  Used by ``mapInArrow`` tasks: the Gram partials and every boosting
pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def x_block(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """(rows, p) float64 matrix from a list<double> column of equal lengths."""
    col = batch.column(name)
    n = batch.num_rows
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n == 0:
        return flat.reshape(0, 0)
    p, rest = divmod(flat.size, n)
    if rest:
        raise ValueError("feature arrays differ in length")
    return flat.reshape(n, p)


def by_group(batches: Iterator[pa.RecordBatch], scalars: list[str]) -> Iterator[tuple[int, pd.DataFrame]]:
    """For every batch and fit group ``g`` in it: the group's scalar columns
    as a small DataFrame whose ``attrs['X']`` holds its feature block."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = x_block(batch)
        pdf = pa.Table.from_batches([batch.select(scalars)]).to_pandas()
        g = pdf["g"].to_numpy()
        for gv in np.unique(g):
            mask = g == gv
            part = pdf[mask].reset_index(drop=True)
            part.attrs["X"] = x[mask]
            yield int(gv), part


def to_batch(df: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(df, schema=schema, preserve_index=False)
