"""What the operators on embeddings share: which vectors count, as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: str = "embedding") -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of doubles; shorter ones are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.flatten(), float)
    sizes = np.diff(offsets)
    width = dim or (int(sizes.max()) if len(sizes) else 0)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = place < width
    out[row[fits], place[fits]] = flat[fits]
    return out


def sample(df: DataFrame, most: int, seed: int = 3) -> np.ndarray:
    """At most ``most`` vectors, those that sort first by a hash of their values: the bounded sample that models are fitted on."""
    rows = df.select("embedding").orderBy(F.xxhash64(F.lit(seed), "embedding")).limit(most).toArrow()
    return matrix(rows.column(0)) if rows.num_rows else np.zeros((0, 0))
