"""What the two embedding operators share: which vectors count, and columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINITE = "x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector that is finite and not zero."""
    v = f"`{vector_column}`"
    return vectors.where(
        f"`{id_column}` IS NOT NULL AND {v} IS NOT NULL AND forall({v}, x -> {FINITE}) "
        f"AND exists({v}, x -> x <> 0)"
    ).select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
