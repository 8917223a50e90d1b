"""Embeddings as vectors of whole numbers, which the exact operators on vectors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a vector entry.
SCALE = 256


def usable(vector: str = "embedding") -> Column:
    """True where the vector is there and all of its entries are finite numbers."""
    fine = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double"))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def whole_numbers(df: DataFrame, *columns: str, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """columns and x, array<bigint>: floor(scale * entry) of the usable rows. A vector that is shorter than the table's longest is
    filled with zeros."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)))
    rows = df.where(usable(vector)).select(*columns, x.alias("x"))
    least, most = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))))
    return rows


def grid(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix of int64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def grids(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, grid(batch.column(column))
