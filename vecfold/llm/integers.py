"""Vectors as exact integers: components times a scale, rounded down.

Products of such vectors are summed in 64 bits, which is exact while a component stays within
``LIMIT``. A vector with a larger one is refused, since its distances and scores fit no long.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 26


def usable(vector: str, dimensions: int | None = None) -> Column:
    """True for vectors without null, NaN or infinite components (and with ``dimensions`` of them, if given)."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    known = F.col(vector).isNotNull() & finite
    return F.coalesce(known if dimensions is None else known & (F.size(vector) == dimensions), F.lit(False))


def lists(matrix: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column."""
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column of ``width`` integers a row as a 64-bit matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(len(column), width)


def scaled(rows: DataFrame, vector: str, scale: int, others: dict[str, Column]) -> DataFrame:
    """The columns ``others`` and ``x``: floor(scale * component), the component taken as a double."""
    given = rows.select(*[c.alias(name) for name, c in others.items()], F.col(vector).cast("array<double>").alias("x"))
    names = list(others)

    def per_batch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            column = batch.column("x")
            values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
            if values.size and np.abs(values).max() > LIMIT:
                raise ValueError(f"a component exceeds {LIMIT} after scaling by {scale}")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int32)
            x = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], x], [*names, "x"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields if f.name != "x")
    return given.mapInArrow(per_batch, f"{kinds}, x array<int>")
