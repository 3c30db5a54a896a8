"""What the vector searches share: valid vectors, cells of a grid, and the best rows of each query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame) -> DataFrame:
    """vec_id and vector of the rows whose vector is neither null nor holds null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(~bad)


def matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """A list column as rows of a matrix; shorter vectors are filled up with zeros."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    for i, n in enumerate(sizes):
        out[i, :n] = flat[offsets[i] : offsets[i] + n]
    return out


def integers(x: np.ndarray, scale: int, exact: int) -> np.ndarray:
    """floor(scale * x), ``scale`` a power of two; as Python integers if any is as large as ``exact``."""
    with np.errstate(over="ignore"):
        whole = np.floor(x * scale)  # exact unless infinite, as such a product only moves the exponent
    if np.abs(whole).max(initial=0) < exact:
        return whole.astype(np.int64)
    out = [int(w) if np.isfinite(w) else int(v) * scale for v, w in zip(x.ravel().tolist(), whole.ravel().tolist(), strict=True)]
    return np.array(out, dtype=object).reshape(x.shape)


def best_rows(found: DataFrame, k: int, salt: str, *more: str) -> DataFrame:
    """The k best rows (query_id, vec_id, score) of each query, in two steps so that no task gets all of a query's.

    Columns named in ``more`` decide among equal scores, larger first.
    """
    order = [F.col("score").desc(), *[F.col(c).desc() for c in more], F.col("vec_id").asc()]
    part = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", salt).orderBy(*order))).filter(F.col("rank") <= k)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
