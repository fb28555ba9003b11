"""Integer vectors of the embeddings table and exact squared distances between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A component's largest magnitude as an integer: squared distances of up to 64 components then fit a long.
MOST = 1 << 27
#: Up to this magnitude (and 256 components), products of vectors are exact in doubles.
EXACT = 1 << 21
ROWS = 4096


def whole(df: DataFrame, scale: int, label: bool = False) -> DataFrame:
    """(vec_id, [label,] parts array<int>) of the rows whose vector is there with no null or non-finite component; x becomes
    floor(scale * x), x as double. A row with a component beyond MOST is left out like a non-finite one: its distances fit no long."""
    x = F.col("embedding").cast("array<double>")
    kept = df.where(F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) <= F.lit(MOST / scale))))
    parts = F.transform(x, lambda v: F.floor(v * scale).try_cast("int")).alias("parts")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), *[F.col("label")] * label, parts)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width as int64."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """All squared distances of rows to entries, exactly, as int64."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        inner = a @ b.T  # whole numbers below 2**53
        return (x * x).sum(axis=1)[:, None] + (entries * entries).sum(axis=1)[None, :] - 2 * inner.astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - entries[None, :, k]
        out += d * d
    return out


def own_squared(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distance of each row to its own partner."""
    d = x - to
    return (d * d).sum(axis=1)
