"""Clean vectors, and blocks of them that travel as one row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite and not null, not all zero."""
    x = F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)


def vector_type(df: DataFrame, vector: str) -> str:
    """The array type that keeps a column's precision: floats stay floats, all else is double."""
    kind = df.schema[vector].dataType
    return "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"


def matrix(data: bytes, rows: int, dim: int) -> np.ndarray:
    """The vectors whose components data holds, single or double as its length says."""
    return np.frombuffer(data, dtype=np.float32 if len(data) == 4 * rows * dim else np.float64).reshape(rows, dim)


def distinct(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vector, n): each distinct usable vector once, with its least id and how many rows have it.

    Rows with a null id, and vectors of another length than most have, take no part in a search of theirs: lengths are
    kept apart by the column dim.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(vector_type(df, vector)).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    return rows.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "vector", "n", F.size("vector").alias("dim"))


def pack(batches, fields: dict[str, str]) -> dict[str, np.ndarray]:
    """NumPy arrays of an Arrow table's columns; a list column becomes a matrix."""
    out = {}
    for name, kind in fields.items():
        column = batches.column(name).combine_chunks()
        if kind == "matrix":
            flat = column.flatten().to_numpy(zero_copy_only=False)
            out[name] = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision and then rounded; safe for very large and very small components."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)
    return (y / np.sqrt((y * y).sum(axis=1, keepdims=True))).astype(np.float32)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosines in double precision."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
