"""Vectors as rows: which take part, bytes for shuffles, matrices inside tasks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def taking_part(vectors: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(vec_id, v, more...) of the rows with an id, a vector and only finite components; v is an array of doubles."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    v = F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *more).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))


def shape(rows: DataFrame) -> tuple[int, int]:
    """How many rows have the usual length of a vector (the commonest one, of several the longest), and that length."""
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (usual["count"], usual["d"]) if usual else (0, 0)


def matrix(column, dtype: str, d: int) -> np.ndarray:
    """Rows of a column of bytes as a matrix."""
    return np.frombuffer(b"".join(column), dtype).reshape(-1, d)


def packed(m: np.ndarray, dtype: str) -> list[bytes]:
    """The rows of a matrix as bytes."""
    m = np.ascontiguousarray(m, dtype)
    raw, step = m.tobytes(), m.shape[1] * m.itemsize
    return [raw[i : i + step] for i in range(0, len(raw), step)] if step else [b""] * len(m)


def first_of_each(owner: np.ndarray, n: int) -> np.ndarray:
    """Of rows sorted by owner: a mask of the first n rows of every owner."""
    at = np.arange(len(owner))
    begins = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(begins, at, 0)) < n
