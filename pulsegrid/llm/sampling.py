"""Bounded, repeatable samples for fitting classifiers, and distributed lookups of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_share(key: str):
    """A number from 0 to 1 that depends on the key alone."""
    return (F.xxhash64(key).cast("double") / 2.0**64) + 0.5


def bounded_sample(keys: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows whose hashed keys are smallest, nearly always: the same rows for the same table, at most n at any size.

    A share of the hash range that holds 1.5 n rows on average is cut off before the sort, so that tasks send no more.
    """
    keys = keys.where(F.col(key).isNotNull())
    share = 1.5 * n / max(keys.count(), 1)
    return (keys.where(hash_share(key) < share) if share < 1 else keys).orderBy(F.xxhash64(key), key).limit(n)


def sample_per_group(keys: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """At most n distinct keys of every group, with the smallest hashes of the group; the columns are group and key.

    Groups are cut to a share of the hash range that holds 1.5 n keys on average before they are numbered.
    """
    keys = keys.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(group, key).distinct()
    sizes = keys.groupBy(group).agg(F.count("*").alias("_size"))
    near = keys.join(sizes, group).where(hash_share(key) < 1.5 * n / F.col("_size"))
    number = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(key), key))
    return near.select(group, key, number.alias("_number")).where(F.col("_number") <= n).select(group, key)
