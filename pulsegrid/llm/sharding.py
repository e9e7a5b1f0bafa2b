"""Contiguous shards of nearly equal byte size from global prefix sums.

Only (key, size, checksum) rows are shuffled, never texts. Rows are range partitioned by key; each
partition sums its own sizes, the totals (one row per partition) become partition offsets, and a
row's global prefix is its offset plus its local running sum. Equal targets of the grand total then
cut the sequence into shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship


def _local_prefix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running size and position inside one sorted partition, batch by batch."""
    from pyspark import TaskContext

    part, size, n = TaskContext.get().partitionId(), 0, 0
    for f in frames:
        done = f["size"].cumsum() + size
        out = f[["doc_id", "size", "text_crc32"]].assign(part=part, before=done - f["size"], row=range(n, n + len(f)))
        if len(f):
            size, n = int(done.iloc[-1]), n + len(f)
        yield out


def shard_by_bytes(
    docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, partitions: int | None = None
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Shards follow the order of ids (nulls first; ties by size, checksum) and a row belongs to the shard in whose
    target range the middle of its byte range lies, so a shard misses its target by one text at most.
    size is the UTF-8 length plus `overhead`, a null text having no bytes; its checksum is that of
    the empty text. slot counts from 0 in each shard. Repeated rows get slots of their own; an empty table
    gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text).alias("text_crc32")
    )
    keys = ["doc_id", "size", "text_crc32"]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    schema = "doc_id long, size long, text_crc32 long, part int, before long, row long"
    local = materialize(dealt.sortWithinPartitions(*keys).mapInPandas(_local_prefix, schema), "shard-prefix")
    # one row per partition: bounded by the number of partitions, not by the data
    totals = local.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = materialize(
        totals.select(
            "part",
            F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("byte_offset"),
            F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("row_offset"),
            F.sum("bytes").over(every).alias("total"),
        ),
        "shard-offsets",
    )
    placed = local.join(F.broadcast(offsets), "part").select(
        *keys,
        F.least(F.expr(f"({n_shards}L * ((before + byte_offset) * 2 + size)) div (total * 2)"), F.lit(n_shards - 1)).cast("int").alias("shard"),
        (F.col("row") + F.col("row_offset")).alias("position"),
    )
    starts = placed.groupBy("shard").agg(F.min("position").alias("start"))  # n_shards rows
    return placed.join(F.broadcast(starts), "shard").select(
        *keys,
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("position") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
