"""Exact deduplication through an extendible-hash index, in DataFrame operations only.

1. Every text gets a 64-bit pseudo key. Distinct pseudo keys are counted per prefix, and the directory doubles from one
   slot until no bucket holds more than `capacity` of them, or until `max_depth` bits are used up. Buckets that never
   overflowed keep a shallow local depth and are shared by several slots. It is built from counts, never from keys on the
   driver, and has 2**max_depth slots at most, so it may be broadcast.
2. Insertion: a row finds its bucket through its slot. Inside a bucket equal texts meet: rows are grouped by bucket,
   pseudo key and text, which compares bytes. Map tasks combine their own copies first, so a text that fills a third of the
   table leaves one row per task.
3. Owner tasks take ranges of buckets. There, texts that share a pseudo key but differ get places in a collision chain, and
   the entries (bucket, pseudo key, chain place, digest, representative, group size) go to the shared folder.
4. Lookup: a document goes by slot to a bucket, by pseudo key to a chain and by digest to its entry. Entries are one row per
   distinct text and both sides are plain shuffles, so adaptive execution splits a hot key.

Two different texts with the same pseudo key and the same SHA-256 would be told apart in step 2 and
stop the job in step 3 (`raise_error`) rather than be merged.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, text_or_empty

MAX_DEPTH = 16  # 65,536 slots
CAPACITY = 4096


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The only columns the operator touches, under its own names, so clashing extra columns do no harm."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("pseudo_key"), F.sha2(text.cast("binary"), 256).alias("sha")
    )


def _prefix(key, depth: int):
    """The top `depth` bits of a pseudo key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(entries: DataFrame, capacity: int | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Slots of the directory: (slot, global_depth, bucket, local_depth) of a table of distinct pseudo keys.

    A bucket is named by its local depth and prefix. A prefix becomes a bucket at the first depth at
    which it holds no more than `capacity` entries; overfull ones split, which doubles the directory. By default the
    capacity is 4,096, or what spreads the keys over 4,096 buckets if that is more, so depth follows the number of keys.
    At most 2**max_depth slots exist, whatever the input. An empty input has one bucket of depth 0.
    """
    n_keys = entries.count()
    capacity = capacity or max(CAPACITY, math.ceil(n_keys / 4096))
    # four bits more than an even spread needs: what is overfull there still splits no further
    max_depth = min(max_depth, math.ceil(math.log2(max(n_keys / capacity, 1))) + 4)
    counts = entries.groupBy(_prefix(F.col("pseudo_key"), max_depth).alias("fine")).agg(F.count("*").alias("n"))
    depths = F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")
    shift = (F.lit(max_depth) - F.col("depth")).cast("int")
    levels = (
        counts.select("fine", "n", depths)
        .select("depth", F.call_function("shiftrightunsigned", "fine", shift).alias("prefix"), "n")
        .groupBy("depth", "prefix")
        .agg(F.sum("n").alias("n"))
    )
    over = levels.where((F.col("n") > capacity) & (F.col("depth") < max_depth))
    # children of overfull prefixes, empty ones included, plus the root
    children = over.select(
        (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
    ).unionByName(entries.sparkSession.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")))
    leaves = children.join(over.select("depth", "prefix"), ["depth", "prefix"], "left_anti")
    top = over.agg(F.coalesce(F.max("depth") + 1, F.lit(0)).alias("global_depth"))
    spread = (F.col("global_depth") - F.col("depth")).cast("int")
    width = F.call_function("shiftleft", F.lit(1).cast("long"), spread)
    first = F.col("prefix") * width
    return leaves.crossJoin(F.broadcast(top)).select(  # top is one row
        F.explode(F.sequence(first, first + width - 1)).alias("slot"),
        "global_depth",
        F.format_string("%d:%d", "depth", "prefix").alias("bucket"),
        F.col("depth").alias("local_depth"),
    )


def _routed(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """Rows with the bucket that their pseudo key's slot points to; a key whose slot is missing goes nowhere."""
    depth = directory.agg(F.max("global_depth")).first()[0]
    slots = directory.select("slot", "bucket", "local_depth")
    return rows.withColumn("slot", _prefix(F.col("pseudo_key"), depth)).join(F.broadcast(slots), "slot")  # 2**max_depth rows at most


def build_index(docs: DataFrame, directory: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One entry per distinct text, in the shared folder, owned by bucket range.

    Columns: bucket, local_depth, pseudo_key, chain, sha, keep_id, group_size. Null texts are empty.
    The representative is the largest id; ids that are null lose against any other.
    """
    inserted = (
        _routed(_keyed(docs, id_col, text_col), directory)
        .groupBy("bucket", "local_depth", "pseudo_key", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("bucket", "local_depth", "pseudo_key", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "keep_id", "group_size")
    )
    groups = materialize(inserted, "dedup-groups")
    chain = Window.partitionBy("bucket", "pseudo_key").orderBy("sha")  # in the owner task: no further shuffle
    twins = F.lag("sha").over(chain) == F.col("sha")
    entries = (
        groups.repartitionByRange("bucket")
        .withColumn("chain", F.row_number().over(chain) - 1)
        .withColumn("sha", F.when(twins, F.raise_error(F.lit("two texts share pseudo key and digest"))).otherwise(F.col("sha")))
        .select("bucket", "local_depth", "pseudo_key", "chain", "sha", "keep_id", "group_size")
    )
    index = materialize(entries, "dedup-index")
    discard(groups)
    return index


def look_up(docs: DataFrame, directory: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with their entries: slot, bucket, pseudo key, then the chain's digests. What the index does not hold is not returned."""
    rows = _routed(_keyed(docs, id_col, text_col).select("doc_id", "pseudo_key", "sha"), directory)
    return rows.select("doc_id", "bucket", "pseudo_key", "sha").join(index.drop("local_depth"), ["bucket", "pseudo_key", "sha"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when identical byte for byte; null counts as empty, and empty texts are one group.
    The largest id of a group stays. Rows that repeat both id and text each count in group_size and
    are all marked kept if they hold the largest id. An empty table gives no rows. Other columns of
    the input are neither read nor returned.
    """
    keys = materialize(_keyed(docs, id_col, text_col).select("pseudo_key").distinct(), "dedup-keys")
    directory = materialize(build_directory(keys, capacity, max_depth), "dedup-directory")
    discard(keys)
    index = build_index(docs, directory, id_col, text_col)
    return look_up(docs, directory, index, id_col, text_col).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "bucket",
        "chain",
    )
