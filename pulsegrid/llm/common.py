"""Shared helpers: tables in the cluster's shared folder, code for the executors, null-safe inputs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete, written

#: Write a narrow intermediate table to the shared folder and read it back. It goes with its scope, or by discard() before.
materialize = written


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more (frames derived from them are passed over)."""
    for t in tables:
        if path := getattr(t, "_folder", None):
            delete(t.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a session, for the tasks that run Python, and keep their batches small.

    Arrow batches default to 10,000 rows, which may be gigabytes of text: unless the session says otherwise they are
    bounded by 1,000 rows and 8 MB.
    """
    context = spark.sparkContext
    for name, usual, ours in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "8m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", ours)
    if getattr(context, "_pulsegrid_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="pulsegrid-code-")) / "pulsegrid_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    context.addPyFile(str(target))
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    context._pulsegrid_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_bucket(name: str, n: int) -> Column:
    """crc32 of the decimal text of a key, modulo n (null keys count as the empty text)."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


def maybe_among(rows: DataFrame, ids: DataFrame, key: str, bits: int = 25) -> DataFrame:
    """The rows whose key is among the ids, and a few others: no shuffle of the rows.

    The ids' hashes become one bitmap of 2**bits bits in pieces of 4 KB, so what is broadcast is 4 MB at most, at any size.
    The share of others is the share of set bits. Follow with an exact inner join (a semi join would be planned before
    this filter); rows with a null key go.
    """

    def places(name: str):
        spot = F.pmod(F.xxhash64(name), F.lit(1 << bits))
        return F.shiftright(spot, 15).alias("_piece"), spot.bitwiseAND(F.lit(32767)).alias("_bit")

    pieces = ids.where(F.col(key).isNotNull()).select(*places(key)).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    placed = rows.where(F.col(key).isNotNull()).select("*", *places(key))
    byte = F.conv(F.hex(F.substring("_bitmap", (F.shiftright("_bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    hit = F.getbit(byte, F.col("_bit").bitwiseAND(F.lit(7)).cast("int")) == 1
    return placed.join(F.broadcast(pieces), "_piece").where(hit).select(*rows.columns)


def digest(name: str) -> Column:
    """SHA-256 of a text in lowercase hex; null counts as empty."""
    return F.sha2(text_or_empty(name).cast("binary"), 256)


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not among dropped (doc_id, text_sha256): id and text both decide, so other texts of an id stay.

    Rows without an id stay. dropped should be a written table: then Spark knows its size when it plans the join.
    """
    gone = dropped.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_dropped_id"), F.col("text_sha256").alias("_dropped_text")).distinct()
    same = (docs[id_col].cast("long") == gone["_dropped_id"]) & (F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary"), 256) == gone["_dropped_text"])
    return docs.join(gone, same, "left_anti")
