"""A stored dimension of first sights: keys over many loads, the smallest sequence wins.

A load appends only what it changes: keys that are new, and keys that it saw earlier than what is stored. Of equal sequences the row that
is first by further columns wins, in whatever order the loads come. Loads have numbers and are published through a commit log, so a load that is repeated, also after an interruption, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import first_seen
from ..streaming.commits import CommitLog, committed, read_committed


class StoredDimension:
    """Rows by key under a folder. sequence: the column that says what came first, in the data or at ingestion; ties: columns that decide between equal ones."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, sequence: str, ties: tuple[str, ...] = ()):
        self.spark, self.root, self.schema, self.key, self.sequence = spark, root, schema, key, sequence
        self.columns = spark.createDataFrame([], schema).columns
        self.order = [sequence, *ties]
        self.place = [*self.order, *[c for c in self.columns if c != key and c not in self.order]]

    def read(self) -> DataFrame:
        """One row per key: the first by sequence; of equal sequences the first by ties, then the row that is smallest."""
        return first_seen(read_committed(self.spark, self.root, self.schema).select(*self.columns), self.key, self.order)

    def load(self, rows: DataFrame, number: int) -> None:
        """Take the rows of a load. Null keys and null sequences take no part; a number that was loaded before is passed over."""
        if number in CommitLog(self.spark, self.root).entries():
            return
        new = first_seen(rows.select(*self.columns).where(F.col(self.sequence).isNotNull()), self.key, self.order)
        known = read_committed(self.spark, self.root, self.schema).groupBy(F.col(self.key).alias("_key")).agg(F.min(F.struct(*self.place)).alias("_known"))
        changed = new.join(known, F.col(self.key) == F.col("_key"), "left").where(F.col("_known").isNull() | (F.struct(*self.place) < F.col("_known")))
        committed(self.root)(changed.select(*self.columns), number)


def new_in_year(first: DataFrame, year: int, key: str, at: str) -> DataFrame:
    """key, first_at of the keys whose first sight over all loaded years lies in the year."""
    return first.where(F.year(at) == year).select(key, F.col(at).alias("first_at"))
