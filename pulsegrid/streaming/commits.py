"""A log of committed batches: what a stream has written counts once its batch is in the log.

A batch is written to a folder of its own attempt, and one small file in the log then names that folder: the file appears
whole, by a rename. A run that dies before leaves a folder that no entry names, one that dies after finds its entry when
the batch comes again. Readers take only folders that the log names. Every `FOLD`th entry repeats the earlier ones, so
a reader opens a bounded number of files, however long the stream runs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLD = 50
#: Called with the batch and "written" or "committed": tests and drills raise here.
Between = Callable[[int, str], None]


class CommitLog:
    """Entries (a small dict per batch) in root/_log. One writer at a time: the stream's driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _list(self, path: str) -> list[str]:
        p = self._path(path)
        return [x.getPath().getName() for x in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def entries(self) -> dict[int, dict]:
        batches = sorted(int(n.removesuffix(".json")) for n in self._list(f"{self.root}/_log") if n.endswith(".json"))
        last = max((b for b in batches if b % FOLD == 0), default=-1)
        out: dict[int, dict] = {}
        for b in batches:
            if b >= last:
                at = self._fs.open(self._path(f"{self.root}/_log/{b}.json"))
                try:
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8")
                finally:
                    at.close()
                out |= {int(k): v for k, v in json.loads(text).items()}
        return out

    def commit(self, batch: int, entry: dict) -> None:
        """Publish a batch; one that is there already stays as it is."""
        done = self.entries()
        if batch in done:
            return
        named = (done if batch % FOLD == 0 else {}) | {batch: entry}
        draft, final = self._path(f"{self.root}/_log/.{uuid.uuid4().hex}"), self._path(f"{self.root}/_log/{batch}.json")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps({str(k): v for k, v in named.items()}).encode()))
        finally:
            out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"batch {batch} could not be committed")

    def folders(self) -> list[str]:
        return [f"{self.root}/data/batch={b}/attempt={e['attempt']}" for b, e in sorted(self.entries().items())]

    def sweep(self) -> int:
        """Delete the folders of attempts that no entry names; how many there were. Not while a stream writes."""
        named, gone = {f.removeprefix(f"{self.root}/data/") for f in self.folders()}, 0
        for b in self._list(f"{self.root}/data"):
            for a in self._list(f"{self.root}/data/{b}"):
                if f"{b}/{a}" not in named:
                    self._fs.delete(self._path(f"{self.root}/data/{b}/{a}"), True)
                    gone += 1
        return gone


def committed(root: str, shape: Callable[[DataFrame, dict[int, dict]], DataFrame] | None = None, note: Callable[[DataFrame], dict] | None = None, between: Between | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that writes a batch and then commits it. shape(rows, entries so far) may change the rows; note(written rows) adds to the entry."""

    def sink(df: DataFrame, batch: int) -> None:
        log = CommitLog(df.sparkSession, root)
        entries = log.entries()
        if batch in entries:
            return  # it was written and committed before the stream's own checkpoint knew
        attempt = uuid.uuid4().hex
        rows = shape(df, entries) if shape else df
        path = f"{log.root}/data/batch={batch}/attempt={attempt}"
        rows.write.parquet(path)
        if between:
            between(batch, "written")
        log.commit(batch, {"attempt": attempt} | (note(df.sparkSession.read.schema(rows.schema).parquet(path)) if note else {}))
        if between:
            between(batch, "committed")

    return sink


def read_committed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of all committed batches, with their batch; none where nothing is committed."""
    folders = CommitLog(spark, root).folders()
    if not folders:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("int"))
    full = f"{schema}, batch int, attempt string"
    return spark.read.schema(full).option("basePath", f"{root.rstrip('/')}/data").parquet(*folders).drop("attempt")
