"""Intermediate tables in the folder that a cluster shares, and their deletion.

A table that is written once is computed once, whatever reads it, and its size is known to the planner. Every table belongs to
the innermost open `scope()` and is deleted when that closes; outside of any scope, when the process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_scopes: list[list[tuple[SparkSession, str]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="pulsegrid-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh name in the shared folder, owned by the innermost scope."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _scopes[-1].append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives executors, is computed once."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """What is written inside is deleted at the end: frames that read it must be finished (written, counted, collected) by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            delete(spark, path)


@atexit.register
def _sweep() -> None:
    for spark, path in _scopes[0]:
        with contextlib.suppress(Exception):  # the session may have ended before
            delete(spark, path)
