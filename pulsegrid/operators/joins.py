"""Joins between activity tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_hygiene(health: DataFrame, hygiene: DataFrame, order: str | None = None) -> DataFrame:
    """Health rows with the hygiene score; of repeated hygiene rows the last by order (else the largest score) counts."""
    last = hygiene.groupBy("repo_id").agg(F.max_by("score", F.coalesce(F.col(order), F.lit(0)) if order else F.coalesce("score", F.lit(-1))).alias("score"))
    return health.join(last, "repo_id", "left")


def of_collected(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children whose parent was collected."""
    return children.join(parents.select(*keys).distinct(), keys, "left_semi")


ROWS_PER_TASK = 200_000


def file_presence(repos: DataFrame, paths: list[str], tree: DataFrame) -> DataFrame:
    """repo_id, path, exists, type, size: a row for each expected path of each repository.

    Repositories and entries meet in one grouping by repo_id. Its sort is a task's memory, so they are dealt over as many tasks as
    their rows ask for (an entry a path, at most, is expected of a repository), and not combined in scans, which would sort there too.
    """
    if not paths:
        return tree.select("repo_id", "path", F.lit(False).alias("exists"), "type", "size").where(F.lit(False))
    tasks = max(1, math.ceil(repos.count() * (1 + len(paths)) / ROWS_PER_TASK))
    absent = [F.lit(None).cast(tree.schema[c].dataType).alias(c) for c in ("path", "type", "size")]
    known = repos.select("repo_id", F.lit(True).alias("_known"), *absent)
    entries = tree.where(F.col("repo_id").isNotNull() & F.col("path").isin(*paths)).select("repo_id", F.lit(False).alias("_known"), "path", "type", "size")
    entry = lambda p: F.max(F.when(F.col("path") == p, F.struct("type", "size")))
    found = known.unionByName(entries).repartition(tasks, "repo_id").groupBy("repo_id").agg(F.bool_or("_known").alias("_known"), *[entry(p).alias(f"_e{i}") for i, p in enumerate(paths)])
    each = found.where("_known").select("repo_id", F.inline(F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"_e{i}").alias("e")) for i, p in enumerate(paths)])))
    return each.select("repo_id", "path", F.col("e").isNotNull().alias("exists"), F.col("e.type").alias("type"), F.col("e.size").alias("size"))


def workflow_files(tree: DataFrame, prefixes: list[str]) -> DataFrame:
    """repo_id, prefix, path of blobs under a prefix; under two prefixes a file appears twice."""
    under = F.array_compact(F.array(*[F.when(F.col("path").startswith(p), F.lit(p)) for p in prefixes]))
    return tree.where("type = 'blob'").select("repo_id", F.explode(under).alias("prefix"), "path", "size")


def under_prefixes(files: DataFrame, prefixes: DataFrame, path: str = "path", prefix: str = "prefix") -> DataFrame:
    """files with a column prefix: a row for each distinct prefix of the table that a path starts with; paths under none are left out.

    An equi-join: a path is cut at the lengths that prefixes have (of which there are no more than the longest prefix has
    characters), and the beginnings are looked up. Prefixes may be any number; the empty one is over every path, null ones over none.
    """
    wanted = prefixes.where(F.col(prefix).isNotNull()).select(F.col(prefix).alias("prefix")).distinct()
    lengths = sorted(r[0] for r in wanted.select(F.length("prefix")).distinct().collect())
    if not lengths:
        return files.withColumn("prefix", F.lit(None).cast("string")).where(F.lit(False))
    possible = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return files.withColumn("_n", F.explode(possible)).withColumn("prefix", F.left(F.col(path), F.col("_n"))).drop("_n").join(wanted, "prefix", "left_semi").select(*files.columns, "prefix")


def years_with_stats(years: DataFrame, summary: DataFrame) -> DataFrame:
    return years.join(summary, "year", "left")


def first_rule(nodes: str) -> Column:
    """The first of a list of rules, null for an empty list."""
    return F.get(F.col(nodes), F.lit(0))


def union_comments(issue_comments: DataFrame, review_comments: DataFrame) -> DataFrame:
    """Both kinds as one stream with a tag."""
    return issue_comments.withColumn("comment_type", F.lit("issue")).unionByName(review_comments.withColumn("comment_type", F.lit("review")))


def numbers_per_repo(rows: DataFrame, number: str = "number") -> DataFrame:
    """The distinct numbers of each repository as rows: stays distributed, sort where it is shown."""
    return rows.select("repo_id", number).where(F.col(number).isNotNull()).distinct()
