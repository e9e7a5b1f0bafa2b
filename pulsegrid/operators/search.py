"""Search over contributors and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def search_index(people: DataFrame, repos: DataFrame) -> DataFrame:
    """kind, name, weight: people with their pull requests, repositories with their merges."""
    return people.select(F.lit("contributor").alias("kind"), F.col("login").alias("name"), F.col("total_prs").cast("long").alias("weight")).unionByName(
        repos.select(F.lit("repository").alias("kind"), F.col("repo_full_name").alias("name"), F.col("prs_merged").cast("long").alias("weight"))
    )


def global_search(index: DataFrame, query: str, limit: int = 5, min_length: int = 2) -> DataFrame:
    """The first hits, contributors before repositories; too short a query finds nothing."""
    if len(query) < min_length:
        return index.where(F.lit(False))
    return index.where(F.lower("name").contains(query.lower())).orderBy("kind", F.desc("weight"), "name").limit(limit)


def grams(text: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """The distinct runs of two and of three characters of a lower-cased text."""
    low = F.lower(text)
    run = lambda n: F.transform(F.when(F.length(low) >= n, F.sequence(F.lit(1), F.length(low) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(low, i, F.lit(n)))
    return F.array_distinct(F.concat(*[run(n) for n in sizes]))


class NameIndex:
    """Postings of names by their runs of two and three characters, stored under a folder.

    Postings are in the order of their runs, so that a lookup opens few row groups, and the number of a run's postings is stored
    with the run. A term is looked up by its rarest run; whether a candidate holds the whole term is checked on the name.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, index: DataFrame) -> None:
        """index: kind, name, weight. Null names are in no posting; repeated rows are found each."""
        named = index.where(F.col("name").isNotNull()).select("kind", "name", "weight")
        postings = named.select(F.explode(grams(F.col("name"))).alias("gram"), "kind", "name", "weight")
        postings.repartitionByRange("gram", "kind", "name").sortWithinPartitions("gram", "kind", "name").write.mode("overwrite").parquet(f"{self.root}/postings")
        self.spark.read.parquet(f"{self.root}/postings").groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.root}/runs")

    def find(self, terms: DataFrame, min_length: int = 2) -> DataFrame:
        """term, kind, name, weight of every name that holds a term (in any letter case). Null and too short terms find nothing; a repeated term counts once."""
        asked = terms.select("term").where(F.length("term") >= min_length).distinct()
        runs = self.spark.read.parquet(f"{self.root}/runs")
        parts = asked.select("term", F.explode(F.when(F.length("term") > 2, grams(F.col("term"), (3,))).otherwise(grams(F.col("term"), (2,)))).alias("gram"))
        rarest = parts.join(runs, "gram").groupBy("term").agg(F.min(F.struct("n", "gram")).alias("r")).select("term", F.col("r.gram").alias("gram"))
        postings = self.spark.read.parquet(f"{self.root}/postings")
        return postings.join(rarest, "gram").where(F.lower("name").contains(F.lower("term"))).select("term", "kind", "name", "weight")

    def first_hits(self, terms: DataFrame, n: int = 5) -> DataFrame:
        """The first n hits of each term, as `global_search` orders them."""
        w = Window.partitionBy("term").orderBy("kind", F.desc("weight"), "name")
        return self.find(terms).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
