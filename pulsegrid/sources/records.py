"""Reading and writing records: enveloped JSON lines, Parquet tables, JSON and CSV exports."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.normalize import envelope_schema

USER = "struct<login: string, avatar_url: string, type: string>"
#: Payload types of the raw records.
PAYLOADS = {
    "pull_request": f"struct<number: bigint, title: string, body: string, html_url: string, state: string, user: {USER}, created_at: string, updated_at: string, merged_at: string, additions: bigint, deletions: bigint, labels: array<struct<name: string>>>",
    "issue": f"struct<number: bigint, title: string, state: string, user: {USER}, created_at: string, updated_at: string, closed_at: string, pull_request: struct<url: string>>",
    "review": f"struct<repo: string, number: bigint, user: {USER}, state: string, submitted_at: string>",
    "comment": f"struct<repo: string, issue_url: string, user: {USER}, created_at: string, body: string>",
    "tree": "struct<repo: string, tree: array<struct<path: string, type: string, sha: string, size: bigint>>>",
    "protection": "struct<repo: string, branch: string, status: int, body: string>",
    "security": "struct<repo: string, dependabot_alerts: boolean, secret_scanning: boolean, push_protection: boolean, code_scanning: boolean, error: string>",
    "repo": "struct<id: bigint, name: string, full_name: string, description: string, language: string, stargazers_count: bigint, forks_count: bigint, archived: boolean, private: boolean, fork: boolean, visibility: string, topics: array<string>, size: bigint, pushed_at: string, default_branch: string>",
    "repo_detail": "struct<full_name: string, languages: struct<edges: array<struct<size: bigint, node: struct<name: string>>>>, topics: array<string>, license: struct<name: string>, defaultBranchRef: struct<name: string>, issues: struct<open: bigint, closed: bigint>, pulls: struct<open: bigint, merged: bigint>>",
}
REJECT = "_corrupt_record"
RECORDS_PER_FILE = 500_000


def payload(name: str) -> T.StructType:
    return T.DataType.fromDDL(PAYLOADS[name])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path can be listed by Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_enveloped(spark: SparkSession, path: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines) of JSON lines in envelopes. payload: a name of PAYLOADS or a type text."""
    schema = envelope_schema(PAYLOADS.get(payload, payload)).add(REJECT, T.StringType())
    lines = spark.read.text(path).where("trim(value) <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT}
    parsed = lines.select("value", F.from_json("value", schema, options).alias("r"))
    return parsed.where(f"r.{REJECT} IS NULL").select("r.*").drop(REJECT), parsed.where(f"r.{REJECT} IS NOT NULL").select(F.col("value").alias("line"))


def enveloped(df: DataFrame, source: str, endpoint: str, page: Column | None = None) -> DataFrame:
    """Rows of df as payloads of fresh envelopes."""
    return df.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(source).alias("source"), F.lit(endpoint).alias("endpoint"),
        F.uuid().alias("request_id"), (F.lit(1) if page is None else page).cast("int").alias("page"), F.struct(*df.columns).alias("data"),
    )


def write_enveloped(df: DataFrame, path: str, source: str, endpoint: str, mode: str = "append") -> None:
    """JSON lines in gzip, as envelopes repeat most of a line. Such a file is read by one task, so files end at `RECORDS_PER_FILE` lines."""
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": RECORDS_PER_FILE}
    enveloped(df, source, endpoint).write.mode(mode).options(**packed).json(path)


def count_records(spark: SparkSession, path: str) -> int:
    """Non-empty lines; 0 for a missing path."""
    return spark.read.text(path).where("trim(value) <> ''").count() if exists(spark, path) else 0


def counted_records(spark: SparkSession, path: str) -> DataFrame:
    """count_records as a table of one row, n."""
    lines = spark.read.text(path) if exists(spark, path) else spark.createDataFrame([], "value string")
    return lines.agg(F.count_if(F.trim("value") != "").alias("n"))


def write_raw(df: DataFrame, root: str, mode: str = "append") -> None:
    """Hive layout root/year=/source=/target=: readers prune by the folders."""
    df.write.mode(mode).partitionBy("year", "source", "target").json(root)


def write_years(df: DataFrame, root: str) -> None:
    """Parquet by year: only the years that df has are replaced, the others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(root)


def read_years(spark: SparkSession, root: str, *wanted: int) -> DataFrame:
    """The rows of the wanted years (all, if none is named): the filter prunes folders, files of other years are not opened."""
    df = spark.read.parquet(root)
    return df.where(F.col("year").isin(*wanted)) if wanted else df


def stored_years(spark: SparkSession, root: str, first: int = 2000, last: int = 2100) -> DataFrame:
    """The years that have a folder, newest first: a listing, no file is read. Other folders are passed over; a missing root has none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [x.getPath().getName().removeprefix("year=") for x in fs.listStatus(p) if x.isDirectory()] if fs.exists(p) else []
    found = sorted((int(n) for n in names if n.isdigit() and first <= int(n) <= last), reverse=True)
    return spark.createDataFrame([(y,) for y in found], "year int")


def repo_from_file(column: Column) -> Column:
    """owner/name from a file name owner__name.ext."""
    return F.regexp_replace(F.regexp_replace(column, r"\.[^.]+$", ""), "__", "/")


def file_of_repo(column: Column) -> Column:
    return F.regexp_replace(column, "/", "__")


def write_table(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """A curated or metric table in Parquet, in key order: range partitioned and sorted, so row groups can be skipped."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).partitionBy(*partition_by).parquet(path)


BUCKETS = 64


def _bucket_table(path: str) -> str:
    return "bucketed_" + hashlib.sha256(path.encode()).hexdigest()[:32]


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A curated table in buckets of its keys, sorted in each: joins and groupings on the keys need no shuffle. One file a bucket."""
    name = _bucket_table(path)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)


def read_bucketed(spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The table of write_bucketed, also in another session: the folder is named to the catalog again where it is not known."""
    name = _bucket_table(path)
    if not spark.catalog.tableExists(name):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_document(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A metric family as JSON in one file: for report-sized results."""
    df.coalesce(1).write.mode(mode).json(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows, or an empty DataFrame if the path is not there."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def first_nonempty(*frames: DataFrame) -> DataFrame:
    """The first that has a row, else the last."""
    for f in frames[:-1]:
        if not f.isEmpty():
            return f
    return frames[-1]


def require(tables: dict[str, DataFrame], *names: str) -> None:
    """Fail early if a required input is missing or has no columns."""
    missing = [n for n in names if n not in tables or not tables[n].columns]
    if missing:
        raise FileNotFoundError("required inputs are missing: " + ", ".join(missing))


def years(df: DataFrame, column: str = "year", first: int = 2000, last: int = 2100) -> DataFrame:
    """The years present, newest first. On a partition column only folders are read."""
    return df.where(F.col(column).between(first, last)).select(F.col(column).cast("int").alias("year")).distinct().orderBy(F.desc("year"))


def csv_ready(df: DataFrame) -> DataFrame:
    """All columns as texts with white space collapsed."""
    return df.select(*[F.regexp_replace(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"\s+", " ").alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    csv_ready(df).write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def repo_details(details: DataFrame, discovered: DataFrame, protection: DataFrame, presence: DataFrame) -> DataFrame:
    """Detailed metadata joined to discovery, the protection rule and a map of file presence."""
    languages = F.map_from_entries(F.transform("languages.edges", lambda e: F.struct(e["node"]["name"], e["size"])))
    flat = details.select(
        F.col("full_name").alias("repo_id"), languages.alias("languages"), "topics", F.col("license.name").alias("license"), F.coalesce("defaultBranchRef.name", F.lit("main")).alias("default_branch"),
        F.col("issues.open").alias("issues_open"), F.col("issues.closed").alias("issues_closed"), F.col("pulls.open").alias("pulls_open"), F.col("pulls.merged").alias("pulls_merged"),
    )
    files = presence.groupBy("repo_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "exists"))).alias("files"))  # one entry per expected path
    return flat.join(discovered, "repo_id", "left").join(protection, "repo_id", "left").join(files, "repo_id", "left")
