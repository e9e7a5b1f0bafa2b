"""From raw documents to encoded training text, in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads
again as the next stage's docs. All but the last return the columns of documents, whatever they are; the
columns doc_id and text are used. A decision names a row by its doc_id and the digest of its text, so of an id with several
texts only the text that is meant goes. Rows without a doc_id cannot be named and stay. No row is sampled, capped or looked at
in part. Columns beyond doc_id and text are carried along, whatever their names.

Empty tables pass through. A null text is empty: not toxic unless the classifier says so, equal to other
empty texts, near nothing, leaked from nothing, and encoded to no tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.bpe import bpe_digests
from pulsegrid.llm.common import digest, materialize, table, without
from pulsegrid.llm.decontaminate import drop_leaked, find_leaks
from pulsegrid.llm.exact_dedup import exact_dedup
from pulsegrid.llm.minhash import near_dup_classes
from pulsegrid.llm.toxicity import score_held_out
from pulsegrid.sources.scratch import delete, new_folder, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. Repeated rows go or stay together; null and empty texts are scored as empty."""
    scores = score_held_out(docs, table(spark, sf_dir, "labels"))
    return without(docs, materialize(scores.where("predicted = 1").select("doc_id", "text_sha256"), "stage-toxic"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; rows that repeat it leave one, the one whose columns hash lowest."""
    decided = materialize(exact_dedup(docs).select("doc_id", "kept", "text_sha256"), "stage-exact")
    out = without(docs, decided.where("not kept"))
    again = decided.where("kept and doc_id is not null").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id", "text_sha256")
    again = materialize(again, "stage-again")
    if not again.limit(1).count():
        return out
    # rows that occur once, and of each that repeats the first by a hash of all its columns
    named = out.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), digest("text").alias("_digest"))
    repeated = named.join(again, (named["_id"] == again["doc_id"]) & (named["_digest"] == again["text_sha256"])).groupBy("_id", "_digest")
    return without(out, again).unionByName(repeated.agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, similarity 0.8) the document with the smallest id stays.

    Where an id has several texts, its rows are compared as documents of their own; of a class the smallest id stays
    then too, and of its texts the one with the smallest digest.
    """
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"))
    spread = named.groupBy("doc_id").agg(F.min("_hash").alias("low"), F.max("_hash").alias("high"))
    if not spread.where("low <> high").limit(1).count():
        copies = near_dup_classes(docs, width=5, threshold=80).where("not kept").select("doc_id")
        copies = materialize(copies, "stage-near").withColumnRenamed("doc_id", "_copy")
        return docs.join(copies, docs["doc_id"].cast("long") == copies["_copy"], "left_anti")
    rows = named.select("doc_id", "text", digest("text").alias("text_sha256")).distinct().withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "stage-rows")  # written, so that the numbers stay what they are
    classes = near_dup_classes(rows, id_col="row", width=5, threshold=80).select(F.col("doc_id").alias("row"), "component_id")
    member = materialize(rows.select("row", "doc_id", "text_sha256").join(classes, "row"), "stage-members")
    first = member.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_sha256")).alias("first"))
    copies = member.join(first, "component_id").where(F.struct("doc_id", "text_sha256") != F.col("first"))
    return without(docs, materialize(copies.select("doc_id", "text_sha256"), "stage-near"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item, whole or edited, go. Repeated rows go or stay together; null and empty texts stay."""
    return drop_leaked(docs, materialize(find_leaks(docs, table(spark, sf_dir, "benchmark")), "stage-leaks"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, one row per row; a null text has no tokens."""
    return bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: No SQL: a classifier, alignments and BPE are beyond it; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents. What a stage writes for itself goes when it ends, its result when the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        with scope():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
