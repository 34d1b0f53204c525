"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; its result is written as
Parquet and reread as the next stage's ``docs``. All stages but the last return the columns of
``documents``. Near-dedup keeps one row of each group whatever its ids are: the first by id (nulls last), then
by the hash of id and text, then by all columns, so rows that repeat id and text leave it as one. Very long texts go
through every stage whole; columns of other names pass through all of them, but those that begin with two underscores are the
stages' own. Without labels the quality model scores 0.5 and keeps all, without benchmark items nothing is
contaminated. Every other case (null texts, ties, empty tables) is as the operators define it.

What a stage writes for itself is deleted when its result is written, and that when the next stage's is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import decontaminate, jaccard, mixing, quality, suffix
from loomwork.llm.common import few, fresh_path, saved, table
from loomwork.storage import delete, scratch

#: SQL can't express a fitted model, XXH64 fingerprints or their links.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality model, fitted on all labels, scores at least 0.5."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("__score", quality.score(docs, model)).filter("__score >= 0.5").drop("__score")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of links at a Jaccard similarity of 0.8 and more, of five-word shingles.

    SimHash fingerprints are linked by vantage-point trees first, as in op10, and confirmed; a prefix filter adds the links that they miss."""
    found = saved(jaccard.near_duplicates(docs).select("doc_id", "key", "first_key"), "found")
    copies = saved(found.filter("key != first_key").select(F.col("key").alias("__copy"), F.col("doc_id").alias("__copy_id")).distinct(), "copies")
    # rows that share id and text with the first of their component, and so its key
    repeated = saved(found.filter("key = first_key").groupBy("key").count().filter("count > 1").select(F.col("key").alias("__again")), "repeated")
    rows = docs.withColumn("__key", jaccard.row_key("doc_id", "text"))
    # keys are hashes; with the id beside them no other row is taken for a copy
    rows = rows.join(few(copies), (F.col("__key") == F.col("__copy")) & F.col("doc_id").eqNullSafe(F.col("__copy_id")), "left_anti")
    if repeated.isEmpty():
        return rows.drop("__key")
    again = few(repeated)
    once = rows.join(again, F.col("__key") == F.col("__again"), "left_semi").groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return rows.join(again, F.col("__key") == F.col("__again"), "left_anti").drop("__key").unionByName(once)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes byte strings of 100 and more that start earlier; a document of which nothing is left goes."""
    found = suffix.removals(docs).withColumn("text", suffix.kept_text()).withColumn("n_chars", F.length("text").cast("long"))
    return found.filter("__spans is null or n_chars > 0").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    hit = decontaminate.with_contamination(docs, table(spark, sf_dir, "benchmark"), into="__hit")
    return hit.filter("not __hit.contaminated").drop("__hit")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by Poisson counts so that sources reach their weights, in shuffled order."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("near-dedup", one_of_near_duplicates),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
