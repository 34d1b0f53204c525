"""Joins on ids, merges, deduplication and upserts. Ids are compared as strings.

Catalyst picks broadcast or sort-merge by size; nothing here forces a broadcast of data that grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unfinished_ids(todo: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """Resume: rows of ``todo`` whose id isn't in ``done``."""
    ids = done.select(F.col(id_col).cast("string").alias("__id")).distinct()
    return todo.join(ids, F.col(id_col).cast("string") == F.col("__id"), "left_anti")


def prefer_new(new: DataFrame, old: DataFrame, id_col: str = "id", origin: str | None = None) -> DataFrame:
    """All rows of ``new`` and the rows of ``old`` with other ids; repeated ids within a side stay."""
    kept = unfinished_ids(old, new, id_col)
    if origin:
        new, kept = new.withColumn(origin, F.lit("new")), kept.withColumn(origin, F.lit("old"))
    return new.unionByName(kept, allowMissingColumns=True)


def overlap(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ``left`` whose id is in ``right``."""
    ids = right.select(F.col(id_col).cast("string").alias("__id")).distinct()
    return left.join(ids, F.col(id_col).cast("string") == F.col("__id"), "left_semi")


def missing_labels(samples: DataFrame, labels: list[str], done: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """(id, number of labels missing) of samples for which a requested label isn't done.

    The labels are a short list, so each sample's done labels are compared as a set: no cross join."""
    have = done.filter(F.col(label_col).isin(labels)).groupBy(F.col(id_col).cast("string").alias("__id")).agg(F.countDistinct(label_col).alias("__have"))
    ids = samples.select(F.col(id_col).cast("string").alias(id_col)).distinct()
    joined = ids.join(have, F.col(id_col) == F.col("__id"), "left")
    missing = (F.lit(len(set(labels))) - F.coalesce("__have", F.lit(0))).cast("long")
    return joined.select(id_col, missing.alias("n_missing")).filter("n_missing > 0")


def not_done_for(samples: DataFrame, done: DataFrame, label: str, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Samples that one label hasn't processed."""
    return unfinished_ids(samples, done.filter(F.col(label_col) == label), id_col)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def keep_last(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row of each key, blank keys dropped; an aggregate, so that no window buffers rows."""
    rest = [c for c in df.columns if c not in keys]
    present = df.filter(F.coalesce(F.col(keys[0]).cast("string"), F.lit("")) != "")
    best = F.max_by(F.struct(*rest), F.col(ordinal))
    return present.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """New rows overwrite old ones of the same keys; running it twice changes nothing."""
    both = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("__side", ordinal))
    return both.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*").select(*old.columns)


def side_by_side(rows: DataFrame, models: list[str], value: str, ordinal: str, id_col: str = "id", model_col: str = "model") -> DataFrame:
    """A row per id with a column per model; of repeated rows the last counts, a missing model is null.

    One aggregation over all models in place of a join per model."""
    columns = [F.max_by(F.when(F.col(model_col) == m, F.col(value)), F.when(F.col(model_col) == m, F.col(ordinal))).alias(f"model_{i + 1}") for i, m in enumerate(models)]
    return rows.filter(F.col(model_col).isin(models)).groupBy(id_col).agg(*columns)


def with_sample(results: DataFrame, samples: DataFrame, columns: list[str], ordinal: str, id_col: str = "id") -> DataFrame:
    """Each result with columns of the first sample of its id."""
    first = samples.groupBy(F.col(id_col).alias("__id")).agg(F.min_by(F.struct(*columns), F.col(ordinal)).alias("__s"))
    return results.join(first, F.col(id_col) == F.col("__id")).select(results["*"], *[F.col(f"__s.{c}").alias(c) for c in columns])


def label_difference(wanted: Column, have: Column) -> Column:
    """Labels of the first array that aren't in the second, sorted."""
    return F.array_sort(F.array_except(wanted, have))
