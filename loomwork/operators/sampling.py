"""Exact-size sampling and splits, the same in every run and engine: the order is md5('seed:id').

Global positions come from :func:`loomwork.storage.with_rank`, so no task sees all rows; positions
within strata use row_number() <= k, which Spark prunes to k rows per task before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.storage import few, with_rank


def shuffle_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """All rows with their ``position`` in the seeded order."""
    key = shuffle_key(F.col(id_col), seed)
    return with_rank(df.withColumn("__key", key), F.col("__key"), F.col(id_col), name="position").drop("__key")


def split(df: DataFrame, id_col: str, seed: int, fraction: float, minimum: int = 0) -> DataFrame:
    """``split``: the first int(n * fraction) rows of the seeded order, ``minimum`` at least, are val."""
    ranked = shuffled(df, id_col, seed)
    n_val = max(minimum, int(ranked.count() * fraction))  # from the files' footers
    return ranked.withColumn("split", F.when(F.col("position") <= n_val, "val").otherwise("train"))


def quotas(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, quota): total // strata each, one more for the first total % strata by name. A row per stratum, made without the driver."""
    names = with_rank(df.select(F.col(stratum).alias("__stratum")).distinct(), F.col("__stratum"))
    share, extra = divmod(total, max(1, names.count()))
    return names.select("__stratum", (F.lit(share) + (F.col("rank") <= extra).cast("int")).cast("int").alias("__quota"))


def _first_of_strata(df: DataFrame, stratum: str, order: list[Column], most: int) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most)


def stratified(df: DataFrame, stratum: str, id_col: str, total: int, seed: int) -> DataFrame:
    """Exactly the quota of each stratum in seeded order; short strata aren't topped up."""
    wanted = quotas(df, stratum, total)
    most = wanted.agg(F.max("__quota")).first()[0] or 0
    first = _first_of_strata(df, stratum, [shuffle_key(F.col(id_col), seed), F.col(id_col)], most)
    return first.join(few(wanted), F.col(stratum).eqNullSafe(F.col("__stratum"))).filter("__n <= __quota").drop("__n", "__stratum", "__quota")


def balanced_head(df: DataFrame, stratum: str, position: str, total: int) -> DataFrame:
    """The quota of each stratum in an order that is already there."""
    wanted = quotas(df, stratum, total)
    most = wanted.agg(F.max("__quota")).first()[0] or 0
    first = _first_of_strata(df, stratum, [F.col(position)], most)
    return first.join(few(wanted), F.col(stratum).eqNullSafe(F.col("__stratum"))).filter("__n <= __quota").drop("__n", "__stratum", "__quota")


def round_robin(df: DataFrame, stratum: str, id_col: str, total: int, seed: int) -> DataFrame:
    """One row of each stratum in turn until ``total``; exhausted strata are passed over. Blank strata
    are ``unknown``; all rows if ``total`` isn't positive or there are no more."""
    named = df.withColumn("__s", F.coalesce(F.nullif(F.col(stratum), F.lit("")), F.lit("unknown")))
    if total <= 0:
        return named.drop("__s")
    first = _first_of_strata(named, "__s", [shuffle_key(F.col(id_col), seed), F.col(id_col)], total)
    return first.orderBy("__n", "__s").limit(total).drop("__n", "__s")


def random_k(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement."""
    return df.orderBy(shuffle_key(F.col(id_col), seed), F.col(id_col)).limit(k)


def first_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def even_first_k(df: DataFrame, stratum: str, order: list[Column], total: int) -> DataFrame:
    """total // strata rows of each stratum, first ones first; the remainder is dropped. All rows if there are no more."""
    if total <= 0 or df.count() <= total:
        return df
    strata = df.select(stratum).distinct().count()
    return _first_of_strata(df, stratum, order, total // max(1, strata)).drop("__n")
