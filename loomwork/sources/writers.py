"""Sinks. Spark's commit protocol takes the place of locks and flushes: a row is there once its task has committed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.sources.readers import CSV_OPTIONS


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path, ignoreNullFields=False)


def rewrite_jsonl(current: DataFrame, results: DataFrame, path: str, id_col: str = "id", ordinal: str = "ordinal") -> None:
    """All of ``results``: those of ``current`` samples first, in their order, then the rows of earlier runs.

    ``path`` must be new, as the old one is usually being read."""
    order = current.groupBy(F.col(id_col).alias("__id")).agg(F.min(ordinal).alias("__n"))
    joined = results.join(order, F.col(id_col) == F.col("__id"), "left")
    joined.orderBy(F.col("__n").isNull(), "__n", ordinal).drop("__id", "__n").write.mode("error").json(path, ignoreNullFields=False)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """A folder per split, from one pass."""
    df.write.partitionBy(split_col).json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV_OPTIONS).csv(path)


def report_json(sections: dict[str, DataFrame]) -> str:
    """A pretty JSON report; sections are aggregates of a few rows each."""
    rows = {name: [json.loads(x) for x in df.select(F.to_json(F.struct("*")).alias("j")).toPandas()["j"]] for name, df in sections.items()}
    return json.dumps(rows, indent=2, sort_keys=True, ensure_ascii=False)
