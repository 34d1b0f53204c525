"""Quality filters with an account of what was rejected, and required-field checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomwork.functions import pytext as t

KEPT = "kept"
#: What :func:`reject_reason` gives.
REASONS = ["quality", "words", "downweight", KEPT]


def not_blank(s: Column) -> Column:
    """For labels and for prompts and answers alike."""
    return s.isNotNull() & (t.strip(s) != "")


def require(df: DataFrame, columns: list[str], ordinal: str) -> DataFrame:
    """``df`` if every row has all ``columns``; else an error that names the first row without one."""
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    bad = df.withColumn("__missing", missing).filter(F.col("__missing").isNotNull()).orderBy(ordinal).select(ordinal, "__missing").first()
    if bad:
        raise ValueError(f"Row {bad[0]} missing '{bad[1]}'")
    return df


def quality_ok(has_key: Column, score: Column, least: float) -> Column:
    """Rows without the key pass, a null score is 0; ``least`` <= 0 turns the filter off."""
    if least <= 0:
        return F.lit(True)
    return F.when(has_key, F.coalesce(score, F.lit(0.0)) >= least).otherwise(True)


def words_ok(text: Column, known_count: Column, most: int) -> Column:
    """At most ``most`` words, by a known count that isn't 0 or by counting; 0 turns the cap off."""
    if most <= 0:
        return F.lit(True)
    return F.coalesce(F.nullif(known_count.cast("long"), F.lit(0)), t.word_count(text)) <= most


def sampled(flag: Column, id_col: Column, factor: float, seed: int) -> Column:
    """Flagged rows stay with probability ``factor``, by a hash of seed and id; others always stay."""
    if factor >= 1:
        return F.lit(True)
    share = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return ~F.coalesce(flag, F.lit(False)) | (share <= factor)


def reject_reason(quality: Column, words: Column, sample: Column) -> Column:
    """The first filter that a row fails, in this order, else ``kept``."""
    return F.when(~quality, "quality").when(~words, "words").when(~sample, "downweight").otherwise(KEPT)


def reject_counts(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def counted(df: DataFrame, counters: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` as it is, and an observation that has, once a job has run through it, how many rows each counter is true for.

    So a job that writes what a filter keeps also counts what it rejects: the rows are read once. A counter's name is its key in ``observation.get``."""
    seen = Observation()
    return df.observe(seen, *[F.count(F.when(flag, F.lit(1))).alias(name) for name, flag in counters.items()]), seen


def write_kept(df: DataFrame, reason: Column, write: Callable[[DataFrame], None], reasons: list[str] = REASONS) -> dict[str, int]:
    """Write the rows that no filter rejects, and return how many each reason has; one job does both."""
    rows, seen = counted(df.withColumn("__reason", reason), {r: F.col("__reason") == r for r in reasons})
    write(rows.filter(F.col("__reason") == KEPT).drop("__reason"))
    return seen.get


def one_by_id(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """The rows of one id; an error if there are none."""
    found = df.filter(F.col(id_col) == value)
    if found.isEmpty():
        raise LookupError(f"id '{value}' not found")
    return found
