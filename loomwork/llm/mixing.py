"""Mixing sources to target weights by Poisson replication, with Spark expressions only.

A source's repetition rate is its target weight over its share of the corpus (in code points).
Each document gets a uniform number from a hash of seed and row, and the inverse of the Poisson
distribution with its source's rate turns it into a count; the document is repeated that often
and all copies are shuffled globally by another hash. A row is known by all its columns and, where rows are
equal in all of them, by a number among these, so that neither null nor repeated ids share a draw or a place. Rates above ``STEP`` are drawn as a sum of
equal parts with a number each, so the distribution never underflows.

Weights default to shares to the power ``alpha`` (temperature sampling). Weights given for sources are
taken relative to each other; a source without one has weight 0.

Defined results: null texts and empty texts count no code points and follow their source's rate; a
source without any code point keeps rate 1; a null source is a source of its own; repeated rows draw
each for itself; a very long text is a row like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import saved

STEP = 64.0
#: Terms of the cumulative distribution for a rate up to STEP; what lies beyond has a mass under 1e-12.
TERMS = 160
#: Copies of one row that are made in one go.
RUN = 10_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def rates(docs: DataFrame, source_col: str, text_col: str, alpha: float, weights: dict[str, float] | None) -> DataFrame:
    """A row per source: source, chars, rate, draws, cdf of one draw."""
    sizes = docs.groupBy(F.col(source_col).alias("__source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).cast("double").alias("__chars"))
    sizes = saved(sizes, "source-sizes")
    if weights is None:
        weight = F.when(F.col("__chars") > 0, F.pow(F.col("__chars"), F.lit(float(alpha)))).otherwise(F.lit(0.0))
    else:
        given = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))]) if weights else F.create_map(F.lit(""), F.lit(0.0))
        weight = F.coalesce(F.try_element_at(given, F.col("__source")), F.lit(0.0))
    sizes = sizes.withColumn("__weight", F.when(F.col("__chars") > 0, weight).otherwise(F.lit(0.0)))
    total = sizes.agg(F.sum("__chars"), F.sum("__weight")).first()
    all_chars, all_weight = F.lit(total[0] or 0.0), F.lit(total[1] or 0.0)
    rate = F.when(F.col("__chars") > 0, F.col("__weight") / F.when(all_weight > 0, all_weight) * all_chars / F.when(F.col("__chars") > 0, F.col("__chars")))
    out = sizes.withColumn("__rate", F.when(F.col("__chars") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(F.lit(1.0)))
    out = out.withColumn("__draws", F.greatest(F.lit(1), F.ceil(F.col("__rate") / STEP)).cast("int")).withColumn("__mean", F.col("__rate") / F.col("__draws"))
    # the cumulative distribution by p(k + 1) = p(k) * mean / (k + 1)
    cdf = F.expr(
        f"aggregate(sequence(1, {TERMS}), named_struct('p', exp(-__mean), 'sum', exp(-__mean), 'all', array(exp(-__mean))),"
        " (s, k) -> named_struct('p', s.p * __mean / k, 'sum', s.sum + s.p * __mean / k, 'all', concat(s.all, array(s.sum + s.p * __mean / k))), s -> s.all)"
    )
    return out.withColumn("__cdf", cdf).select("__source", "__rate", "__draws", "__cdf")


def known(docs: DataFrame, text_col: str, broadcast_rows: int) -> DataFrame:
    """``docs`` with ``__row``, the columns as a JSON object with the text's md5, so that rows that differ have different ones, and
    ``__nth``, the number among rows equal in all of them.

    Rows that have no equal aren't moved. Others are counted by value, which combines map-side, and made anew from the count."""
    shown = [F.md5(F.col(c).cast("binary")).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    rows = docs.withColumn("__row", F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}))
    again = rows.groupBy(F.md5("__row").alias("__again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__again")
    again = saved(again, "repeated-rows")
    n = again.count()
    if not n:
        return rows.withColumn("__nth", F.lit(1).cast("long"))
    if n <= broadcast_rows:
        again = F.broadcast(again)
    met = F.md5("__row") == F.col("__again")
    equal = rows.join(again, met, "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n"))
    # a row may stand for any number of copies, so they are dealt out before they are made
    runs = equal.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / RUN)))).repartition("__row", "__run")
    made = runs.withColumn("__nth", F.explode(F.sequence(F.col("__run") * RUN + 1, F.least(F.col("__n"), (F.col("__run") + 1) * RUN)))).drop("__n", "__run")
    return rows.join(again, met, "left_anti").withColumn("__nth", F.lit(1).cast("long")).unionByName(made)


def counts(docs: DataFrame, source_col: str = "source", text_col: str = "text", *, alpha: float = 0.5, weights: dict[str, float] | None = None, seed: str = "mix", broadcast_sources: int = 10_000, copies_col: str = "copies", rate_col: str = "rate", keep_row: bool = False) -> DataFrame:
    """``docs`` with ``copies_col`` and ``rate_col`` (in place of columns of these names). Up to ``broadcast_sources`` sources are broadcast; more are joined by shuffling."""
    by_source = rates(docs, source_col, text_col, alpha, weights)
    if by_source.count() <= broadcast_sources:
        by_source = F.broadcast(by_source)
    joined = known(docs, text_col, broadcast_sources).join(by_source, F.col(source_col).eqNullSafe(F.col("__source")), "left")
    drawn = F.aggregate(F.sequence(F.lit(1), F.col("__draws")), F.lit(0), lambda acc, j: acc + F.size(F.filter("__cdf", lambda p: p < uniform(F.lit(seed), F.col("__row"), F.col("__nth"), j))))
    one = F.size(F.filter("__cdf", lambda p: p < F.col("__u")))
    joined = joined.withColumn("__u", uniform(F.lit(seed), F.col("__row"), F.col("__nth"), F.lit(1)))
    count = F.when(F.col("__draws") == 1, one).otherwise(drawn)
    return joined.withColumns({copies_col: count, rate_col: F.col("__rate")}).drop("__source", "__chars", "__weight", "__draws", "__mean", "__cdf", "__u", *({"__rate"} - {rate_col}), *([] if keep_row else ["__row", "__nth"]))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", *, seed: str = "mix", **options) -> DataFrame:
    """The mixture: every document as often as drawn, with ``copy_no`` from 1, shuffled globally.
    Columns named copy_no or shuffle_key are replaced.

    ``shuffle_key`` is uniform, so dealing rows out by its hash and sorting each partition by it is a
    random order as good as a total sort, without the sampling pass over all texts that one needs."""
    out = counts(docs, source_col, text_col, seed=seed, copies_col="__copies", rate_col="__rate", keep_row=True, **options).filter("__copies > 0")
    out = out.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies", "__rate")
    key = F.md5(F.concat_ws(":", F.lit(seed + "-order"), "__row", F.col("__nth").cast("string"), F.col("copy_no").cast("string")))
    return out.withColumn("shuffle_key", key).drop("__row", "__nth").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
