"""Reports by model and task: rollups, winners, gates, costs, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import pytext as t
from loomwork.operators.filters import counted
from loomwork.storage import with_rank

TOTAL = "TOTAL"


def _named(task: str) -> list[Column]:
    """``task_type`` and ``is_total`` of a row of grouping sets with its ``g``, the grouping of the task."""
    total = F.col("g") == 1
    return [F.when(total, TOTAL).otherwise(F.col(task)).alias("task_type"), total.alias("is_total")]


def as_long(flag: Column) -> Column:
    return F.coalesce(flag.cast("long"), F.lit(0)).cast("long")


def accuracy(df: DataFrame, correct: str = "correct", model: str = "model", task: str = "task_type") -> DataFrame:
    """(model, task, correct, total), one row per pair."""
    return df.groupBy(model, task).agg(F.sum(as_long(F.col(correct))).alias("correct"), F.count(F.lit(1)).alias("total"))


def accuracy_with_totals(df: DataFrame, correct: str = "correct", model: str = "model", task: str = "task_type") -> DataFrame:
    """:func:`accuracy` plus a row per model that ``is_total``, called ``TOTAL``, from one aggregation with two grouping levels.

    A task may be called ``TOTAL`` as well, so it's the flag that tells them apart."""
    by = df.select(F.col(model).alias("model"), F.coalesce(F.col(task), F.lit("")).alias("task"), as_long(F.col(correct)).alias("ok"))
    both = by.groupingSets([[F.col("model"), F.col("task")], [F.col("model")]], F.col("model"), F.col("task"))
    out = both.agg(F.sum("ok").alias("correct"), F.count(F.lit(1)).alias("total"), F.grouping("task").alias("g"))
    return out.select("model", *_named("task"), "correct", "total")


def winners(table: DataFrame, task: str = "task_type", n_models: int = 1) -> DataFrame:
    """Per task the short name of the model with the best rate, or ``tie``. ``table`` has a row per model and task, and totals if they are marked.

    Of ``n_models`` compared, those without rows for a task have rate 0, so a best rate of 0 is a tie."""
    best = table.withColumn("rate", F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total").cast("double")), F.lit(0.0)))
    # rates are compared exactly: the largest rate and how many models have it, in one pass
    keys = [task, *(c for c in ["is_total"] if c in table.columns)]
    top = best.groupBy(*keys).agg(F.max("rate").alias("best_rate"), F.collect_list(F.struct("rate", "model")).alias("all"))  # an entry per model
    top = top.withColumn("at_top", F.transform(F.filter("all", lambda x: x["rate"] == F.col("best_rate")), lambda x: x["model"]))
    return top.select(*keys, F.when((F.size("at_top") > 1) | ((F.col("best_rate") == 0) & F.lit(n_models > 1)), "tie").otherwise(t.short_name(F.col("at_top")[0])).alias("winner"))


def summary(df: DataFrame, digits: int = 6, correct: str = "correct", model: str = "model", task: str = "task_type") -> DataFrame:
    """Accuracy by model and by model and task, blank tasks as ``unknown``; the model's own row ``is_total``."""
    named = df.withColumn(task, F.coalesce(F.nullif(F.col(task), F.lit("")), F.lit("unknown")))
    return accuracy_with_totals(named, correct, model, task).withColumn("accuracy", t.rate(F.col("correct"), F.col("total"), digits))


def nested_summary(flat: DataFrame) -> DataFrame:
    """:func:`summary` as a row per model with a map of its tasks, for a JSON report."""
    entry = F.struct("task_type", F.struct("correct", "total", "accuracy"))
    total = lambda c: F.max(F.when(F.col("is_total"), F.col(c))).alias(c)
    tasks = F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("is_total"), entry))))
    return flat.groupBy("model").agg(total("correct"), total("total"), total("accuracy"), tasks.alias("by_task"))


def flat_rates(df: DataFrame, flags: dict[str, str], task: str = "task_type", digits: int = 4, round_total: bool = True, drop_blank: bool = False) -> DataFrame:
    """Rates of flags overall (``is_total``) and by task, from one aggregation. ``drop_blank`` leaves blank
    tasks out of the rows by task, but not out of the overall row."""
    by = df.select(F.col(task).alias("task"), *[as_long(F.col(c)).alias(f"__{name}") for name, c in flags.items()])
    sets = by.groupingSets([[F.col("task")], []], F.col("task"))
    out = sets.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"__{name}").alias(f"__{name}") for name in flags], F.grouping("task").alias("g"))
    if drop_blank:
        out = out.filter((F.col("g") == 1) | (F.coalesce(F.col("task"), F.lit("")) != ""))
    exact = lambda name: F.try_divide(F.col(f"__{name}").cast("double"), F.col("n").cast("double"))
    rate = lambda name: F.when((F.col("g") == 1) & F.lit(not round_total), exact(name)).otherwise(F.bround(exact(name), digits))
    return out.select(*_named("task"), "n", *[rate(name).alias(name) for name in flags])


def quality_metrics(df: DataFrame, model: str = "model") -> DataFrame:
    """Match and parse rates, mean words of reasoning, mean time of rows whose time isn't negative; 0 for none."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return df.groupBy(model).agg(
        mean(as_long(F.col("correct")).cast("double")).alias("match_rate"),
        mean(as_long(F.col("parse_success")).cast("double")).alias("parse_rate"),
        mean(t.word_count(F.col("reasoning")).cast("double")).alias("avg_words"),
        mean(F.when(F.col("gen_time") >= 0, F.col("gen_time"))).alias("avg_time"),
    )


def value_counts(df: DataFrame, column: str, ordinal: str, top: int | None = None) -> DataFrame:
    """Counts by value; with ``top`` the most frequent ones, ties by first appearance."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("__first"))
    if top is not None:
        counts = counts.orderBy(F.desc("n"), "__first").limit(top)
    return counts.drop("__first")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def costs(df: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Token totals and cost per model. Only the totals, a row per model, meet the price table."""
    totals = df.groupBy(model).agg(F.sum(F.coalesce("tokens_in", F.lit(0))).cast("long").alias("tokens_in"), F.sum(F.coalesce("tokens_out", F.lit(0))).cast("long").alias("tokens_out"))
    priced = totals.join(prices, model, "left")
    return priced.select(model, "tokens_in", "tokens_out", ((F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6).alias("cost"))


def gate(df: DataFrame, order: list[Column], rows: int, least: float) -> DataFrame:
    """The pilot gate: parse and match rate of the first ``rows`` rows, and whether both reach ``least``."""
    first = df.orderBy(*order).limit(rows)
    rates = first.agg(F.count(F.lit(1)).alias("n"), F.avg(as_long(F.col("parse_success"))).alias("parse_rate"), F.avg(as_long(F.col("correct"))).alias("match_rate"))
    return rates.withColumn("passed", F.coalesce((F.col("parse_rate") >= least) & (F.col("match_rate") >= least), F.lit(False)))


def first_failures(df: DataFrame, order: list[Column], k: int = 3) -> DataFrame:
    return df.filter(~F.coalesce("parse_success", F.lit(False)) | ~F.coalesce("correct", F.lit(False))).orderBy(*order).limit(k)


def recommendation(metrics: DataFrame, model: str = "model") -> DataFrame:
    """The best model by match rate and then parse rate, the first by name among equals, and the second;
    no row for fewer than two models. ``metrics`` has a row per model."""
    two = metrics.orderBy(F.desc("match_rate"), F.desc("parse_rate"), model).limit(2)
    ranked = two.agg(F.sort_array(F.collect_list(F.struct("match_rate", "parse_rate", F.col(model).alias("m")))).alias("x"))
    ranked = ranked.filter(F.size("x") == 2)
    # sort_array is ascending, also by name: of two equals the first name wins
    equal = (F.col("x")[0]["match_rate"] == F.col("x")[1]["match_rate"]) & (F.col("x")[0]["parse_rate"] == F.col("x")[1]["parse_rate"])
    best, second = F.when(equal, F.col("x")[0]).otherwise(F.col("x")[1]), F.when(equal, F.col("x")[1]).otherwise(F.col("x")[0])
    return ranked.select(best["m"].alias("winner"), best["match_rate"].alias("winner_rate"), second["m"].alias("second"), second["match_rate"].alias("second_rate"))


def done_counters(df: DataFrame, failed: Column, task: str = "task_type") -> DataFrame:
    """Per task: rows done without failing, parsed, correct; and a row that ``is_total``, whose ``done`` counts failed rows too."""
    flags = df.select(F.col(task).alias("task"), failed.cast("long").alias("f"), as_long(F.col("parse_success")).alias("p"), as_long(F.col("correct")).alias("c"))
    both = flags.groupingSets([[F.col("task")], []], F.col("task"))
    out = both.agg(F.sum(1 - F.col("f")).alias("ok"), F.count(F.lit(1)).alias("all"), F.sum("f").alias("errors"), F.sum(F.col("p") * (1 - F.col("f"))).alias("parse_ok"), F.sum(F.col("c") * (1 - F.col("f"))).alias("correct"), F.grouping("task").alias("g"))
    return out.select(*_named("task"), F.when(F.col("g") == 1, F.col("all")).otherwise(F.col("ok")).alias("done"), "errors", "parse_ok", "correct")


def write_with_progress(df: DataFrame, failed: Column, tasks: list[str], write: Callable[[DataFrame], None], task: str = "task_type") -> list[tuple[str | None, int, int, int, int]]:
    """Write all rows, and return (task, done, errors, parse_ok, correct) of each of ``tasks`` and, as task None, of all rows, counted by the
    job that writes. In the last one ``done`` counts failed rows too, and other tasks' rows."""
    ok, right = F.coalesce("parse_success", F.lit(False)), F.coalesce("correct", F.lit(False))
    flags = {"done": ~failed, "errors": failed, "parse_ok": ~failed & ok, "correct": ~failed & right}
    per_task = {f"{i}:{name}": (F.col(task) == x) & flag for i, x in enumerate(tasks) for name, flag in flags.items()}
    rows, seen = counted(df, per_task | {f"all:{name}": flag for name, flag in (flags | {"done": F.lit(True)}).items()})
    write(rows)
    return [(x, *(seen.get[f"{i}:{name}"] for name in flags)) for i, x in [*enumerate(tasks), ("all", None)]]


def correct_models(results: DataFrame, ordinal: str, id_col: str = "id", model: str = "model", keep: list[str] | None = None) -> DataFrame:
    """Per id the models with a correct result, each with its first one, in the order of those results."""
    keep = keep or []
    # not a filter: it would be pushed below the scoring and score every row twice
    rows = results.withColumn("__right", F.when(F.col("correct"), F.col(ordinal)))
    first = rows.groupBy(id_col, model).agg(F.min("__right").alias("__n"), *[F.min_by(c, "__right").alias(c) for c in keep]).filter("__n is not null")
    models = F.transform(F.array_sort(F.collect_list(F.struct("__n", model, *keep))), lambda x: F.struct(x[model].alias("model"), *[x[c].alias(c) for c in keep]))
    return first.groupBy(id_col).agg(models.alias("correct_models"))


def moving_average(df: DataFrame, group: str, ordinal: str, value: str, rows: int, workers: int, *, block: int = 50_000) -> DataFrame:
    """Mean of the last ``rows`` values of a run, and the time left at ``workers`` at once, for each row.

    A run (``group``) is one generator's log, in the order of its completions. A run may be long, so it
    is cut into blocks by position, each with the ``rows`` - 1 rows before it."""
    ranked = with_rank(df, F.col(group), F.col(ordinal), name="__rank")
    sizes = ranked.groupBy(group).agg(F.min("__rank").alias("__first"), F.count(F.lit(1)).alias("__total")).withColumnRenamed(group, "__group")
    ranked = ranked.join(sizes, F.col(group).eqNullSafe(F.col("__group"))).withColumn("done", F.col("__rank") - F.col("__first") + 1).drop("__group")
    own = F.floor((F.col("done") - 1) / block)
    last = F.floor((F.col("done") + rows - 2) / block)
    blocks = ranked.withColumn("__block", F.explode(F.sequence(own, F.greatest(own, F.least(last, F.floor((F.col("__total") - 1) / block)))))).withColumn("__own", F.col("__block") == own)
    w = Window.partitionBy(group, "__block").orderBy("done")
    out = blocks.withColumn("recent", F.avg(value).over(w.rowsBetween(-(rows - 1), 0))).filter("__own")
    return out.withColumn("seconds_left", (F.col("__total") - F.col("done")) * F.col("recent") / workers).drop("__rank", "__first", "__total", "__block", "__own")


def every(df: DataFrame, done: str, n: int) -> DataFrame:
    """Every n-th row of a progress log."""
    return df.filter(F.col(done) % n == 0)


def sample_picks(first_model: DataFrame, ordinal: str, k: int, task: str = "task_type", id_col: str = "id") -> DataFrame:
    """Rows to show: the first wrong row of each task, tasks by name, then tasks without one by appearance."""
    by_task = first_model.groupBy(task).agg(F.min(F.when(~F.col("correct"), F.struct(ordinal, id_col))).alias("wrong"), F.min(F.struct(ordinal, id_col)).alias("first"))
    picked = by_task.select(task, F.when(F.col("wrong").isNotNull(), 0).otherwise(1).alias("__late"), F.coalesce("wrong", "first").alias("row"))
    order = [F.col("__late"), F.when(F.col("__late") == 0, F.col(task)), F.col(f"row.{ordinal}")]
    return picked.orderBy(*order).limit(k).select(task, F.col(f"row.{id_col}").alias(id_col))


def length_stats(df: DataFrame, text_col: str, by: str) -> DataFrame:
    """Of the lengths of texts, in code points and in words, by group: rows, mean, median, 95th percentile and longest.

    Percentiles are exact; Spark counts distinct lengths for them, of which there are few."""
    measured = df.select(by, F.length(F.coalesce(text_col, F.lit(""))).alias("chars"), t.word_count(F.col(text_col)).alias("words"))
    of = lambda c: [F.avg(c).alias(f"mean_{c}"), F.percentile(c, 0.5).alias(f"median_{c}"), F.percentile(c, 0.95).alias(f"p95_{c}"), F.max(c).cast("long").alias(f"most_{c}")]
    return measured.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *of("chars"), *of("words"))
