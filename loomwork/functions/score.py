"""Normalisation and three answer scorers, which differ on purpose and keep their own names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import extract
from loomwork.functions import pytext as t


def normalised(value: Column, task: Column) -> Column:
    """An answer in its task's normal form."""
    s = t.strip(value)
    bare = F.btrim(s, F.lit(".,;: "))
    # ten decimals without trailing zeros
    digits = F.regexp_replace(t.ten_decimals(bare.try_cast("double")), r"\.?0+$", "")
    first_byte = F.regexp_extract(s, extract.BIN8, 0)
    return (
        F.when(task == "roman", F.regexp_replace(F.upper(s), f"[{t.SPACE}]+", ""))
        .when(task == "bit_manipulation", F.when(first_byte != "", first_byte).otherwise(F.replace(s, F.lit(" "), F.lit(""))))
        .when(task.isin(*extract.NUMERIC_TASKS), F.when(bare.rlike(t.FLOAT), digits).otherwise(bare))
        .when(task == "cipher_text", F.btrim(F.lower(t.collapse(s)), F.lit(" .,:;!?")))
        .when(task == "symbol_transform", s)
        .otherwise(t.collapse(s))
    )


def _text(value: Column) -> Column:
    return t.strip(F.coalesce(value, F.lit("None")))  # str(None)


def score_relative(pred: Column, gold: Column, task: Column) -> Column:
    """Roman without case; gravity and units within 1 % of max(|gold|, 1); everything else exact."""
    p, g = _text(pred), _text(gold)
    a, b = t.to_float(p), t.to_float(g)
    near = F.abs(a - b) / F.greatest(F.abs(b), F.lit(1.0)) < 0.01
    # near is null unless both sides are numbers
    return F.when(task == "roman", F.upper(p) == F.upper(g)).otherwise(F.coalesce(F.when(task.isin(*extract.NUMERIC_TASKS), near), p == g))


def score_lenient(pred: Column, gold: Column, task: Column) -> Column:
    """Roman without case; else within 5 % whenever both sides are numbers, whatever the task; else exact."""
    p, g = _text(pred), _text(gold)
    a, b = t.to_float(p), t.to_float(g)
    near = F.abs(a - b) < 0.05 * F.greatest(F.abs(b), F.lit(1.0))
    return F.when(F.coalesce(task, F.lit("")) == "roman", F.upper(p) == F.upper(g)).otherwise(F.coalesce(near, p == g))


def match_mode(pred_norm: Column, gold_norm: Column, task: Column, rel_tol: float = 1e-3, abs_tol: float = 1e-6) -> Column:
    """``exact``, ``numeric_tolerance`` (gravity and units only) or ``none`` for normalised answers."""
    a, b = t.to_float(pred_norm), t.to_float(gold_norm)
    apart = F.abs(a - b)  # infinite or NaN is never close
    close = (apart < float("inf")) & (apart <= F.greatest(F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol)))
    return F.when(pred_norm == gold_norm, "exact").when(task.isin(*extract.NUMERIC_TASKS) & close, "numeric_tolerance").otherwise("none")


def score_official(pred_norm: Column, gold_norm: Column, task: Column, rel_tol: float = 1e-3, abs_tol: float = 1e-6) -> Column:
    """struct(correct, match_mode) on normalised answers: exact, or close for gravity and units."""
    mode = match_mode(pred_norm, gold_norm, task, rel_tol, abs_tol)
    return F.struct((mode != "none").alias("correct"), mode.alias("match_mode"))


def with_result(df: DataFrame, text_col: str, gold_col: str, task_col: str, *, latency: str = "latency", ttft: str = "ttft", prompt_tokens: str = "prompt_tokens", completion_tokens: str = "completion_tokens", rel_tol: float = 1e-3, abs_tol: float = 1e-6) -> DataFrame:
    """The full result row: extraction, normal forms, official score, rounded times and token speeds."""
    df = extract.with_prediction(df, text_col, task_col)
    df = df.withColumns({"pred_normalised": normalised(F.col("pred"), F.col(task_col)), "gold_normalised": normalised(F.col(gold_col), F.col(task_col))})
    df = df.withColumn("match_mode", match_mode(F.col("pred_normalised"), F.col("gold_normalised"), F.col(task_col), rel_tol, abs_tol))
    first, took, p, c = F.col(ttft), F.col(latency), F.coalesce(F.col(prompt_tokens), F.lit(0)), F.coalesce(F.col(completion_tokens), F.lit(0))
    seconds = F.greatest(took - F.coalesce(first, F.lit(0.0)), F.lit(0.001))
    return df.withColumns(
        {
            "correct": F.col("match_mode") != "none",
            "latency_sec": F.bround(took, 4),
            "ttft_sec": F.when(first != 0, F.bround(first, 4)),
            "prefill_speed_tps": F.when((first > 0) & (p > 0), F.bround(F.try_divide(p.cast("double"), first), 1)),
            "gen_speed_tps": F.when(c > 0, F.bround(c / seconds, 1)),
        }
    )
