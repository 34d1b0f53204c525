"""Task inference, response parsing and answer extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import pytext as t

#: Phrases of prompts, in this order, and the task each one shows.
TASK_PHRASES = (
    ("wonderland numeral system", "roman"),
    ("roman numeral", "roman"),
    ("secret unit conversion", "unit_conversion"),
    ("gravitational constant has been secretly changed", "gravity"),
    ("secret encryption rules are used on text", "cipher_text"),
    ("bit manipulation rule transforms 8-bit binary numbers", "bit_manipulation"),
    ("secret set of transformation rules is applied to equations", "symbol_transform"),
)
NUMERIC_TASKS = ("gravity", "unit_conversion")
#: The patterns of answers.
BOXED = r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
SIGNED_NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
BIN8 = r"(?U)\b[01]{8}\b"
ROMAN = r"(?U)\b[IVXLCDM]+\b"
ANSWER_LINE = f"(?dim)(?:final answer|answer|result|therefore|thus)[{t.SPACE}]*[:：][{t.SPACE}]*(.+)$"
SHORT_LINE = 120


def task_type(explicit: Column, prompt: Column) -> Column:
    """An explicit task, stripped and in lower case; else what the first phrase found in the prompt says; else ''."""
    low = F.lower(prompt)
    found = F.lit("")
    for phrase, name in reversed(TASK_PHRASES):
        found = F.when(low.contains(phrase), name).otherwise(found)
    return F.coalesce(t.blank_to_null(F.lower(t.strip(explicit))), found, F.lit(""))


def parsed(text: Column) -> Column:
    """struct(reasoning, answer, parse_success) of ``REASONING: ... ANSWER: ...``.

    Reasoning runs to the first ``ANSWER:`` behind it or to the end, the answer from the first
    ``ANSWER:`` of the text to the end of its line. If either is missing the reasoning is the
    whole text and the answer ``PARSE_ERROR``."""
    answer = rf"(?d)ANSWER:[{t.SPACE}]*(.+?)(?:\n|$)"
    ok = text.rlike(r"REASONING:") & text.rlike(answer)
    return F.struct(
        t.strip(F.when(ok, F.regexp_extract(text, rf"(?s)REASONING:[{t.SPACE}]*(.*?)(?=ANSWER:|\z)", 1)).otherwise(text)).alias("reasoning"),
        F.when(ok, t.strip(F.regexp_extract(text, answer, 1))).otherwise(F.lit("PARSE_ERROR")).alias("answer"),
        ok.alias("parse_success"),
    )


def last_boxed(text: Column) -> Column:
    return t.strip(t.last(t.matches(text, BOXED, 1)))


def has_boxed(text: Column) -> Column:
    return text.rlike(BOXED)


def last_answer_line(text: Column) -> Column:
    """The last labelled answer; else the last line of at most 120 characters; else the last line; else null."""
    all_lines = t.lines(text)
    short = F.filter(all_lines, lambda x: F.length(x) <= SHORT_LINE)
    return F.coalesce(t.strip(t.last(t.matches(text, ANSWER_LINE, 1))), t.last(short), t.last(all_lines))


def simple_answer(text: Column) -> Column:
    """Boxed, else the last number, else the last line; '' where there is none of them."""
    return F.coalesce(last_boxed(text), t.last(t.matches(text, NUMBER)), t.last(t.lines(text)), F.lit(""))


def with_prediction(df: DataFrame, text_col: str, task_col: str) -> DataFrame:
    """Add ``pred`` and ``extract_method``. Every pattern is run once, as a column of its own."""
    text, task = F.coalesce(F.col(text_col), F.lit("")), F.col(task_col)
    df = df.withColumns({"__boxed": last_boxed(text), "__line": last_answer_line(text)})
    df = df.withColumns(
        {
            "__bin": F.when(task == "bit_manipulation", t.last(t.matches(text, BIN8))),
            "__roman": F.when(task == "roman", t.last(t.matches(text, ROMAN))),
            "__number": F.when(task.isin(*NUMERIC_TASKS), t.last(t.matches(text, SIGNED_NUMBER))),
        }
    )
    line = F.col("__line")
    unquoted = t.strip(F.btrim(t.strip(line), F.lit("`")))
    no_quotes = F.btrim(F.btrim(unquoted, F.lit('"')), F.lit("'"))
    one = lambda value, name: F.struct(value.alias("pred"), F.lit(name).alias("extract_method"))
    found = (
        F.when(F.col("__boxed").isNotNull(), one(F.col("__boxed"), "boxed"))
        .when(F.col("__bin").isNotNull(), one(F.col("__bin"), "heuristic_bin8"))
        .when(F.col("__roman").isNotNull(), one(F.col("__roman"), "heuristic_roman"))
        .when(F.col("__number").isNotNull(), one(F.col("__number"), "heuristic_numeric"))
        .when((task == "symbol_transform") & (line != ""), one(unquoted, "heuristic_symbol_line"))
        .when((task == "cipher_text") & (line != ""), one(no_quotes, "heuristic_text_line"))
        .when(line.isNotNull(), one(t.strip(line), "heuristic"))
        .otherwise(one(F.lit(""), "empty"))
    )
    return df.withColumn("__found", found).withColumns({"pred": F.col("__found.pred"), "extract_method": F.col("__found.extract_method")}).drop("__boxed", "__line", "__bin", "__roman", "__number", "__found")


def think_split(text: Column) -> Column:
    """struct(thinking, answer): what stands behind <think>, up to </think> or the end, and the rest; tags go."""
    thinking = F.replace(F.array_join(t.matches(text, r"(?s)<think>(.*?)(?:</think>|\z)", 1), ""), F.lit("<think>"), F.lit(""))
    answer = F.replace(F.regexp_replace(text, r"(?s)<think>.*?(?:</think>|\z)", ""), F.lit("</think>"), F.lit(""))
    return F.struct(thinking.alias("thinking"), answer.alias("answer"))
