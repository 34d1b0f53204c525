"""Literal cases of text rules, extraction and scoring."""

from __future__ import annotations

import math
import random
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import extract, score
from loomwork.functions import pytext as t


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_strip_and_collapse(spark):
    texts = [" a ", "\t b\n", " c  d　", "", "   "]
    assert column(spark, texts, t.strip) == [x.strip() for x in texts]
    assert column(spark, texts, t.collapse) == [" ".join(x.split()) for x in texts]


def test_to_float(spark):
    cases = {"1": 1.0, "-1.5e3": -1500.0, ".5": 0.5, "5.": 5.0, "inf": math.inf, "-Infinity": -math.inf, "1_000": None, "1.0d": None, "0x1p3": None, "": None, "abc": None}
    assert column(spark, list(cases), t.to_float) == list(cases.values())
    assert math.isnan(column(spark, ["NaN"], t.to_float)[0])


@pytest.mark.parametrize(
    "text, expected",
    [
        ("REASONING: a\nb\nANSWER: 42\nx", ("a\nb", "42", True)),
        ("ANSWER: 1 REASONING: z", ("z", "1 REASONING: z", True)),
        ("REASONING: only", ("REASONING: only", "PARSE_ERROR", False)),
        ("REASONING: ANSWER: 7", ("", "7", True)),
        ("", ("", "PARSE_ERROR", False)),
        ("REASONING:\u2003r ANSWER:\u00a0\n42", ("r", "42", True)),
        ("REASONING: r ANSWER:\x1c\x85\u3000\n 7 \nx", ("r", "7", True)),
    ],
)
def test_parsed(spark, text, expected):
    assert tuple(value(spark, extract.parsed(F.lit(text)))) == expected


def test_boxed_and_lines(spark):
    assert value(spark, extract.last_boxed(F.lit(r"\boxed{1} … \boxed{x{2}y}"))) == "x{2}y"
    assert value(spark, extract.last_boxed(F.lit("none"))) is None
    assert value(spark, extract.last_answer_line(F.lit("Result： 5\nthus: 6 \nend"))) == "6"
    assert value(spark, extract.last_answer_line(F.lit("short\n" + "x" * 121))) == "short"
    assert value(spark, extract.last_answer_line(F.lit("x" * 121))) == "x" * 121
    assert value(spark, extract.last_answer_line(F.lit(" \n "))) is None
    assert value(spark, extract.simple_answer(F.lit(""))) == ""


def test_cascade(spark):
    rows = [("a \\boxed{ 3 }", "roman", "3", "boxed"), ("x 01010101 y 11110000", "bit_manipulation", "11110000", "heuristic_bin8"), ("is XIV or IX.", "roman", "IX", "heuristic_roman"), ("+3.5 then -4", "gravity", "-4", "heuristic_numeric"), ("`@#`", "symbol_transform", "@#", "heuristic_symbol_line"), ("`\"cat\"`", "cipher_text", "cat", "heuristic_text_line"), ("plain", "", "plain", "heuristic"), ("", "gravity", "", "empty"), (None, "roman", "", "empty")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, task string, want string, method string")
    for r in extract.with_prediction(df, "text", "task").collect():
        assert (r["pred"], r["extract_method"]) == (r["want"], r["method"])


def test_task_type(spark):
    assert value(spark, extract.task_type(F.lit(" Gravity "), F.lit("roman numeral"))) == "gravity"
    assert value(spark, extract.task_type(F.lit("  "), F.lit("A Roman Numeral"))) == "roman"
    assert value(spark, extract.task_type(F.lit(None).cast("string"), F.lit("other"))) == ""


@pytest.mark.parametrize(
    "scorer, pred, gold, task, expected",
    [
        (score.score_relative, "100.9", "100", "gravity", True),
        (score.score_relative, "0.009", "0", "gravity", True),
        (score.score_relative, "101", "100", "gravity", False),
        (score.score_relative, "n/a", "n/a", "gravity", True),
        (score.score_relative, "xiv", "XIV", "roman", True),
        (score.score_relative, "1", "00000001", "bit_manipulation", False),
        (score.score_relative, "nan", "1", "gravity", False),
        (score.score_lenient, "1", "00000001", "bit_manipulation", True),
        (score.score_lenient, "104", "100", "", True),
        (score.score_lenient, "106", "100", "", False),
    ],
)
def test_scorers(spark, scorer, pred, gold, task, expected):
    assert value(spark, scorer(F.lit(pred), F.lit(gold), F.lit(task))) is expected


@pytest.mark.parametrize("text, task, expected", [(" 19.00. ", "gravity", "19"), ("-0.50", "unit_conversion", "-0.5"), ("100", "gravity", "100"), ("x1", "gravity", "x1"), ("inf", "gravity", "inf"), ("x i v", "roman", "XIV"), ("a 00001111 b", "bit_manipulation", "00001111"), ("1 0", "bit_manipulation", "10"), (" The  Cat. ", "cipher_text", "the cat"), (" a  b ", "", "a b")])
def test_normalised(spark, text, task, expected):
    assert value(spark, score.normalised(F.lit(text), F.lit(task))) == expected


def test_official(spark):
    official = lambda p, g, task: tuple(value(spark, score.score_official(F.lit(p), F.lit(g), F.lit(task))))
    assert official("100.05", "100", "gravity") == (True, "numeric_tolerance")
    assert official("a", "a", "") == (True, "exact")
    assert official("inf", "5", "gravity") == (False, "none")
    assert official("1", "01", "roman") == (False, "none")


@pytest.mark.parametrize(
    ("text", "thinking", "answer"),
    [
        ("<think>abc truncated", "abc truncated", ""),
        ("<think>a</think>b", "a", "b"),
        ("x<think>a<think>b</think>c</think>d", "ab", "xcd"),
        ("<think>a</think>b<think>c</think>d<think>e", "ace", "bd"),
        ("a</think>b", "", "ab"),
        ("", "", ""),
        ("<think>", "", ""),
    ],
)
def test_think_split(spark, text, thinking, answer):
    assert tuple(value(spark, extract.think_split(F.lit(text)))) == (thinking, answer)


def test_labels(spark):
    assert column(spark, ["amber-1.5", "3.1-cedar", "1-2", ""], t.short_name) == ["amber", "cedar", "1", ""]
    assert value(spark, t.percent_label(F.lit(2), F.lit(3))) == "2/3  66%"
    assert value(spark, t.percent_label(F.lit(0), F.lit(0))) == "0/0  0%"
    assert value(spark, t.limit_from_json(F.lit("a"), "not json", 5)) == 5


TEXT = st.text(alphabet=st.sampled_from("ab 1\n\t.{}\\é "), max_size=40)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_properties(spark, texts):
    assert column(spark, texts, t.strip) == [x.strip() for x in texts]
    assert column(spark, texts, t.word_count) == [len(x.split()) for x in texts]
    assert all(column(spark, texts, lambda v: score.score_relative(v, v, F.lit("gravity"))))


def test_word_borders_follow_unicode(spark):
    cases = {"x 10101010 y": "10101010", "é10101010": None, "10101010ñ": None, "漢10101010 11110000": "11110000"}
    assert column(spark, list(cases), lambda c: t.last(t.matches(c, extract.BIN8))) == list(cases.values())
    assert column(spark, ["éXIV", "XIV é", "XIVñ"], lambda c: t.last(t.matches(c, extract.ROMAN))) == [None, "XIV", None]
    assert column(spark, ["Answer\u00a0:\u2003 5", "thus\u3000：\x1f6"], extract.last_answer_line) == ["5", "6"]


def test_ten_decimals_are_those_of_python(spark):
    rng = random.Random(3)
    ties = [(2 * rng.randint(0, 10**6) + 1) / 2**k for k in (11, 12, 20) for _ in range(300)]
    some = [0.0, -0.0, 1e22, 1e23, 2.0**63, 2.0**63 - 1024, 9.99999999995, 0.99999999995, 5e-11, 1.5e-10, 5e-324, -1e-20, 2.0**-34, 2.0**-35, 3 * 2.0**-36, 1.7976931348623157e308, math.inf, -math.inf, math.nan]
    drawn = [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(1500)] + [rng.random() * 10 ** rng.randint(-14, 20) for _ in range(1500)]
    values = [*some, *ties, *drawn]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(t.ten_decimals(F.col("x"))).collect()]
    assert [(x, g) for x, g in zip(values, got) if g != f"{x:.10f}"] == []
    assert value(spark, score.normalised(F.lit("0.00048828125"), F.lit("gravity"))) == "0.0004882812"
