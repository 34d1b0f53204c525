"""Input relations for the queries, derived from the driver's tables by SQL that both engines read alike.

The SQL keeps to integer arithmetic, CASE and concatenation; ``{name}`` is a table. Line feed, backslash,
back quote and braces are chr(10), chr(92), chr(96), chr(123), chr(125), as string literals differ between the engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.sources.readers import exists
from loomwork.storage import fresh_path, table

TASKS = ("roman", "bit_manipulation", "gravity", "unit_conversion", "cipher_text", "symbol_transform", "")
MODELS = ("amber-1.5", "birch-2", "3.1-cedar", "dune")
#: Fixed prices per million tokens in and out, by model.
PRICES = {"amber-1.5": (0.075, 0.3), "birch-2": (0.8, 4.0), "3.1-cedar": (0.1, 0.5), "dune": (1.0, 5.0)}

_BASE = """
SELECT event_id AS n, CAST(floor(event_id / 4) AS BIGINT) AS s, event_id % 4 AS m, CAST(floor(abs(coalesce(value, 0)) * 100) AS BIGINT) AS v, user_id AS u
FROM {events}
"""

_GOLD = """
SELECT n, s, m, v, u, s % 7 AS k,
  CASE s % 7
    WHEN 0 THEN CASE s % 5 WHEN 0 THEN 'XIV' WHEN 1 THEN 'MCM' WHEN 2 THEN 'VII' WHEN 3 THEN 'XL' ELSE 'I' END
    WHEN 1 THEN lpad(bin(s % 256), 8, '0')
    WHEN 2 THEN concat(CAST(s % 900 AS STRING), '.', lpad(CAST(s % 100 AS STRING), 2, '0'))
    WHEN 3 THEN concat('-', CAST(s % 50 AS STRING), '.50')
    WHEN 4 THEN concat('Cat sees the ', CASE s % 3 WHEN 0 THEN 'Queen' WHEN 1 THEN 'dragon' ELSE 'old  Key' END)
    WHEN 5 THEN concat(CASE s % 2 WHEN 0 THEN '@#' ELSE concat(chr(123), '|') END, CAST(s % 10 AS STRING))
    ELSE concat('plain ', CAST(s % 10 AS STRING)) END AS gold
FROM (""" + _BASE + """) AS base
"""

_PRED = """
SELECT n, s, m, v, u, k, gold,
  CASE WHEN n % 7 < 4 THEN gold
       WHEN n % 7 = 4 AND k = 2 THEN concat(CAST(s % 900 AS STRING), '.', lpad(CAST((s + 3) % 100 AS STRING), 2, '0'))
       WHEN n % 7 = 4 THEN lower(gold)
       WHEN n % 7 = 5 AND k = 1 THEN CAST(s % 256 AS STRING)
       WHEN n % 7 = 5 THEN concat(gold, '0')
       ELSE concat('wrong ', CAST(n % 13 AS STRING)) END AS pred,
  concat('step ', CAST(n % 5 AS STRING), ' of', chr(10), '  the  rule ', CASE n % 3 WHEN 0 THEN 'holds' ELSE 'fails at 11' END) AS why
FROM (""" + _GOLD + """) AS g
"""

#: id, model, task_type, prompt, gold, raw, gen_time, ttft, tokens_in, tokens_out, n (the row's ordinal)
RESPONSES = """
SELECT concat('s', CAST(s AS STRING)) AS id,
  CASE m WHEN 0 THEN 'amber-1.5' WHEN 1 THEN 'birch-2' WHEN 2 THEN '3.1-cedar' ELSE 'dune' END AS model,
  CASE k WHEN 0 THEN 'roman' WHEN 1 THEN 'bit_manipulation' WHEN 2 THEN 'gravity' WHEN 3 THEN 'unit_conversion' WHEN 4 THEN 'cipher_text' WHEN 5 THEN 'symbol_transform' ELSE '' END AS task_type,
  CASE k WHEN 0 THEN 'In the Wonderland numeral system, write it.' WHEN 1 THEN 'A secret bit manipulation rule transforms 8-bit binary numbers.'
    WHEN 2 THEN 'The gravitational constant has been secretly changed.' WHEN 3 THEN 'Apply the secret unit conversion here.'
    WHEN 4 THEN 'Secret encryption rules are used on text.' WHEN 5 THEN 'A secret set of transformation rules is applied to equations.' ELSE 'Something else.' END AS prompt,
  gold,
  CASE n % 13
    WHEN 0 THEN concat('REASONING: ', why, chr(10), 'ANSWER: ', pred)
    WHEN 1 THEN concat('ANSWER: ', pred, ' REASONING: ', why)
    WHEN 2 THEN concat('REASONING: ', why)
    WHEN 3 THEN concat(why, ' ', chr(92), 'boxed', chr(123), pred, chr(125), ' end')
    WHEN 4 THEN concat(chr(92), 'boxed', chr(123), '1', chr(125), ' then ', chr(92), 'boxed', chr(123), 'x', chr(123), pred, chr(125), 'y', chr(125))
    WHEN 5 THEN concat(why, chr(10), 'Final answer : ', pred, chr(10), 'done')
    WHEN 6 THEN CASE n % 5 WHEN 0 THEN concat('<think>', why, ' ', pred) WHEN 1 THEN concat('<think>a<think>', why, '</think>', pred, '</think>')
      WHEN 2 THEN concat('x<think>', why, '</think>', pred, '<think>more</think> <think>') ELSE concat('<think>', why, '</think>', pred) END
    WHEN 7 THEN concat(why, chr(10), chr(96), pred, chr(96), chr(10))
    WHEN 8 THEN ''
    WHEN 9 THEN concat('  ', pred, '  ', chr(10), chr(10), ' ')
    WHEN 10 THEN concat('thus: no', chr(10), 'Therefore ： ', pred)
    WHEN 11 THEN concat(repeat('lorem ', 30), pred)
    ELSE concat('REASONING:', chr(10), why, chr(10), chr(10), 'ANSWER:', chr(10), ' ', pred, ' ', chr(10), 'x') END AS raw,
  CASE WHEN n % 17 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(1 + n % 40 AS DOUBLE) / 8 END AS gen_time,
  CASE WHEN n % 11 = 0 THEN CAST(NULL AS DOUBLE) WHEN n % 11 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(1 + n % 8 AS DOUBLE) / 16 END AS ttft,
  100 + n % 300 AS tokens_in, CASE WHEN n % 19 = 0 THEN 0 ELSE 20 + n % 90 END AS tokens_out, n
FROM (""" + _PRED + """) AS p
"""

#: id, prompt, answer, task_type, ordinal; some fields blank or null, ids repeated
PROBLEMS = """
SELECT CASE WHEN event_id % 9 = 0 THEN CAST(NULL AS STRING) ELSE concat('q', CAST(event_id % 400 AS STRING)) END AS id,
  CASE WHEN event_id % 10 = 1 THEN '   ' WHEN event_id % 10 = 2 THEN CAST(NULL AS STRING)
    WHEN event_id % 10 = 3 THEN concat(' The gravitational constant has been SECRETLY changed.', chr(10), 'Say "how", please ') ELSE concat('What is roman numeral ', CAST(event_id % 30 AS STRING), '? ') END AS prompt,
  CASE WHEN event_id % 12 = 5 THEN CAST(NULL AS STRING) ELSE concat(' a', CAST(event_id % 50 AS STRING), ' ') END AS answer,
  CASE WHEN event_id % 8 = 4 THEN ' Gravity ' ELSE CAST(NULL AS STRING) END AS task_type, event_id AS ordinal
FROM {events}
"""

#: id, text, quality_score, has_quality, known_words, needs_downweight; a document without a label lacks the key
QUALITY_ROWS = """
SELECT d.doc_id AS id, d.text, d.lang, d.source, l.doc_id IS NOT NULL AS has_quality,
  CASE WHEN l.doc_id % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(l.quality AS DOUBLE) * 0.75 END AS quality_score,
  CASE WHEN d.doc_id % 3 = 0 THEN CAST(d.doc_id % 700 AS BIGINT) ELSE CAST(NULL AS BIGINT) END AS known_words,
  d.doc_id % 4 = 0 AS needs_downweight
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""


def of_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The relation as a DataFrame."""
    used = {name: table(spark, sf_dir, name) for name in ("events", "documents", "labels") if f"{{{name}}}" in sql}
    return spark.sql(sql, **used)


_RECORDED: dict[tuple[str, str, str], str] = {}


def recorded(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """The relation as a table, written once for an application: responses are recorded data, and
    queries over them should read columns and not derive them anew."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    changed = max((s.getModificationTime() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)), default=0)
    key = (spark.sparkContext.applicationId, f"{sf_dir} {changed}", name)
    df = of_spark(spark, sf_dir, sql)
    if key not in _RECORDED or not exists(spark, _RECORDED[key]):
        path = fresh_path(spark, name)
        df.write.parquet(path)
        _RECORDED[key] = path
    return spark.read.schema(df.schema).parquet(_RECORDED[key])


def for_duckdb(sql: str) -> str:
    """The same relation as a subquery for DuckDB."""
    for name in ("events", "documents", "labels"):
        sql = sql.replace(f"{{{name}}}", name)
    return f"({sql.replace('AS STRING)', 'AS VARCHAR)')})"
