"""The same queries in DuckDB's SQL, written from the semantics and not from the Spark plans.

DuckDB's regular expressions have no look-ahead and ASCII classes; the inputs hold ASCII white space only."""

from __future__ import annotations

from loomwork.plans import derived

RESPONSES = derived.for_duckdb(derived.RESPONSES)
PROBLEMS = derived.for_duckdb(derived.PROBLEMS)
QUALITY = derived.for_duckdb(derived.QUALITY_ROWS)

BOXED = r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
FLOAT = r"^(?i)[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?|nan)$"
LINE = "(?im)(?:final answer|answer|result|therefore|thus)\\s*[:：]\\s*(.+)$"
NUMERIC = "('gravity', 'unit_conversion')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def to_float(x: str) -> str:
    return f"(CASE WHEN regexp_matches({strip(x)}, '{FLOAT}') THEN TRY_CAST({strip(x)} AS DOUBLE) END)"


def last(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, '{pattern}', {group})[-1]"


def collapse(x: str) -> str:
    return rf"regexp_replace({strip(x)}, '\s+', ' ', 'g')"


def words(x: str) -> str:
    return rf"coalesce(len(regexp_extract_all({x}, '\S+')), 0)"


LINES = r"list_filter(list_transform(string_split(raw, chr(10)), lambda x: " + strip("x") + "), lambda x: x <> '')"
ANSWER_LINE = f"coalesce({strip(last('raw', LINE, 1))}, list_filter({LINES}, lambda x: length(x) <= 120)[-1], ({LINES})[-1])"
BOXED_LAST = strip(last("raw", BOXED, 1))
SIMPLE = rf"coalesce({BOXED_LAST}, {last('raw', r'-?[0-9]+(?:\.[0-9]+)?')}, ({LINES})[-1], '')"


def relative(p: str, g: str, task: str = "task_type") -> str:
    a, b = to_float(p), to_float(g)
    return f"""(CASE WHEN {task} = 'roman' THEN upper({strip(p)}) = upper({strip(g)})
      WHEN {task} IN {NUMERIC} AND {a} IS NOT NULL AND {b} IS NOT NULL THEN abs({a} - {b}) / greatest(abs({b}), 1) < 0.01
      ELSE {strip(p)} = {strip(g)} END)"""


def lenient(p: str, g: str, task: str = "task_type") -> str:
    a, b = to_float(p), to_float(g)
    return f"""(CASE WHEN {task} = 'roman' THEN upper({strip(p)}) = upper({strip(g)})
      WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN abs({a} - {b}) < 0.05 * greatest(abs({b}), 1) ELSE {strip(p)} = {strip(g)} END)"""


def normal(x: str) -> str:
    bare = f"trim({strip(x)}, '.,;: ')"
    return rf"""(CASE WHEN task_type = 'roman' THEN regexp_replace(upper({strip(x)}), '\s+', '', 'g')
      WHEN task_type = 'bit_manipulation' THEN coalesce(nullif(regexp_extract({strip(x)}, '\b[01]{{8}}\b'), ''), replace({strip(x)}, ' ', ''))
      WHEN task_type IN {NUMERIC} THEN coalesce(rtrim(rtrim(printf('%.10f', {to_float(bare)}), '0'), '.'), {bare})
      WHEN task_type = 'cipher_text' THEN trim(lower({collapse(x)}), ' .,:;!?')
      WHEN task_type = 'symbol_transform' THEN {strip(x)} ELSE {collapse(x)} END)"""


PARSED = rf"""(SELECT *, CASE WHEN ok THEN {strip("regexp_extract(raw, '(?s)REASONING:\\s*(.*?)(?:ANSWER:|\\z)', 1)").replace(chr(92) * 2, chr(92))} ELSE {strip('raw')} END AS reasoning,
  CASE WHEN ok THEN {strip("regexp_extract(raw, 'ANSWER:QQ(.+?)(?:QN|$)', 1)").replace('QQ', chr(92) + 's*').replace('QN', chr(92) + 'n')} ELSE 'PARSE_ERROR' END AS answer, ok AS parse_success
  FROM (SELECT *, contains(raw, 'REASONING:') AND regexp_matches(raw, 'ANSWER:\s*(.+?)(?:\n|$)') AS ok FROM {RESPONSES}))"""
SCORED = f"(SELECT *, {relative('answer', 'gold')} AS correct FROM {PARSED})"

_FOUND = f"""(SELECT *, {BOXED_LAST} AS boxed, {ANSWER_LINE} AS line,
  CASE WHEN task_type = 'bit_manipulation' THEN {last('raw', r'\b[01]{8}\b')} END AS bin8,
  CASE WHEN task_type = 'roman' THEN {last('raw', r'\b[IVXLCDM]+\b')} END AS rom,
  CASE WHEN task_type IN {NUMERIC} THEN {last('raw', r'[-+]?[0-9]+(?:\.[0-9]+)?')} END AS num FROM {RESPONSES})"""
_UNQUOTED = strip("trim(line, '`')")
CASCADE = f"""(SELECT *, CASE WHEN boxed IS NOT NULL THEN boxed WHEN bin8 IS NOT NULL THEN bin8 WHEN rom IS NOT NULL THEN rom WHEN num IS NOT NULL THEN num
    WHEN task_type = 'symbol_transform' AND line <> '' THEN {_UNQUOTED}
    WHEN task_type = 'cipher_text' AND line <> '' THEN trim(trim({_UNQUOTED}, '"'), '''') ELSE coalesce({strip('line')}, '') END AS pred,
  CASE WHEN boxed IS NOT NULL THEN 'boxed' WHEN bin8 IS NOT NULL THEN 'heuristic_bin8' WHEN rom IS NOT NULL THEN 'heuristic_roman' WHEN num IS NOT NULL THEN 'heuristic_numeric'
    WHEN task_type = 'symbol_transform' AND line <> '' THEN 'heuristic_symbol_line' WHEN task_type = 'cipher_text' AND line <> '' THEN 'heuristic_text_line'
    WHEN line IS NOT NULL THEN 'heuristic' ELSE 'empty' END AS extract_method FROM {_FOUND})"""
NORMALISED = f"(SELECT *, {normal('pred')} AS pn, {normal('gold')} AS gn FROM {CASCADE})"
_A, _B = to_float("pn"), to_float("gn")
RESULTS = f"""(SELECT *, match_mode <> 'none' AS correct FROM (SELECT *, CASE WHEN pn = gn THEN 'exact'
    WHEN task_type IN {NUMERIC} AND abs({_A} - {_B}) <= greatest(1e-3 * greatest(abs({_A}), abs({_B})), 1e-6) THEN 'numeric_tolerance' ELSE 'none' END AS match_mode FROM {NORMALISED}))"""

_SPLIT = "(SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS position, count(*) OVER () AS total FROM documents)"
_TRAIN = f"(SELECT * FROM {_SPLIT} WHERE position > floor(total * 0.1))"


def strata(source: str, stratum: str, order: str, total: int) -> str:
    return f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY {order}) AS rn, dense_rank() OVER (ORDER BY {stratum}) - 1 AS i FROM {source}),
      c AS (SELECT count(DISTINCT {stratum}) AS k FROM {source})
      SELECT {{columns}} FROM t, c WHERE rn <= {total} // k + CASE WHEN i < {total} % k THEN 1 ELSE 0 END"""


def _robin(source: str, stratum: str, key: str, total: int) -> str:
    return f"""SELECT {{columns}} FROM (SELECT *, row_number() OVER (PARTITION BY st ORDER BY md5('42:' || {key}::VARCHAR), {key}) AS rn FROM (SELECT *, coalesce(nullif({stratum}, ''), 'unknown') AS st FROM {source})) ORDER BY rn, st LIMIT {total}"""


_Q_OK = "(CASE WHEN has_quality THEN coalesce(quality_score, 0) >= 0.5 ELSE true END)"
_W_OK = f"(coalesce(nullif(known_words, 0), {words('text')}) <= 400)"
_S_OK = "(NOT coalesce(needs_downweight, false) OR ('0x' || substr(md5('42:' || id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 <= 0.5)"
_RATES = "count(*) AS n, round_even(avg(correct::INT), 4) AS accuracy, round_even(avg(has_boxed::INT), 4) AS boxed_rate"
_BOX = f"regexp_matches(raw, '{BOXED}')"
_FIRST_TWO = "row_number() OVER (ORDER BY match_rate DESC, parse_rate DESC, model)"
_METRICS = f"SELECT model, avg(correct::INT) AS match_rate, avg(parse_success::INT) AS parse_rate, avg({words('reasoning')}) AS avg_words, coalesce(avg(CASE WHEN gen_time >= 0 THEN gen_time END), 0) AS avg_time FROM {SCORED} GROUP BY model"
_TOTALS = f"SELECT model, CASE WHEN grouping(task_type) = 1 THEN 'TOTAL' ELSE task_type END AS task_type, grouping(task_type) = 1 AS is_total, sum(correct::INT)::BIGINT AS correct, count(*) AS total FROM {SCORED} GROUP BY GROUPING SETS ((model, task_type), (model))"
_SUMMARY = f"""SELECT model, CASE WHEN grouping(task) = 1 THEN 'TOTAL' ELSE task END AS task_type, grouping(task) = 1 AS is_total, sum(correct::INT)::BIGINT AS correct, count(*) AS total, round_even(sum(correct::INT) / count(*), 6) AS accuracy
  FROM (SELECT *, coalesce(nullif(task_type, ''), 'unknown') AS task FROM {RESULTS}) GROUP BY GROUPING SETS ((model, task), (model))"""
_SHORT = "coalesce(list_filter(string_split(model, '-'), lambda p: p <> '' AND NOT regexp_matches(replace(p, '.', ''), '^[0-9]+$'))[1], string_split(model, '-')[1])"
_MOVING = f"""SELECT *, row_number() OVER w AS done, avg(gen_time) OVER (PARTITION BY model ORDER BY n ROWS 99 PRECEDING) AS recent, count(*) OVER (PARTITION BY model) AS total FROM {RESPONSES} WINDOW w AS (PARTITION BY model ORDER BY n)"""
_KEPT = f"SELECT *, row_number() OVER (ORDER BY ordinal) AS rn, {strip('prompt')} AS p, {strip('answer')} AS a FROM {PROBLEMS} WHERE {strip('coalesce(prompt, chr(32))')} <> '' AND {strip('coalesce(answer, chr(32))')} <> ''"

ORACLES = {
    "a1_csv_scan": f"SELECT id, prompt, answer, task_type, ordinal FROM {PROBLEMS}",
    "a2_csv_normalise": f"""SELECT coalesce(id, 'row_' || (rn - 1)) AS sample_id, p AS prompt, a AS answer,
      CASE WHEN task_type IS NOT NULL THEN lower({strip('task_type')}) WHEN contains(lower(p), 'roman numeral') THEN 'roman' WHEN contains(lower(p), 'gravitational') THEN 'gravity' ELSE '' END AS task_type, ordinal FROM ({_KEPT})""",
    "a3_jsonl_strict": f"SELECT id, model, raw, gen_time, n FROM {RESPONSES}",
    "a4_jsonl_tolerant": f"SELECT id, n FROM {RESPONSES} WHERE n % 5 > 2",
    "a5_jsonl_alias": """SELECT CASE WHEN event_id % 3 = 0 THEN 'jsonl_' || (2 * place) ELSE 'j' || event_id END AS sample_id, CASE event_id % 4 WHEN 0 THEN 'roman numeral' WHEN 1 THEN 'u' ELSE 'p' END AS prompt,
      CASE event_id % 7 WHEN 0 THEN '7' WHEN 1 THEN 't' WHEN 2 THEN '0' WHEN 3 THEN 'false' WHEN 4 THEN 'True' WHEN 5 THEN '2.5' ELSE 'a' END AS answer,
      2 * place AS line, CASE event_id % 4 WHEN 0 THEN 'roman' ELSE '' END AS task_type FROM (SELECT event_id, row_number() OVER (PARTITION BY event_id // 5000 ORDER BY event_id) - 1 AS place FROM events) WHERE event_id % 4 <> 3""",
    "a6_multi_file_scan": f"SELECT id, n, CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS origin, 1::BIGINT AS n_missing FROM {RESPONSES}",
    "a7_append_sink": f"SELECT id, model, n FROM {RESPONSES} WHERE n % 3 = 0 OR id NOT IN (SELECT id FROM {RESPONSES} WHERE n % 3 = 0)",
    "a8_ordered_sink": f"SELECT id || '/' || model AS id, gold, row_number() OVER (ORDER BY n % 3 <> 0, n) AS position FROM {RESPONSES}",
    "a8_published": f"SELECT id, model, gold || '!' AS gold, n FROM {RESPONSES} WHERE n % 5 <> 0",
    "a9_split_sinks": f"SELECT doc_id, lang, CASE WHEN position <= floor(total * 0.1) THEN 'val' ELSE 'train' END AS split FROM {_SPLIT}",
    "a10_csv_sink": f"SELECT n, raw, gold FROM {RESPONSES}",
    "a11_json_report": _SUMMARY,
    "a12_settings": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('7:' || doc_id::VARCHAR), doc_id) <= floor(count(*) OVER () * 0.2) THEN 'val' ELSE 'train' END AS split, 400 AS max_words FROM documents",
    "a13_columns": " UNION ALL ".join(
        f"SELECT {i} AS place, '{c}' AS name, (SELECT count({c}) FROM documents) AS present, (SELECT string_agg(coalesce({c}::VARCHAR, 'null'), '|' ORDER BY doc_id) FROM (SELECT doc_id AS doc_id, * EXCLUDE (doc_id) FROM documents ORDER BY doc_id LIMIT 3)) AS head"
        for i, c in enumerate(("doc_id", "text", "lang", "source", "n_chars"))
    ),
    "b1_labelled": f"SELECT ordinal, task_type FROM {PROBLEMS} WHERE task_type IS NOT NULL AND {strip('task_type')} <> ''",
    "b2_not_empty": f"SELECT ordinal FROM ({_KEPT})",
    "b3_required": f"SELECT count(*) AS n FROM {RESPONSES}",
    "b4_quality_filter": f"SELECT id FROM {QUALITY} WHERE {_Q_OK}",
    "b4_quality_key_present": f"SELECT id FROM {QUALITY} WHERE {_Q_OK}",
    "b5_word_cap": f"SELECT id FROM {QUALITY} WHERE {_W_OK}",
    "b6_downweight": f"SELECT id FROM {QUALITY} WHERE {_S_OK}",
    "b7_reject_counts": f"SELECT CASE WHEN NOT {_Q_OK} THEN 'quality' WHEN NOT {_W_OK} THEN 'words' WHEN NOT {_S_OK} THEN 'downweight' ELSE 'kept' END AS reason, count(*) AS n FROM {QUALITY} GROUP BY 1",
    "b7_counted_write": f"""WITH r AS (SELECT CASE WHEN NOT {_Q_OK} THEN 'quality' WHEN NOT {_W_OK} THEN 'words' WHEN NOT {_S_OK} THEN 'downweight' ELSE 'kept' END AS reason FROM {QUALITY})
      SELECT v.reason, (SELECT count(*) FROM r WHERE r.reason = v.reason) AS n, (SELECT count(*) FROM r WHERE r.reason = 'kept') AS written FROM (VALUES ('quality'), ('words'), ('downweight'), ('kept')) AS v(reason)""",
    "b8_one_by_id": f"SELECT id, model, gold FROM {RESPONSES} WHERE id = 's17'",
    "b9_positive_time": f"SELECT model, avg(CASE WHEN gen_time >= 0 THEN gen_time END) AS avg_time FROM {RESPONSES} GROUP BY model",
    "b10_first_failures": f"SELECT id, model, answer, gold FROM {SCORED} WHERE NOT parse_success OR NOT correct ORDER BY n LIMIT 3",
    "b11_shortened": "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS shown FROM documents",
    "b12_labels": f"SELECT n, {_SHORT} AS short_model, CASE task_type WHEN 'bit_manipulation' THEN 'bit' WHEN 'cipher_text' THEN 'cipher' WHEN 'symbol_transform' THEN 'symbol' WHEN 'unit_conversion' THEN 'unit' ELSE task_type END AS short_task FROM {RESPONSES}",
    "b13_token_limits": f"SELECT n, CASE task_type WHEN 'roman' THEN 64 WHEN 'gravity' THEN 256 ELSE 512 END::BIGINT AS max_new_tokens FROM {RESPONSES}",
    "c1_task_type": f"SELECT n, CASE WHEN n % 10 = 0 THEN 'gravity' ELSE task_type END AS inferred FROM {RESPONSES}",
    "c2_parse": f"SELECT n, reasoning, answer, parse_success FROM {PARSED}",
    "c3_c8_last_matches": rf"""SELECT n, {BOXED_LAST} AS boxed, {_BOX} AS has_boxed, {last('raw', r'[-+]?[0-9]+(?:\.[0-9]+)?')} AS signed_number, {last('raw', r'-?[0-9]+(?:\.[0-9]+)?')} AS number,
      {last('raw', r'\b[01]{8}\b')} AS last_bin8, regexp_extract(raw, '\b[01]{{8}}\b') AS first_bin8, {last('raw', r'\b[IVXLCDM]+\b')} AS roman, {ANSWER_LINE} AS answer_line FROM {RESPONSES}""",
    "c9_extract_cascade": f"SELECT n, pred, extract_method FROM {CASCADE}",
    "c10_simple_answer": f"SELECT n, {SIMPLE} AS pred FROM {RESPONSES}",
    "c11_think_split": rf"""SELECT n, replace(array_to_string(regexp_extract_all(raw, '(?s)<think>(.*?)(?:</think>|\z)', 1), ''), '<think>', '') AS thinking,
      replace(regexp_replace(raw, '(?s)<think>.*?(?:</think>|\z)', '', 'g'), '</think>', '') AS answer FROM {RESPONSES}""",
    "c12_collapse": f"SELECT doc_id, {collapse('text')} AS collapsed FROM documents",
    "c13_word_count": f"SELECT doc_id, {words('text')}::BIGINT AS words FROM documents",
    "d1_normalise": f"SELECT n, pn AS pred_norm, gn AS gold_norm FROM {NORMALISED}",
    "d1_ten_decimals": "SELECT event_id, printf('%.10f', value) AS plain, printf('%.10f', value / 3e7::DOUBLE) AS small, printf('%.10f', value * -1e19::DOUBLE) AS large FROM events",
    "d2_to_float": f"SELECT n, {to_float('x')} AS number FROM (SELECT n, CASE n % 6 WHEN 0 THEN gold || '_0' WHEN 1 THEN gold || 'd' WHEN 2 THEN gold || 'e2' ELSE gold END AS x FROM {RESPONSES})",
    "d3_score_relative": f"SELECT n, correct FROM {SCORED}",
    "d4_score_lenient": f"SELECT n, {lenient('pred', 'gold')} AS correct FROM (SELECT *, {SIMPLE} AS pred FROM {RESPONSES})",
    "d5_score_official": f"SELECT n, correct, match_mode FROM {RESULTS}",
    "d6_result_rows": f"""SELECT n, pred, extract_method, pn AS pred_normalised, gn AS gold_normalised, correct, match_mode, round_even(gen_time, 4) AS latency_sec, CASE WHEN ttft <> 0 THEN round_even(ttft, 4) END AS ttft_sec,
      CASE WHEN ttft > 0 AND tokens_in > 0 THEN round_even(tokens_in / ttft, 1) END AS prefill_speed_tps, CASE WHEN tokens_out > 0 THEN round_even(tokens_out / greatest(gen_time - coalesce(ttft, 0), 0.001), 1) END AS gen_speed_tps FROM {RESULTS}""",
    "d7_ticks": f"SELECT n, CASE WHEN correct THEN '✓' ELSE '✗' END AS tick FROM {SCORED}",
    "e1_resume": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "e2_prefer_new": """SELECT doc_id AS id, quality, NULL AS lang, 'new' AS origin FROM labels UNION ALL
      SELECT doc_id, NULL, lang, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "e3_overlap": "SELECT count(*) AS n_overlap FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "e4_unfinished": f"SELECT id, 3 - count(DISTINCT model) FILTER (n % 7 <> 0 AND model <> 'dune') AS n_missing FROM {RESPONSES} GROUP BY id HAVING n_missing > 0",
    "e5_not_done_for_model": f"SELECT DISTINCT id FROM {RESPONSES} WHERE id NOT IN (SELECT id FROM {RESPONSES} WHERE n % 7 <> 0 AND model = 'dune')",
    "e6_side_by_side": f"""SELECT id, arg_max(answer, n) FILTER (model = 'amber-1.5') AS model_1, arg_max(answer, n) FILTER (model = 'birch-2') AS model_2, arg_max(answer, n) FILTER (model = '3.1-cedar') AS model_3,
      arg_max(answer, n) FILTER (model = 'dune') AS model_4 FROM {SCORED} GROUP BY id""",
    "e7_with_sample": f"SELECT r.id, r.model, s.gold, s.prompt FROM {RESPONSES} r JOIN (SELECT id, arg_min(gold, n) AS gold, arg_min(prompt, n) AS prompt FROM {RESPONSES} GROUP BY id) s USING (id)",
    "e8_summary_rows": "SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels)",
    "e9_prior_rows": "SELECT conv_id AS id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)",
    "f1_accuracy": f"SELECT model, task_type, sum(correct::INT)::BIGINT AS correct, count(*) AS total FROM {SCORED} GROUP BY model, task_type",
    "f2_accuracy_with_totals": _TOTALS,
    "f3_summary": _SUMMARY,
    "f3_nested_summary": f"WITH s AS ({_SUMMARY}) SELECT a.model, a.correct, a.total, a.accuracy, b.task_type, b.accuracy AS task_accuracy FROM s a JOIN s b USING (model) WHERE a.is_total AND NOT b.is_total",
    "f4_flat_rates": f"SELECT CASE WHEN grouping(task_type) = 1 THEN 'TOTAL' ELSE task_type END AS task_type, grouping(task_type) = 1 AS is_total, {_RATES} FROM (SELECT *, {relative('pred', 'gold')} AS correct FROM (SELECT *, {SIMPLE} AS pred, {_BOX} AS has_boxed FROM {RESPONSES})) GROUP BY GROUPING SETS ((task_type), ())",
    "f4_flat_rates_lenient": f"""SELECT * FROM (SELECT CASE WHEN g = 1 THEN 'TOTAL' ELSE t END AS task_type, g = 1 AS is_total, n, CASE WHEN g = 1 THEN c ELSE round_even(c, 4) END AS accuracy, CASE WHEN g = 1 THEN b ELSE round_even(b, 4) END AS boxed_rate
      FROM (SELECT grouping(task_type) AS g, task_type AS t, count(*) AS n, avg(correct::INT) AS c, avg(has_boxed::INT) AS b FROM (SELECT *, {lenient('pred', 'gold')} AS correct FROM (SELECT *, {SIMPLE} AS pred, {_BOX} AS has_boxed FROM {RESPONSES})) GROUP BY GROUPING SETS ((task_type), ()))) WHERE task_type <> ''""",
    "f5_quality_metrics": _METRICS,
    "f6_percent_labels": f"SELECT model, task_type, c || '/' || t || '  ' || floor(100.0 * c / t)::INT || '%' AS label FROM (SELECT model, task_type, sum(correct::INT)::BIGINT AS c, count(*) AS t FROM {SCORED} GROUP BY model, task_type)",
    "f7_value_counts": "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, min(doc_id) LIMIT 10",
    "f7_task_counts": f"SELECT task_type, count(*) AS n FROM {RESPONSES} GROUP BY task_type",
    "f8_distinct": "SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL",
    "f9_costs": f"""SELECT model, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, (sum(tokens_in)::DOUBLE * any_value(i) + sum(tokens_out)::DOUBLE * any_value(o)) / 1e6 AS cost
      FROM {RESPONSES} JOIN (VALUES {', '.join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, (i, o) in derived.PRICES.items())}) AS p(model, i, o) USING (model) GROUP BY model""",
    "f10_gate": f"SELECT count(*) AS n, avg(parse_success::INT) AS parse_rate, avg(correct::INT) AS match_rate, parse_rate >= 0.95 AND match_rate >= 0.95 AS passed FROM (SELECT * FROM {SCORED} ORDER BY n LIMIT 100)",
    "f11_winners": f"""WITH t AS (SELECT *, correct::DOUBLE / total AS rate, max(correct::DOUBLE / total) OVER (PARTITION BY task_type, is_total) AS best FROM ({_TOTALS}))
      SELECT task_type, is_total, CASE WHEN count(*) > 1 OR any_value(best) = 0 THEN 'tie' ELSE any_value({_SHORT}) END AS winner FROM t WHERE rate = best GROUP BY task_type, is_total""",
    "f12_recommendation": f"""WITH r AS (SELECT *, {_FIRST_TWO} AS rn FROM ({_METRICS}))
      SELECT a.model AS winner, a.match_rate AS winner_rate, b.model AS second, b.match_rate AS second_rate FROM r a, r b WHERE a.rn = 1 AND b.rn = 2""",
    "f13_counters": f"""SELECT CASE WHEN grouping(task_type) = 1 THEN 'TOTAL' ELSE task_type END AS task_type, grouping(task_type) = 1 AS is_total, CASE WHEN grouping(task_type) = 1 THEN count(*) ELSE count(*) FILTER (gen_time >= 0) END AS done, count(*) FILTER (gen_time < 0) AS errors,
      count(*) FILTER (gen_time >= 0 AND parse_success) AS parse_ok, count(*) FILTER (gen_time >= 0 AND correct) AS correct FROM {SCORED} GROUP BY GROUPING SETS ((task_type), ())""",
    "f13_written_progress": f"""SELECT CASE WHEN grouping(task_type) = 1 THEN NULL ELSE task_type END AS task_type, CASE WHEN grouping(task_type) = 1 THEN count(*) ELSE count(*) FILTER (gen_time >= 0) END AS done, count(*) FILTER (gen_time < 0) AS errors,
      count(*) FILTER (gen_time >= 0 AND parse_success) AS parse_ok, count(*) FILTER (gen_time >= 0 AND correct) AS correct FROM {SCORED} GROUP BY GROUPING SETS ((task_type), ())""",
    "f14_clean_answers": f"SELECT id, any_value(task_type) AS task_type, any_value(gold) AS gold, any_value(prompt) AS prompt, string_agg(model || '=' || pred, '|' ORDER BY model >= 'c', n) AS models FROM {RESULTS} WHERE correct GROUP BY id",
    "f14_correct_models": f"SELECT id, string_agg(model || '=' || pred, '|' ORDER BY n) AS models FROM (SELECT id, model, min(n) AS n, arg_min(pred, n) AS pred FROM {RESULTS} WHERE correct GROUP BY id, model) GROUP BY id",
    "g1_moving_average": f"SELECT n, done, recent, (total - done) * recent / 15 AS seconds_left FROM ({_MOVING})",
    "g2_progress": f"SELECT model, done, recent FROM ({_MOVING}) WHERE done % 100 = 0",
    "g3_even_first": "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 20 // (SELECT count(DISTINCT lang) FROM documents)",
    "g4_round_robin": _robin("documents", "lang", "doc_id", 50).replace("{columns}", "doc_id, lang"),
    "g5_sample_picks": f"""WITH f AS (SELECT task_type, coalesce(arg_min(id, n) FILTER (NOT correct), arg_min(id, n)) AS id, count(*) FILTER (NOT correct) = 0 AS late, min(n) AS first_n FROM {SCORED} WHERE model = 'amber-1.5' GROUP BY task_type)
      SELECT task_type, id FROM f ORDER BY late, CASE WHEN NOT late THEN task_type END, first_n LIMIT 3""",
    "s1_streaming_resume": f"SELECT id || '/' || model AS id, gold, n FROM {RESPONSES}",
    "s2_streaming_progress": f"SELECT task_type, count(*) AS done, sum(parse_success::INT)::BIGINT AS parse_ok FROM {SCORED} GROUP BY task_type",
    "f15_length_stats": f"""SELECT source, count(*) AS n, avg(chars) AS mean_chars, quantile_cont(chars, 0.5) AS median_chars, quantile_cont(chars, 0.95) AS p95_chars, max(chars) AS most_chars,
      avg(words) AS mean_words, quantile_cont(words, 0.5) AS median_words, quantile_cont(words, 0.95) AS p95_words, max(words) AS most_words
      FROM (SELECT source, length(coalesce(text, '')) AS chars, {words('text')} AS words FROM documents) GROUP BY source""",
    "g6_sorted": "SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS position FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)",
    "g7_head": f"SELECT n, id FROM {RESPONSES} ORDER BY n LIMIT 100",
    "g7_tail": f"SELECT n, id FROM {RESPONSES} ORDER BY n OFFSET 100",
    "h1_shuffle": f"SELECT doc_id, position FROM {_SPLIT}",
    "h2_split": f"SELECT doc_id, CASE WHEN position <= floor(total * 0.1) THEN 'val' ELSE 'train' END AS split FROM {_SPLIT}",
    "h2_split_at_least_one": "SELECT r_regionkey, CASE WHEN row_number() OVER (ORDER BY md5('42:' || r_regionkey::VARCHAR), r_regionkey) <= greatest(1, floor(count(*) OVER () * 0.1)) THEN 'val' ELSE 'train' END AS split FROM region",
    "h3_stratified": strata("documents", "lang", "md5('42:' || doc_id::VARCHAR), doc_id", 50).replace("{columns}", "doc_id, lang"),
    "h4_task_balanced": _robin(f"(SELECT id || '/' || model AS id, task_type FROM {RESPONSES})", "task_type", "id", 50).replace("{columns}", "id, task_type"),
    "h5_balanced_head": strata(_TRAIN, "lang", "position", 50).replace("{columns}", "doc_id, lang"),
    "h6_random_k": "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 20",
    "h7_union": "SELECT doc_id, lang, NULL::INT AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels",
    "h8_keep_first": f"SELECT id, arg_min(coalesce(answer, '~'), ordinal) AS answer, min(ordinal) AS ordinal FROM {PROBLEMS} WHERE id IS NOT NULL GROUP BY id".replace("arg_min(coalesce(answer, '~'), ordinal)", "nullif(arg_min(coalesce(answer, '~'), ordinal), '~')"),
    "h9_keep_last": f"SELECT id, nullif(arg_max(coalesce(answer, '~'), ordinal), '~') AS answer, max(ordinal) AS ordinal FROM {PROBLEMS} WHERE id IS NOT NULL GROUP BY id",
    "h10_label_difference": f"""SELECT id, array_to_string(list_sort(list_filter(['amber-1.5', 'birch-2', '3.1-cedar', 'dune'], lambda x: NOT list_contains(have, x))), ',') AS missing
      FROM (SELECT id, coalesce(list(DISTINCT model) FILTER (n % 7 <> 0), []) AS have FROM {RESPONSES} GROUP BY id)""",
    "h11_upsert": f"SELECT id, model, CASE WHEN n % 4 = 1 THEN gold || '!' ELSE gold END AS gold, CASE WHEN n % 4 = 1 THEN -n ELSE n END AS ordinal FROM {RESPONSES}",
    "h11_nested_upsert": f"SELECT id, task_type, gold, prompt, model AS model_label, CASE WHEN n % 4 = 1 THEN pred || '!' ELSE pred END AS pred, n % 4 <> 1 AND correct AS correct FROM {RESULTS}",
    "messages_by_conversation": "SELECT conv_id, count(*) AS n_messages, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS shape FROM conversations GROUP BY conv_id",
}
