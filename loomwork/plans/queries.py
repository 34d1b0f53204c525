"""The registered queries: one or more for each operator of the library, over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.config import Settings
from loomwork.functions import extract, score
from loomwork.functions import pytext as t
from loomwork.operators import evaluations, filters, relational, reports, sampling
from loomwork.plans import derived
from loomwork.sources import publish, readers, writers
from loomwork.storage import fresh_path, saved, table, with_rank
from loomwork.streaming import resume

CONFIG = Settings()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.recorded(spark, sf_dir, "responses", derived.RESPONSES)


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.recorded(spark, sf_dir, "problems", derived.PROBLEMS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses parsed and scored by the relative rule."""
    rows = responses(spark, sf_dir).withColumn("__p", extract.parsed(F.col("raw"))).select("*", "__p.*").drop("__p")
    return rows.withColumn("correct", score.score_relative(F.col("answer"), F.col("gold"), F.col("task_type")))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses extracted and scored by the official-like rule, with times and speeds."""
    return score.with_result(responses(spark, sf_dir), "raw", "gold", "task_type", latency="gen_time", prompt_tokens="tokens_in", completion_tokens="tokens_out")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# sources and sinks


@query
def a1_csv_scan(spark, sf_dir):
    path = fresh_path(spark, "csv")
    writers.write_csv(problems(spark, sf_dir).select("id", "prompt", "answer", "task_type", "ordinal"), path)
    return readers.read_csv(spark, path, f"{readers.PROBLEMS}, ordinal bigint")


@query
def a2_csv_normalise(spark, sf_dir):
    return readers.normalised_problems(problems(spark, sf_dir), "ordinal")


@query
def a3_jsonl_strict(spark, sf_dir):
    path = fresh_path(spark, "jsonl")
    writers.append_jsonl(responses(spark, sf_dir).select("id", "model", "raw", "gen_time", "n"), path)
    return readers.read_jsonl(spark, path, "id string, model string, raw string, gen_time double, n bigint")


@query
def a4_jsonl_tolerant(spark, sf_dir):
    path = fresh_path(spark, "broken")
    n, good = F.col("n"), F.to_json(F.struct("id", "n"))
    # cut off, with text behind, two objects, two with a comma, an array's end within, single quotes, an array, null
    broken = [F.concat(F.lit('{"id": "'), F.col("id")), F.concat(good, F.lit(" junk")), F.concat(good, good), F.concat(good, F.lit(", "), good)]
    broken += [F.concat(good, F.lit("] ["), good), F.replace(good, F.lit('"'), F.lit("'")), F.concat(F.lit("["), good, F.lit("]")), F.lit("null")]
    which = F.element_at(F.array(*broken), (n % len(broken) + 1).cast("int"))
    line = F.when(n % 5 == 0, which).when(n % 5 == 1, "").when(n % 5 == 2, F.to_json(F.struct("n"))).otherwise(good)
    responses(spark, sf_dir).select(line.alias("value")).write.text(path)
    return readers.read_jsonl_tolerant(spark, path, "id string, n bigint", required="id")


@query
def a5_jsonl_alias(spark, sf_dir):
    e = F.col("event_id")
    pair = F.concat(F.lit('{"id": '), F.when(e % 3 == 0, "null").otherwise(F.concat(F.lit('"j'), e.cast("string"), F.lit('"'))))
    ask = F.when(e % 4 == 0, ', "prompt": "", "question": " roman numeral "').when(e % 4 == 1, ', "prompt": false, "user": "u"').when(e % 4 == 2, ', "prompt": "p", "question": "q"').otherwise(', "prompt": null')
    say = F.when(e % 7 == 0, ', "answer": 0, "output": 7').when(e % 7 == 1, ', "answer": 0.0, "target": "t "').when(e % 7 == 2, ', "answer": "0"').when(e % 7 == 3, ', "answer": "false"')
    say = say.when(e % 7 == 4, ', "answer": [], "output": true').when(e % 7 == 5, ', "answer": {}, "target": 2.50').otherwise(', "answer": "a"')
    path = fresh_path(spark, "aliases")
    # a file for each 5,000 ids, in their order, with a blank line behind each row
    lines = table(spark, sf_dir, "events").select(F.concat(pair, ask, say, F.lit("}\n")).alias("value"), e.alias("event_id"), F.floor(e / 5000).alias("part"))
    lines.repartition("part").sortWithinPartitions("part", "event_id").select("value", "part").write.partitionBy("part").text(path)
    return readers.read_samples(spark, path)


@query
def a6_multi_file_scan(spark, sf_dir):
    base = fresh_path(spark, "inputs")
    rows = responses(spark, sf_dir).select("id", "n")
    writers.append_jsonl(rows.filter("n % 2 = 0"), f"{base}/even.jsonl")
    writers.append_jsonl(rows.filter("n % 2 = 1"), f"{base}/odd.jsonl")
    found, missing = readers.read_existing(spark, [f"{base}/even.jsonl", f"{base}/absent.jsonl", f"{base}/odd.jsonl"], "id string, n bigint")
    return found.withColumn("n_missing", F.lit(len(missing)).cast("long"))


@query
def a7_append_sink(spark, sf_dir):
    path = fresh_path(spark, "append")
    rows = responses(spark, sf_dir).select("id", "model", "n")
    writers.append_jsonl(rows.filter("n % 3 = 0"), path)
    done = readers.read_jsonl(spark, path, "id string, model string, n bigint")
    writers.append_jsonl(relational.unfinished_ids(rows, done), path)
    return readers.read_jsonl(spark, path, "id string, model string, n bigint")


@query
def a8_ordered_sink(spark, sf_dir):
    path = fresh_path(spark, "ordered")
    rows = responses(spark, sf_dir).select(F.concat_ws("/", "id", "model").alias("id"), "gold", F.col("n").alias("ordinal"))
    writers.rewrite_jsonl(rows.filter("ordinal % 3 = 0").select("id", "ordinal"), rows, path)
    # the order within the files is the order of the rows
    back = spark.read.schema("id string, gold string, ordinal bigint").json(path).withColumn("at", F.monotonically_increasing_id()).withColumn("file", F.input_file_name())
    return with_rank(saved(back, "back"), F.col("file"), F.col("at"), name="position").select("id", "gold", "position")


@query
def a8_published(spark, sf_dir):
    """An output replaced by one that is made from itself."""
    path = fresh_path(spark, "published")
    publish.publish(responses(spark, sf_dir).select("id", "model", "gold", "n"), path)
    again = lambda: publish.read_published(spark, path, "id string, model string, gold string, n bigint")
    publish.publish(again().withColumn("gold", F.concat("gold", F.lit("!"))).filter("n % 5 != 0"), path)
    return again()


@query
def a9_split_sinks(spark, sf_dir):
    path = fresh_path(spark, "splits")
    split = sampling.split(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id", CONFIG.seed, CONFIG.val_fraction)
    writers.write_splits(split.select("doc_id", "lang", "split"), path)
    return spark.read.schema("doc_id bigint, lang string, split string").json(path)


@query
def a10_csv_sink(spark, sf_dir):
    path = fresh_path(spark, "csv")
    writers.write_csv(responses(spark, sf_dir).select("n", "raw", "gold"), path)
    back = readers.read_csv(spark, path, "n bigint, raw string, gold string")
    return back.withColumn("raw", F.coalesce("raw", F.lit("")))


@query
def a11_json_report(spark, sf_dir):
    text = writers.report_json({"summary": reports.summary(results(spark, sf_dir))})
    rows = F.explode(F.from_json(F.get_json_object(F.lit(text), "$.summary"), "array<struct<model: string, task_type: string, is_total: boolean, correct: bigint, total: bigint, accuracy: double>>"))
    return spark.range(1).select(rows.alias("r")).select("r.*")


@query
def a12_settings(spark, sf_dir):
    """The split that a configuration asks for, others of its settings by default."""
    settings = Settings.from_dict({"seed": 7, "val_fraction": 0.2})
    return sampling.split(documents(spark, sf_dir).select("doc_id"), "doc_id", settings.seed, settings.val_fraction).select("doc_id", "split", F.lit(settings.max_words).alias("max_words"))


@query
def a13_columns(spark, sf_dir):
    return readers.preview(documents(spark, sf_dir), "doc_id", 3).select("place", "name", "present", F.array_join("head", "|", "null").alias("head"))


# projections, filters, predicates


@query
def b1_labelled(spark, sf_dir):
    return problems(spark, sf_dir).filter(filters.not_blank(F.col("task_type"))).select("ordinal", "task_type")


@query
def b2_not_empty(spark, sf_dir):
    return problems(spark, sf_dir).filter(filters.not_blank(F.col("prompt")) & filters.not_blank(F.col("answer"))).select("ordinal")


@query
def b3_required(spark, sf_dir):
    return filters.require(responses(spark, sf_dir), ["prompt", "gold", "raw"], "n").agg(F.count(F.lit(1)).alias("n"))


def _quality(spark, sf_dir, *columns):
    return derived.of_spark(spark, sf_dir, derived.QUALITY_ROWS).select("id", "source", "text", "has_quality", "quality_score", "known_words", "needs_downweight")


_QUALITY_OK = filters.quality_ok
_REASON = lambda: filters.reject_reason(
    filters.quality_ok(F.col("has_quality"), F.col("quality_score"), CONFIG.min_quality),
    filters.words_ok(F.col("text"), F.col("known_words"), CONFIG.max_words),
    filters.sampled(F.col("needs_downweight"), F.col("id"), CONFIG.downweight, CONFIG.seed),
)


@query
def b4_quality_filter(spark, sf_dir):
    rows = _quality(spark, sf_dir)
    return rows.filter(filters.quality_ok(F.col("has_quality"), F.col("quality_score"), CONFIG.min_quality)).select("id")


@query
def b4_quality_key_present(spark, sf_dir):
    rows = _quality(spark, sf_dir)
    raw = F.when(F.col("has_quality"), F.to_json(F.struct("id", "quality_score"), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct("id")))
    rows = rows.withColumn("raw", raw)
    kept = filters.quality_ok(readers.has_key(F.col("raw"), "quality_score"), F.get_json_object("raw", "$.quality_score").try_cast("double"), CONFIG.min_quality)
    return rows.filter(kept).select("id")


@query
def b5_word_cap(spark, sf_dir):
    return _quality(spark, sf_dir).filter(filters.words_ok(F.col("text"), F.col("known_words"), CONFIG.max_words)).select("id")


@query
def b6_downweight(spark, sf_dir):
    return _quality(spark, sf_dir).filter(filters.sampled(F.col("needs_downweight"), F.col("id"), CONFIG.downweight, CONFIG.seed)).select("id")


@query
def b7_reject_counts(spark, sf_dir):
    return filters.reject_counts(_quality(spark, sf_dir).withColumn("reason", _REASON()), "reason")


@query
def b7_counted_write(spark, sf_dir):
    """Reject counts from the job that writes what is kept, beside what was written."""
    path = fresh_path(spark, "kept")
    counts = filters.write_kept(_quality(spark, sf_dir), _REASON(), lambda rows: writers.append_jsonl(rows.select("id"), path))
    written = spark.read.schema("id bigint").json(path).agg(F.count(F.lit(1)).alias("written"))
    reasons = F.from_json(F.lit(json.dumps(counts)), "map<string, bigint>")
    return written.select(F.explode(reasons).alias("reason", "n"), "written")


@query
def b8_one_by_id(spark, sf_dir):
    return filters.one_by_id(responses(spark, sf_dir), "id", "s17").select("id", "model", "gold")


@query
def b9_positive_time(spark, sf_dir):
    return responses(spark, sf_dir).groupBy("model").agg(F.avg(F.when(F.col("gen_time") >= 0, F.col("gen_time"))).alias("avg_time"))


@query
def b10_first_failures(spark, sf_dir):
    return reports.first_failures(scored(spark, sf_dir), [F.col("n")]).select("id", "model", "answer", "gold")


@query
def b11_shortened(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", t.shortened(F.col("text"), 200).alias("shown"))


@query
def b12_labels(spark, sf_dir):
    short = {"bit_manipulation": "bit", "cipher_text": "cipher", "symbol_transform": "symbol", "unit_conversion": "unit"}
    return responses(spark, sf_dir).select("n", t.short_name(F.col("model")).alias("short_model"), t.looked_up(F.col("task_type"), short).alias("short_task"))


@query
def b13_token_limits(spark, sf_dir):
    return responses(spark, sf_dir).select("n", t.limit_from_json(F.col("task_type"), '{"roman": 64, "gravity": 256}', CONFIG.default_max_new_tokens).alias("max_new_tokens"))


# classification, parsing, extraction


@query
def c1_task_type(spark, sf_dir):
    rows = responses(spark, sf_dir).select("n", F.when(F.col("n") % 10 == 0, " Gravity ").alias("explicit"), "prompt")
    return rows.select("n", extract.task_type(F.col("explicit"), F.col("prompt")).alias("inferred"))


@query
def c2_parse(spark, sf_dir):
    return responses(spark, sf_dir).select("n", extract.parsed(F.col("raw")).alias("parsed")).select("n", "parsed.*")


@query
def c3_c8_last_matches(spark, sf_dir):
    raw = F.col("raw")
    return responses(spark, sf_dir).select(
        "n",
        extract.last_boxed(raw).alias("boxed"),
        extract.has_boxed(raw).alias("has_boxed"),
        t.last(t.matches(raw, extract.SIGNED_NUMBER)).alias("signed_number"),
        t.last(t.matches(raw, extract.NUMBER)).alias("number"),
        t.last(t.matches(raw, extract.BIN8)).alias("last_bin8"),
        F.regexp_extract(raw, extract.BIN8, 0).alias("first_bin8"),
        t.last(t.matches(raw, extract.ROMAN)).alias("roman"),
        extract.last_answer_line(raw).alias("answer_line"),
    )


@query
def c9_extract_cascade(spark, sf_dir):
    return extract.with_prediction(responses(spark, sf_dir), "raw", "task_type").select("n", "pred", "extract_method")


@query
def c10_simple_answer(spark, sf_dir):
    return responses(spark, sf_dir).select("n", extract.simple_answer(F.col("raw")).alias("pred"))


@query
def c11_think_split(spark, sf_dir):
    return responses(spark, sf_dir).select("n", extract.think_split(F.col("raw")).alias("x")).select("n", "x.*")


@query
def c12_collapse(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", t.collapse(F.col("text")).alias("collapsed"))


@query
def c13_word_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", t.word_count(F.col("text")).alias("words"))


# normalisation and scoring


@query
def d1_normalise(spark, sf_dir):
    rows = extract.with_prediction(responses(spark, sf_dir), "raw", "task_type")
    return rows.select("n", score.normalised(F.col("pred"), F.col("task_type")).alias("pred_norm"), score.normalised(F.col("gold"), F.col("task_type")).alias("gold_norm"))


@query
def d1_ten_decimals(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", t.ten_decimals(value).alias("plain"), t.ten_decimals(value / 3e7).alias("small"), t.ten_decimals(value * -1e19).alias("large"))


@query
def d2_to_float(spark, sf_dir):
    rows = responses(spark, sf_dir)
    s = F.when(F.col("n") % 6 == 0, F.concat("gold", F.lit("_0"))).when(F.col("n") % 6 == 1, F.concat("gold", F.lit("d"))).when(F.col("n") % 6 == 2, F.concat("gold", F.lit("e2"))).otherwise(F.col("gold"))
    return rows.select("n", t.to_float(s).alias("number"))


@query
def d3_score_relative(spark, sf_dir):
    return scored(spark, sf_dir).select("n", "correct")


@query
def d4_score_lenient(spark, sf_dir):
    rows = responses(spark, sf_dir).withColumn("pred", extract.simple_answer(F.col("raw")))
    return rows.select("n", score.score_lenient(F.col("pred"), F.col("gold"), F.col("task_type")).alias("correct"))


@query
def d5_score_official(spark, sf_dir):
    return results(spark, sf_dir).select("n", "correct", "match_mode")


@query
def d6_result_rows(spark, sf_dir):
    return results(spark, sf_dir).select("n", "pred", "extract_method", "pred_normalised", "gold_normalised", "correct", "match_mode", "latency_sec", "ttft_sec", "prefill_speed_tps", "gen_speed_tps")


@query
def d7_ticks(spark, sf_dir):
    return scored(spark, sf_dir).select("n", F.when(F.col("correct"), "✓").otherwise("✗").alias("tick"))


# joins


@query
def e1_resume(spark, sf_dir):
    return relational.unfinished_ids(documents(spark, sf_dir).select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query
def e2_prefer_new(spark, sf_dir):
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return relational.prefer_new(new, documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang"), "id", origin="origin")


@query
def e3_overlap(spark, sf_dir):
    return relational.overlap(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id").agg(F.count(F.lit(1)).alias("n_overlap"))


@query
def e4_unfinished(spark, sf_dir):
    rows = responses(spark, sf_dir)
    done = rows.filter("n % 7 != 0").select("id", F.col("model").alias("label"))
    return relational.missing_labels(rows.select("id"), list(derived.MODELS[:3]), done)


@query
def e5_not_done_for_model(spark, sf_dir):
    rows = responses(spark, sf_dir)
    done = rows.filter("n % 7 != 0").select("id", F.col("model").alias("label"))
    return relational.not_done_for(rows.select("id").distinct(), done, "dune")


@query
def e6_side_by_side(spark, sf_dir):
    return relational.side_by_side(scored(spark, sf_dir), list(derived.MODELS), "answer", "n")


@query
def e7_with_sample(spark, sf_dir):
    samples = responses(spark, sf_dir).select("id", "gold", "prompt", "n")
    return relational.with_sample(responses(spark, sf_dir).select("id", "model"), samples, ["gold", "prompt"], "n")


@query
def e8_summary_rows(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return relational.overlap(ids, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id"))


@query
def e9_prior_rows(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn")
    return relational.unfinished_ids(turns, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id"))


# aggregations


@query
def f1_accuracy(spark, sf_dir):
    return reports.accuracy(scored(spark, sf_dir))


@query
def f2_accuracy_with_totals(spark, sf_dir):
    return reports.accuracy_with_totals(scored(spark, sf_dir))


@query
def f3_summary(spark, sf_dir):
    return reports.summary(results(spark, sf_dir))


@query
def f3_nested_summary(spark, sf_dir):
    nested = reports.nested_summary(reports.summary(results(spark, sf_dir)))
    return nested.select("model", "correct", "total", "accuracy", F.explode("by_task").alias("task_type", "v")).select("model", "correct", "total", "accuracy", "task_type", F.col("v.accuracy").alias("task_accuracy"))


@query
def f4_flat_rates(spark, sf_dir):
    rows = responses(spark, sf_dir).withColumns({"has_boxed": extract.has_boxed(F.col("raw")), "pred": extract.simple_answer(F.col("raw"))})
    rows = rows.withColumn("correct", score.score_relative(F.col("pred"), F.col("gold"), F.col("task_type")))
    return reports.flat_rates(rows, {"accuracy": "correct", "boxed_rate": "has_boxed"})


@query
def f4_flat_rates_lenient(spark, sf_dir):
    rows = responses(spark, sf_dir).withColumns({"has_boxed": extract.has_boxed(F.col("raw")), "pred": extract.simple_answer(F.col("raw"))})
    rows = rows.withColumn("correct", score.score_lenient(F.col("pred"), F.col("gold"), F.col("task_type")))
    return reports.flat_rates(rows, {"accuracy": "correct", "boxed_rate": "has_boxed"}, round_total=False, drop_blank=True)


@query
def f5_quality_metrics(spark, sf_dir):
    return reports.quality_metrics(scored(spark, sf_dir))


@query
def f6_percent_labels(spark, sf_dir):
    return reports.accuracy(scored(spark, sf_dir)).select("model", "task_type", t.percent_label(F.col("correct"), F.col("total")).alias("label"))


@query
def f7_value_counts(spark, sf_dir):
    return reports.value_counts(documents(spark, sf_dir), "source", "doc_id", top=10)


@query
def f7_task_counts(spark, sf_dir):
    return reports.value_counts(responses(spark, sf_dir), "task_type", "n")


@query
def f8_distinct(spark, sf_dir):
    return reports.distinct_values(documents(spark, sf_dir), "lang")


@query
def f9_costs(spark, sf_dir):
    prices = spark.createDataFrame([(m, *p) for m, p in derived.PRICES.items()], "model string, price_in double, price_out double")
    return reports.costs(responses(spark, sf_dir), prices)


@query
def f10_gate(spark, sf_dir):
    return reports.gate(scored(spark, sf_dir), [F.col("n")], CONFIG.pilot_rows, CONFIG.gate)


@query
def f11_winners(spark, sf_dir):
    return reports.winners(reports.accuracy_with_totals(scored(spark, sf_dir)), n_models=len(derived.MODELS))


@query
def f12_recommendation(spark, sf_dir):
    return reports.recommendation(reports.quality_metrics(scored(spark, sf_dir)))


@query
def f13_counters(spark, sf_dir):
    return reports.done_counters(scored(spark, sf_dir), F.col("gen_time") < 0)


@query
def f13_written_progress(spark, sf_dir):
    """The counters of a run from the job that writes its rows."""
    path = fresh_path(spark, "run")
    found = reports.write_with_progress(scored(spark, sf_dir), F.col("gen_time") < 0, list(derived.TASKS), lambda rows: writers.append_jsonl(rows.select("n"), path))
    return spark.createDataFrame(found, "task_type string, done bigint, errors bigint, parse_ok bigint, correct bigint")


SAMPLE = ["task_type", "gold", "prompt"]


def _evaluations(spark, sf_dir):
    return results(spark, sf_dir).select("id", F.col("model").alias("model_label"), *SAMPLE, "pred", "correct", "n")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Nested rows as a JSONL file has them."""
    path = fresh_path(df.sparkSession, name)
    publish.publish(df, path)
    return publish.read_published(df.sparkSession, path, df.schema)


@query
def f14_clean_answers(spark, sf_dir):
    """Right answers by sample, gathered in two runs."""
    rows = _kept(evaluations.nested(_evaluations(spark, sf_dir), SAMPLE, "n"), "evaluations")
    answers = lambda keep: evaluations.clean_answers(rows.withColumn("results", F.map_filter("results", keep)), SAMPLE, fields={"answer": "pred"})
    first = _kept(answers(lambda label, _: label < F.lit("c")), "answers")
    found = evaluations.merged_answers(first, answers(lambda label, _: F.lit(True)), SAMPLE)
    return found.select("id", *SAMPLE, F.array_join(F.transform("correct_models", lambda m: F.concat(m["model"], F.lit("="), m["answer"])), "|").alias("models"))


@query
def f14_correct_models(spark, sf_dir):
    found = reports.correct_models(results(spark, sf_dir), "n", keep=["pred"])
    return found.select("id", F.array_join(F.transform("correct_models", lambda x: F.concat(x["model"], F.lit("="), x["pred"])), "|").alias("models"))


# windows, ranking, limits


@query
def g1_moving_average(spark, sf_dir):
    return reports.moving_average(responses(spark, sf_dir), "model", "n", "gen_time", 100, CONFIG.workers).select("n", "done", "recent", "seconds_left")


@query
def g2_progress(spark, sf_dir):
    log = reports.moving_average(responses(spark, sf_dir), "model", "n", "gen_time", 100, CONFIG.workers)
    return reports.every(log, "done", 100).select("model", "done", "recent")


@query
def g3_even_first(spark, sf_dir):
    return sampling.even_first_k(documents(spark, sf_dir).select("doc_id", "lang"), "lang", [F.col("doc_id")], CONFIG.smoke_size)


@query
def g4_round_robin(spark, sf_dir):
    return sampling.round_robin(documents(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id", CONFIG.sample_size, CONFIG.seed)


@query
def g5_sample_picks(spark, sf_dir):
    return reports.sample_picks(scored(spark, sf_dir).filter(F.col("model") == derived.MODELS[0]), "n", 3)


@query
def g6_sorted(spark, sf_dir):
    return with_rank(reports.value_counts(documents(spark, sf_dir), "source", "doc_id"), F.desc("n"), F.col("source"), name="position")


@query
def g7_head(spark, sf_dir):
    return sampling.first_k(responses(spark, sf_dir).select("n", "id"), [F.col("n")], 100)


@query
def g7_tail(spark, sf_dir):
    return with_rank(responses(spark, sf_dir).select("n", "id"), F.col("n"), name="position").filter("position > 100").select("n", "id")


# sampling, splitting, set operations


@query
def h1_shuffle(spark, sf_dir):
    return sampling.shuffled(documents(spark, sf_dir).select("doc_id"), "doc_id", CONFIG.seed)


@query
def h2_split(spark, sf_dir):
    return sampling.split(documents(spark, sf_dir).select("doc_id"), "doc_id", CONFIG.seed, CONFIG.val_fraction).select("doc_id", "split")


@query
def h2_split_at_least_one(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "region").select("r_regionkey"), "r_regionkey", CONFIG.seed, CONFIG.val_fraction, minimum=1).select("r_regionkey", "split")


@query
def h3_stratified(spark, sf_dir):
    return sampling.stratified(documents(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id", CONFIG.sample_size, CONFIG.seed)


@query
def h4_task_balanced(spark, sf_dir):
    rows = responses(spark, sf_dir).select(F.concat_ws("/", "id", "model").alias("id"), "task_type")
    return sampling.round_robin(rows, "task_type", "id", CONFIG.sample_size, CONFIG.seed)


@query
def h5_balanced_head(spark, sf_dir):
    train = sampling.split(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id", CONFIG.seed, CONFIG.val_fraction).filter("split = 'train'")
    return sampling.balanced_head(train, "lang", "position", CONFIG.sample_size).select("doc_id", "lang")


@query
def h6_random_k(spark, sf_dir):
    return sampling.random_k(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id", CONFIG.smoke_size, CONFIG.seed)


@query
def h7_union(spark, sf_dir):
    a = documents(spark, sf_dir).select("doc_id", "lang")
    b = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return a.unionByName(b, allowMissingColumns=True)


@query
def h8_keep_first(spark, sf_dir):
    return relational.keep_first(problems(spark, sf_dir).filter("id is not null").select("id", "answer", "ordinal"), ["id"], [F.col("ordinal")])


@query
def h9_keep_last(spark, sf_dir):
    return relational.keep_last(problems(spark, sf_dir).select("id", "answer", "ordinal"), ["id"], "ordinal")


@query
def h10_label_difference(spark, sf_dir):
    have = responses(spark, sf_dir).groupBy("id").agg(F.collect_set(F.when(F.col("n") % 7 != 0, F.col("model"))).alias("have"))  # a model four at most
    wanted = F.array(*[F.lit(m) for m in derived.MODELS])
    return have.select("id", F.array_join(relational.label_difference(wanted, F.col("have")), ",").alias("missing"))


@query
def h11_upsert(spark, sf_dir):
    rows = responses(spark, sf_dir).select("id", "model", "gold", F.col("n").alias("ordinal"))
    new = rows.filter("ordinal % 4 = 1").withColumn("gold", F.concat("gold", F.lit("!"))).withColumn("ordinal", -F.col("ordinal"))
    return relational.upsert(rows, new, ["id", "model"], "ordinal")


@query
def h11_nested_upsert(spark, sf_dir):
    """Nested rows of a file, with the results of another run put in twice."""
    rows = _evaluations(spark, sf_dir)
    old = _kept(evaluations.nested(rows, SAMPLE, "n"), "evaluations")
    again = rows.filter("n % 4 = 1").withColumns({"pred": F.concat("pred", F.lit("!")), "correct": F.lit(False), "gold": F.lit("other")})
    new = evaluations.nested(again, SAMPLE, "n")
    once = _kept(evaluations.merged(old, new, SAMPLE), "evaluations")
    return evaluations.flattened(evaluations.merged(once, new, SAMPLE), SAMPLE)


# streams


@query
def s1_streaming_resume(spark, sf_dir):
    """Every row of the log in its file of three; the second run finds ids that the first one has done."""
    source, out, checkpoint = (fresh_path(spark, x) for x in ("arriving", "done", "stream"))
    rows = responses(spark, sf_dir).select(F.concat_ws("/", "id", "model").alias("id"), "gold", "n")
    process = lambda batch: batch.withColumn("batch", F.col("gold"))
    for part in (F.col("n") % 3 > 0, F.lit(True)):
        writers.append_jsonl(rows.filter(part), source)
        resume.resume_stream(spark, source, "id string, gold string, n bigint", out, checkpoint, process, order_col="n").awaitTermination()
    return spark.read.parquet(out).select("id", "gold", "n")


@query
def s2_streaming_progress(spark, sf_dir):
    source, out, checkpoint = (fresh_path(spark, x) for x in ("arriving", "counts", "stream"))
    saved_rows = scored(spark, sf_dir).select("task_type", "parse_success", "n")
    saved_rows.write.parquet(source)
    counts = resume.progress_stream(spark.readStream.schema(saved_rows.schema).parquet(source))
    write = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("task_type", "done", "parse_ok")


# text of whole tables


@query
def f15_length_stats(spark, sf_dir):
    return reports.length_stats(documents(spark, sf_dir), "text", "source")


@query
def messages_by_conversation(spark, sf_dir):
    turn = F.struct("turn", "role", F.length("text").alias("chars"))
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("messages"))
    return chats.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["chars"].cast("string"))), ",").alias("shape"))
