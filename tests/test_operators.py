"""Properties of joins, sampling, filters, reports, sources and streams on small tables."""

from __future__ import annotations

import csv
import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from loomwork.config import Settings
from loomwork.operators import evaluations, filters, relational, reports, sampling
from loomwork.sources import publish, readers, writers
from loomwork.storage import looked_up, saved, scratch, with_rank
from loomwork.streaming import resume

SIX = ["bit_manipulation", "cipher_text", "gravity", "roman", "symbol_transform", "unit_conversion"]


def test_split_is_exact_and_exhaustive(spark):
    for n, want in ((9500, 950), (5, 0), (0, 0)):
        out = sampling.split(spark.range(n), "id", 42, 0.10)
        assert out.filter("split = 'val'").count() == want and out.select("id").distinct().count() == n
    assert sampling.split(spark.range(5), "id", 42, 0.10, minimum=1).filter("split = 'val'").count() == 1


def test_rank_is_a_permutation(spark):
    ranked = with_rank(spark.range(1000).withColumn("k", F.col("id") % 7), F.col("k"), F.col("id"))
    assert [r["rank"] for r in ranked.orderBy("k", "id").collect()] == list(range(1, 1001))


def test_stratified_sizes(spark):
    df = spark.range(600).withColumn("task", F.element_at(F.array(*[F.lit(x) for x in SIX]), (F.col("id") % 6 + 1).cast("int")))
    got = {r[0]: r[1] for r in sampling.stratified(df, "task", "id", 50, 42).groupBy("task").count().collect()}
    assert [got[x] for x in SIX] == [9, 9, 8, 8, 8, 8]
    short = df.filter("task != 'roman' or id < 10")
    assert sampling.stratified(short, "task", "id", 50, 42).filter("task = 'roman'").count() == short.filter("task = 'roman'").count()


def test_round_robin_refills(spark):
    df = spark.createDataFrame([(str(i), "a" if i < 2 else "b") for i in range(20)] + [("x", None)], "id string, t string")
    got = {r[0]: r[1] for r in sampling.round_robin(df, "t", "id", 9, 1).groupBy("t").count().collect()}
    assert got == {"a": 2, "b": 6, None: 1}
    assert sampling.round_robin(df, "t", "id", 0, 1).count() == 21


def test_prefer_new_keeps_bags_and_ids_as_text(spark):
    new = spark.createDataFrame([("1", "n"), ("1", "n2")], "id string, v string")
    old = spark.createDataFrame([(1, "o"), (2, "o"), (2, "o2")], "id int, v string").withColumn("id", F.col("id").cast("string"))
    assert sorted(tuple(r) for r in relational.prefer_new(new, old).collect()) == [("1", "n"), ("1", "n2"), ("2", "o"), ("2", "o2")]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "m", 1, 0), ("b", "m", 2, 1)], "id string, model string, v int, n int")
    new = spark.createDataFrame([("a", "m", 9, 0), ("c", "m", 3, 1)], "id string, model string, v int, n int")
    once = relational.upsert(old, new, ["id", "model"], "n")
    twice = relational.upsert(once, new, ["id", "model"], "n")
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r["id"]: r["v"] for r in once.collect()} == {"a": 9, "b": 2, "c": 3}


def test_keep_last_drops_blank(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("", 3, 2), (None, 4, 3)], "id string, v int, n int")
    assert [tuple(r) for r in relational.keep_last(df, ["id"], "n").collect()] == [("a", 2, 1)]


def test_quality_filter_missing_null_low_enough(spark):
    rows = [(0, '{"id":0}'), (1, '{"quality_score":null}'), (2, '{"quality_score":0.4}'), (3, '{"quality_score":0.5}')]
    df = spark.createDataFrame(rows, "i int, raw string")
    ok = filters.quality_ok(readers.has_key(F.col("raw"), "quality_score"), F.get_json_object("raw", "$.quality_score").try_cast("double"), 0.5)
    assert [r["ok"] for r in df.select("i", ok.alias("ok")).orderBy("i").collect()] == [True, False, False, True]


def test_first_failing_filter_counts(spark):
    df = spark.createDataFrame([(False, False, True), (True, False, False), (True, True, False), (True, True, True)], "q boolean, w boolean, s boolean")
    got = filters.reject_counts(df.withColumn("r", filters.reject_reason(F.col("q"), F.col("w"), F.col("s"))), "r")
    assert {r[0]: r[1] for r in got.collect()} == {"quality": 1, "words": 1, "downweight": 1, "kept": 1}


def test_required_and_lookup(spark):
    df = spark.createDataFrame([(0, "p", "a"), (1, None, "a")], "n int, prompt string, answer string")
    with pytest.raises(ValueError, match="Row 1 missing 'prompt'"):
        filters.require(df, ["prompt", "answer"], "n")
    with pytest.raises(LookupError):
        filters.one_by_id(df, "n", "7")


def test_golden_totals_winner_and_recommendation(spark):
    right = {"bit_manipulation": 7, "cipher_text": 8, "gravity": 8, "roman": 8, "symbol_transform": 6, "unit_conversion": 8}
    total = dict(zip(SIX, [9, 9, 8, 8, 8, 8]))
    rows = [("one-1", x, i < right[x], True, "w", 1.0) for x in SIX for i in range(total[x])] + [("two-2", x, True, True, "w w", -1.0) for x in SIX for _ in range(total[x])]
    df = spark.createDataFrame(rows, "model string, task_type string, correct boolean, parse_success boolean, reasoning string, gen_time double")
    table = reports.accuracy_with_totals(df)
    totals = {r["model"]: (r["correct"], r["total"]) for r in table.filter("is_total").collect()}
    assert totals == {"one-1": (45, 50), "two-2": (50, 50)}
    winners = {r["task_type"]: r["winner"] for r in reports.winners(table).collect()}
    assert winners["gravity"] == "tie" and winners["symbol_transform"] == "two" and winners["TOTAL"] == "two"
    lone = reports.accuracy(df.filter("task_type = 'roman' and model = 'one-1'").withColumn("correct", F.lit(False)))
    assert [r["winner"] for n in (1, 2) for r in reports.winners(lone, n_models=n).collect()] == ["one", "tie"]
    metrics = reports.quality_metrics(df)
    assert {r["model"]: r["avg_time"] for r in metrics.collect()} == {"one-1": 1.0, "two-2": 0.0}
    assert tuple(reports.recommendation(metrics).first()) == ("two-2", 1.0, "one-1", 0.9)
    assert reports.recommendation(metrics.limit(1)).count() == 0
    gate = reports.gate(df, [F.col("model"), F.col("task_type")], 50, 0.95).first()
    assert (gate["match_rate"], gate["passed"]) == (0.9, False)


def test_a_task_may_be_called_total(spark):
    df = spark.createDataFrame([("m", "TOTAL", True, True), ("m", "x", False, True), ("m", "x", True, False)], "model string, task_type string, correct boolean, parse_success boolean")
    assert sorted(map(tuple, reports.accuracy_with_totals(df).collect())) == [("m", "TOTAL", False, 1, 1), ("m", "TOTAL", True, 2, 3), ("m", "x", False, 1, 2)]
    nested = reports.nested_summary(reports.summary(df)).first()
    assert (nested["correct"], nested["total"], set(nested["by_task"])) == (2, 3, {"TOTAL", "x"})
    assert sorted((r["task_type"], r["is_total"]) for r in reports.winners(reports.accuracy_with_totals(df)).collect()) == [("TOTAL", False), ("TOTAL", True), ("x", False)]
    assert sorted((r["task_type"], r["is_total"], r["n"]) for r in reports.flat_rates(df, {"a": "correct"}).collect()) == [("TOTAL", False, 1), ("TOTAL", True, 3), ("x", False, 2)]
    assert sorted((r["task_type"], r["is_total"], r["done"]) for r in reports.done_counters(df, F.lit(False)).collect()) == [("TOTAL", False, 1), ("TOTAL", True, 3), ("x", False, 2)]


def test_reports_of_nothing(spark):
    empty = spark.createDataFrame([], "model string, task_type string, correct boolean, parse_success boolean, reasoning string, gen_time double")
    assert reports.summary(empty).count() == 0 and reports.quality_metrics(empty).count() == 0
    assert reports.gate(empty, [F.col("model")], 100, 0.95).first()["passed"] is False


def test_jsonl_strict_raises_and_tolerant_drops(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n\nnot json\n{"other": 1}\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path), "id string").collect()
    assert [r[0] for r in readers.read_jsonl_tolerant(spark, str(tmp_path), "id string", required="id").collect()] == ["a"]


def test_jsonl_is_judged_by_whole_lines(spark, tmp_path):
    """What a query reads of a line doesn't change what counts as malformed."""
    (tmp_path / "x.jsonl").write_text('{"id": "a", "n": 1}\n{"id": "b", "n": "zz"}\n{"id": "c"\n')
    schema = "id string, n bigint"
    rows = readers.read_jsonl_tolerant(spark, str(tmp_path), schema)
    assert (rows.count(), [r[0] for r in rows.select("id").collect()], [tuple(r) for r in rows.collect()]) == (1, ["a"], [("a", 1)])
    strict = readers.read_jsonl(spark, str(tmp_path), schema)
    for action in (strict.count, strict.collect, strict.select("id").collect):
        with pytest.raises(Exception, match="malformed"):
            action()


GOOD = ['{"id":"a","n":1}', ' {"id":"b","n":2}\t', '{"id":"c","__end":"z"}', '{"id":"d","x":[{"y":"}"}]}']
BROKEN = [
    '{"id":"a","n":1} junk', '{"id":"a","n":3}{"id":"b","n":4}', "{'id':'e','n':5}", '{"id":"a"},{"id":"b"}', '{"id":"a"}] [{"id":"b"}', '{"id":"a"},{"__end":true}] x', '{"id":"a"},true',
    '[{"id":"a"}]', "42", '"x"', "null", '{"id":"a"', '{"id":"a"},', "{id:1}", "",
]


def test_a_line_holds_one_object(spark):
    rows = spark.createDataFrame([(x,) for x in GOOD + BROKEN], "line string").select("line", readers.one_object(F.col("line")).alias("ok")).collect()
    assert {r["line"] for r in rows if r["ok"]} == set(GOOD)


@pytest.mark.parametrize("line", BROKEN[:-1])
def test_readers_refuse_lines_of_more_or_less_than_one_object(spark, tmp_path, line):
    (tmp_path / "x.jsonl").write_text("\n".join([*GOOD, line, '{"id":"last","prompt":"p","answer":"a"}']) + "\n")
    schema = "id string, n bigint"
    kept = readers.read_jsonl_tolerant(spark, str(tmp_path), schema)
    assert [r["id"] for r in kept.collect()] == ["a", "b", "c", "d", "last"] and kept.count() == 5
    for read in (lambda: readers.read_jsonl(spark, str(tmp_path), schema).count(), lambda: readers.read_samples(spark, str(tmp_path)).collect()):
        with pytest.raises(Exception, match="malformed line"):
            read()


def test_numbered_lines_read_twice_at_most(spark, tmp_path):
    (tmp_path / "x").write_text("a\nb\n")
    got = readers.numbered_lines(spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("text") == 1  # and one read for the table of places


def csv_file(path, rng, rows, ending):
    fields = ["", "plain", "with, comma", 'say "x", ""y""', "two\nlines", "crlf\r\nin\n\n\nblank", " spaced ", "é漢", "z" * 400]
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator=ending)
        out.writerow(["id", "prompt", "answer", "task_type"])
        out.writerows([f"i{i}", *(rng.choice(fields) for _ in range(3))] for i in range(rows))


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_csv_with_line_breaks_is_split(spark, tmp_path, ending):
    rng = random.Random(1)
    for name, n in (("a", 1500), ("b", 40), ("c", 0)):
        csv_file(tmp_path / f"{name}.csv", rng, n, ending)
    # a record over many splits; no last line feed
    (tmp_path / "long.csv").write_text('id,prompt,answer,task_type\n1,"' + "line\n" * 4000 + '",x,\n\n2,y,"z"', newline="")
    want = []
    for file in sorted(tmp_path.iterdir()):
        with open(file, newline="") as f:
            want += [tuple(x or None for x in r) + (None,) * (4 - len(r)) for r in list(csv.reader(f))[1:] if r]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6k")
    try:
        got = [tuple(r) for r in readers.read_csv(spark, str(tmp_path)).collect()]
        assert spark.read.text(str(tmp_path), lineSep="\n").withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    if ending == "\n":
        assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in readers.read_csv(spark, str(tmp_path), whole_files=True).collect())


@pytest.mark.parametrize("text", ['1,a"b,c,d\n2,"x",y,z\n', '1,"ab"c,c,d\n', '1,"abc,c,d\n2,a,b,c\n', '1,b,c,d\n2, "q",r,s\n', '1,b,c,"\n'])
def test_csv_with_quotes_within_fields_is_refused(spark, tmp_path, text):
    (tmp_path / "x.csv").write_text("id,prompt,answer,task_type\n" + text)
    with pytest.raises(Exception, match="whole_files"):
        readers.read_csv(spark, str(tmp_path)).collect()


def test_rank_offsets_are_an_array(spark):
    """Ten thousand partitions' offsets, looked up by index; the plan holds no map."""
    values = [7 * i for i in range(10_000)]
    df = spark.range(30_000).select("id", looked_up(values, F.col("id") % 10_000).alias("x"))
    assert df.filter("x != 7 * (id % 10000)").count() == 0
    assert "map" not in with_rank(spark.range(50), F.desc("id"))._jdf.queryExecution().optimizedPlan().toString()
    assert with_rank(spark.range(0), F.col("id")).count() == 0


def test_scratch_scopes_are_per_thread(spark, tmp_path):
    made = []
    with scratch(spark):
        inside = saved(spark.range(3), "inside")
        other = threading.Thread(target=lambda: made.append(saved(spark.range(4), "other")))
        other.start()
        other.join()
        assert inside.count() == 3
    assert made[0].count() == 4
    with pytest.raises(Exception):
        inside.count()


def test_preview(spark):
    df = spark.createDataFrame([(2, None), (1, "a"), (3, "c")], "n int, s string")
    assert [tuple(r) for r in readers.preview(df, "n", 2).orderBy("place").collect()] == [(0, "n", "int", 3, ["1", "2"]), (1, "s", "string", 2, ["a", None])]
    assert [tuple(r) for r in readers.preview(df.limit(0), "n", 2).orderBy("place").collect()] == [(0, "n", "int", 0, []), (1, "s", "string", 0, [])]


def test_published_output_is_old_or_new(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, path)
    ids = lambda: sorted(r[0] for r in publish.read_published(spark, path, "id bigint").collect())
    publish.publish(spark.range(3), path)
    with pytest.raises(Exception):  # fails while it is written
        publish.publish(spark.range(100, 1000, 1, 8).withColumn("id", F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long"))), path)
    assert ids() == [0, 1, 2] and len([x for x in os.listdir(path) if x.startswith("version-")]) == 1
    with pytest.MonkeyPatch.context() as m:  # fails between the rows and the pointer to them
        m.setattr(publish, "_make_current", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            publish.publish(spark.range(9), path)
    assert ids() == [0, 1, 2]
    reading = publish.read_published(spark, path, "id bigint")
    publish.publish(reading.select(F.col("id") + 10), path, fmt="json")
    publish.publish(spark.range(5), path)
    assert ids() == [0, 1, 2, 3, 4]
    assert len(publish.versions(spark, path)) == 2 and not [x for x in os.listdir(path) if "next" in x]


def test_counters_come_from_the_writing_job(spark, tmp_path):
    df = spark.range(100).withColumns({"text": F.lit("a b"), "q": F.col("id") % 10})
    reason = filters.reject_reason(F.col("q") > 0, F.col("q") > 1, F.lit(True))
    spark.sparkContext.setJobGroup("counted", "")
    got = filters.write_kept(df, reason, lambda rows: writers.append_jsonl(rows, str(tmp_path / "kept")))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) == 1
    assert got == {"quality": 10, "words": 10, "downweight": 0, "kept": 80} and spark.read.json(str(tmp_path / "kept")).count() == 80
    rows = spark.createDataFrame([("t", True, True, False), ("t", None, None, False), ("t", True, True, True), ("u", True, False, False), (None, True, True, False)], "task_type string, parse_success boolean, correct boolean, failed boolean")
    spark.sparkContext.setJobGroup("progress", "")
    progress = reports.write_with_progress(rows, F.col("failed"), ["t", "v"], lambda df: writers.append_jsonl(df, str(tmp_path / "all")))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("progress")) == 1
    spark.sparkContext.setJobGroup("", "")
    assert progress == [("t", 2, 1, 1, 1), ("v", 0, 0, 0, 0), (None, 5, 1, 3, 2)]


FLAT = "id string, model_label string, task_type string, prompt string, gold_answer string, prediction_extracted string, correct boolean, n bigint"
SAMPLE = ["task_type", "prompt", "gold_answer"]


def test_nested_evaluations_round_trip(spark, tmp_path):
    flat = spark.createDataFrame([
        ("a", "m2", "t", "p", "g", "x", True, 1), ("a", "m1", "t2", "p2", "g2", "y", False, 2), ("a", "m2", "t", "p", "g", "z", False, 3), ("b", "m1", "t", None, "g", None, None, 4), (None, "m1", "t", "p", "g", "x", True, 5), ("c", None, "t", "p", "g", "x", True, 6),
    ], FLAT)
    rows = evaluations.nested(flat, SAMPLE, "n")
    publish.publish(rows, str(tmp_path / "e"))
    back = publish.read_published(spark, str(tmp_path / "e"), rows.schema)
    shown = lambda df: {r["id"]: (tuple(r[c] for c in SAMPLE), [(e["key"], e["value"]["prediction_extracted"], e["value"]["correct"]) for e in r["e"]]) for r in df.withColumn("e", F.map_entries("results")).collect()}
    assert shown(back) == {"a": (("t", "p", "g"), [("m2", "z", False), ("m1", "y", False)]), "b": (("t", None, "g"), [("m1", None, None)])}
    new = evaluations.nested(spark.createDataFrame([("a", "m1", "T", "P", "G", "new", True, 1), ("a", "m3", "T", "P", "G", "w", True, 2), ("d", "m1", "t", "p", "g", "v", True, 3)], FLAT), SAMPLE, "n")
    merged = evaluations.merged(back, new, SAMPLE)
    want = {"a": (("t", "p", "g"), [("m2", "z", False), ("m1", "new", True), ("m3", "w", True)]), "b": (("t", None, "g"), [("m1", None, None)]), "d": (("t", "p", "g"), [("m1", "v", True)])}
    assert shown(merged) == want and shown(evaluations.merged(merged, new, SAMPLE)) == want
    assert evaluations.flattened(merged, SAMPLE).count() == 5
    fields = {"answer": "prediction_extracted"}
    old = evaluations.clean_answers(evaluations.nested(flat.filter("n = 1"), SAMPLE, "n"), SAMPLE, fields=fields)
    clean = evaluations.merged_answers(old, evaluations.clean_answers(merged, SAMPLE, fields=fields), SAMPLE)
    assert {r["id"]: [tuple(m) for m in r["correct_models"]] for r in clean.collect()} == {"a": [("m2", "x"), ("m1", "new"), ("m3", "w")], "d": [("m1", "v")]}


def test_lines_are_numbered_within_their_file(spark, tmp_path):
    for name, n in (("a", 2000), ("b", 3), ("c", 0)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" + ("\n" if i % 10 == 9 else "") for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = sorted((r["file"][-1], r["line"], r["value"]) for r in readers.numbered_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(name, i, line) for name in "abc" for i, line in enumerate((tmp_path / name).read_text().splitlines())]


def test_samples_take_the_first_truthy_alias(spark, tmp_path):
    objects = [
        {"prompt": "p", "answer": "0"}, {"prompt": 0, "question": " q ", "answer": False, "output": "false"}, {"id": 7, "user": "u", "answer": 0.0, "target": 7},
        {"prompt": "p", "answer": 1.5, "task": "Roman"}, {"prompt": [], "question": {}, "user": "u", "answer": True}, {"prompt": "p", "answer": ""}, {"id": "  ", "prompt": " ", "question": "q", "answer": "a"},
        {"id": "i", "prompt": None, "question": "roman numeral", "answer": "  x"}, {"prompt": "p", "answer": -3}, {"prompt": "é\n", "answer": "\\boxed{1}"},
    ]
    (tmp_path / "x.jsonl").write_text("\n\n".join(map(json.dumps, objects)) + "\n")
    want = []
    for i, o in enumerate(objects):
        prompt, answer = (str(next((o[k] for k in keys if o.get(k)), "")).strip() for keys in (("prompt", "question", "user"), ("answer", "output", "target")))
        if prompt and answer:
            want.append((str(o.get("id") or f"jsonl_{2 * i}").strip(), prompt, answer, 2 * i))
    got = readers.read_samples(spark, str(tmp_path))
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    assert {r["line"]: r["task_type"] for r in got.collect() if r["task_type"]} == {6: "roman", 14: "roman"}
    (tmp_path / "y.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        readers.read_samples(spark, str(tmp_path)).collect()


def test_problem_ids_are_made_of_places(spark):
    rows = [(None, "p", "a", None, 5), ("", "p", "a", None, 2), ("x", "p", "a", None, 3), (None, " ", "a", None, 1), (" ", "p", "a", None, 9)]
    df = spark.createDataFrame(rows, readers.PROBLEMS + ", ordinal bigint")
    assert {r["ordinal"]: r["sample_id"] for r in readers.normalised_problems(df, "ordinal").collect()} == {2: "row_0", 3: "x", 5: "row_2", 9: ""}


def test_quotas_of_many_strata(spark):
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("s"), F.col("id") % 300).alias("s"))
    out = sampling.stratified(df, "s", "id", 450, 1)
    counts = {r["s"]: r["count"] for r in out.groupBy("s").count().collect()}
    names = sorted({f"s{i % 300}" for i in range(300)})
    assert counts == {x: 1 + (i < 150) for i, x in enumerate(names)}


def test_length_stats(spark):
    df = spark.createDataFrame([("a", "x yy"), ("a", None), ("a", " z  "), ("b", "")], "g string, text string")
    got = {r["g"]: tuple(r)[1:] for r in reports.length_stats(df, "text", "g").collect()}
    assert got == {"a": (3, 8 / 3, 4.0, 4.0, 4, 1.0, 1.0, pytest.approx(1.9), 2), "b": (1, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0)}


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'a "quoted"\nline', " b ", None), (None, "p", "q", "t")]
    df = spark.createDataFrame(rows, readers.PROBLEMS)
    writers.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "c")).collect()), key=str) == sorted(rows, key=str)


def test_missing_inputs_and_report(spark, tmp_path):
    writers.append_jsonl(spark.range(2).selectExpr("cast(id as string) id"), str(tmp_path / "a.jsonl"))
    found, missing = readers.read_existing(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], "id string")
    assert sorted(map(tuple, found.collect())) == [("0", "a"), ("1", "a")] and missing == [str(tmp_path / "b.jsonl")]
    assert json.loads(writers.report_json({"s": spark.range(1)})) == {"s": [{"id": 0}]}


def test_settings():
    assert Settings.from_dict({"seed": 1}).seed == 1
    with pytest.raises(ValueError, match="colour"):
        Settings.from_dict({"colour": 1})


def test_resume_stream_is_idempotent(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "id string, v int"
    put = lambda *rows: writers.append_jsonl(spark.createDataFrame(rows, schema).coalesce(1), source)
    run = lambda at=mark: resume.resume_stream(spark, source, schema, out, at, lambda df: df, order_col="v").awaitTermination()
    done = lambda: sorted(((r["id"], r["v"]) for r in spark.read.parquet(out).collect()), key=str)
    put(("a", 3), ("b", 2), ("a", 1), (None, 7))
    run()
    put(("b", 0), ("c", 4), ("c", None), (None, 7), ("a", 0))
    run()
    want = sorted([("a", 1), ("b", 2), ("c", None), (None, 7), (None, 7)], key=str)
    assert done() == want
    run()
    assert done() == want
    run(str(tmp_path / "other"))  # another checkpoint reads all files anew, and finds what is done in the output
    assert [x for x in done() if x[0]] == [x for x in want if x[0]]


def test_resume_stream_runs_a_batch_again(spark, tmp_path):
    """A batch that fails before it is committed leaves nothing twice."""
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    writers.append_jsonl(spark.range(50).select(F.col("id").cast("string")), source)
    runs = []

    def process(batch):
        runs.append(1)
        return batch if len(runs) > 1 else batch.withColumn("id", F.when(F.col("id") != "17", F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("string")))

    with pytest.raises(Exception):
        resume.resume_stream(spark, source, "id string", out, mark, process).awaitTermination()
    resume.resume_stream(spark, source, "id string", out, mark, process).awaitTermination()
    assert sorted(int(r["id"]) for r in spark.read.parquet(out).collect()) == list(range(50))


def test_resume_batch_cost_does_not_follow_the_output(spark, tmp_path):
    """A later batch writes a file of its own and reads no file of the output."""
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    seen = []
    process = lambda df: (seen.append(df._jdf.queryExecution().analyzed().toString()), df)[1]
    for k in range(3):
        writers.append_jsonl(spark.range(k * 2000, (k + 1) * 2000 + 100).select(F.col("id").cast("string")), source)
        resume.resume_stream(spark, source, "id string", out, mark, process).awaitTermination()
    assert spark.read.parquet(out).count() == 6100 and not any("parquet" in x for x in seen)
    assert [len([f for f in fs if f.endswith(".parquet")]) for d, _, fs in os.walk(out) if "__batch=" in d] == [1, 1, 1]


def test_progress_stream(spark, tmp_path):
    writers.append_jsonl(spark.createDataFrame([("t", True), ("t", False), ("u", None)], "task_type string, parse_success boolean"), str(tmp_path / "r"))
    stream = spark.readStream.schema("task_type string, parse_success boolean").json(str(tmp_path / "r"))
    q = resume.progress_stream(stream).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("progress").collect())) == [("t", 2, 1), ("u", 1, 0)]


def test_moving_average_across_blocks(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("g"), F.col("id").alias("n"), (F.col("id") * F.col("id")).cast("double").alias("v"))
    whole = reports.moving_average(df, "g", "n", "v", 5, 3)
    parts = reports.moving_average(df, "g", "n", "v", 5, 3, block=4)
    rows = lambda d: sorted(tuple(r) for r in d.select("n", "done", "recent", "seconds_left").collect())
    assert rows(whole) == rows(parts)
    assert rows(whole)[4] == (4, 3, pytest.approx((0 + 4 + 16) / 3), pytest.approx(22 * (20 / 3) / 3))


def test_strip_covers_pythons_white_space():
    from loomwork.functions.pytext import SPACE

    assert set(SPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
