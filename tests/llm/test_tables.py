"""WARC archives, chats and mixing."""

from __future__ import annotations

import hashlib
import math
import re

import cases
import pytest
from pyspark.sql import functions as F

from loomwork.llm import chat, mixing, warc
from loomwork.llm.common import fresh_path

PAGES = [
    (5, "http://a", "p" * 100), (3, "http://b\r\nX: 1 %0D", "p" * 100), (9, None, "p" * 100), (4, "u", "q" * 99), (6, "u", "q" * 99), (7, "u", None), (8, "u", ""),
    (10, "u", "é" * 60), (11, "u", "é" * 60), (12, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 5), (13, "u", "\r\n\r\n"), (14, "x" * 9000, "z" * 500_000), (3, "again", "p" * 100), (None, "n", "p" * 100), (None, "n", "only null" * 20),
]
SCHEMA = "page_id bigint, url string, html string, extra int, payload string, of int, digest string"


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1, "clash", 2, "clash") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("most", [200_000, 0])
def test_warc_round_trip(spark, most):
    got = warc.round_trip(pages(spark), broadcast_rows=most).collect()
    first: dict = {}
    for i, _, h in PAGES:
        if h and len(h.encode()) >= 100:
            first[h] = min(x for x in (first.get(h), i) if x is not None) if i is not None or first.get(h) is not None else None
    want = []
    for i, u, h in PAGES:
        raw = (h or "").encode()
        refers = first.get(h) if len(raw) >= 100 and first.get(h) != i else None
        want.append((i, u, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers is not None else "response", refers, True))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_warc_index_and_selected_ranges(spark):
    path = fresh_path(spark, "archives")
    warc.write(pages(spark), path, records_per_archive=4)
    index = warc.index(spark, path)
    assert index.count() == len(PAGES) and index.select("archive").distinct().count() > 3
    some = warc.read(index.filter("record_id in ('4', '14')")).collect()
    assert {(r["page_id"], r["payload_bytes"]) for r in some} == {(4, 99), (14, 500_000)} and all(r["digest_ok"] for r in some)


def parse_archive(raw: bytes) -> list[tuple[dict, bytes]]:
    """A strict reader of WARC 1.1: (fields, block) of each record."""
    out, at = [], 0
    while at < len(raw):
        head, _, _ = raw[at:].partition(b"\r\n\r\n")
        first, *lines = head.split(b"\r\n")
        assert first == b"WARC/1.1"
        fields = {}
        for line in lines:
            name, colon, value = line.decode("utf-8").partition(": ")
            assert colon and name not in fields and "\r" not in value and "\n" not in value
            fields[name] = value
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        assert re.fullmatch(r"<urn:(page:-?\d+|uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})>", fields["WARC-Record-ID"])
        start, size = at + len(head) + 4, int(fields["Content-Length"])
        assert raw[start + size : start + size + 4] == b"\r\n\r\n"
        out.append((fields, raw[start : start + size]))
        at = start + size + 4
    return out


def test_warc_records_are_valid(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    warc.write(pages(spark), path, records_per_archive=4, date="2025-01-31T12:00:00Z")
    records = [r for f in sorted((tmp_path / "archives").glob("part-*")) for r in parse_archive(f.read_bytes())]
    assert len(records) == len(PAGES) and {f["WARC-Date"] for f, _ in records} == {"2025-01-31T12:00:00Z"}
    for fields, block in records:
        http, _, body = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n")
        if fields["WARC-Type"] == "response":
            assert hashlib.sha256(body).hexdigest() == fields["WARC-Payload-Digest"].removeprefix("sha256:") and "WARC-Profile" not in fields
        else:
            assert fields["WARC-Type"] == "revisit" and not body and fields["WARC-Refers-To"]
            assert fields["WARC-Profile"] == "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    nameless = [f["WARC-Record-ID"] for f, _ in records if "uuid" in f["WARC-Record-ID"]]
    assert len(nameless) == len(set(nameless)) == 2


@pytest.mark.parametrize("range_bytes", [64, 700, 8 << 20])
def test_warc_index_in_ranges(spark, range_bytes):
    path = fresh_path(spark, "archives")
    warc.write(pages(spark), path, records_per_archive=5)
    got = warc.read(warc.index(spark, path, range_bytes=range_bytes))
    assert got.count() == len(PAGES) and got.filter("not digest_ok").count() == 0


def test_warc_of_nothing(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


TURNS = [
    (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "<|im_sep|><|im_end|>\n"), (1, 4, None, None), (2, None, "user", "x"), (2, 1, "user", r"<\| <\\| <|"), (2, 1, "user", r"<\| <\\| <|"),
    (3, 1, "assistant", ""), (4, 1, "a\nb|<c>", "<|im_start|>assistant\nhi<|im_end|>"), (None, 1, "assistant", "n" * 5000), (5, 1, "assistant", "🙂<|"), (5, 1, "assistant", "\n"),
]


def test_chats_round_trip(spark):
    turns = spark.createDataFrame([(*t, 0, "clash") for t in TURNS], "conv_id bigint, turn bigint, role string, text string, starts int, blocks string")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    for conv in {t[0] for t in TURNS}:
        order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
        want = [(t[2] or "", t[3] or "") for t in sorted((t for t in TURNS if t[0] == conv), key=order)]
        assert [tuple(x) for x in got[conv]["turns"]] == want
        assert got[conv]["loss_text"] == "".join(text for role, text in want if role == "assistant")
        assert got[conv]["mask_ok"] is True
        roles = [role for role, _ in want]
        assert got[conv]["n_blocks"] == 1 + sum(a != b for a, b in zip(roles, roles[1:]))
        assert got[conv]["formatted"].count("<|im_start|>") == got[conv]["n_blocks"]


def test_chat_mask_covers_the_output(spark):
    turns = spark.createDataFrame([t for t in TURNS], "conv_id bigint, turn bigint, role string, text string")
    for r in chat.format_chats(turns).collect():
        assert sum(x["chars"] for x in r["loss_mask"]) == len(r["formatted"])
        at, loss = 0, ""
        for x in r["loss_mask"]:
            loss += r["formatted"][at : at + x["chars"]] if x["loss"] else ""
            at += x["chars"]
        assert "<|" not in loss
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_tampered_masks_are_told(spark):
    turns = spark.createDataFrame([t for t in TURNS if t[0] is not None], "conv_id bigint, turn bigint, role string, text string")
    chats = chat.format_chats(turns)
    read = lambda df: {r["conv_id"]: r for r in chat.read_chats(df).collect()}
    good = read(chats)
    longer = chats.withColumn("loss_mask", F.expr("transform(loss_mask, (r, i) -> named_struct('chars', r.chars + if(i % 2 = 0, 5, 0), 'loss', r.loss))"))
    moved = chats.withColumn("loss_mask", F.expr("transform(loss_mask, (r, i) -> named_struct('chars', if(i = 0, r.chars + 1, if(i = size(loss_mask) - 1, r.chars - 1, r.chars)), 'loss', r.loss))"))
    # conversation 3 has but an empty text, which may stand anywhere
    for bad in (read(longer), read(moved)):
        assert not any(r["mask_ok"] for c, r in bad.items() if c != 3)
        assert any(bad[c]["loss_text"] != good[c]["loss_text"] for c in good)
    # a text run said to carry loss shows in the loss text
    all_loss = read(chats.withColumn("loss_mask", F.expr("transform(loss_mask, (r, i) -> named_struct('chars', r.chars, 'loss', i % 2 = 1))")))
    assert all(r["loss_text"] == "".join(t["text"] for t in r["turns"]) for r in all_loss.values())


def test_runs_are_cut_in_long_conversations(spark):
    """More runs than one stretch of them, characters of every width, and a first U+FEFF."""
    text = lambda i: ["a", "\ufeffé", "漢<|im_sep|>", "😀😀", ""][i % 5] * (i % 7)
    turns = spark.createDataFrame([(1, i, ["user", "assistant", "assistant"][i % 3], text(i)) for i in range(900)] + [(2, 0, "assistant", "x" * 1_200_000 + "é")], "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert got[1]["mask_ok"] and got[1]["loss_text"] == "".join(text(i) for i in range(900) if i % 3)
    assert got[2]["mask_ok"] and got[2]["loss_text"] == "x" * 1_200_000 + "é"


def test_chats_are_native(spark):
    turns = spark.createDataFrame([t for t in TURNS], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.read_chats(chat.format_chats(turns))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_uniform_and_poisson(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.lit("xxxx").alias("text"))
    out = mixing.counts(docs, weights={"a": 3.0, "b": 1.0})
    by = {r["source"]: r for r in out.groupBy("source").agg(F.avg("copies").alias("m"), F.variance("copies").alias("v"), F.first("rate").alias("rate")).collect()}
    assert math.isclose(by["a"]["rate"], 3.0) and math.isclose(by["b"]["rate"], 1 / 3)
    for r in by.values():
        assert abs(r["m"] - r["rate"]) < 0.1 and abs(r["v"] - r["rate"]) < 0.2


def test_large_rates_are_summed(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4, "rare").otherwise("common").alias("source"), F.lit("t").alias("text"))
    out = mixing.counts(docs, weights={"rare": 1.0, "common": 1.0}).filter("source = 'rare'").collect()
    assert out[0]["rate"] == 250 and all(150 < r["copies"] < 350 for r in out)


@pytest.mark.parametrize("most", [10_000, 0])
def test_rows_without_ids_draw_for_themselves(spark, most):
    """Null ids, with different texts and with equal ones, spread over draws and partitions."""
    n = 4000
    docs = spark.range(2 * n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") < n, F.concat(F.lit("t"), F.col("id") + 10_000)).otherwise("txxxxx").alias("text"))
    for seed in ("mix", "a"):
        drawn = mixing.counts(docs, seed=seed, broadcast_sources=most).withColumn("same", F.col("text") == "txxxxx")
        for r in drawn.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.avg("copies").alias("m"), F.variance("copies").alias("v")).collect():
            assert r["n"] == n and abs(r["m"] - 1) < 0.08 and abs(r["v"] - 1) < 0.12
    out = mixing.mix(docs, broadcast_sources=most)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 2 * min(sizes)
    assert out.select("shuffle_key").distinct().count() == out.count()


def test_equal_rows_are_made_anew(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 3)
    docs = spark.createDataFrame([(1, "a", "x")] * 8 + [(1, "a", "y"), (None, None, None), (None, None, None)], "doc_id bigint, source string, text string")
    got = mixing.known(docs, "text", 100).groupBy("doc_id", "source", "text").agg(F.sort_array(F.collect_list("__nth")).alias("n")).collect()
    assert sorted((r["text"] or "", r["n"]) for r in got) == [("", [1, 2]), ("x", list(range(1, 9))), ("y", [1])]


def test_rows_that_differ_have_keys_that_differ(spark):
    """A null and the text "null", and values that hold what separates them from others."""
    rows = [(1, None, "x"), (1, "null", "x"), (1, "a\x1fb", None), (1, "a", "b"), (1, 'a","text":"b', "c"), (1, "", None), (1, None, None), (None, "1", "x"), (1, "a", ""), (1, "a\x1f", "b")]
    for columns in ("doc_id bigint, source string, text string", "doc_id bigint, text string, source string"):
        docs = spark.createDataFrame(rows, columns)
        assert mixing.known(docs, "text", 100).select("__row").distinct().count() == len(rows)
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), weights={"a": 1.0, "null": 30.0})
    assert out.select("shuffle_key").distinct().count() == out.count() > 0


def test_mixing_is_native(spark):
    plan = mixing.mix(cases.documents(spark))._jdf.queryExecution().toString()
    assert "ArrowEval" not in plan and "BatchEval" not in plan and "InArrow" not in plan


@pytest.mark.parametrize("most", [10_000, 0])
def test_mixing_cases(spark, most):
    docs = cases.documents(spark)
    counts = mixing.counts(docs, broadcast_sources=most)
    assert counts.count() == docs.count() and counts.columns == [*docs.columns, "rate"]
    out = mixing.mix(docs, broadcast_sources=most)
    assert out.columns == [*docs.columns, "copy_no", "shuffle_key"] and set(r[0] for r in out.select("copies").collect()) == {3}
    assert out.count() == counts.agg(F.sum("copies")).first()[0]
    assert mixing.mix(cases.empty(spark)).count() == 0
    # without weights only sources that have no text keep a rate
    assert mixing.counts(docs.filter("n_chars > 0"), weights={}).agg(F.sum("copies")).first()[0] == 0
    again = mixing.mix(docs, broadcast_sources=most)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, again.collect()))
