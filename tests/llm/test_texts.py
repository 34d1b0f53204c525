"""Language filters, token counts, quality and decontamination."""

from __future__ import annotations

import math
import random

import cases
import public_tokenizers
import pytest
import numpy as np
from brute import contaminated
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm import bpe, decontaminate, langid, quality
from loomwork.llm.common import sample_below
from loomwork.llm.queries import op1_language_filters, op5_quality_gam

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
COUNTER = bpe.TokenCounter(VOCABULARY)
LIBRARY = Tokenizer.from_file(VOCABULARY)
ODD = ["", " ", "İΣΑΣ don't I'LL 12٣½", "<|endoftext|>x<|startoftext|> <|endoftext|", "a" * 3000, "é é \x1c\x1d\x85z​", "🙂👍🏽 ﬀ ǅ", "'S'T'RE 'Ve", "한국어 ไทย"]


@pytest.mark.parametrize("text", ODD)
def test_tokens_of_odd_texts(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_tokens_equal_the_library(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False))


def test_tokens_of_every_code_point():
    """Each code point below U+32000, and those of planes 14 to 16 in part, beside letters, digits and signs."""
    points = [c for c in [*range(0x32000), *range(0xE0000, 0xE0200), 0xF0000, 0x10FFFF] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}? {chr(c)}{chr(c)}" for c in points]
    want = [len(e) for at in range(0, len(texts), 20_000) for e in LIBRARY.encode_batch(texts[at : at + 20_000], add_special_tokens=False)]
    assert [hex(c) for c, t, w in zip(points, texts, want) if COUNTER.count(t) != w] == []


def test_tokens_of_very_long_texts():
    for text in ("word, " * 400_000, "wörter und 漢字! " * 90_000, "é" * 1_100_000):
        assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False))


def test_tokens_of_a_full_cache():
    small = bpe.TokenCounter(VOCABULARY, cache_words=2)
    assert small.count("one two three four one two") == len(LIBRARY.encode("one two three four one two").ids)


def test_tokens_of_documents(spark):
    docs = cases.documents(spark)
    for r in docs.select("text", bpe.token_counts(F.col("text"), VOCABULARY).alias("c")).collect():
        assert tuple(r["c"]) == (len((r["text"] or "").encode()), len(LIBRARY.encode(r["text"] or "", add_special_tokens=False)))
    assert cases.empty(spark).select(bpe.token_counts(F.col("text"), VOCABULARY)).count() == 0


def test_languages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op1_language_filters(spark, sf).filter("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got >= 0.98


def test_language_cases(spark):
    docs = cases.documents(spark)
    filters = langid.fit(docs)
    assert filters.languages == ["en", "fr"]
    for r in docs.select("text", langid.predict(docs, filters).alias("p")).collect():
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["p"]["lang_pred"] in ("en", "fr")) if has_letter else r["p"]["lang_pred"] == "und"
        assert 0 <= r["p"]["score"] <= 1
    none = langid.fit(cases.empty(spark))
    assert none.predict(["abc", None])[0] == ["und", "und"]
    assert none.predict([])[0] == []
    # letters that no language knows: the most frequent one
    assert filters.predict(["漢"])[0] == [filters.default] or filters.predict(["漢"])[1][0] > 0


def plain_language(text: str | None, filters: langid.LanguageFilters, known: list[set[int]]) -> tuple[str, float]:
    """The prediction from a set of n-grams per language, hit by hit."""
    low, hits, n = (text or "").lower(), [0] * len(known), 0
    for i, c in enumerate(low):
        if c.isalpha():
            around = [low[j] if 0 <= j < len(low) and low[j].isalpha() else " " for j in (i - 1, i, i + 1)]
            gram = ord(around[0]) | ord(around[1]) << 21 | ord(around[2]) << 42
            n += 1
            hits = [h + (gram in grams) for h, grams in zip(hits, known)]
    sure = [max(0.0, (h - n * r) / max(1e-9, 1 - r)) for h, r in zip(hits, filters.false_positive_rates())]
    if not n:
        return "und", 0.0
    if sum(sure) <= 0:
        return filters.default, 0.0
    return filters.languages[sure.index(max(sure))], max(sure) / sum(sure)


def test_language_filters_agree_with_plain_sets(spark):
    """Filters of several languages against sets of what each one's slots contain, over every n-gram of the texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    filters = langid.fit(docs)
    texts = [r["text"] for r in docs.collect()] + [None, "", "12 34", "ÄÖ ñ", "漢字 " * 30, "a" * 300_000]
    grams = np.unique(langid.trigrams([t or "" for t in texts])[1])
    where = langid.slots(grams, filters.planes.shape[1], filters.n_hashes)
    known = [{int(g) for g, *at in zip(grams.tolist(), *where) if all(filters.planes[0][a] >> i & 1 for a in at)} for i in range(len(filters.languages))]
    names, scores = filters.predict(texts)
    for t, name, s in zip(texts, names, scores):
        assert (name, pytest.approx(s)) == plain_language(t, filters, known)


def test_learned_grams_are_the_frequent_ones(spark):
    """What the filters hold is what counting says, and besides false positives nothing else."""
    docs = cases.documents(spark).filter("lang is not null and text is not null")
    filters = langid.fit(docs, docs_per_language=10**9)
    counts: dict = {}
    for r in docs.collect():
        for g in langid.trigrams([r["text"]])[1].tolist():
            counts.setdefault(r["lang"], {}).setdefault(g, 0)
            counts[r["lang"]][g] += 1
    size = {x: sum(c.values()) for x, c in counts.items()}
    rate = lambda x, g: counts[x].get(g, 0) / size[x] if counts[x].get(g, 0) >= 2 else 0.0
    every, extra = {g for c in counts.values() for g in c}, 0
    for i, x in enumerate(filters.languages):
        for g in every:
            held = all(filters.planes[0][int(w[0])] >> i & 1 for w in langid.slots(np.array([g], dtype=np.uint64), filters.planes.shape[1], filters.n_hashes))
            due = rate(x, g) > 0 and rate(x, g) >= 0.15 * max(rate(y, g) for y in filters.languages)
            assert held or not due
            extra += held and not due
    assert extra <= 0.001 * len(every) + 2


def test_languages_are_learned_at_any_count(spark, monkeypatch):
    """A language's share of its texts may be tiny: its sample is as large as that of any other."""
    rows = [(i, f"{'the and of' if i % 2 else 'der die das'} {i}", "en" if i % 2 else "de") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    share = spark.range(10**6).filter(sample_below(3e-4, F.col("id"))).count()
    assert 200 < share < 420
    # of 3e9 texts, 3000 have hashes below the bound of a share of 1e-6; of 1e10, that of 3e-7; the bound is exact to a millionth
    assert spark.range(10**7).filter(sample_below(1e-6, F.col("id"))).count() > 0
    monkeypatch.setattr(langid, "sample_below", lambda share, *key: sample_below(share * F.lit(0.5), *key))
    half = langid.fit(docs, docs_per_language=40)
    assert half.languages == ["de", "en"] and half.predict(["the and of"])[0] == ["en"]
    monkeypatch.undo()
    few = langid.fit(docs, docs_per_language=40)
    assert few.languages == ["de", "en"] and few.predict(["the and of", "der die das"])[0] == ["en", "de"]
    with pytest.raises(ValueError, match="more than 1 languages"):
        langid.fit(docs, max_languages=1)
    assert langid.fit(docs, max_languages=2).languages == ["de", "en"]


def test_many_languages(spark):
    """More than one plane of 62 bits."""
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 5)) for _ in range(3)), f"l{i % 70:02d}") for i in range(70)]
    # each language has a word of its own, often
    rows = [(i, (t + f" {chr(0x3400 + i % 70)}{chr(0x3500 + i % 70)}" * 5), lang) for i, t, lang in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    filters = langid.fit(docs)
    assert filters.planes.shape[0] == 2
    names, _ = filters.predict([r[1] for r in rows])
    assert sum(a == r[2] for a, r in zip(names, rows)) >= 66


def test_false_positives_are_corrected():
    import numpy as np

    full = langid.LanguageFilters(["a", "b"], "a", np.array([[3] * 8 + [2] * 8], dtype=np.int64), 1)
    assert list(full.false_positive_rates()) == [0.5, 1.0]
    # language b matches everything, so its hits say nothing
    assert full.predict(["some words of text to look up here"])[0] == ["a"]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op5_quality_gam(spark, sf).filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert got >= 0.97


def test_quality_cases(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(i * 7 % 101, i % 2 if i % 5 else None) for i in range(40)] + [(None, 1)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    scores = [r["s"] for r in docs.select(quality.score(docs, model).alias("s")).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    unfitted = quality.fit(cases.empty(spark), labels)
    assert unfitted.score(quality.matrix(["abc", None, ""])).tolist() == [0.5, 0.5, 0.5]
    assert quality.features(None) == quality.features("")


def plain_score(model: quality.AdditiveModel, x: list[float]) -> float:
    """Table entries by bin, one after the other."""
    of = lambda edges, v: sum(1 for e in edges if v >= e)
    total = model.base + sum(t[of(e, v)] for e, t, v in zip(model.edges, model.tables, x))
    total += sum(t[of(model.coarse[a], x[a])][of(model.coarse[b], x[b])] for a, b, t in model.pairs)
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_scores_are_sums_of_bins(spark):
    docs = cases.documents(spark, ["word " * 300_000])
    labels = spark.createDataFrame([(r[0], len(r[1] or "") % 2) for r in cases.rows()], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    for r in docs.select("text", quality.score(docs, model).alias("s")).collect():
        assert r["s"] == pytest.approx(plain_score(model, quality.features(r["text"])))


def test_tables_are_boosted_in_cycles():
    """One round over the features, by hand: a tree of residuals each, from the base rate."""
    rng = np.random.default_rng(5)
    x, y = rng.random((300, len(quality.FEATURES))).round(2), rng.integers(0, 2, 300).astype(float)
    model = quality.train(x, y, rounds=1, pair_rounds=0, n_pairs=0, leaves=1, rate=0.5, ridge=1.0)
    total = np.full(300, math.log(y.mean() / (1 - y.mean())))
    for j in range(x.shape[1]):
        p = 1 / (1 + np.exp(-total))
        step = 0.5 * (y - p).sum() / ((p * (1 - p)).sum() + 1.0)
        assert model.tables[j] == pytest.approx(np.full(len(model.tables[j]), step))
        total = total + step
    # of two leaves, the cut is the one that lowers the loss most
    grad, weight = rng.normal(size=20), rng.random(20) + 0.1
    tree = quality._tree(grad, weight, 2, 1.0)
    best = max(range(1, 20), key=lambda c: grad[:c].sum() ** 2 / (weight[:c].sum() + 1) + grad[c:].sum() ** 2 / (weight[c:].sum() + 1))
    assert tree == pytest.approx(np.repeat([grad[:best].sum() / (weight[:best].sum() + 1), grad[best:].sum() / (weight[best:].sum() + 1)], [best, 20 - best]))


def test_quality_learns_a_pair():
    """An interaction that no single feature shows."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert {(a, b) for a, b, _ in model.pairs} >= {(0, 1)}
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95


ITEMS = [(1, None), (2, ""), (3, "..."), (4, "One two"), (10, "a b c d e f g h i j k l"), (11, "A B C d e f g h i j"), (12, "one TWO"), (None, "ä ö ü"), (5, "7 7 7 7 7 7 7 7 7 7 7 7")]
TEXTS = ["x one, two y", "b c d e f g h i j k", "a b c d e f g h i", "z a b c d e f g h i j k l m", "Ä! ä ö ü", "7 " * 25, "one two one two", ""]


def contract(docs, items, **options):
    return decontaminate.with_contamination(docs.select("text"), items, into="found", **options).select("text", "found.*")


@pytest.mark.parametrize("most", [2_000_000, 1])
def test_contamination_matches_brute_force(spark, most):
    docs = cases.documents(spark, TEXTS)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for r in contract(docs, items, max_window_words=most).collect():
        assert tuple(r)[1:6] == contaminated(r["text"], ITEMS)
    full = decontaminate.with_contamination(docs, items, max_window_words=most)
    assert full.count() == docs.count() and full.drop("contamination").columns == docs.columns


def test_contamination_spans_are_code_points(spark):
    docs = spark.createDataFrame([("ß Ünd — ONE, two ende",)], "text string")
    items = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    r = contract(docs, items).first()
    assert [r["text"][s["start"] : s["end"]] for s in r["spans"]] == ["ONE, two"]


def test_long_items_are_scanned_in_parts(spark):
    """An item of more words than a block holds, hit in several of its parts and across their edges."""
    rng = random.Random(2)
    long = cases.sentence(rng, 500).split()
    items = [(1, " ".join(long)), (2, " ".join(long[40:60])), (3, cases.sentence(rng, 30))]
    texts = [" ".join(long[a:b]) for a, b in ((0, 500), (3, 13), (95, 111), (488, 500), (0, 9), (200, 260))]
    docs = spark.createDataFrame([(t, *range(7)) for t in texts], "text string, __row long, item_id int, row int, of int, doc int, runs int, items int")
    for most in (2_000_000, 200, 1000):
        got = decontaminate.with_contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), max_window_words=most, into="contamination")
        assert got.columns == [*docs.columns, "contamination"] and {tuple(r)[1:-1] for r in got.collect()} == {tuple(range(7))}
        for r in got.select("text", "contamination.*").collect():
            assert tuple(r)[1:6] == contaminated(r["text"], items)
        # a column named as the result is replaced where it stands
        assert decontaminate.with_contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), max_window_words=most, into="of").columns == docs.columns


def test_contamination_of_very_long_texts(spark):
    rng = random.Random(4)
    text = cases.sentence(rng, 250_000)
    words = text.split()
    items = [(1, " ".join(words[200_000:200_030])), (2, " ".join(words[-11:])), (3, "nowhere at all")]
    docs = spark.createDataFrame([(text, "old")], "text string, contamination string")
    found = decontaminate.with_contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")).first()["contamination"]
    assert len(text) > 1_000_000 and (found["n_words"], found["n_hit"], found["items"]) == (250_000, 41, ["1", "2"])


def test_contamination_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert contract(cases.empty(spark), items).count() == 0
    none = contract(cases.documents(spark), items.limit(0)).filter("contaminated or n_items > 0")
    assert none.count() == 0


def test_a_worker_keeps_benchmarks_apart(spark):
    docs = spark.createDataFrame([("one two",), ("three four",)], "text string")
    for word, hit in (("one two", "one two"), ("three four", "three four")) * 2:
        items = spark.createDataFrame([(1, word)], "item_id bigint, text string")
        assert [r["text"] for r in contract(docs, items).filter("contaminated").collect()] == [hit]
