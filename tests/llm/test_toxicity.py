"""Toxicity: features against plain hashing, FTRL steps by hand, held-out accuracy, awkward tables."""

from __future__ import annotations

import math
import random

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import toxicity
from loomwork.llm.queries import op13_toxicity_ftrl

BITS = 18
MOD = 1 << 64


def mixed(h: int) -> int:
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % MOD
    h = (h ^ h >> 27) * 0x94D049BB133111EB % MOD
    return h ^ h >> 31


def plain_features(text: str | None) -> set[int]:
    """Coordinates by hashing each word by itself."""
    words, word = [], b""
    for b in [*(text or "").lower().encode(), 32]:
        if chr(b).isascii() and not chr(b).isalnum():
            words += [word] if word else []
            word = b""
        else:
            word += bytes([b])
    of = lambda w: mixed(sum((b + 1) * pow(toxicity._BASE, i, MOD) for i, b in enumerate(w)) % MOD)
    h = [of(w) for w in words]
    found = [(x, "word") for x in h] + [(of(w[:k]) + k, "start") for w in words for k in toxicity.STARTS]
    for gap, kind in ((1, "pair"), (2, "over1"), (3, "over2")):
        found += [((3 * a + b) % MOD, kind) for a, b in zip(h, h[gap:])]
    return {mixed(x % MOD ^ toxicity._SALTS[kind]) >> 64 - BITS for x, kind in found}


def by_text(texts: list[str | None]) -> list[set[int]]:
    out: list[set[int]] = [set() for _ in texts]
    for of, ids in toxicity.features(texts, BITS):
        for i, x in zip(of.tolist(), ids.tolist()):
            out[i].add(x)
    return out


@pytest.mark.parametrize("block", [1 << 20, 64, 7])
def test_features_of_whole_texts_in_blocks(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    texts = [*cases.texts()[:12], None, "", " ", "a", "Ab,cd  ef-GH é12 ÄÖ", "one two three four five six seven", "x" * 300 + " y z", "漢字 かな 漢字", "a b c d e f g h"]
    assert by_text(texts) == [plain_features(t) for t in texts]


def test_features_of_a_very_long_text():
    text = " ".join(f"w{i % 5000}" for i in range(400_000))
    assert by_text(["x", text, "y z"]) == [plain_features("x"), plain_features(text), plain_features("y z")]
    of, ids = toxicity.distinct_features(["b a a", None, "a"], BITS)
    assert [set(ids[of == i].tolist()) for i in range(3)] == [plain_features("b a a"), set(), plain_features("a")]


def test_steps_are_those_of_ftrl_proximal():
    """Three rows over four coordinates and the bias, by the formulas for single numbers."""
    state = toxicity.State.empty(2, alpha=0.7, beta=0.5, l1=0.3)
    z, n = [0.0] * 5, [0.0] * 5
    for ids, y in [([0, 2], 1.0), ([0, 1], 0.0), ([0, 2, 3], 1.0), ([0], 1.0)] * 3:
        state.learn(np.array(ids), y)
        at = [*ids, 4]
        w = {}
        for i in at:
            bound = 0.0 if i == 4 else 0.3
            w[i] = 0.0 if abs(z[i]) <= bound else -(z[i] - math.copysign(bound, z[i])) / ((0.5 + math.sqrt(n[i])) / 0.7)
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            rate = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7
            z[i] += g - rate * w[i]
            n[i] += g * g
    assert np.allclose(state.z, z) and np.allclose(state.n, n)


def test_shards_are_averaged(spark):
    """A round over Spark's shards equals the mean of states that learn here."""
    rng = random.Random(9)
    rows = [(i, f"{'vile scum' if i % 3 == 0 else 'kind word'} {rng.randint(0, 9)} text", i % 3 == 0) for i in range(90)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, bits=12, shards=3, rounds=2, l1=0.5)
    placed = docs.join(labels, "doc_id").select("text", "toxic", F.xxhash64("doc_id", F.col("toxic").cast("double")).alias("p")).collect()
    state = toxicity.State.empty(12, l1=0.5)
    for _ in range(2):
        parts = []
        for k in range(3):
            own = toxicity.State(state.z.copy(), state.n.copy(), l1=0.5)
            for r in sorted((r for r in placed if r["p"] % 3 == k), key=lambda r: r["p"]):
                own.learn(toxicity.distinct_features([r["text"]], 12)[1], r["toxic"])
            parts.append(own)
        state = toxicity.State(sum(p.z for p in parts) / 3, sum(p.n for p in parts) / 3, l1=0.5)
    w = state.weights()
    assert np.array_equal(model.at, np.flatnonzero(w[:-1])) and np.allclose(model.weight, w[model.at]) and model.bias == pytest.approx(w[-1])
    assert 0 < len(model.at) < 200


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    got = op13_toxicity_ftrl(spark, sf).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    count = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert count[1, 1] >= 0.8 * (count[1, 1] + count.get((1, 0), 0))
    assert count.get((0, 1), 0) <= 0.01 * count[0, 0]


def test_toxicity_cases(spark):
    docs = cases.documents(spark)
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r[0] for r in docs.select(toxicity.score(docs, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(0, 1), (0, 1), (7, 0), (14, 0), (14, 1), (None, 1), (21, None), (9999, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, rounds=1)
    got = docs.select("text", toxicity.score(docs, model).alias("s")).collect()
    assert len(got) == docs.count() and all(0 <= r["s"] <= 1 for r in got)
    assert len({r["s"] for r in got if not (r["text"] or "").strip()}) == 1
    assert cases.empty(spark).select(toxicity.score(docs, model)).count() == 0
    assert len(toxicity.fit(cases.empty(spark), labels).at) == 0
    alone = model.score(["idiot " * 300_000, "", "x"])
    assert alone.tolist() == [*model.score(["idiot " * 300_000]), *model.score([""]), *model.score(["x"])]
