"""Fingerprint sketches, repeated strings, SimHash and the pipeline."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import cases
import numpy as np
import pytest
import xxhash
from brute import _murmur, components, contaminated, fingerprint, likeness, place, read_sketch, repeats, similar_components, sketch, sketch_likeness
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import fingerprints, mixing, quality, simhash, suffix
from loomwork.llm.windows import cuts, sliding


def by_next(rows: list[tuple]) -> dict[tuple, str]:
    """(id, text) to the next text, in the operator's order."""
    tie = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - ((1 << 64) if xxhash.xxh64_intdigest(t.encode(), 42) >> 63 else 0)
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
    return {key: order[(k + 1) % len(order)][1] for k, key in enumerate(order)}


def sketched_rows() -> list[tuple]:
    rng = random.Random(17)
    lines = [cases.sentence(rng, rng.randint(1, 40)) + rng.choice(["", ".", "?!", "..."]) for _ in range(60)]
    more = ["\n".join(rng.sample(lines, k)) for k in (1, 2, 5, 17, 18, 33, 60, 60)] + [cases.sentence(rng, 9).replace(" ", ". ") * 40, "ß." * 300, "😀" * 500]
    rows = [(r[0], r[1]) for r in cases.rows(more)]
    return [*rows, rows[3], rows[3], (7, cases.texts()[1]), (None, "null id"), (None, "null id"), (None, None), (None, "another")]


def test_sketches_match_brute_force(spark):
    rows = sketched_rows()
    after = by_next(rows)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, rank int, s string").repartition(3)
    got = sorted(map(tuple, fingerprints.fingerprinted(docs).collect()), key=repr)
    want = []
    for i, t in rows:
        t, n = t or "", after[i, t or ""]
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), sketch(t), sketch(e), pytest.approx(likeness(t, e)), pytest.approx(likeness(t, n))))
    read = [(*r[:3], read_sketch(r[3]), read_sketch(r[4]), *r[5:]) for r in got]
    assert len(read) == len(want)
    by = lambda r: repr((*r[:3], sorted(r[3][2].items())))
    for g, w in zip(sorted(read, key=by), sorted(want, key=by)):
        assert g == w


def test_likeness_is_that_of_the_returned_fingerprints(spark):
    rows = sketched_rows()
    after = by_next(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fingerprints.fingerprinted(docs).collect()
    # equal texts have equal fingerprints, so that of any row with the next text will do
    of_text = {tuple(sorted(sketch(t or "")[2].items())): t or "" for _, t in rows}
    own = {}
    for r in got:
        own[of_text[tuple(sorted(read_sketch(r["fingerprint"])[2].items()))]] = r["fingerprint"]
    assert len(own) == len({t or "" for _, t in rows if t != ""} | {""}) or len(own) == len(set(of_text.values()))
    for r in got:
        text = of_text[tuple(sorted(read_sketch(r["fingerprint"])[2].items()))]
        assert r["near_edited"] == pytest.approx(sketch_likeness(r["fingerprint"], r["edited_fingerprint"]))
        nexts = {n for (i, t), n in after.items() if i == r["doc_id"] and own[of_text[tuple(sorted(sketch(t)[2].items()))]] == own[text]}
        assert any(r["near_next"] == pytest.approx(sketch_likeness(r["fingerprint"], own[of_text[tuple(sorted(sketch(n)[2].items()))]])) for n in nexts)


def test_likeness_follows_the_shared_part(spark):
    """What two texts share counts alike wherever it stands."""
    rng = random.Random(3)
    head, tail = cases.sentence(rng, 60)[:256], cases.sentence(rng, 400)
    other_head, other_tail = cases.sentence(rng, 60)[:256], cases.sentence(rng, 400)
    pairs = [(head + "\n" + tail, head + "\n" + other_tail), (head + "\n" + tail, other_head + "\n" + tail)]
    docs = spark.createDataFrame([(2 * k + j, t) for k, pair in enumerate(pairs) for j, t in enumerate(pair)], "doc_id bigint, text string")
    near = {r["doc_id"]: r["near_next"] for r in fingerprints.fingerprinted(docs).collect()}
    assert near[1] < 0.25 and near[3] > 0.75


def test_equal_texts_have_equal_sketches(spark):
    docs = cases.documents(spark)
    by = {}
    for r in fingerprints.fingerprinted(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        by.setdefault(r["text"] or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert fingerprints.fingerprinted(cases.empty(spark)).count() == 0
    one = fingerprints.fingerprinted(docs.filter("text = 'a'").limit(1)).first()
    assert (one["near_edited"], one["near_next"]) == (1.0, 1.0)


def test_peeling_recovers_digests_and_tells_failure(spark):
    of = lambda n: f"transform(sequence(1L, {n}L), i -> shiftleft(i, 16) | cast(hash(cast(i as bigint)) & 65535 as bigint))"
    row = spark.range(1).select(
        F.expr(fingerprints.outcome(fingerprints.peel(fingerprints.let("sk", fingerprints.sketch(of(9), "16"), "sk.cells"), "16"))).alias("few"),
        F.expr(fingerprints.outcome(fingerprints.peel(fingerprints.let("sk", fingerprints.sketch(of(300), "16"), "sk.cells"), "16"))).alias("many"),
        F.expr(f"array_sort({fingerprints.let('sk', fingerprints.sketch(of(900), '1024'), fingerprints.recovered('sk'))}) = array_sort({of(900)})").alias("same"),
    ).first()
    assert (row["few"], row["many"], row["same"]) == (9, None, True)


def test_sketches_too_small_are_made_larger(spark):
    """Digests that share all their cells at the first size."""
    tables = {}
    for i in range(200_000):
        x = i << 16 | _murmur(i) & 65535
        other = tables.setdefault(tuple(place(x, t, 16) for t in range(3)), x)
        if other != x:
            break
    pair = f"array({other}L, {x}L)"
    made = fingerprints.with_sketch(spark.range(1).select(F.expr(pair).alias("xs")), "xs", "sk").select("sk.s", F.expr(fingerprints.recovered("sk")).alias("got")).first()
    assert made["s"] > 16 and set(made["got"]) == {x, other}


def test_likeness_of_sketches_that_never_peel(spark, monkeypatch):
    """Where no size peels the digests are compared as they are; a peeling that is cut off is made larger."""
    of = lambda a, b: f"transform(sequence({a}L, {b}L), i -> shiftleft(i, 16) | cast(hash(cast(i as bigint)) & 65535 as bigint))"
    rows = fingerprints.with_sketch(fingerprints.with_sketch(spark.range(1).select(F.expr(of(1, 40)).alias("a"), F.expr(of(11, 60)).alias("b")), "a", "one"), "b", "two")
    with_all = fingerprints.with_likeness(rows, "near", "one", "two").first()
    assert with_all["near"] == pytest.approx(1 - 30 / 90)
    monkeypatch.setattr(fingerprints, "outcome", lambda peeled: f"if(size({peeled}.cells) < 0, 0, cast(null as int))")
    assert fingerprints.with_likeness(rows, "near", "one", "two").first()["near"] == pytest.approx(1 - 30 / 90)
    monkeypatch.undo()
    monkeypatch.setattr(fingerprints, "ROUNDS", 1)
    cut = fingerprints.with_sketch(spark.range(1).select(F.expr(of(1, 60)).alias("a")), "a", "one").select("one.s", F.size("one_xs").alias("n")).first()
    assert cut["n"] == 60 and cut["s"] > 64


def test_sketches_are_native(spark):
    plan = fingerprints.fingerprinted(cases.documents(spark))._jdf.queryExecution().toString()
    assert "ArrowEval" not in plan and "BatchEval" not in plan


@pytest.mark.parametrize("held", [1_000_000, 1])
def test_repeats_match_brute_force(spark, held):
    rng = random.Random(3)
    passage = cases.sentence(rng, 40)
    more = [cases.sentence(rng, 30) + passage[i % 5 :] + cases.sentence(rng, 3) for i in range(40)] + ["de " * 400, "de " * 90, "é" * 200, "x" + "é" * 200]
    rows = [(i, t) for i, t in enumerate([*cases.texts(), *more])]
    docs = spark.createDataFrame([(i, t, "keep", 1) for i, t in rows], "doc_id bigint, text string, spans string, a int").repartition(5)
    got = {r["doc_id"]: tuple(r["d"]) for r in suffix.removals(docs, held=held).select("doc_id", suffix.digests().alias("d")).collect()}
    want = repeats([t for _, t in rows])
    assert [got[i] for i, _ in rows] == [w[:4] for w in want]
    kept = {r["doc_id"]: r["k"] for r in suffix.removals(docs).select("doc_id", suffix.kept_text().alias("k")).collect()}
    assert [kept[i] for i, _ in rows] == [w[4].decode("utf-8", "ignore") for w in want]


def test_repeats_with_equal_and_null_ids(spark):
    t = cases.sentence(random.Random(1), 80)
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t + "more"), (2, "other " + t), (3, None)], "doc_id bigint, text string")
    got = suffix.removals(docs).select("doc_id", suffix.digests().alias("d")).select("doc_id", "d.n_removed").collect()
    by = sorted(((r[0] is not None, r[0] or 0, r[1]) for r in got))
    n = len(t)
    assert by == [(False, 0, 0), (True, 1, n), (True, 1, n), (True, 2, n), (True, 2, n), (True, 3, 0)]
    assert suffix.removals(cases.empty(spark)).count() == 0


def test_long_texts_in_blocks():
    data = np.frombuffer(cases.sentence(random.Random(2), 3000).encode(), dtype=np.uint8)
    assert (sliding(data, 7, np.minimum) == [data[i : i + 7].min() for i in range(len(data) - 6)]).all()
    whole = set(cuts(data).tolist())
    parts = set(suffix.chunk_starts(data.tobytes(), len(data) - 99, 1000).tolist())
    assert {c for c in whole if c < len(data) - 99} <= parts


@pytest.mark.parametrize("text", [*cases.texts(), "A\x0bB\x0cC\x1cD", "Ünï ÄÖ"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == fingerprint(text)


def test_links_in_every_shape():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 800).astype(np.uint64)
    dense = np.uint64(99) ^ np.array([(1 << int(a)) | (1 << int(b)) | (1 << int(c)) for a, b, c in rng.integers(0, 14, (600, 3))], dtype=np.uint64)
    z = np.unique(np.concatenate([x, x[:200] ^ np.uint64(5), dense]))
    want = components([int(v) for v in z])
    links = dict(simhash.local_links(z, 2))
    roots = [links.get(int(v), int(v)) for v in z]
    assert roots == [int(z[i]) for i in want]
    tree = simhash.ShardTree(z, 4, 2)
    forest = simhash.Forest()
    for _, part in tree.route(z):
        for a, b in simhash.local_links(part, 2):
            forest.join(a, b)
    assert [forest.find(int(v)) for v in z] == roots


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1000, 999), (1000, 1001)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000: 999, 1001: 999}
    assert simhash.components(edges.limit(0)).count() == 0


def test_near_duplicates_match_brute_force(spark):
    rows = [r[:2] for r in cases.rows()]
    docs = cases.documents(spark)
    prints = [fingerprint(t) for _, t in rows]
    group = components(prints)
    low = {g: min(i for (i, _), h in zip(rows, group) if h == g) for g in set(group)}
    got = sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((i, p, low[g]) for (i, _), p, g in zip(rows, prints, group))
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


def test_near_duplicates_in_shards(spark):
    """The sharded path: many fingerprints, some a few bits apart, with few to a shard."""
    rng = random.Random(9)
    texts = [cases.sentence(rng, rng.randint(20, 60)) for _ in range(260)]
    for t in list(texts[:120]):
        words = t.split()
        words[rng.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    prints = [fingerprint(t) for t in texts]
    group = components(prints)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, fp int, root string")
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs, shard_rows=16).collect()}
    assert got == {i: (p, g) for i, (p, g) in enumerate(zip(prints, group))}
    assert len(set(group)) < len(set(prints))


@pytest.mark.parametrize("wanted", [1, 16, 128])
def test_shards_keep_to_their_bound(wanted):
    """With their copies, over twice the bound in no shard, and growing as the docstring says."""
    x = np.random.default_rng(1).integers(0, 2**63, 1 << 17).astype(np.uint64)
    rows = len(x) // wanted
    share = min(1.0, 64 / rows)
    tree = simhash.ShardTree(x[: int(len(x) * share)], share * rows, 2)
    sizes = [len(part) for _, part in tree.route(x)]
    assert max(sizes) <= 2 * rows and sum(sizes) <= 1.35 * len(x) * wanted**0.37
    assert set(np.concatenate([part for _, part in tree.route(x)]).tolist()) == set(x.tolist())


def test_links_over_the_shard_tree(spark):
    rng = np.random.default_rng(8)
    x = np.unique(rng.integers(0, 2**63, 1500).astype(np.uint64))
    x = np.unique(np.concatenate([x, x[:300] ^ np.uint64(9), x[:100] ^ np.uint64(1 << 40)]))
    nodes = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp bigint")
    forest = simhash.Forest()
    for r in simhash.links(nodes, 2, shard_rows=64, sample_per_shard=8).collect():
        forest.join(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1)
    assert [forest.find(int(v)) for v in x] == [int(x[i]) for i in components([int(v) for v in x])]


def test_very_long_texts(spark):
    """Texts of over a megabyte: fingerprints, sketches and removed bytes."""
    rng = random.Random(6)
    unit = cases.sentence(rng, 40_000)
    long = "\n".join(f"{k} {unit[k:]}" for k in range(7))
    rows = [(1, long), (2, "short"), (3, long[:700_000] + "!" + long[700_000:])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len(long) > 1_000_000
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.near_duplicates(docs).collect()} == {i: fingerprint(t) for i, t in rows}
    after = by_next(rows)
    for r in fingerprints.fingerprinted(docs).collect():
        t = dict(rows)[r["doc_id"]]
        n = after[r["doc_id"], t]
        assert read_sketch(r["fingerprint"]) == sketch(t) and r["near_next"] == pytest.approx(likeness(t, n))
    got = {r["doc_id"]: tuple(r["d"]) for r in suffix.removals(docs, block=1 << 18).select("doc_id", suffix.digests().alias("d")).collect()}
    assert [got[i] for i, _ in rows] == [w[:4] for w in repeats([t for _, t in rows])]


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    from types import SimpleNamespace as Of

    from loomwork.storage import shared_dir

    session = lambda master: Of(sparkContext=Of(getConf=lambda: Of(get=lambda k, d: d), master=master, applicationId="app-x"))
    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_dir(session(master))
    assert shared_dir(session("local[4]")).startswith("file://")


def test_near_duplicates_with_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "only here x y"), (4, "a b c d")], "doc_id bigint, text string")
    assert sorted(map(repr, (r["component_id"] for r in simhash.near_duplicates(docs).collect()))) == ["4", "4", "4", "None"]


def expected_pipeline(spark, sf_dir):
    """The stages' rules, one document at a time, given the quality scores and the draws of the mixture."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    rows = [r for r, s in zip(rows, model.score(quality.matrix([r["text"] for r in rows]))) if s >= 0.5]
    first = similar_components([r["text"] for r in rows])
    rows = [r for k, r in enumerate(rows) if first[k] == k]
    out, items = [], [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for r, (_, removed, _, _, kept) in zip(rows, repeats([r["text"] for r in rows])):
        text = kept.decode("utf-8", "ignore")
        if (text or not removed) and not contaminated(text, items)[4]:
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def test_pipeline_matches_brute_force(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    want = expected_pipeline(spark, sf_dir)
    copies = {r["doc_id"]: r["copies"] for r in mixing.counts(spark.createDataFrame([[r[c] for c in schema.names] for r in want], schema)).collect()}
    got = corpus_pipeline.run(spark, sf_dir)
    assert set(schema.names) <= set(got.columns)
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()) == sorted((r["doc_id"], r["text"], r["n_chars"]) for r in want for _ in range(copies[r["doc_id"]]))


def test_repeated_rows_leave_near_dedup_as_one(spark, sf_dir):
    rng = random.Random(12)
    a, b = cases.sentence(rng, 80), cases.sentence(rng, 80)
    docs = spark.createDataFrame([(4, a, "x")] * 3 + [(9, a, "x"), (5, b, "y"), (None, b, "y"), (None, None, "z"), (None, None, "z")], "doc_id bigint, text string, source string")
    out = corpus_pipeline.one_of_near_duplicates(spark, docs, sf_dir)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(4, a, "x"), (5, b, "y"), (None, None, "z")], key=repr)
    assert corpus_pipeline.without_repeats(spark, out, sf_dir).count() == 3


def test_stages_without_labels_or_items(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = cases.documents(spark)
    assert corpus_pipeline.quality_filter(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).count() == docs.count()


def test_pipeline_leaves_only_its_last_table(spark, sf_dir):
    from loomwork.storage import fresh_path

    folder = Path(fresh_path(spark, "probe").removeprefix("file://")).parent
    before = set(folder.iterdir())
    out = corpus_pipeline.run(spark, sf_dir)
    left = [p.name for p in set(folder.iterdir()) - before]
    assert len(left) == 1 and left[0].startswith("mixing-sources") and out.count() > 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_tables(spark, sf_dir, stage):
    name, f = corpus_pipeline.STAGES[stage]
    assert len(name) <= 40
    docs = cases.documents(spark)
    out = f(spark, docs, sf_dir)
    assert out.columns == docs.columns or stage == 4
    assert out.count() > 0
    assert f(spark, docs.limit(0), sf_dir).count() == 0


def test_literal_doubling_agrees(spark):
    docs = cases.documents(spark).filter("coalesce(length(text), 0) < 9000").select("doc_id", "text")
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.collect()})
    want = repeats([t for _, t in rows])
    found: dict = {}
    for r in suffix.doubled(docs).collect():
        found.setdefault(r["__doc"], []).append({"a": r["a"], "b": r["b"]})
    assert [sum(b - a for a, b in suffix.byte_spans(found.get(i), 100)) for i, _ in rows] == [w[1] for w in want]


@pytest.mark.parametrize("threshold, gram, block", [(12, 4, 1 << 20), (13, 4, 17), (20, 8, 50)])
def test_repeats_of_small_strings(spark, threshold, gram, block):
    """Many texts over two or three letters, so that every way of overlapping turns up."""
    rng = random.Random(threshold)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 40))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: tuple(r["d"]) for r in suffix.removals(docs, threshold=threshold, gram=gram, held=5, block=block).select("doc_id", suffix.digests(threshold).alias("d")).collect()}
    assert [got[i] for i in range(len(texts))] == [w[:4] for w in repeats(texts, threshold)]
