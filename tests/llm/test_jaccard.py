"""Near duplicates by five-word shingles, alone and as the pipeline's stage."""

from __future__ import annotations

import random

import cases
import numpy as np
import pytest
from brute import components, similar_components

import corpus_pipeline
from loomwork.llm import jaccard, simhash


def edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randint(0, 10**9)}"
    return " ".join(words)


def near_texts() -> list[str | None]:
    """Copies with edits on both sides of the threshold, chains of edits, and a passage in many texts."""
    rng = random.Random(11)
    base, passage = [cases.sentence(rng, n) for n in (40, 60, 100, 300)], cases.sentence(rng, 30)
    out = [*cases.texts(), *base, *(f"{cases.sentence(rng, 60)} {passage} {cases.sentence(rng, 60)}" for _ in range(30))]
    for b in base:
        out += [edited(rng, b, rng.randint(1, max(2, len(b.split()) // 25))) for _ in range(25)]
        link = b
        for _ in range(6):
            out.append(link := edited(rng, link, 1))
    return out


@pytest.mark.parametrize(("sample_rows", "block_rows", "block_shingles"), [(1 << 13, 1 << 14, 1 << 21), (1, 7, 1 << 21), (1, 1 << 14, 500)])
def test_near_duplicates_match_brute_force(spark, sample_rows, block_rows, block_shingles):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, sample_rows=sample_rows, block_rows=block_rows, block_shingles=block_shingles).collect()}
    want = similar_components(texts)
    assert len({w for w in want if want.count(w) > 5}) >= 4
    assert [got[i] for i in range(len(texts))] == want
    assert jaccard.near_duplicates(cases.empty(spark)).count() == 0


def clustered_sets() -> list[np.ndarray]:
    rng = np.random.default_rng(4)
    bases = [rng.integers(-(2**62), 2**62, n) for n in (5, 30, 200, 1500)]
    return [np.unique(np.concatenate([rng.permutation(b)[: len(b) - k], rng.integers(-(2**62), 2**62, k)])) for b in bases for k in rng.integers(0, len(b) // 4 + 1, 40)]


def classes(n: int, edges) -> list[int]:
    label = list(range(n))
    for a, b in edges:
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    return label


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b))
    return 5 * common >= 4 * (len(a) + len(b) - common)


@pytest.mark.parametrize("linked", [1, 7, 160])
def test_local_search_links_every_pair(linked):
    """``linked`` of the sets are one component from the beginning."""
    sets = clustered_sets()
    comp = np.array([max(0, i - linked + 1) for i in range(len(sets))])
    before = [(i, 0) for i in range(linked)]
    found = jaccard.local_links(np.arange(len(sets)), comp, np.concatenate(sets), np.array([len(s) for s in sets]), 4, 5)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])]
    assert all(similar(sets[a], sets[b]) for a, b in found)
    assert classes(len(sets), before + found) == classes(len(sets), before + pairs)
    keep = jaccard.with_partners(np.array([len(s) for s in sets]), comp, [jaccard.sketch(s) for s in sets], 4, 5)
    assert all(keep[i] and keep[j] for i, j in pairs if comp[i] != comp[j])


@pytest.mark.parametrize("linked", [1, 40, 100])
def test_blocks_bring_pairs_together(spark, linked):
    """Of a split group any two nodes meet of which one isn't in the largest component, and no task has many."""
    rows = [(5, 1, i, 10, max(0, i - linked + 1)) for i in range(5, 105)] + [(7, 1, i, 10, i) for i in range(7, 11)]
    groups = spark.createDataFrame(rows, "low bigint, band bigint, node bigint, n bigint, comp bigint")
    for grid in (False, True):
        tasks: dict = {}
        for r in jaccard.in_blocks(groups, grid, 20, 10**9).collect():
            tasks.setdefault((r["low"], r["i"], r["j"]), []).append((r["node"], r["comp"]))
        assert max(map(len, tasks.values())) <= 80 and sorted(tasks[7, 0, 0]) == [(i, i) for i in range(7, 11)]
        met = {(a, b) for (low, *_), nodes in tasks.items() for a in nodes for b in nodes if low == 5}
        all_nodes = {(r[2], r[4]) for r in rows if r[0] == 5}
        if grid:
            counts = {c: sum(x == c for _, x in all_nodes) for _, c in all_nodes}
            most = max(counts, key=lambda c: (counts[c], c))
            assert all((a, b) in met for a in all_nodes for b in all_nodes if a[0] != b[0] and not (a[1] == b[1] == most))
        else:
            assert {a for a, _ in met} == all_nodes and all(((5, max(0, 6 - linked)), a) in met for a in all_nodes)
            assert len([1 for (low, *_) in tasks if low == 5]) > 1


def test_classes_of_sizes_bring_similar_sets_together():
    rng = np.random.default_rng(6)
    none, met = np.zeros(0, dtype=np.int64), 0
    bases = [rng.permutation(10**6)[:n] for n in (1, 2, 5, 9, 30, 200, 1500)]
    found = [np.unique(np.concatenate([rng.permutation(b)[: len(b) - cut], rng.integers(10**6, 10**9, more)])) for b in bases for cut in range(len(b) // 9 + 1)[:30] for more in {0, 1, len(b) // 9}]
    found = [x for x in found if len(x)]
    keys = [{(cell, side, t) for cell, side, k in jaccard.by_sizes(len(x), 4, 5) for t in jaccard.in_order(x, none, none)[:k].tolist()} for x in found]
    facing = [{(cell, side if side == 2 else 1 - side, t) for cell, side, t in k} for k in keys]
    for i, x in enumerate(found):
        for j in range(i):
            if similar(x, found[j]):
                met += 1
                assert keys[i] & facing[j]
    assert met > 500


def test_texts_around_one_passage_dont_meet(spark, monkeypatch):
    """Many texts just under the threshold, and a few over it, of which none is in a large component."""
    rng, grid = random.Random(3), []
    passage = cases.sentence(rng, 99)
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(15))
    texts = [f"{passage} {own(i)}" for i in range(800)]
    texts += [t.rsplit(" ", 3)[0] + f" last{i} words{i} here{i}" for i, t in enumerate(texts[:20])]
    whole = jaccard.in_blocks
    monkeypatch.setattr(jaccard, "in_blocks", lambda groups, last, *a: grid.append(groups.count()) or whole(groups, last, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, sample_rows=1, block_rows=100).collect()}
    assert got == {i: i - 800 if i >= 800 else i for i in range(len(texts))}
    assert grid[0] >= 800 and grid[1] < 200


def set_fingerprint(x: np.ndarray) -> int:
    h = [int(v) & (1 << 64) - 1 for v in x]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@pytest.mark.parametrize("r", [0, 2, 8])
def test_simhash_links_come_first_and_are_confirmed(spark, monkeypatch, r):
    """Without the filter, the links are those between similar sets among the ones that fingerprints bring together."""
    texts = near_texts()
    found = [jaccard.shingles(t) for t in texts]
    prints = [set_fingerprint(x) for x in found]
    assert [jaccard.fingerprint_of(x) for x in found] == prints
    cluster, asked = components(prints, r), []
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if cluster[i] == cluster[j] and bool(len(found[i])) == bool(len(found[j]))]
    confirmed = [(i, j) for i, j in pairs if not len(found[i]) or similar(found[i], found[j])]
    assert len(confirmed) > 30 and (r < 8 or len(pairs) > len(confirmed))
    by_trees = jaccard.clusters
    monkeypatch.setattr(jaccard, "clusters", lambda nodes, bits: asked.append((sorted(x["fp"] & (1 << 64) - 1 for x in nodes.collect()), bits)) or by_trees(nodes, bits))
    monkeypatch.setattr(jaccard, "shared_tokens", lambda nodes: nodes.select(jaccard.F.lit(0).cast("long").alias("token"), "node", "n").limit(0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {x["doc_id"]: x["component_id"] for x in jaccard.near_duplicates(docs, r=r).collect()}
    assert asked == [(sorted({p for p, x in zip(prints, found) if len(x)}), r)]
    assert [got[i] for i in range(len(texts))] == classes(len(texts), confirmed)


def test_stage_runs_the_vantage_point_search(spark, sf_dir, monkeypatch):
    """All fingerprints of the stage's documents go through the shards of op10's operator, at its radius."""
    docs, searched, search = spark.read.parquet(f"{sf_dir}/documents.parquet"), [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, r, **kw: searched.append((nodes.count(), r)) or search(nodes, r, **kw))
    corpus_pipeline.one_of_near_duplicates(spark, docs, sf_dir).count()
    assert searched == [(len({set_fingerprint(x) for (t,) in docs.select("text").collect() if len(x := jaccard.shingles(t))}), 2)]


def test_sketches_differ_in_no_more_bits_than_sets():
    sets = clustered_sets()
    for some in (sets[:80], sets):  # of several widths
        bits = jaccard.folded([jaccard.sketch(s) for s in some])
        for i in range(0, len(some), 7):
            for j in range(len(some)):
                assert np.bitwise_count(bits[i] ^ bits[j]).sum() <= len(np.setxor1d(some[i], some[j]))


def test_stage_removes_near_copies_that_two_bits_miss(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    first = similar_components([t for _, t in rows])
    kept = [i for k, (i, _) in enumerate(rows) if first[k] == k]
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_near_duplicates(spark, docs, sf_dir).collect()) == kept
    assert not {145, 177} & set(kept)


def test_stage_keeps_one_row_of_each_group(spark, sf_dir):
    rng = random.Random(8)
    a, b, c = (cases.sentence(rng, 50) for _ in range(3))
    near = edited(rng, c, 1)
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, c, "y"), (7, c, "x"), (None, near, "x"), (None, None, "x"), (None, "", "x"), (8, a, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = corpus_pipeline.one_of_near_duplicates(spark, docs, sf_dir)
    kept = sorted(map(tuple, got.collect()), key=repr)
    assert got.columns == docs.columns
    assert [r for r in kept if r[0]] == [(1, a, "x"), (5, b, "x"), (7, c, "x")]
    assert len(kept) == 4 and kept[-1][0] is None and not kept[-1][1]
    only_null = spark.createDataFrame([(None, a, "x"), (None, a, "x"), (None, near, "x"), (None, c, "x")], docs.schema)
    assert len(corpus_pipeline.one_of_near_duplicates(spark, only_null, sf_dir).collect()) == 2
