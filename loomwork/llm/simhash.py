"""SimHash near-duplicates: vantage-point shards, exact links, distributed components.

A text's fingerprint has a bit set if more than half of its shingles' XXH64 hashes have it. Equal
fingerprints are one node. A vantage-point tree over a bounded sample of nodes splits all nodes into
shards: a node goes to the near side of a vantage point (distance <= mu) or to the far side, and
near nodes with a distance over mu - r also to the far side, for by the triangle inequality
only those can link across the boundary. Every pair within r bits thus meets in some shard. Within
a shard the same splitting goes on down to small sets that are compared exactly; a set that a vantage
point can't split (a dense ball) is searched breadth first. A shard returns a spanning forest
of its links, so groups are never expanded into pairs, and star contraction joins the forests.

Defined results: null texts and texts without words have fingerprint 0 and link like any other;
fewer words than a shingle are one shingle; very long texts are read whole, their shingles in blocks; repeated rows
share a fingerprint and a component; null ids are left out of the smallest id of a component (null if it has no
other); other columns of any name are left out; an empty table is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import batches_of, drop_saved, sample_below, saved, ship, worker_udf

LEAF = 256
CHUNK = 1 << 16


def ones(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that more than half of ``n`` hashes have."""
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_of(h: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes; 0 for none."""
    return majority(sum((ones(h[at : at + CHUNK]) for at in range(0, len(h), CHUNK)), np.zeros(64, dtype=np.int64)), len(h))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), seed)
    n, counts = len(words) - width + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(n, at + CHUNK) + width - 1]
        h = np.array([digest(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(width)))], dtype="<u8")
        counts += ones(h)
    return majority(counts, n)


def fingerprints(text: Column, width: int = 3) -> Column:
    """A long column with the fingerprint's 64 bits."""

    @worker_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), width) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def vantage(x: np.ndarray, r: int) -> tuple[int, int] | None:
    """(pivot, mu) that splits ``x`` best of some pivots; None if none makes both sides clearly smaller."""
    best = None
    for k in range(min(4, len(x))):
        pivot = x[k * (len(x) // 4)] if len(x) >= 4 else x[k]
        d = np.bitwise_count(x ^ pivot)
        for mu in (int(np.median(d)), int(np.median(d)) - 1):
            near, far = np.count_nonzero(d <= mu), np.count_nonzero(d > mu - r)
            if best is None or max(near, far) < best[0]:
                best = (max(near, far), near + far, int(pivot), mu)
    if best is None or best[0] > 0.8 * len(x) or best[1] > 1.6 * len(x):
        return None
    return best[2], best[3]


def sides(x: np.ndarray, pivot: int, mu: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.bitwise_count(x ^ np.uint64(pivot)).astype(np.int16)
    return d <= mu, d > mu - r


class ShardTree:
    """The top of the vantage-point tree. A part of the sample is split while it is over ``most``, copies counted, so
    that depth follows what a shard really gets, and only shards that are too large get deeper.

    Of random fingerprints, the worst case, n in all and b to a shard, copies make n * (n / b) ** 0.37 rows."""

    def __init__(self, sample: np.ndarray, most: float, r: int) -> None:
        self.r, self.shards = r, 0
        self.root = self._grow(sample, most)

    def _grow(self, x: np.ndarray, most: float):
        cut = vantage(x, self.r) if len(x) > max(8, most) else None
        if cut is None:
            self.shards += 1
            return self.shards - 1
        near, far = sides(x, *cut, self.r)
        return (*cut, self._grow(x[near], most), self._grow(x[far], most))

    def route(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        todo = [(self.root, x)]
        while todo:
            node, part = todo.pop()
            if not len(part):
                continue
            if isinstance(node, int):
                yield node, part
            else:
                near, far = sides(part, node[0], node[1], self.r)
                todo += [(node[2], part[near]), (node[3], part[far])]


class Forest:
    """Union-find over the linked fingerprints only."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        up = self.up
        top = a
        while (b := up.get(top, top)) != top:
            top = b
        while (b := up.get(a, a)) != top and b != a:
            up[a] = top
            a = b
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))


def _exact(x: np.ndarray, r: int, forest: Forest) -> None:
    """All links of ``x`` into the forest, breadth first: a linked node leaves the set at once."""
    if len(x) <= LEAF:
        i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= r, 1))
        if len(i) <= 4 * len(x):
            for a, b in zip(x[i].tolist(), x[j].tolist()):
                forest.join(a, b)
            return
    rest = x
    while len(rest):
        front, rest = rest[:1], rest[1:]
        root = int(front[0])
        while len(front) and len(rest):
            near = np.zeros(len(rest), dtype=bool)
            for at in range(0, len(front), 64):
                near |= (np.bitwise_count(front[at : at + 64, None] ^ rest[None, :]) <= r).any(axis=0)
            front, rest = rest[near], rest[~near]
            for a in front.tolist():
                forest.join(root, a)


def local_links(x: np.ndarray, r: int) -> list[tuple[int, int]]:
    """(node, root) of a spanning forest of all links within ``x``."""
    forest, todo = Forest(), [np.unique(x)]
    while todo:
        part = todo.pop()
        cut = vantage(part, r) if len(part) > LEAF else None
        if cut is None:
            _exact(part, r, forest)
        else:
            near, far = sides(part, *cut, r)
            todo += [part[near], part[far]]
    return [(a, root) for a in list(forest.up) if (root := forest.find(a)) != a]


def links(nodes: DataFrame, r: int, *, shard_rows: int = 1 << 15, sample_per_shard: int = 64, most_sampled: int = 1 << 21) -> DataFrame:
    """Edges (a, b) that connect the fingerprints ``fp`` of ``nodes`` just as all links within r bits do.

    The tree comes from a sample of ``sample_per_shard`` fingerprints for each ``shard_rows``, about ``most_sampled`` (16 MB) in
    all at most; the links are exact for any tree, and a shard is split further by the task that has it."""
    ship(nodes.sparkSession)
    n = nodes.count()
    share = min(1.0, most_sampled / max(1, n), sample_per_shard / shard_rows)
    sample = nodes.filter(sample_below(share, F.col("fp"))).select("fp").toArrow()["fp"] if n > shard_rows else pa.array([], pa.int64())
    drawn = np.sort(np.asarray(sample).astype(np.int64)).view(np.uint64)
    tree = ShardTree(np.random.default_rng(0).permutation(drawn), share * shard_rows, r)
    shared = nodes.sparkSession.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, part in shared.value.route(np.asarray(batch.column(0)).view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard, dtype=np.int64)), pa.array(part.view(np.int64))], ["shard", "fp"])

    def within(group: pa.Table) -> pa.Table:
        x = np.concatenate([np.asarray(c) for c in group["fp"].chunks]).view(np.uint64)
        found = np.array(local_links(x, r), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return nodes.select("fp").mapInArrow(batches_of(route), "shard bigint, fp bigint").groupBy("shard").applyInArrow(within, "a bigint, b bigint")


def _stars(edges: DataFrame) -> bool:
    """Whether every node ``a`` has one edge, and none of the nodes ``b``, which are smaller, is such a node."""
    several = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not several.isEmpty():
        return False
    return edges.join(edges.select(F.col("b").alias("__b")).distinct(), F.col("a") == F.col("__b"), "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge that isn't its component's smallest: alternating
    large-star and small-star contraction, until only stars are left. Each round is a table in the shared folder."""
    oriented = lambda df: df.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = saved(oriented(edges), "edges")
    while not _stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = oriented(both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        after = saved(oriented(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))), "edges")
        drop_saved(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def clusters(nodes: DataFrame, r: int, *, shard_rows: int = 1 << 15) -> DataFrame:
    """(fp, root) for every ``fp`` of ``nodes`` that links within r bits connect with a smaller one."""
    return components(links(nodes, r, shard_rows=shard_rows)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, r: int = 2, shard_rows: int = 1 << 15) -> DataFrame:
    """doc_id, fp and component_id, the smallest id that links reach, for every row."""
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), width).alias("fp")), "fingerprints")
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    stars = clusters(nodes, r, shard_rows=shard_rows)
    rooted = nodes.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # only components of several fingerprints need another look
    several = rooted.join(stars.select("root").distinct(), "root", "left_semi")
    lowest = several.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(lowest, "root", "left").select("fp", F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")
