"""Near-duplicates by the Jaccard similarity of word shingles: SimHash by vantage-point trees, exact links, complete prefix filter.

A text's set holds the XXH64 hashes of its shingles of ``width`` words. Equal sets are one node. First SimHash fingerprints of
the sets are linked within ``r`` bits by :mod:`loomwork.llm.simhash`, through its shards, trees and star contraction, and the sets
that it brings together are compared whole: its links stand if the sets are similar. Similar sets can differ in more bits than a
vantage point prunes at, so the links that it misses are then found by a prefix filter, between the components that it leaves. Two sets of
similarity s or more share at least s of the larger one's shingles, so in any order that holds for all sets they share
l of the first n - ceil(s * n) + l (the prefix; l is 1 + n // 10). Shingles that are frequent in a bounded sample come
last in the order; the sample changes the work and not the result. Their sizes differ by the factor 1 / s at most, so
they meet in a band of sizes. A node that shares fewer than l shingles of its prefix in a band leaves it. Others that share
a shingle meet in the group of that shingle's smallest node. There they are told apart by parity sketches, whose
Hamming distance is at most the sets' difference, and only possible partners are compared whole.

The filter's links are found in two passes: every node in one of its groups, and then, between components only, in all groups in
which several components are left. A group returns edges that connect its components instead of pairs. Groups
of more than ``block_rows`` nodes or ``block_shingles`` shingles are split: in the first pass into blocks; in the second, if
more than that is outside their largest component, by the shingles that are rare within them (:func:`regrouped`), so that a passage
which many texts share doesn't bring them together; what is still too large into pairs of blocks.

Defined results: null texts and texts without words have the empty set and are one node; fewer words than a
shingle are one shingle; very long texts are sets like any other, compared whole; repeated rows share a node and
a component; null ids are left out of the smallest id of a component (null if it has no other); columns of other
names aren't looked at; an empty table is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import batches_of, drop_saved, few, kinds, repeated, sample_below, saved, worker_udf
from loomwork.llm.simhash import clusters, components, fingerprint_of


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted set of shingle hashes of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.int64)
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(width)))], dtype=np.uint64).view(np.int64))


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *arrays])))


def sets(text: Column, width: int) -> Column:
    @worker_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        return lists([shingles(t.as_py(), width) for t in texts])

    return of(text)


def least(n):
    """How many shingles of its prefix a set of ``n`` shares with a similar one that isn't smaller."""
    return 1 + n // 10


def in_order(x: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``x`` in the order (count in the sample, hash)."""
    seen = np.zeros(len(x), dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
        seen = np.where(frequent[at] == x, counts[at], 0)
    return x[np.lexsort((x, seen))]


def prefix(x: np.ndarray, frequent: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first of ``x`` in the order, as many as similarity num / den needs to share :func:`least` of them."""
    return in_order(x, frequent, counts)[: len(x) - -(-num * len(x) // den) + least(len(x))] if len(x) else x


def prefixes(text: Column, width: int, order, num: int, den: int) -> Column:
    """node, which identifies the set, its size, SimHash fingerprint, prefix and sketch."""

    @worker_udf("struct<node:bigint,n:bigint,fp:bigint,prefix:array<bigint>,sketch:binary>")
    def of(texts: pa.Array) -> pa.Array:
        frequent, counts = order.value
        found = [shingles(t.as_py(), width) for t in texts]
        nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in found], dtype=np.uint64).view(np.int64)
        prints = np.array([fingerprint_of(x) for x in found], dtype=np.uint64).view(np.int64)
        columns = [pa.array(nodes), pa.array([len(x) for x in found], pa.int64()), pa.array(prints), lists([prefix(x, frequent, counts, num, den) for x in found]), pa.array([sketch(x) for x in found], pa.binary())]
        return pa.StructArray.from_arrays(columns, ["node", "n", "fp", "prefix", "sketch"])

    return of(text)


def frequent_shingles(docs: DataFrame, text_col: str, width: int, sample_rows: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of at most ``most`` shingles that occur in several of about ``sample_rows`` texts."""
    sample = docs.filter(sample_below(sample_rows / max(1, docs.count()), F.col(text_col))).select(F.col(text_col).alias("text")).distinct()
    found = sample.select(F.explode(sets(F.col("text"), width)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = found.filter("n >= 3").orderBy(F.desc("n"), "token").limit(most).toArrow()
    tokens, n = (np.asarray(top[c]).astype(np.int64) for c in ("token", "n"))
    order = np.argsort(tokens)
    return tokens[order], n[order]


def sketch(x: np.ndarray) -> bytes:
    """The parity of the shingles in each of about ``len(x)`` cells: sets differ in at least as many shingles as their sketches in bits."""
    cells = max(64, 1 << (len(x) - 1).bit_length())
    return np.packbits((np.bincount(x & (cells - 1), minlength=cells) & 1).astype(np.uint8)).tobytes() if len(x) else bytes(8)


def folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of words, all folded to the width of the shortest: parities of fewer cells."""
    width = min(map(len, sketches))
    out = np.empty((len(sketches), width // 8), dtype=np.uint64)
    for i, s in enumerate(sketches):
        row = np.frombuffer(s, dtype=np.uint64)
        # cells are numbered by the low bits, so equal ones of fewer cells stand ``width`` bytes apart
        out[i] = np.bitwise_xor.reduce(row.reshape(-1, width // 8), axis=0) if len(s) > width else row
    return out


class Near:
    """Sets laid out by size, with the sketches that tell which may be similar: by the size, which is the distance
    to the empty set, and by the Hamming distance of the sketches. Sets of one ``comp`` are linked already."""

    def __init__(self, n: np.ndarray, comp: np.ndarray, sketches: list[bytes], num: int, den: int) -> None:
        self.num, self.den = num, den
        self.order = np.argsort(n, kind="stable")
        self.n, self.label = n[self.order], np.unique(comp, return_inverse=True)[1][self.order]
        self.bits = folded(sketches)[self.order]

    def seeds(self) -> np.ndarray:
        """All places but those of the largest component: every pair to be linked has one of them."""
        count = np.bincount(self.label)
        return np.flatnonzero(self.label != count.argmax()) if count.max() > 1 else np.arange(len(self.label))

    def of(self, i: int) -> np.ndarray:
        """Places of other components whose sets may be similar to that at ``i``."""
        lo, hi = np.searchsorted(self.n, -(-self.num * self.n[i] // self.den)), np.searchsorted(self.n, self.den * self.n[i] // self.num, side="right")
        at = lo + np.flatnonzero(self.label[lo:hi] != self.label[i])
        apart = np.bitwise_count(self.bits[at] ^ self.bits[i]).sum(axis=1, dtype=np.int64)
        return at[apart * (self.num + self.den) <= (self.den - self.num) * (self.n[i] + self.n[at])]


def with_partners(n: np.ndarray, comp: np.ndarray, sketches: list[bytes], num: int, den: int) -> np.ndarray:
    """Which sets may be similar to one of another component."""
    near, found = Near(n, comp, sketches, num, den), np.zeros(len(n), dtype=bool)
    alone = len(np.unique(comp)) == len(comp)
    for i in near.seeds():
        if alone and found[i]:
            continue  # whoever else may be similar to it is a seed too
        at = near.of(i)
        if len(at):
            found[i] = found[at] = True
    out = np.zeros(len(n), dtype=bool)
    out[near.order] = found
    return out


def local_links(nodes: np.ndarray, comp: np.ndarray, values: np.ndarray, lengths: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between sets of similarity num / den or more that connect whatever components such links connect.

    ``values`` holds the sets, none of them empty, one after the other."""
    starts = np.cumsum(lengths) - lengths
    near = Near(lengths, comp, [sketch(values[s : s + k]) for s, k in zip(starts, lengths)], num, den)
    ids, order = np.unique(values, return_inverse=True)[1], near.order
    mark, edges = np.zeros(len(values), dtype=bool), []
    for i in near.seeds():
        at = near.of(i)
        if not len(at):
            continue
        own = ids[starts[order[i]] : starts[order[i]] + near.n[i]]
        mark[own] = True
        common = [np.count_nonzero(mark[ids[starts[order[j]] : starts[order[j]] + near.n[j]]]) for j in at]
        mark[own] = False
        for j in at[np.array(common) * (num + den) >= num * (near.n[i] + near.n[at])]:
            if near.label[j] != near.label[i]:
                near.label[near.label == near.label[j]] = near.label[i]
                edges.append((int(nodes[order[j]]), int(nodes[order[i]])))
    return edges


def shared_tokens(nodes: DataFrame) -> DataFrame:
    """(token, node, n) for every shingle of a prefix that another node's prefix has too."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch["prefix"]
            token, of = np.asarray(prefix.flatten()), np.repeat(np.arange(len(prefix)), np.asarray(prefix.value_lengths()))
            columns = [batch[c].take(pa.array(of)) for c in ("node", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(token), *columns, pa.array(kinds(token))], ["token", "node", "n", "kind"])

    rows = nodes.select("node", "n", "prefix").mapInArrow(batches_of(tokens), "token bigint, node bigint, n bigint, kind tinyint")
    return repeated(rows, "token", ["node", "n"])


#: Where classes of sizes begin, in steps of 4 %.
STEPS = np.unique(np.ceil(1.04 ** np.arange(1000.0)).astype(np.int64))


def by_sizes(n: int, num: int, den: int) -> Iterator[tuple[int, int, int]]:
    """The pairs of classes in which a set of ``n`` meets similar sets, its side (0 the smaller class, 1 the larger, 2 both are its own)
    and how many of its first shingles, in any one order, it has to bring to share one with each set of the other side.

    Sets of about one size share 2 num / (num + den) of it."""
    small = -(-num * n // den)
    own, first, last = (int(np.searchsorted(STEPS, x, side="right")) - 1 for x in (n, small, den * n // num))
    for other in range(first, last + 1):
        common = -(-num * (n + max(int(STEPS[other]), small)) // (num + den))
        if common <= n:
            yield min(own, other) * len(STEPS) + max(own, other), 2 if own == other else int(own > other), n - common + 1


def crowded(groups: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """(__low, __band, __rows, __all) of the groups of which more than a task should hold is outside the largest component."""
    large = groups.groupBy("low", "band").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all")).filter((F.col("rows") > block_rows) | (F.col("all") > block_shingles))
    large = saved(large.select(F.col("low").alias("__low"), F.col("band").alias("__band")), "large")
    if large.isEmpty():
        return large.withColumns({"__rows": F.lit(0).cast("long"), "__all": F.lit(0).cast("long")})
    comps = groups.join(few(large), (F.col("low") == F.col("__low")) & (F.col("band") == F.col("__band"))).groupBy("__low", "__band", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all"))
    most = F.max_by(F.struct("rows", "all"), F.struct("rows", "comp"))
    split = comps.groupBy("__low", "__band").agg(most.alias("m"), F.sum("rows").alias("__rows"), F.sum("all").alias("__all"))
    beside = (F.col("__rows") - F.col("m.rows") > block_rows) | (F.col("__all") - F.col("m.all") > block_shingles)
    return saved(split.filter(beside).drop("m"), "crowded")


def regrouped(groups: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, block_rows: int, block_shingles: int) -> DataFrame:
    """``groups`` (low, band, node, n, comp), of which crowded ones are replaced by smaller ones in which all their similar pairs meet.

    Such a group gets an order of its own, in which shingles that are frequent in a sample of its nodes come last, and
    its nodes meet again by the beginnings of their sets in this order, as long as their sizes need them. The sample
    (about 256 nodes, 2^18 shingles) changes the work and not the result. A block of a group's nodes is ordered by one task."""
    crowds = crowded(groups, block_rows, block_shingles)
    if crowds.isEmpty():
        return groups
    of = (F.col("low") == F.col("__low")) & (F.col("band") == F.col("__band"))
    inside = saved(groups.join(few(crowds), of).drop("__low", "__band"), "inside")
    whole = whole_sets(inside, nodes, docs, id_col, text_col, width)
    sample = inside.filter(sample_below(F.least(F.lit(256.0) / F.col("__rows"), F.lit(float(1 << 18)) / F.col("__all")), F.col("node")))
    seen = sample.join(whole, "node").select("low", "band", "__rows", "__all", F.explode("x").alias("token")).groupBy("low", "band", "__rows", "__all", "token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    blocks = F.ceil(F.greatest(F.col("__rows") / block_rows, F.col("__all") / block_shingles)).cast("int")
    seen = saved(seen.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select("low", "band", "block", "token", "c"), "order")
    placed = inside.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).join(whole, "node").select("low", "band", "block", "node", "n", "comp", "x")

    def beginnings(group: pa.Table, order: pa.Table) -> pa.Table:
        frequent, counts = np.asarray(order["token"]), np.asarray(order["c"])
        by = np.argsort(frequent)
        x = group["x"].combine_chunks()
        values, ends = np.asarray(x.flatten()), np.cumsum(np.asarray(x.value_lengths()).astype(np.int64))
        tokens, cells, sides, rows = [np.zeros(0, dtype=np.int64)], [], [], []
        for i, (lo, hi) in enumerate(zip([0, *ends], ends)):
            ordered = in_order(values[lo:hi], frequent[by], counts[by])
            for cell, side, length in by_sizes(int(hi - lo), num, den):
                tokens.append(ordered[:length])
                cells.append(cell)
                sides.append(side)
                rows.append(i)
        lengths = [len(t) for t in tokens[1:]]
        at = pa.array(np.repeat(np.array(rows, dtype=np.int64), lengths))
        own = [group[c].take(at) for c in ("low", "band", "node", "n", "comp")]
        classes = [pa.array(np.repeat(np.array(x, dtype=np.int64), lengths)) for x in (cells, sides)]
        return pa.Table.from_arrays([*own, *classes, pa.array(np.concatenate(tokens))], names=["low", "band", "node", "n", "comp", "cell", "side", "token"])

    key = ["low", "band", "block"]
    types = "low bigint, band bigint, node bigint, n bigint, comp bigint, cell bigint, side bigint, token bigint"
    hits = saved(placed.groupBy(*key).cogroup(seen.groupBy(*key)).applyInArrow(beginnings, types), "hits")
    cell = ["low", "band", "cell", "token"]
    ends = [F.min("node").alias("first"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.min("side").alias("small"), F.max("side").alias("large")]
    met = hits.groupBy(*cell).agg(*ends).filter("least < most and (large = 2 or small < large)").select(*cell, "first")
    again = hits.join(few(saved(met, "met")), cell).select(F.xxhash64("low", "cell", "first").alias("low"), "band", "node", "n", "comp").distinct()
    out = saved(groups.join(few(crowds), of, "left_anti").unionByName(again), "regrouped")
    drop_saved(inside, whole, seen, hits)
    return out


def in_blocks(groups: DataFrame, grid: bool, block_rows: int, block_shingles: int) -> DataFrame:
    """``groups`` with (i, j), by which a group of more than a task should hold is split.

    Either into blocks that each have the group's smallest node too; or (``grid``) into pairs of blocks, so that any two nodes
    meet of which one isn't in the group's largest component: blocks of that component meet the others, but not each other."""
    blocks = lambda rows, shingles: F.greatest(F.lit(1), F.ceil(F.greatest(rows / block_rows, shingles / block_shingles))).cast("int")
    size = groups.groupBy("low", "band").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all"))
    large = size.select(F.col("low").alias("__low"), F.col("band").alias("__band"), blocks(F.col("rows"), F.col("all")).alias("__k")).filter("__k > 1")
    large = saved(large, "large")
    if large.isEmpty():
        return groups.withColumns({"i": F.lit(0), "j": F.lit(0)})
    of = (F.col("low") == F.col("__low")) & (F.col("band") == F.col("__band"))
    every = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    hashed = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    task = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    alone = F.array(task(F.lit(0), F.lit(0)))
    if grid:
        comps = groups.join(few(large), of).groupBy("__low", "__band", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all"))
        most = F.max_by(F.struct("comp", "rows", "all"), F.struct("rows", "comp"))
        split = comps.groupBy("__low", "__band").agg(most.alias("m"), F.sum("rows").alias("rows"), F.sum("all").alias("all"))
        split = split.select("__low", "__band", F.col("m.comp").alias("__most"), blocks(F.col("m.rows"), F.col("m.all")).alias("__k"), blocks(F.col("rows") - F.col("m.rows"), F.col("all") - F.col("m.all")).alias("__r"))
        joined = groups.join(few(saved(split, "large")), of, "left")
        k, own = F.col("__k"), hashed("__r") + F.col("__k")
        in_most = F.transform(every("__r"), lambda o: task(hashed("__k"), k + o))
        others = F.concat(F.transform(every("__k"), lambda o: task(o, own)), F.transform(every("__r"), lambda o: task(F.least(own, k + o), F.greatest(own, k + o))))
        tasks = F.when(F.col("__k").isNull(), alone).when(F.col("comp") == F.col("__most"), in_most).otherwise(others)
    else:
        joined = groups.join(few(large), of, "left")
        tasks = F.when(F.col("__k").isNull(), alone).when(F.col("node") == F.col("low"), F.transform(every("__k"), lambda o: task(o, o))).otherwise(F.array(task(hashed("__k"), hashed("__k"))))
    return joined.withColumn("__t", F.explode(tasks)).select(*groups.columns, "__t.i", "__t.j")


def connected(groups: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) found within ``groups`` (low, band, i, j, node, n, comp) between nodes of different comp.

    Sketches are compared first; only sets with a possible partner are computed again from a text, and compared whole."""
    key = ["low", "band", "i", "j"]

    def possible(group: pa.Table) -> pa.Table:
        keep = with_partners(np.asarray(group["n"]), np.asarray(group["comp"]), group["sketch"].to_pylist(), num, den)
        return group.filter(pa.array(keep)).select([*key, "node", "comp"])

    def within(group: pa.Table) -> pa.Table:
        x = group["x"].combine_chunks()
        lengths = np.asarray(x.value_lengths()).astype(np.int64)
        found = local_links(np.asarray(group["node"]), np.asarray(group["comp"]), np.asarray(x.flatten()), lengths, num, den)
        found = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    sketched = groups.join(nodes.select("node", "sketch"), "node")
    left = saved(sketched.groupBy(*key).applyInArrow(possible, "low bigint, band bigint, i int, j int, node bigint, comp bigint"), "possible")
    whole = whole_sets(left, nodes, docs, id_col, text_col, width)
    edges = saved(left.join(whole, "node").groupBy(*key).applyInArrow(within, "a bigint, b bigint"), "links")
    drop_saved(left, whole)
    return edges


def whole_sets(of: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, x): the sets of the nodes in ``of``, from a row of each."""
    wanted = saved(of.select("node").distinct().join(nodes.select("node", "key"), "node"), "wanted")
    texts = docs.select(row_key(id_col, text_col).alias("key"), text_col).join(few(wanted), "key").groupBy("node").agg(F.min(text_col).alias("text"))
    whole = saved(texts.select("node", sets(F.col("text"), width).alias("x")), "sets")
    drop_saved(wanted)
    return whole


def size_band(num: int, den: int) -> Column:
    """Similar sizes ``n`` are in the same band or the next one; the base is a little larger than their ratio for rounding."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.001 * den / num)))


def by_fingerprints(nodes: DataFrame, r: int, num: int, den: int, block_rows: int, block_shingles: int) -> DataFrame:
    """Groups (low, band, i, j, node, n, comp) of nodes whose SimHash fingerprints are linked within ``r`` bits, directly or by others.

    Each node is a component of its own; the empty set has no group. Groups of more than a task should hold are split into
    blocks that each have the group's smallest node too."""
    some, band = nodes.filter("n > 0").select("node", "n", "fp"), size_band(num, den)
    stars = clusters(saved(some.select("fp").distinct(), "fingerprints"), r)
    rooted = some.join(stars, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "node", "n")
    placed = saved(rooted.withColumn("band", F.explode(F.array(band, band + 1))), "placed")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block_rows, F.sum("n") / block_shingles)).cast("int")
    several = placed.groupBy("root", "band").agg(F.min("node").alias("low"), F.max("node").alias("high"), blocks.alias("k")).filter("low < high").drop("high")
    dealt = F.when(F.col("node") == F.col("low"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("k")).cast("int")))
    met = placed.join(few(saved(several, "several")), ["root", "band"])
    return met.select("low", "band", F.explode(dealt).alias("i"), F.lit(0).alias("j"), "node", "n", F.col("node").alias("comp"))


def between(groups: DataFrame, stars: DataFrame) -> DataFrame:
    """``groups`` (low, band, node, n) in which several components are left, with comp."""
    rest = groups.join(stars.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = rest.groupBy("low", "band").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("low", "band")
    return rest.join(few(saved(mixed, "mixed")), ["low", "band"])


def links(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, block_rows: int, block_shingles: int, r: int) -> DataFrame:
    """(node, root): the components that all pairs of sets of similarity num / den or more make.

    ``nodes`` has node, key, n, fp, prefix and sketch."""
    args, bounds = (id_col, text_col, width, num, den), (block_rows, block_shingles)
    edges = lambda stars: stars.select(F.col("node").alias("a"), F.col("root").alias("b"))
    stars = components(connected(by_fingerprints(nodes, r, num, den, *bounds), nodes, docs, *args))
    band = size_band(num, den)
    hits = shared_tokens(nodes).withColumn("band", F.explode(F.array(band, band + 1)))
    hits = saved(hits, "hits")
    met = saved(hits.groupBy("token", "band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("token", "band"), "met")
    hits_met = saved(hits.join(few(met), ["token", "band"]), "hits")
    drop_saved(hits, met)
    # the smallest set that is similar to one of n has ceil(num * n / den)
    needed = 1 + F.floor(F.ceil(F.col("n") * num / den) / 10)
    enough = saved(hits_met.groupBy("node", "n", "band").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= needed).select("node", "band"), "enough")
    hits = saved(hits_met.join(few(enough), ["node", "band"]), "hits")
    drop_saved(hits_met, enough)
    ends = hits.groupBy("token", "band").agg(F.max("node").alias("high"), F.min("node").alias("first")).filter("first < high").select("token", "band", F.col("first").alias("low"))
    groups = saved(hits.join(few(saved(ends, "ends")), ["token", "band"]).select("low", "band", "node", "n").distinct(), "groups")
    drop_saved(hits)
    # first every node in one of its groups, which settles most of a group of copies; then all groups in which components meet
    one = between(groups, stars).groupBy("node", "n", "comp").agg(F.min(F.struct("low", "band")).alias("g")).select("g.low", "g.band", "node", "n", "comp")
    stars = components(edges(stars).unionByName(connected(in_blocks(saved(one, "one"), False, *bounds), nodes, docs, *args)))
    rest = saved(between(groups, stars), "rest")
    drop_saved(groups)
    more = connected(in_blocks(regrouped(rest, nodes, docs, *args, *bounds), True, *bounds), nodes, docs, *args)
    drop_saved(rest)
    return components(edges(stars).unionByName(more))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, num: int = 4, den: int = 5, sample_rows: int = 1 << 13, most: int = 1 << 18, block_rows: int = 1 << 14, block_shingles: int = 1 << 21, r: int = 2
) -> DataFrame:
    """doc_id, key (of id and text), node, component_id, the smallest id that links reach, and first_key for every row.

    first_key is the key of the component's first row by (id, nulls last, then key)."""
    order = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text_col, width, sample_rows, most))
    found = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), prefixes(F.col(text_col), width, order, num, den).alias("s"))
    shingled = saved(found.select("doc_id", "key", "s.*"), "shingles")
    rows = saved(shingled.select("doc_id", "key", "node"), "rows")
    lows = saved(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("low")), "nodes")
    # the first row of each node; rows that repeat id and text are all first, and one of them will do
    first = shingled.join(few(lows.select(F.col("low.key").alias("__first"))), F.col("key") == F.col("__first"), "left_semi").drop("doc_id")
    nodes = saved(first, "sets")
    if nodes.count() > lows.count():
        nodes = saved(first.dropDuplicates(["node"]), "sets")
    drop_saved(shingled)
    stars = links(nodes, docs, id_col, text_col, width, num, den, block_rows, block_shingles, r)
    drop_saved(nodes)
    rooted = lows.join(stars.withColumnRenamed("root", "__root"), "node", "left").withColumn("root", F.coalesce("__root", "node")).drop("__root")
    # only components of several nodes need another look
    several = rooted.join(stars.select("root").distinct(), "root", "left_semi")
    lowest = several.groupBy("root").agg(F.min("low").alias("lowest"))
    classes = rooted.join(lowest, "root", "left").select("node", F.coalesce("lowest", "low").alias("first"))
    return rows.join(classes, "node").select("doc_id", "key", "node", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key"))


def row_key(id_col: str, text_col: str) -> Column:
    """A long column that rows with the same id and text share."""
    return F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull())
