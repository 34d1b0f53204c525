"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are the hashes of its words, of its pairs of neighbours, of pairs with one or two words
between (skip-grams), and of the beginnings of its words, as inflected forms share them, each once. FTRL-proximal gives every
coordinate a rate of its own, which falls with the gradients it has seen, and an L1 bound below which its weight is
exactly 0, so that the model is a short list of weights, which is broadcast.

Learning takes ``rounds`` passes over a bounded sample of labelled rows (``max_rows`` of them, chosen by a hash of the id). In
a pass each of ``shards`` tasks learns from its own rows, on from the state of the pass before, and the new states are averaged.
Only coordinates that a shard met travel to the driver, of 2 ** ``bits`` at most.
Scoring reads whole texts in blocks and looks weights up by array indexing.

Defined results: null and empty texts have no features and the score of the bias alone; with no usable labels every score is 0.5;
labels that contradict each other are separate training rows; null labels are not used; equal labels of one id count
once, and of texts that share an id the least one is learned from. Very long texts are scored whole; other
columns of any name aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import batches_of, sample_below, ship, worker_udf

#: Texts are hashed in blocks of about so many bytes, cut between words.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SALTS = {"word": 0xD1B54A32D192ED03, "pair": 0x8CB92BA72F3D8DD7, "over1": 0xABC98388FB8FAC03, "over2": 0x9FB21C651E98DF25, "start": 0xC2B2AE3D27D4EB4F}
#: Letters of a word's beginning that are a feature, in bytes.
STARTS = (5, 7)
#: Bytes of words: ASCII letters and digits, and whatever isn't ASCII.
_WORD = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: list[np.ndarray] = [_powers(_BASE, 1), _powers(pow(_BASE, -1, 1 << 64), 1)]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of a hash from all of its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(start, hash of each word, hashes of its beginnings by length) of a block of lower-case UTF-8 bytes, words whole.

    Hashes are polynomials in the bytes modulo 2**64, differences of running sums, so no word is looked at by itself."""
    n = len(raw)
    if len(_TABLES[0]) < n:
        _TABLES[:] = [_powers(_BASE, max(n, BLOCK + 4096)), _powers(pow(_BASE, -1, 1 << 64), max(n, BLOCK + 4096))]
    power, back = _TABLES
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = _WORD[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    upto = lambda stop: _mixed((sums[stop] - sums[start]) * back[start])
    return start, upto(end), {k: upto(np.minimum(start + k, end)) for k in STARTS}


def features(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, coordinate) of every n-gram of the texts, block by block; repeats stay."""
    shift, before = np.uint64(64 - bits), np.zeros(0, dtype=np.uint64)  # the last words of a text that goes on
    for first, goes_on, raw, starts in _blocks(texts):
        start, words, begun = word_hashes(raw)
        of = (np.searchsorted(starts, start, side="right") - 1 + first).astype(np.int64)
        found = [(of, words ^ np.uint64(_SALTS["word"]))]
        found += [(of, (h + np.uint64(k)) ^ np.uint64(_SALTS["start"])) for k, h in begun.items()]
        seen, words, of = len(before), np.concatenate([before, words]), np.concatenate([np.full(len(before), first), of])
        for gap, kind in ((1, "pair"), (2, "over1"), (3, "over2")):
            at = np.arange(max(0, seen - gap), max(0, len(words) - gap))
            at = at[of[at] == of[at + gap]]
            found.append((of[at], (words[at] * np.uint64(3) + words[at + gap]) ^ np.uint64(_SALTS[kind])))
        before = words[-3:] if goes_on else words[:0]
        yield np.concatenate([x for x, _ in found]), (_mixed(np.concatenate([h for _, h in found])) >> shift).astype(np.int64)


def distinct_features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate), each once and in this order."""
    blocks = [np.unique(of << bits | ids) for of, ids in features(texts, bits)]
    keys = np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, dtype=np.int64)
    return keys >> bits, keys & ((1 << bits) - 1)


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(first text, whether it goes on in the next block, bytes, where texts start) of blocks of texts, cut between words."""
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").lower().encode("utf-8", "surrogatepass")
        if held and size + len(raw) > BLOCK:
            yield _joined(held, first)
            held, first, size = [], i, 0
        if len(raw) <= BLOCK:
            held.append(raw)
            size += len(raw) + 1
            continue
        first, at, whole = i + 1, 0, np.frombuffer(raw, dtype=np.uint8)
        while at < len(whole):
            stop = min(len(whole), at + BLOCK)
            while stop < len(whole) and _WORD[whole[stop]]:  # to the end of the word
                rest = np.flatnonzero(~_WORD[whole[stop : stop + BLOCK]])
                stop = stop + int(rest[0]) if len(rest) else min(len(whole), stop + BLOCK)
            yield i, stop < len(whole), whole[at:stop], np.zeros(1, dtype=np.int64)
            at = stop
    if held:
        yield _joined(held, first)


def _joined(held: list[bytes], first: int) -> tuple[int, bool, np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(x) + 1 for x in held[:-1])])
    return first, False, np.frombuffer(b"\n".join(held), dtype=np.uint8), starts


@dataclass
class State:
    """FTRL-proximal's two sums by coordinate; the last coordinate is the bias, which has no L1 bound."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0

    @classmethod
    def empty(cls, bits: int, **rates: float) -> State:
        return cls(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1), **rates)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Of coordinates of which the last is the bias."""
        z, n = self.z[at], self.n[at]
        bound = np.full(z.shape, self.l1)
        bound[-1] = 0.0
        return np.where(np.abs(z) <= bound, 0.0, -(z - np.sign(z) * bound) * self.alpha / (self.beta + np.sqrt(n)))

    def learn(self, ids: np.ndarray, label: float) -> None:
        """One step on a row's coordinates, each once."""
        at = np.append(ids, len(self.z) - 1)
        w = self.weights(at)
        g, n = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label, self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


@dataclass
class LinearModel:
    """The weights that aren't 0, by coordinate."""

    bits: int
    bias: float
    at: np.ndarray
    weight: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        dense = np.zeros(1 << self.bits)
        dense[self.at] = self.weight
        hits = []
        for of, ids in features(texts, self.bits):
            used = dense[ids] != 0
            hits.append(np.unique(of[used] << self.bits | ids[used]))
        keys = np.unique(np.concatenate(hits)) if hits else np.zeros(0, dtype=np.int64)
        total = self.bias + np.bincount(keys >> self.bits, dense[keys & ((1 << self.bits) - 1)], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    *,
    max_rows: int = 20_000,
    bits: int = 18,
    shards: int = 4,
    rounds: int = 6,
    **rates: float,
) -> LinearModel:
    """Learn from ``labels`` (id, label) joined to the texts of ``docs``. At most about ``max_rows`` labels are used;
    they are broadcast, and their coordinates are computed once and kept by shard."""
    spark = docs.sparkSession
    ship(spark)
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__label")).distinct()
    chosen = usable.filter(sample_below(max_rows / max(1, usable.count()), F.col("__id")))
    joined = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    joined = joined.groupBy("__id", "__label").agg(F.min("__text").alias("__text"))  # ids may repeat, so as many rows as labels
    place = F.xxhash64("__id", "__label")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, ids = distinct_features(batch.column(0).to_pylist(), bits)
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, ids.astype(np.int32)), *batch.columns[1:]], ["ids", "label", "place", "shard"])

    rows = joined.select("__text", "__label", place.alias("place"), F.pmod(place, F.lit(shards)).cast("int").alias("shard"))
    rows = rows.mapInArrow(batches_of(measure), "ids array<int>, label double, place bigint, shard int")
    # a shard each, in an order of its own; kept on disk, and made again where an executor is lost
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("place", "label").persist(StorageLevel.DISK_ONLY)
    state = State.empty(bits, **rates)
    for _ in range(rounds):
        state = _round(rows, state, shards)
    rows.unpersist()
    weights = state.weights()
    at = np.flatnonzero(weights[:-1])
    return LinearModel(bits, float(weights[-1]), at, weights[at])


def _round(rows: DataFrame, before: State, shards: int) -> State:
    """Every shard, a partition of ``rows``, learns from ``before`` on; the mean of their states, summed in the order of the shards."""
    shared = rows.sparkSession.sparkContext.broadcast(before)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        own = State(start.z.copy(), start.n.copy(), start.alpha, start.beta, start.l1)
        shard = None
        for batch in batches:
            ends, ids, label = np.asarray(batch["ids"].offsets), np.asarray(batch["ids"].values), np.asarray(batch["label"])
            for a, b, y in zip(ends, ends[1:], label):
                own.learn(ids[a:b], y)
            shard = batch["shard"][0].as_py() if batch.num_rows else shard
        if shard is not None:
            met = np.flatnonzero(own.n != start.n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), shard, np.int32)), pa.array(met.astype(np.int32)), pa.array((own.z - start.z)[met]), pa.array((own.n - start.n)[met])], ["shard", "at", "z", "n"])

    got = rows.mapInArrow(batches_of(learn), "shard int, at int, z double, n double").toArrow()
    order = np.argsort(np.asarray(got["shard"]), kind="stable")
    at = np.asarray(got["at"])[order]
    after = State(before.z.copy(), before.n.copy(), before.alpha, before.beta, before.l1)
    np.add.at(after.z, at, np.asarray(got["z"])[order] / shards)
    np.add.at(after.n, at, np.asarray(got["n"])[order] / shards)
    shared.destroy()
    return after


def score(docs: DataFrame, model: LinearModel, text_col: str = "text") -> Column:
    """A double column, 0 to 1; the broadcast holds the weights that aren't 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @worker_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts.to_pylist()), pa.float64())

    return rate(F.col(text_col))
