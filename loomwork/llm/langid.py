"""Language identification with bit-sliced Bloom filters over letter n-grams.

One table of slots serves all languages: a slot holds a bitmask with one bit per language, and
the AND of an n-gram's slots is the set of languages whose filter contains it. A text's n-grams
are looked up once; the hits of each language are its popcount over those masks, corrected for
the filter's false-positive rate, and the largest corrected count decides.

Defined results: null texts and texts without a letter give ``und`` and score 0; texts with
letters of which no n-gram is known give the most frequent learned language and score 0; ties
go to the language first in sorted order; with nothing to learn from every text is ``und``.
Repeated rows are answered row by row. Rows with a null text or language are not learned from. Very long texts
are read whole, by themselves; other columns of any name aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import batches_of, sample_below, ship, worker_udf

UND = "und"
PLANE_BITS = 62
BLOCK_CHARS = 1 << 18
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, packed trigram) for every letter of every text.

    A trigram is a letter with its two neighbours; anything but a letter counts as a space."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[code]
    code = np.where(letter, code, 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    ends = np.cumsum([len(t) + 1 for t in low])
    return np.searchsorted(ends, at, side="left"), code[at - 1] | code[at] << np.uint64(21) | code[at + 1] << np.uint64(42)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of neighbouring texts of about BLOCK_CHARS together, so that arrays stay small."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        run.append(text or "")
        size += len(text or "")
        if size >= BLOCK_CHARS:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run


def slots(grams: np.ndarray, n_slots: int, n_hashes: int) -> list[np.ndarray]:
    """The slots of each n-gram by double hashing of a 64-bit mix; n_slots is a power of two."""
    h = grams + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(j) * step) & np.uint64(n_slots - 1)).astype(np.int64) for j in range(n_hashes)]


@dataclass
class LanguageFilters:
    """``planes[p][slot]`` has the bits of languages ``PLANE_BITS * p`` and on."""

    languages: list[str]
    default: str
    planes: np.ndarray
    n_hashes: int

    def false_positive_rates(self) -> np.ndarray:
        if not self.languages:
            return np.zeros(0)
        filled = [np.count_nonzero(self.planes[i // PLANE_BITS] >> (i % PLANE_BITS) & 1) for i in range(len(self.languages))]
        return (np.array(filled) / self.planes.shape[1]) ** self.n_hashes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores, rates = [], [], self.false_positive_rates()
        for _, run in blocks(texts):
            doc, grams = trigrams(run)
            total = np.bincount(doc, minlength=len(run))
            if not self.languages:
                names += [UND] * len(run)
                scores += [0.0] * len(run)
                continue
            hits = np.zeros((len(run), len(self.languages)))
            where = slots(grams, self.planes.shape[1], self.n_hashes)
            for p, plane in enumerate(self.planes):
                mask = plane[where[0]]
                for w in where[1:]:
                    mask &= plane[w]
                for i in range(p * PLANE_BITS, min(len(self.languages), (p + 1) * PLANE_BITS)):
                    hits[:, i] = np.bincount(doc[(mask >> (i % PLANE_BITS) & 1).astype(bool)], minlength=len(run))
            sure = np.maximum(0.0, (hits - total[:, None] * rates) / np.maximum(1e-9, 1 - rates))
            best, all_sure = sure.argmax(axis=1), sure.sum(axis=1)
            for k in range(len(run)):
                if not total[k]:
                    names.append(UND)
                elif all_sure[k] <= 0:
                    names.append(self.default)
                else:
                    names.append(self.languages[best[k]])
            scores += list(np.where(all_sure > 0, sure.max(axis=1) / np.maximum(all_sure, 1e-9), 0.0))
        return names, np.array(scores)


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_key: str = "doc_id",
    *,
    docs_per_language: int = 3000,
    max_languages: int = 496,
    n_slots: int = 1 << 20,
    n_hashes: int = 3,
    min_count: int = 2,
    min_relative: float = 0.15,
) -> LanguageFilters:
    """Learn the filters from labelled rows.

    All values of ``lang_col`` are learned. The filters take 8 MB for each 62 of them, and more than ``max_languages`` are an error, as a
    bound on memory that left some out would give their texts other names.
    About ``docs_per_language`` rows of each are used at most, chosen by a hash of ``sample_key`` and text. An n-gram enters a language's filter if it occurs ``min_count`` times there and
    its relative frequency is at least ``min_relative`` of the largest in any language. What reaches
    the driver is one row per filled slot: ``n_slots`` at most for each 62 languages."""
    ship(labelled.sparkSession)
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(counts)
    n_planes = max(1, -(-len(languages) // PLANE_BITS))
    planes = np.zeros((n_planes, n_slots), dtype=np.int64)
    if not languages:
        return LanguageFilters([], UND, planes, n_hashes)
    default = max(languages, key=lambda x: (counts[x], x))
    number = {x: i for i, x in enumerate(languages)}
    shares = F.create_map(*[F.lit(v) for x in languages for v in (x, docs_per_language / counts[x])])
    chosen = sample_below(F.try_element_at(shares, F.col(lang_col)), F.col(sample_key), F.col(text_col))

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array([number[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for start, run in blocks(texts):
                doc, grams = trigrams(run)
                of = langs[start + doc]
                for i in np.unique(of):
                    key, n = np.unique(grams[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(np.full(len(key), i)), pa.array(n)], ["gram", "lang", "n"])

    found = rows.filter(chosen).select(text_col, lang_col).mapInArrow(batches_of(count_grams), "gram long, lang long, n long")
    found = found.groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    sizes = {r[0]: r[1] for r in found.groupBy("lang").agg(F.sum("n")).collect()}
    if not sizes:
        return LanguageFilters(languages, default, planes, n_hashes)
    size = F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv])
    found = found.filter(F.col("n") >= min_count).withColumn("rate", F.col("n") / size[F.col("lang")])
    masks = found.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("by"))  # one entry per language

    def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.asarray(batch.column(0)).astype(np.uint64)
            plane, mask = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for where in slots(key, n_slots, n_hashes):
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(plane), pa.array(mask)], ["slot", "plane", "mask"])

    kept = masks.select("gram", F.explode(F.filter("by", lambda x: x["rate"] >= min_relative * F.col("top"))).alias("x"))
    kept = kept.select("gram", F.floor(F.col("x.lang") / PLANE_BITS).cast("long").alias("plane"), F.expr(f"shiftleft(1L, cast(x.lang % {PLANE_BITS} as int))").alias("mask"))
    filled = kept.mapInArrow(batches_of(to_slots), "slot long, plane long, mask long").groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask"))
    got = filled.toArrow()
    planes[np.asarray(got["plane"]), np.asarray(got["slot"])] = np.asarray(got["mask"])
    return LanguageFilters(languages, default, planes, n_hashes)


def predict(docs: DataFrame, filters: LanguageFilters, text_col: str = "text") -> Column:
    """A struct column (lang_pred, score) for the texts of ``docs``; the filters are of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @worker_udf("struct<lang_pred: string, score: double>")
    def identify(texts: pa.Array) -> pa.Array:
        names, scores = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return identify(F.col(text_col))
