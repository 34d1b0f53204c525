"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is binned; cyclic boosting visits the features in turn and adds a shallow
tree of the current residuals to the visited feature's lookup table. Pairs of features whose joint
residuals gain most then get tables of their own, boosted the same way. Scoring is a vectorised
sum of table entries by bin, squashed to 0..1.

The model is fitted on a bounded sample of labelled rows (``max_rows`` of them, chosen by a hash of the
id); every text is scored whole. Features come from the text alone.

Defined results: null and empty texts have all features 0 and a score like any other text; with no
usable labels every score is 0.5; labels that contradict each other are separate training rows;
null labels are not used; equal labels of one id count once, and of texts that share an id the least one is learned from.
Very long texts are scored whole; other columns of any name aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import batches_of, sample_below, ship, worker_udf

FEATURES = (
    "log_bytes",
    "upper_share",
    "symbol_share",
    "digit_share",
    "other_share",
    "punct_share",
    "word_length",
    "distinct_words",
    "repeated_next",
    "lines_per_word",
    "repeated_lines",
    "symbol_words",
    "shout_words",
    "squeezed",
)
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_PUNCT = b".,;:'\"-?()"
_SPACE = b" \t\r\n\x0b\x0c"
_SYMBOL = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGIT + _PUNCT)


def features(text: str | None) -> list[float]:
    """The numbers of FEATURES for one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    part = lambda chars: n - len(raw.translate(None, chars))
    upper, symbol, digit, punct, space = part(_UPPER), part(_SYMBOL), part(_DIGIT), part(_PUNCT), part(_SPACE)
    lower = part(_LOWER)
    inked = max(1, n - space)
    words = raw.split()
    m = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = raw.translate(_MARKS).split()
    return [
        float(np.log1p(n)),
        upper / max(1, upper + lower),
        symbol / inked,
        digit / inked,
        (inked - upper - lower - symbol - digit - punct) / inked,
        punct / inked,
        inked / m,
        len(set(words)) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m,
        len(lines) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(b"#" in w for w in marks) / m,
        sum(w.isupper() and len(w) > 1 for w in words) / m,
        len(zlib.compress(raw, 1)) / n,
    ]


#: Symbols as one mark, to count the words that hold one.
_MARKS = bytes(35 if b in _SYMBOL else 97 if b > 32 else 32 for b in range(256))


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(grad: np.ndarray, weight: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree over ordered bins as a table: greedy cuts, then a Newton step in each leaf."""
    n = len(grad)
    g, w = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + ridge)
    cuts = [0, n]
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                c = np.arange(a + 1, b)
                lift = gain(a, c) + gain(c, b) - gain(a, b)
                k = int(lift.argmax())
                if lift[k] > best[0]:
                    best = (lift[k], int(c[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(n)
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + ridge)
    return out


def train(x: np.ndarray, y: np.ndarray, *, bins: int = 64, coarse_bins: int = 12, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.15, leaves: int = 4, ridge: float = 5.0) -> AdditiveModel:
    """Fit on a feature matrix and 0/1 labels."""
    width = len(FEATURES)
    edges = [_edges(x[:, j], bins) if len(x) else np.zeros(0) for j in range(width)]
    coarse = [_edges(x[:, j], coarse_bins) if len(x) else np.zeros(0) for j in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(x):
        return AdditiveModel(edges, 0.0, tables, [], coarse)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    at = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(width)]
    total = np.full(len(x), base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            r, w = residual()
            step = rate * _tree(np.bincount(at[j], r, len(tables[j])), np.bincount(at[j], w, len(tables[j])), leaves, ridge)
            tables[j] += step
            total += step[at[j]]
    rough = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(width)]
    size = [len(c) + 1 for c in coarse]
    r, w = residual()
    joint = lambda a, b, v: np.bincount(rough[a] * size[b] + rough[b], v, size[a] * size[b])
    gains = []
    for a in range(width):
        for b in range(a + 1, width):
            both = (joint(a, b, r) ** 2 / (joint(a, b, w) + ridge)).sum()
            alone = max((np.bincount(rough[j], r, size[j]) ** 2 / (np.bincount(rough[j], w, size[j]) + ridge)).sum() for j in (a, b))
            gains.append((both - alone, a, b))
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:n_pairs]]
    grids = {ab: np.zeros(size[ab[0]] * size[ab[1]]) for ab in chosen}
    for _ in range(pair_rounds):
        for a, b in chosen:
            r, w = residual()
            # a shallow tree of the pair: cut the first feature, then the second one within each part
            g, h = joint(a, b, r).reshape(size[a], size[b]), joint(a, b, w).reshape(size[a], size[b])
            first = _tree(g.sum(axis=1), h.sum(axis=1), 2, ridge)
            step = np.zeros_like(g)
            for value in np.unique(first):
                rows = first == value
                step[rows] = _tree(g[rows].sum(axis=0), h[rows].sum(axis=0), 2, ridge)
            step = rate * step.ravel()
            grids[a, b] += step
            total += step[rough[a] * size[b] + rough[b]]
    return AdditiveModel(edges, base, tables, [(a, b, grids[a, b].reshape(size[a], size[b])) for a, b in chosen], coarse)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, max_rows: int = 20_000) -> AdditiveModel:
    """Learn from ``labels`` (id, label) joined to the texts of ``docs``. At most about ``max_rows``
    labels are used; they are broadcast, and only their features and labels reach the driver."""
    ship(docs.sparkSession)
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__label"))
    usable = usable.distinct()
    chosen = usable.filter(sample_below(max_rows / max(1, usable.count()), F.col("__id")))
    joined = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    joined = joined.groupBy("__id", "__label").agg(F.min("__text").alias("__text"))  # ids may repeat, so as many rows as labels

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = joined.select("__text", "__label").mapInArrow(batches_of(measure), "x array<double>, y double").toArrow()
    x = np.array(got["x"].to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    y = np.asarray(got["y"], dtype=np.float64)
    order = np.lexsort((y, *x.T))  # the sums of floats then don't depend on the order of arrival
    return train(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> Column:
    """A double column, 0 to 1; the model's tables are of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @worker_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py()) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
        return pa.array(shared.value.score(x), pa.float64())

    return rate(F.col(text_col))
