"""Benchmark decontamination with an Aho-Corasick automaton over normalised test items.

Texts are lower-cased (A-Z) and read as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Every run of
``width`` words of an item is a window; a shorter item is one window, an item without words none.
The automaton's alphabet is the words of the items, numbered; each text is scanned once, and a
word inside any occurrence of a window is hit. Hit runs are mapped to code points of the original.

The items are scanned in blocks: a block's windows hold at most ``max_window_words`` words, which
bounds the automaton that executors build; a longer item is cut into parts that overlap by a window less a word. Larger
benchmarks take one scan per block, one after the other, and the hits of all blocks are merged per text, so no item is
ever left out.

Defined results: null and empty texts have no words and no hits; null items, and items without a
word, never occur; items with equal texts or repeated rows each count by their id, a repeated id
once; a null item id counts under the empty string. Without items nothing is hit. Very long texts are scanned whole. Columns
keep their names, whatever these are, but a column named as ``into`` is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import saved, worker_udf

#: Bytes as they are compared: A-Z in lower case, every byte outside the words' class a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS = "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, contaminated: boolean, items: array<string>, spans: array<struct<start: bigint, end: bigint>>>"
PART = "struct<n_words: bigint, runs: array<struct<a: bigint, b: bigint>>, items: array<string>>"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Windows:
    """The automaton over the windows of some items; built where it is used."""

    def __init__(self, items: Iterable[tuple[str, str]], width: int) -> None:
        self.number: dict[bytes, int] = {}
        held: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                held.setdefault(tuple(ids[i : i + width]), []).append(item)
        self.automaton = None
        if held:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for window, of in held.items():
                self.automaton.add_word(window, (len(window), tuple(dict.fromkeys(of))))
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[list[int]], set[str]]:
        """(number of words, hit runs of words as [first, last + 1], items that occur)."""
        found = words(text)
        if not found or self.automaton is None:
            return len(found), [], set()
        get, runs, items = self.number.get, [], set()
        for end, (length, of) in self.automaton.iter(tuple([get(w, 0) for w in found])):
            items.update(of)
            start, end = end - length + 1, end + 1
            while runs and start <= runs[-1][1]:  # ends only grow, so earlier runs are swallowed from behind
                start = min(start, runs.pop()[0])
            runs.append([start, end])
        return len(found), runs, items


def spans(text: str, runs: list) -> list[tuple[int, int]]:
    """Runs of words as code-point ranges of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    out, done, chars = [], 0, 0
    for a, b in runs:
        ends = []
        for byte in (at[a][0], at[b - 1][1]):
            chars += len(raw[done:byte].decode("utf-8", "surrogatepass"))
            done = byte
            ends.append(chars)
        out.append(tuple(ends))
    return out


def merge(runs: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _result(text: str | None, n: int, runs: list, items: Iterable[str]) -> dict:
    names = sorted(items)
    return {
        "n_words": n,
        "n_hit": sum(b - a for a, b in runs),
        "n_items": len(names),
        "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(),
        "contaminated": bool(runs),
        "items": names,
        "spans": [{"start": a, "end": b} for a, b in spans(text, runs)] if runs else [],
    }


def item_blocks(items: DataFrame, id_col: str, text_col: str, max_window_words: int, width: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, one at a time; one empty block if there are none."""
    block, size, n = [], 0, 0
    rows = items.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col)
    most = max(1, max_window_words // width)  # windows
    for item, text in rows.toLocalIterator():
        found = words(text)
        for at in range(0, max(1, len(found) - width + 1), most):
            part = found[at : at + most + width - 1]
            block.append((item, b" ".join(part).decode("utf-8", "surrogatepass")))
            size += len(part) * width
            if size >= max_window_words:
                yield block
                block, size, n = [], 0, n + 1
    if block or not n:
        yield block


_BUILT: dict[str, Windows] = {}


def _windows(shared, width: int) -> Windows:
    """A worker keeps the automaton of the last block it has used."""
    if shared.id not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.id] = Windows(shared.value, width)
    return _BUILT[shared.id]


class _Shared:
    """A broadcast variable with a key of its own, by which workers hold what they build from it."""

    def __init__(self, spark, value) -> None:
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value

    def gone(self) -> None:
        self.broadcast.destroy()


def _scan(shared: _Shared, width: int) -> Callable[[Column], Column]:
    """UDF: (n_words, runs, items) of a text for one block."""
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])

    @worker_udf(PART)
    def part(texts: pa.Array) -> pa.Array:
        w, out = _windows(shared, width), []
        for x in texts:
            n, runs, found = w.scan(x.as_py())
            out.append({"n_words": n, "runs": [{"a": a, "b": b} for a, b in runs], "items": sorted(found)})
        return pa.array(out, kind)

    return part


def with_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", *, into: str = "contamination", width: int = 10, max_window_words: int = 2_000_000) -> DataFrame:
    """``docs`` with a struct column ``into`` (see HITS): counts, items, spans in code points.

    The automaton of 2,000,000 window words takes about 160 MB of a worker. A larger benchmark takes a
    scan of the texts per block, each of which keeps the hits alone, and one more that joins them."""
    spark = docs.sparkSession
    blocks = item_blocks(items, item_id, item_text, max_window_words, width)
    first, second = next(blocks), next(blocks, None)
    out_type = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    if second is None:
        only = _Shared(spark, first)

        @worker_udf(HITS)
        def hits(texts: pa.Array) -> pa.Array:
            w = _windows(only, width)
            return pa.array([_result(t, *w.scan(t)) for t in (x.as_py() for x in texts)], out_type)

        return docs.withColumn(into, hits(F.col(text_col)))

    @worker_udf(HITS)
    def joined(texts: pa.Array, runs: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for x, r, f in zip(texts, runs, found):
            text = x.as_py()
            out.append(_result(text, len(words(text)), merge((y["a"], y["b"]) for y in r.as_py() or ()), set(f.as_py() or ())))
        return pa.array(out, out_type)

    # a row's columns stay within a struct, so that none of their names meets one of these
    rows = saved(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "texts")
    text = F.col("doc")[text_col]
    found = []
    for block in itertools.chain([first, second], blocks):  # executors hold one at a time
        shared = _Shared(spark, block)
        scanned = rows.select("row", _scan(shared, width)(text).alias("p"))
        found.append(saved(scanned.filter("size(p.runs) > 0").select("row", "p.runs", "p.items"), "hits"))
        shared.gone()
    by_row = functools.reduce(DataFrame.unionByName, found).groupBy(F.col("row").alias("of")).agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    full = rows.join(by_row, F.col("row") == F.col("of"), "left").select("doc", joined(text, F.col("runs"), F.col("items")).alias("result"))
    replaced = [c.lower() == into.lower() for c in docs.columns]
    kept = [F.col("result").alias(into) if again else F.col("doc")[c].alias(c) for c, again in zip(docs.columns, replaced)]
    return full.select(*kept, *([] if any(replaced) else [F.col("result").alias(into)]))
