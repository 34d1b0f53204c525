"""Removal of repeated byte strings by sorted ranks at growing lengths.

A byte goes if a string of ``threshold`` (100) bytes that covers it also starts earlier: in a document
of a smaller id, or at an earlier start of the same document. Prefix doubling sorts (position, rank
pair) rows at growing offsets and drops what is unique until the threshold is passed. Taken
literally, every byte is such a row in every round, many times the input on disk; here each round's
rows are thinned first, by rules that equal strings always agree on, and nothing that could
still repeat is dropped:

1. Chunks. Content-defined chunks, each with the threshold - 1 bytes behind it, are grouped by digest, and the
   first position of a digest is their minimum. All windows of a chunk that isn't the first start earlier elsewhere.
2. Anchors. Of every other window the least ``gram`` (24) bytes by hash are its anchor (equal windows have
   equal anchors). Anchors are ranked by sorting; unique ones drop out with their windows.
3. Pairs. A window has 38 bytes more on at least one side of its anchor. The pairs (rank of the anchor, rank
   of what stands at that offset) are sorted, which ranks 62 bytes; unique ones drop out.
4. Windows. The stretches of windows around what is left are sorted by anchor and position, and
   windows are compared over the whole threshold: the first of each stays, the others go. A task holds
   at most ``held`` windows of one anchor; windows beyond are passed on as rows and sorted by
   Spark on their own rank, so that no anchor is too frequent for a task.

Each round is one shuffle of small rows. Texts are shuffled once, compressed, into a table bucketed by
document that later rounds join without moving it. Digests have 128 bits; anchors are only a filter.

Defined results: null texts are empty; texts under the threshold keep all bytes but count as they are;
rows that repeat an id with the same text are one document, each with the same result; rows that
share an id with different texts are ordered by a hash of the text; a null id comes before any other.
Equal strings that overlap within a text count. Very long texts are one row, scanned in blocks. Columns keep their names,
whatever these are, but those that begin with two underscores. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import batches_of, drop_saved, few, fresh_path, kinds, repeated, saved, ship, worker_udf
from loomwork.llm.windows import Rolling, chosen_grams, cuts, minimisers, mixed

THRESHOLD = 100
GRAM = 24
BLOCK = 1 << 20
STRETCH = 4096
UNITS = "struct<packed: binary, units: array<struct<u1: bigint, u2: bigint, a: int, b: int>>>"
_UNIT_TYPE = pa.list_(pa.struct([("u1", pa.int64()), ("u2", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))
KEY = ["__doc", "__tie"]
CHUNK_BYTES = 8 << 20
#: Bytes of text in a bucket of the table of texts, at most about; buckets aren't split when they are read.
BUCKET_BYTES = 256 << 20


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def chunk_starts(raw: bytes, n_windows: int, block: int = BLOCK) -> np.ndarray:
    """Starts of the chunks of window starts, block by block so that long texts take little memory."""
    found, data = [np.zeros(1, dtype=np.int64)], np.frombuffer(raw, dtype=np.uint8)
    for s in range(0, n_windows, block):
        back = min(s, 32)
        at = cuts(data[s - back : s + block]) + s - back
        found.append(at[at > s] if s else at)
        if s:
            found.append(np.array([s]))
    at = np.unique(np.concatenate(found))
    return at[at < n_windows]


def prepared(docs: DataFrame, id_col: str, text_col: str, threshold: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """The bucketed table: __doc, __tie, __packed (compressed text), __units, and the other columns of ``docs``.

    Rows that repeat id and text are one row of the table without those columns; the second result then has them, by __doc and __tie."""
    spark = docs.sparkSession
    # the smallest long stands for a null id; a real id of that value would tie with it
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("__doc"), F.xxhash64(F.col(text_col)).alias("__tie")]
    each = docs.select(*key, F.octet_length(text_col).alias("n")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    most, size = each.agg(F.max("rows"), F.sum("n")).first()

    @worker_udf(UNITS)
    def unit(texts: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=3).compress
        packed, of, u1, u2, a, b = [], [], [], [], [], []
        for i, text in enumerate(texts):
            raw = _raw(text.as_py())
            packed.append(pack(raw))
            n = len(raw) - threshold + 1
            if n <= 0:
                continue
            starts = chunk_starts(raw, n, block)
            stops = np.append(starts[1:], n)
            for s, e in zip(starts.tolist(), stops.tolist()):
                h = hashlib.blake2b(raw[s : e + threshold - 1], digest_size=16).digest()
                u1.append(int.from_bytes(h[:8], "little", signed=True))
                u2.append(int.from_bytes(h[8:], "little", signed=True))
            of += [i] * len(starts)
            a += starts.tolist()
            b += stops.tolist()
        offsets = np.concatenate([[0], np.cumsum(np.bincount(np.array(of, dtype=np.int64), minlength=len(texts)))]).astype(np.int32)
        units = pa.StructArray.from_arrays([pa.array(u1, pa.int64()), pa.array(u2, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], fields=list(_UNIT_TYPE.value_type))
        return pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), units)], ["packed", "units"])

    rest = [c for c in docs.columns if c != text_col]
    keyed, others = docs.select(*key, *[F.col(c) for c in rest], F.col(text_col).alias("__text")), None
    if (most or 0) > 1:
        others = docs.select(*key, *[F.col(c) for c in rest])
        keyed = keyed.groupBy(*KEY).agg(F.min("__text").alias("__text"))
    done = keyed.withColumn("__r", unit("__text")).drop("__text").select("*", F.col("__r.packed").alias("__packed"), F.col("__r.units").alias("__units")).drop("__r")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // BUCKET_BYTES)
    name = f"loomwork_{uuid.uuid4().hex}"
    (done.repartition(n, *KEY).write.format("parquet").option("path", fresh_path(spark, "texts")).option("compression", "snappy").bucketBy(n, *KEY).saveAsTable(name))
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry only: the files are the session's, in the shared folder
    return texts, others


def later_chunks(units: DataFrame) -> DataFrame:
    """(doc, tie, a, b) of the chunks that aren't the first of their digest.

    The first one is an associative minimum, which combines map-side, so that no digest gathers."""
    place = F.struct(*KEY, "a")
    firsts = units.groupBy("u1", "u2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return units.join(few(saved(firsts, "firsts")), ["u1", "u2"]).filter(place != F.col("first")).select(*KEY, "a", "b")


def not_first(rows: DataFrame, rank: list[str], keep: list[str]) -> DataFrame:
    """Of rows sorted by ``rank`` and then document and start, those whose rank an earlier position has."""
    spread = rows.select(*rank, *KEY, "a", *keep).repartition(*[F.col(c) for c in rank]).sortWithinPartitions(*rank, *KEY, "a")
    names = [*KEY, "a", *keep]
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in names)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                key = np.stack([np.asarray(batch[c]) for c in rank])
                gone = np.zeros(batch.num_rows, dtype=bool)
                gone[1:] = (key[:, 1:] == key[:, :-1]).all(axis=0)
                gone[0] = last is not None and bool((key[:, 0] == last).all())
                last = key[:, -1]
                if gone.any():
                    yield batch.filter(pa.array(gone)).select(names)

    return spread.mapInArrow(batches_of(later), schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch[c][i] for c in batch.schema.names}
            yield row, unpack(row["__packed"].as_py())


def _open_windows(row: dict, n: int) -> np.ndarray:
    """Which of n window starts no chunk has settled."""
    free = np.ones(n, dtype=bool)
    spans = row["spans"].as_py()
    for s in spans or ():
        free[s["a"] : s["b"]] = False
    return free


def _blocks(raw: bytes, free: np.ndarray, threshold: int, gram: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, bytes, gram hashes, anchors of windows, free) by blocks of window starts that have free ones."""
    for s in range(0, len(free), block):
        part = free[s : s + block]
        if part.any():
            data = np.frombuffer(raw, dtype=np.uint8, count=len(part) + threshold - 1, offset=s)
            grams = np.maximum(mixed(Rolling(data).all(gram)), np.uint64(1))
            yield s, data, grams, minimisers(grams, threshold - gram + 1), part


def _ranks(h: list, doc: list, tie: list) -> pa.RecordBatch:
    """Rows (h, doc, tie, kind) of the texts scanned together."""
    n, h = [len(x) for x in h], np.concatenate(h)
    docs, ties = (np.repeat(np.array(x, dtype=np.int64), n) for x in (doc, tie))
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(docs), pa.array(ties), pa.array(kinds(h))], ["h", *KEY, "kind"])


def _pairs(data: np.ndarray, grams: np.ndarray, at: np.ndarray, gram: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the anchors at ``at`` those with ``side`` bytes more on the left, and on the right, as (which, rank pair)
    with the rank pair mixed into one number; first all left ones, then all right ones."""
    roll = Rolling(data)
    left, right = np.flatnonzero(at >= side), np.flatnonzero(at + gram + side <= len(data))
    of_left = mixed(grams[at[left]] ^ mixed(roll.of(at[left] - side, at[left])))
    of_right = mixed(grams[at[right]] + mixed(roll.of(at[right] + gram, at[right] + gram + side)))
    return (left, of_left), (right, of_right)


def anchors(texts: DataFrame, threshold: int, gram: int, block: int) -> DataFrame:
    """(h, doc, tie, kind): the rank of each anchor of a window that is still open; or, where ``texts`` has
    the repeated ranks of a document as ``ranks``, the rank pairs of these anchors and what is beside them.

    A rank that repeats among the texts scanned together is settled: one row of it (KNOWN) still has to
    meet the others of its kind, the rest (FAR) needn't, so a frequent rank doesn't gather."""
    paired, side = "ranks" in texts.columns, (threshold - gram + 1) // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, doc, tie, size = [], [], [], 0
        for row, raw in _texts(batches):
            free = _open_windows(row, max(0, len(raw) - threshold + 1))
            repeated = np.array(row["ranks"].as_py(), dtype=np.int64).view(np.uint64) if paired else None
            for _, data, grams, least, part in _blocks(raw, free, threshold, gram, block):
                at = chosen_grams(grams, np.where(part, least, np.uint64(0)), threshold - gram + 1)
                if paired:
                    at = at[np.isin(grams[at], repeated)]
                    found = np.concatenate([pair for _, pair in _pairs(data, grams, at, gram, side)])
                else:
                    found = grams[at]
                h.append(found)
                doc.append(row["__doc"].as_py())
                tie.append(row["__tie"].as_py())
                size += len(found)
            if size >= 200_000:
                yield _ranks(h, doc, tie)
                h, doc, tie, size = [], [], [], 0
        if h:
            yield _ranks(h, doc, tie)

    return texts.mapInArrow(batches_of(scan), "h bigint, __doc bigint, __tie bigint, kind tinyint")


def stretches(texts: DataFrame, threshold: int, gram: int, block: int) -> DataFrame:
    """(h, doc, tie, a, b, bytes) for each run of open windows that share an anchor with a repeated rank pair.

    A run equal to an earlier one among the texts scanned together is settled: its bytes are null."""
    names, kinds = ["h", *KEY, "a", "b", "bytes"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    side = (threshold - gram + 1) // 2

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0], r[5], r[1], r[2], r[3]))
        rows[1:] = [(*r[:5], None) if (r[0], r[5]) == before else r for r, before in zip(rows[1:], [(q[0], q[5]) for q in rows])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row, raw in _texts(batches):
            repeated = np.array(row["ranks"].as_py(), dtype=np.int64).view(np.uint64)
            free = _open_windows(row, max(0, len(raw) - threshold + 1))
            for s, data, grams, least, part in _blocks(raw, free, threshold, gram, block):
                at = chosen_grams(grams, np.where(part, least, np.uint64(0)), threshold - gram + 1)
                (left, of_left), (right, of_right) = _pairs(data, grams, at, gram, side)
                left, right = at[left[np.isin(of_left, repeated)]], at[right[np.isin(of_right, repeated)]]
                # windows that hold the anchor and the bytes beside it
                marks = np.zeros(len(part) + threshold, dtype=np.int32)
                for low, high in ((left - (threshold - gram), left - side), (right - (threshold - gram - side), right)):
                    np.add.at(marks, np.clip(low, 0, len(part)), 1)
                    np.add.at(marks, np.clip(high + 1, 0, len(part)), -1)
                shown = part & (np.cumsum(marks)[: len(part)] > 0) & np.isin(least, grams[np.concatenate([left, right])])
                key = np.where(shown, least, np.uint64(0))
                change = np.flatnonzero(key[1:] != key[:-1]) + 1
                starts, stops = np.concatenate([[0], change]), np.append(change, len(key))
                for a, b in zip(starts.tolist(), stops.tolist()):
                    if key[a]:
                        for x in range(a, b, STRETCH):
                            y = min(b, x + STRETCH)
                            out.append((int(key[a].view(np.int64)), row["__doc"].as_py(), row["__tie"].as_py(), s + x, s + y, raw[s + x : s + y + threshold - 1]))
                            size += y - x + threshold
            if size >= CHUNK_BYTES:
                yield emit(out)
                out, size = [], 0
        if out:
            yield emit(out)

    return texts.mapInArrow(batches_of(scan), "h bigint, __doc bigint, __tie bigint, a bigint, b bigint, bytes binary")


def compared(rows: DataFrame, threshold: int, held: int) -> DataFrame:
    """Windows of stretches, compared within their anchor in order of position.

    Returns settled runs (w1 null; window starts a to b aren't first) and, beyond ``held`` windows of
    an anchor, open windows with their rank (w1, w2) for another sort."""
    spread = rows.repartition(F.when(F.col("bytes").isNull(), F.xxhash64("h", *KEY, "a")).otherwise(F.col("h"))).sortWithinPartitions("h", *KEY, "a")
    names = ["w1", "w2", *KEY, "a", "b"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none_seen = np.zeros((2, 0), dtype=np.uint64)
        group, seen = None, none_seen  # the anchor at the end of the last part, its windows by both hashes
        for batch in batches:
            settled = batch.filter(batch["bytes"].is_null())
            if settled.num_rows:
                none = pa.nulls(settled.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *(settled[c] for c in names[2:])], names)
            batch = batch.filter(batch["bytes"].is_valid())
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                h, doc, tie, a = (np.asarray(part[c]) for c in ("h", *KEY, "a"))
                text = part["bytes"].to_pylist()
                data = np.frombuffer(b"".join(text), dtype=np.uint8)
                length = np.array([len(t) for t in text])
                n = length - threshold + 1
                row = np.repeat(np.arange(len(n)), n)
                within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                place = (np.cumsum(length) - length)[row] + within
                one, two = (Rolling(data, k).all(threshold)[place] for k in (0, 1))
                start = a[row] + within
                key, of = mixed(one ^ mixed(h[row].view(np.uint64))), h[row]
                order = np.lexsort((two, key))  # positions stay in order
                first = np.ones(len(key), dtype=bool)
                first[order[1:]] = (key[order][1:] != key[order][:-1]) | (two[order][1:] != two[order][:-1])
                open_rows = np.zeros(len(key), dtype=bool)
                if group is not None and h[0] == group:
                    mine = of == group
                    if seen.shape[1]:
                        at = np.minimum(np.searchsorted(seen[0], key), seen.shape[1] - 1)
                        first &= ~(mine & (seen[0, at] == key) & (seen[1, at] == two))
                    if seen.shape[1] >= held:
                        open_rows = mine & first
                if h[-1] != group:
                    group, seen = h[-1], none_seen
                new = (of == group) & first & ~open_rows
                seen = np.concatenate([seen, np.stack([key[new], two[new]])], axis=1)
                seen = seen[:, np.argsort(seen[0], kind="stable")]
                gone = ~first
                index = np.flatnonzero(gone)
                if len(index):
                    # neighbours of one stretch make a run
                    cut = np.flatnonzero((np.diff(index) != 1) | (row[index][1:] != row[index][:-1])) + 1
                    lo, hi = index[np.concatenate([[0], cut])], index[np.append(cut, len(index)) - 1]
                    none = pa.nulls(len(lo), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(doc[row[lo]]), pa.array(tie[row[lo]]), pa.array(start[lo]), pa.array(start[hi] + 1)], names)
                if open_rows.any():
                    o = np.flatnonzero(open_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(one[o].view(np.int64)), pa.array(two[o].view(np.int64)), pa.array(doc[row[o]]), pa.array(tie[row[o]]), pa.array(start[o]), pa.array(start[o] + 1)], names)

    return spread.mapInArrow(batches_of(scan), "w1 bigint, w2 bigint, __doc bigint, __tie bigint, a bigint, b bigint")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: int = THRESHOLD, gram: int = GRAM, held: int = 1_000_000, block: int = BLOCK) -> DataFrame:
    """The columns of ``docs`` but the text, with __packed (the compressed text) and __spans: ranges of
    starts of windows that also start earlier. Texts are scanned in blocks of ``block`` window starts."""
    ship(docs.sparkSession)
    texts, others = prepared(docs, id_col, text_col, threshold, block)
    units = texts.select(*KEY, F.explode("__units").alias("u")).select(*KEY, "u.*")
    chunks = saved(later_chunks(units), "chunks")
    lists = lambda rows: rows.groupBy(*KEY).agg(F.collect_list(F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))).alias("spans"))
    still = texts.select(*KEY, "__packed").join(lists(chunks), KEY, "left")
    sets = lambda rows: rows.groupBy(*KEY).agg(F.collect_set("h").alias("ranks"))
    single = saved(repeated(anchors(still, threshold, gram, block), "h", KEY), "anchors")
    paired = saved(repeated(anchors(still.join(sets(single), KEY), threshold, gram, block), "h", KEY), "pairs")
    drop_saved(single)
    windows = saved(compared(stretches(still.join(sets(paired), KEY), threshold, gram, block), threshold, held), "windows")
    drop_saved(paired)
    beyond = not_first(windows.filter("w1 is not null"), ["w1", "w2"], ["b"])
    long = lambda rows: rows.select(*KEY, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    spans = saved(lists(long(chunks).unionByName(long(windows.filter("w1 is null"))).unionByName(long(beyond))), "spans")
    drop_saved(chunks, windows)
    found = texts.drop("__units").join(spans.withColumnRenamed("spans", "__spans"), KEY, "left")
    return (found if others is None else others.join(found, KEY)).drop(*KEY)


def byte_spans(starts: list[dict] | None, threshold: int) -> list[list[int]]:
    """Maximal runs of bytes that windows with these starts cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"] + threshold - 1) for s in starts or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _kept(raw: bytes, spans: list[list[int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def digests(threshold: int = THRESHOLD) -> Column:
    """Struct (n_bytes, n_removed, n_spans, kept_sha256) for rows of :func:`removals`."""

    @worker_udf("struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string>")
    def of(packed: pa.Array, starts: pa.Array) -> pa.Array:
        unpack, out = zstandard.ZstdDecompressor().decompress, []
        for p, s in zip(packed, starts):
            raw, spans = unpack(p.as_py()), byte_spans(s.as_py(), threshold)
            out.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest()))
        kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.string()], ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names)

    return of(F.col("__packed"), F.col("__spans"))


def kept_text(threshold: int = THRESHOLD) -> Column:
    """The remaining text for rows of :func:`removals`; a code point that lost a byte goes as a whole."""

    @worker_udf("string", once=True)
    def of(packed: pa.Array, starts: pa.Array) -> pa.Array:
        unpack = zstandard.ZstdDecompressor().decompress
        return pa.array([_kept(unpack(p.as_py()), byte_spans(s.as_py(), threshold)).decode("utf-8", "ignore") for p, s in zip(packed, starts)], pa.string())

    return of(F.col("__packed"), F.col("__spans"))


def doubled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: int = THRESHOLD, first: int = 4) -> DataFrame:
    """Prefix doubling taken literally, a row per byte in every round: __doc, __tie, a, b of removed windows.

    It gives what :func:`removals` gives and is kept to hold that against; the README has what it costs.
    Round by round rows (rank, rank at the offset, position) are sorted, equal pairs get one rank
    and unique ones drop out, until the ranks stand for ``threshold`` bytes."""
    ship(docs.sparkSession)
    texts, _ = prepared(docs, id_col, text_col, threshold)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, raw in _texts(batches):
            for s in range(0, len(raw) - first + 1, STRETCH * 16):
                part = np.frombuffer(raw[s : s + STRETCH * 16 + first - 1], dtype=np.uint8).astype(np.int64)
                n = len(part) - first + 1
                rank = sum(part[i : i + n] << (8 * i) for i in range(first))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row[c].as_py(), dtype=np.int64)) for c in KEY] + [pa.array(np.arange(s, s + n)), pa.array(rank)], [*KEY, "a", "r"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, last, held = TaskContext.get().partitionId() << 40, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held[0], batch]).combine_chunks().to_batches()[0]
            one, two = np.asarray(batch["r"]), np.asarray(batch["r2"])
            same = np.concatenate([[held is not None and last == (one[0], two[0]) and held[1]], (one[1:] == one[:-1]) & (two[1:] == two[:-1])])
            name_of = name + np.cumsum(np.concatenate([[0], ~same[1:]]))
            twice = same | np.concatenate([same[1:], [False]])
            name, last, held = int(name_of[-1]), (one[-1], two[-1]), (batch.slice(batch.num_rows - 1), bool(twice[-1]))
            twice[-1] = False
            out = pa.RecordBatch.from_arrays([batch[c] for c in (*KEY, "a")] + [pa.array(name_of)], [*KEY, "a", "r"])
            yield out.filter(pa.array(twice))
        if held is not None and held[1]:
            yield pa.RecordBatch.from_arrays([held[0][c] for c in (*KEY, "a")] + [pa.array([name])], [*KEY, "a", "r"])

    schema = "__doc bigint, __tie bigint, a bigint, r bigint"
    ranks, length = texts.select(*KEY, "__packed").mapInArrow(batches_of(positions), schema), first
    while length < threshold:
        offset = min(length, threshold - length)
        behind = ranks.select(*KEY, (F.col("a") - offset).alias("a"), F.col("r").alias("r2"))
        pairs = ranks.join(behind, [*KEY, "a"]).repartition("r", "r2").sortWithinPartitions("r", "r2")
        ranks = saved(pairs.mapInArrow(batches_of(rerank), schema), "ranks")
        length += offset
    return not_first(ranks.withColumn("b", F.col("a") + 1), ["r"], ["b"])
