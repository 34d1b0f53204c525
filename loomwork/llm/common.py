"""Helpers shared by the operators of this subpackage: shared storage, splits, worker code and memory."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.storage import few, fresh_path, saved, shared_dir, table

__all__ = ["FAR", "KNOWN", "UNKNOWN", "batches_of", "crc_mod", "drop_saved", "few", "fresh_path", "kinds", "repeated", "sample_below", "saved", "shared_dir", "ship", "table", "worker_udf"]


def drop_saved(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`saved` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def sample_below(share: float | Column, *key: Column) -> Column:
    """True for about ``share`` of the keys, however small it is, the same ones in every run; null for a null share."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    least = F.lit(-float(1 << 63))
    return F.when(share >= 1, F.lit(True)).otherwise(F.xxhash64(*key) < F.floor(least + share * float(1 << 64)))


UNKNOWN, KNOWN, FAR = 0, 1, 2


def kinds(key: np.ndarray) -> np.ndarray:
    """For keys that are seen together: UNKNOWN if a key is alone here; else KNOWN for one of its rows and FAR for the others.

    What repeats here is settled: one row still has to meet its like elsewhere, the rest needn't, so a frequent key doesn't gather."""
    _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    kind = np.where(count[inverse] > 1, FAR, UNKNOWN).astype(np.int8)
    kind[first[count > 1]] = KNOWN
    return kind


def repeated(rows: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """(key, *keep) of the rows whose long ``key`` isn't unique; ``kind`` is as :func:`kinds` gives it. One shuffle, by key."""
    rows = rows.select(key, *keep, "kind")
    spread = rows.repartition(F.when(F.col("kind") == FAR, F.xxhash64(key, *keep)).otherwise(F.col(key))).sortWithinPartitions(key)

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, False  # the last row so far, and whether its key is known to repeat
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            h = np.asarray(batch[key])
            same = h[1:] == h[:-1]
            double = np.asarray(batch["kind"]) != UNKNOWN
            double[1:] |= same
            double[:-1] |= same
            double[0] |= known
            held, known = batch.slice(len(h) - 1), bool(double[-1])
            double[-1] = False
            if double.any():
                yield batch.filter(pa.array(double)).select([key, *keep])
        if held is not None and known:
            yield held.select([key, *keep])

    types = dict(rows.dtypes)
    return spread.mapInArrow(batches_of(twice), ", ".join(f"{c} {types[c]}" for c in (key, *keep)))


_SHIPPED: set[str] = set()
BATCH_KEY, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once per application.

    Whole texts travel in batches, held outside the heap by both sides, so a session that has Spark's
    default of rows per batch gets a smaller one; a value that was chosen stays."""
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="loomwork-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


_TRIMMED = [0.0]


def trim(every: float = 1.0) -> None:
    """Return freed memory to the system, now and then: workers live long, and allocators keep their peaks."""
    if time.monotonic() - _TRIMMED[0] < every:
        return
    _TRIMMED[0] = time.monotonic()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def worker_udf(returns: str, once: bool = False):
    """``arrow_udf`` whose code workers can import and that leaves no freed memory behind.

    With ``once`` a filter on its result isn't pushed below it, where it would be evaluated another time."""
    ship(SparkSession.active())

    def wrap(f: Callable):
        # arrow_udf reads the signature, so the wrapper keeps that of f
        @functools.wraps(f)
        def trimmed(*columns):
            try:
                return f(*columns)
            finally:
                trim()

        made = F.arrow_udf(returns)(trimmed)
        return made.asNondeterministic() if once else made

    return wrap


def batches_of(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same for a function of mapInArrow."""

    def trimmed(batches: Iterator) -> Iterator:
        for batch in f(batches):
            yield batch
            trim()
        trim(0)

    return trimmed
