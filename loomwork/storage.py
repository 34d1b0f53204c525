"""Tables in the folder that driver and executors share, and distributed row numbers."""

from __future__ import annotations

import contextlib
import contextvars
import itertools
import json
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests on one machine) a temporary folder is made."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="loomwork-")
    return _OWN_DIR[app]


_OWN_FOLDER: dict[str, str] = {}
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder. What is written there goes when the application's JVM ends, or with its :func:`scratch`."""
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        folder = f"{shared_dir(spark)}/loomwork-{app}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _OWN_FOLDER[app] = folder
    path = f"{_OWN_FOLDER[app]}/{name}-{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what its own thread has written to fresh paths within; what is to stay is written to a path from before."""
    made: list[str] = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in made:
            delete(spark, path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and reread it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Narrow tables are broadcast up to this many rows; larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000


def few(df: DataFrame) -> DataFrame:
    """A narrow table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def with_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in the total order of ``order``, without one task for all rows.

    Rows are range-partitioned and sorted; a row's position is its number in its partition plus the
    sizes of the partitions before, one small row each. The sorted rows are written first, as range
    bounds are sampled and must be the same for both uses."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ordered = saved(ordered, "ranked").withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).collect()  # a row per partition
    of = {r[0]: r[1] for r in sizes}
    before = [0, *itertools.accumulate(of.get(k, 0) for k in range(max(of, default=0)))]
    return ordered.withColumn(name, looked_up(before, F.col("__part")) + F.col("__row") + 1).drop("__at", "__part", "__row")


def looked_up(values: list[int], place: Column) -> Column:
    """``values[place]``, a long: an array that is built once and indexed, so that a row's cost doesn't grow with their number."""
    return F.get(F.from_json(F.lit(json.dumps(values)), "array<bigint>"), place.cast("int"))
