"""Resumable processing and progress counters as Structured Streaming jobs.

The batch forms (``unfinished_ids`` and ``done_counters``) are preferred; these twins serve inputs that keep arriving."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.operators.relational import unfinished_ids
from loomwork.sources.readers import exists

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _first_of_each(id_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        places = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("__order", "__tie")], null_placement="at_start")
        rows = rows.take(places)
        numbered = rows.append_column("__place", pa.array(range(len(rows)), pa.int64()))
        first = numbered.group_by(id_col).aggregate([("__place", "min")])["__place_min"]
        unknown = pc.indices_nonzero(pc.is_null(rows[id_col]))
        known = first.filter(pc.is_valid(rows[id_col].take(first)))
        yield from rows.take(pa.concat_arrays([pc.cast(known, pa.int64()).combine_chunks(), pc.cast(unknown, pa.int64())])).combine_chunks().to_batches()

    return pick


def resume_stream(
    spark: SparkSession, source: str, schema: str, output: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], id_col: str = "id", order_col: str | None = None, rows_per_file: int = 1_000_000
) -> StreamingQuery:
    """Read JSONL files as they arrive, skip ids that were processed before, append what ``process`` makes of the rest.

    The ids that are done are the query's keyed state, so that a batch looks up its own ids, whatever has been written. Of rows of a
    batch that share an id the first one by ``order_col`` counts, nulls first, or else, and among equals, by the whole row. Rows without an id can't be
    known again: each is processed when it arrives. ``process`` keeps the id.

    A batch has a folder of its own, which it overwrites if it's run again, and a file for each ``rows_per_file`` rows. Ids in the
    output of another checkpoint are skipped as well; only these are looked up in files."""
    stream = spark.readStream.schema(schema).json(source)
    columns = stream.columns
    whole = F.to_json(F.struct(*columns))
    rows = stream.withColumns({"__order": F.col(order_col) if order_col else F.lit(0), "__tie": whole}).repartition(id_col)
    first = rows.mapInArrow(_first_of_each(id_col), rows.schema).select(*columns)
    fresh = first.withColumn("__key", F.when(F.col(id_col).isNull(), F.uuid())).dropDuplicates([id_col, "__key"]).drop("__key")

    def step(batch: DataFrame, number: int) -> None:
        own = f"__run={spark.sparkContext.getLocalProperty('sql.streaming.queryId')}"
        others = [r for r in _runs(spark, output) if r != own]
        if others:
            done = [spark.read.parquet(f"{output}/{r}").select(id_col) for r in others]
            batch = unfinished_ids(batch, done[0] if len(done) == 1 else _union(done), id_col)
        batch = batch.persist()
        try:
            files = -(-batch.count() // rows_per_file)
            if files:
                process(batch).coalesce(files).write.mode("overwrite").parquet(f"{output}/{own}/__batch={number}")
        finally:
            batch.unpersist()

    writer = fresh.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # state on disk, its changes in the checkpoint
    try:
        return writer.start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _runs(spark: SparkSession, output: str) -> list[str]:
    """Folders of the checkpoints that have written to an output."""
    if not exists(spark, output):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(output)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().getName() for s in found if s.getPath().getName().startswith("__run="))


def progress_stream(rows: DataFrame, task: str = "task_type") -> DataFrame:
    """Running counts by task over a stream of results."""
    return rows.groupBy(task).agg(F.count(F.lit(1)).alias("done"), F.sum(F.coalesce(F.col("parse_success").cast("long"), F.lit(0))).alias("parse_ok"))
