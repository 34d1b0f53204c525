"""Outputs that are replaced as a whole: a reader finds the old rows or the new ones, never a mixture or nothing.

Each version is a folder of its own, and a small file names the one that is current. That file is written under another name and
renamed over the old one, which Hadoop's file systems do in one step; nothing else of a version is visible before. The version before is
kept, as readers may still be in it, and the one before that is deleted."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from loomwork.storage import delete

CURRENT = "_current.json"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the current version's folder and of the one before; empty where nothing was published."""
    file = _path(spark, f"{path}/{CURRENT}")
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(file):
        return []
    stream = system.open(file)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def publish(df: DataFrame, path: str, fmt: str = "json", **options) -> str:
    """Write ``df`` as the next version of ``path`` and make it current; the folder that it's in. It may be made from the current version.

    Where writing fails, what it left is removed and the current version stays. Of two that publish at once the later one stays current."""
    spark = df.sparkSession
    name = f"version-{uuid.uuid4().hex}"
    try:
        df.write.format(fmt).options(**({"ignoreNullFields": False} if fmt == "json" else {}) | options).save(f"{path}/{name}")
    except Exception:
        delete(spark, f"{path}/{name}")
        raise
    before = versions(spark, path)
    _make_current(spark, path, [name, *before[:1]])
    for old in before[1:]:
        delete(spark, f"{path}/{old}")
    return f"{path}/{name}"


def _make_current(spark: SparkSession, path: str, names: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    temporary, current = _path(spark, f"{path}/_next-{uuid.uuid4().hex}"), _path(spark, f"{path}/{CURRENT}")
    stream = temporary.getFileSystem(conf).create(temporary, False)
    stream.write(bytearray(json.dumps(names).encode()))
    stream.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(kinds, 1)
    overwrite[0] = kinds.OVERWRITE
    qualified = current.getFileSystem(conf).makeQualified(current)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf).rename(temporary, current, overwrite)


def read_published(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "json") -> DataFrame:
    """The current version; an error where there is none."""
    names = versions(spark, path)
    if not names:
        raise FileNotFoundError(f"nothing was published at {path}")
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(f"{path}/{names[0]}")
