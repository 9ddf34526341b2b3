"""Intermediate tables that end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder under ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent and Spark runs on this machine alone, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/grainflow"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in a new folder and read back, so that rounds of a loop don't grow the plan."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file, in whichever file system it is."""
    store, file = _file(spark, path)
    store.delete(file, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    store, folder = _file(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(folder)) if store.exists(folder) else []


def read_text(spark: SparkSession, path: str) -> str:
    store, file = _file(spark, path)
    stream = store.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that doesn't exist yet, whole or not at all. False if someone else's is there."""
    store, file = _file(spark, path)
    _, draft = _file(spark, f"{path}.{uuid.uuid4().hex}")
    stream = store.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    done = not store.exists(file) and store.rename(draft, file)
    if not done:
        store.delete(draft, False)
    return bool(done)
