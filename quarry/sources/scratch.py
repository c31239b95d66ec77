"""Folders for intermediate tables, where all executors can reach them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local master gets a temporary folder, any other an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='quarry-scratch-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def _reached(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the scratch folder. It goes when the driver ends, or by remove()."""
    folder = f"{scratch_dir(spark)}/quarry-{uuid.uuid4().hex}-{name}"
    store, path = _reached(spark, folder)
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    store, path = _reached(spark, folder)
    store.delete(path, True)
    store.cancelDeleteOnExit(path)
