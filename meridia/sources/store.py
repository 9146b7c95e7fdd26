"""An append-only store of batches: a batch is there as a whole or not at all, and is never replaced."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new name in the folder that driver and executors share, ``spark.checkpoint.dir``; only a local
    session that names none gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="meridia-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _batches(spark: SparkSession, root: str, batch: str = "*") -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch={batch}/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(x.getPath().getParent()) for x in found or [])


def files(spark: SparkSession, folder: str) -> list[str]:
    """The data files of a folder that Spark wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")
    return sorted(str(x.getPath()) for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [])


def commit(df: DataFrame, root: str, batch: int) -> bool:
    """Write a batch; False if it is committed already, by this driver or another.

    An attempt writes to a folder of its own, which readers do not see, and a rename that fails
    where the batch is there commits it. So of two drivers one wins, and a batch never changes;
    what a lost attempt left is never read."""
    spark = df.sparkSession
    if _batches(spark, root, str(batch)):
        return False
    attempt = f"{root}/_attempts/{uuid.uuid4().hex}"
    df.write.parquet(attempt)
    fs = spark._jvm.org.apache.hadoop.fs
    source, target = fs.Path(attempt), fs.Path(f"{root}/batch={batch}")
    context = fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    no_overwrite[0] = getattr(fs, "Options$Rename").NONE
    try:
        context.rename(source, target, no_overwrite)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
            raise
        context.delete(source, True)
        return False


def sink(root: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch that is run again after a failure is stored once."""
    def write(df: DataFrame, batch: int) -> None:
        commit(df, root, batch)
    return write


def read(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All committed batches, with their number as column ``batch``; empty if there are none."""
    paths = _batches(spark, root)
    full = f"{schema}, batch long"
    return spark.read.schema(full).option("basePath", root).parquet(*paths) if paths else spark.createDataFrame([], full)
