"""Shared storage between stages, working names, and shipping of this package to the workers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscope.functions import shipping

_DEFAULT = "spark.checkpoint.dir"
#: Most bytes of an Arrow batch: texts may be long, and ten thousand of them take hundreds of MB.
BATCH_BYTES = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, local mode takes a folder
    of this machine; a cluster has no such folder, so that is an error."""
    found = spark.conf.get(_DEFAULT, None) or spark.sparkContext.getConf().get(_DEFAULT)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_DEFAULT} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cellscope-")
        spark.conf.set(_DEFAULT, found)
    return found


def _path(spark: SparkSession, path: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def spool(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost executor
    costs a reread instead of the work before. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._spooled = path
    return out


def drop_spooled(df: DataFrame | None) -> None:
    """Delete a table that ``spool`` returned and nothing reads any more."""
    if df is not None:
        fs, at = _path(df.sparkSession, df._spooled)
        fs.delete(at, True)


def unused(taken: DataFrame | list[str], name: str) -> str:
    """``name``, with as many underscores before it as no column's name needs to clash."""
    low = {c.lower() for c in (taken if isinstance(taken, list) else taken.columns)}
    while name.lower() in low:
        name = "_" + name
    return name


def column(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, and bound Arrow batches by bytes
    (a session setting that changes no result), unless the session bounds them lower."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    shipping.ship(spark)
