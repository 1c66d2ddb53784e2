"""Tables written to the shared folder, so that later work restarts from files and not from the beginning."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch between Spark and Python while a table is staged: whole texts may be in them.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all work is done on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def deleted_at_exit(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def staged(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later stages restart from these files.

    The files are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    deleted_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(table: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = table.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if not path.getName().startswith("stage-"):
            raise ValueError(f"{name} is not a staged table")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)
