"""Tables and streams kept in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs in one process (tests), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.bidloom.shared", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.bidloom.shared", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back, for what reads it more than once: it is computed once, and a lost executor
    repeats no more than a stage."""
    spark = rows.sparkSession
    path = new_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is there now and read its result back, each batch's rows with ``batch``.

    A batch overwrites its own folder, so a batch that is run again after a failure leaves its rows once.
    """
    spark = stream.sparkSession
    path = new_path(spark, name)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
