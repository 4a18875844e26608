"""Intermediate tables below the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, a temporary folder for local masters only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/steps-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written and read again: its lineage ends here, and a lost executor costs a read. The files go when the driver ends."""
    spark = df.sparkSession
    path = folder(spark)
    atexit.register(_drop, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the JVM may have ended; the folder is scratch
        return
