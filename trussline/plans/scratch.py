"""Tables for intermediate results, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A folder of this application's own under spark.checkpoint.dir, else, in local mode, under the
    warehouse.  A cluster has to name its shared folder: the warehouse may be one machine's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")
    return f"{base}/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, when none of its results is read any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write `df` as Parquet and read it back; without a codec named, with the session's.

    Cuts the lineage: what follows reads the table again after an executor is lost, and the work
    before it runs once however often the table is used.
    """
    path = f"{folder(df.sparkSession)}/m-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`materialize` of `df`, and its rows, counted as they are written."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return table, seen.get.get("n") or 0


def remove(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    home = f"/{spark.sparkContext.applicationId}/m-"
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if home in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()
