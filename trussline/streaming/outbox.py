"""Job handlers: batches of the queue in, status and result messages out, each job's result sent once.

A batch goes through `foreachBatch`: its jobs are announced as being processed, handled by the function of their command, and its results are
written to the outbox under the batch's number in one step.  The stream's checkpoint hands a failed batch out again with
the same number: a batch whose results are in the outbox is not handled again, one whose results are not is handled anew, and in either
case its announcements and results replace those of the attempt before.  Readers see results of finished batches alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .jobs import drain

#: Result codes of a job that went well, of one that a handler lost, and of a message that is no job.
OK, CRASHED, UNKNOWN = 0, 12, 16
PROCESSING = "processing"
#: What a command's messages are called.
TYPES = {"import": "import", "genStash": "import", "processDrawing": "drawing", "processClash": "clash"}
MESSAGE = "job string, kind string, type string, status string, value int, teamspace string, container string"

Handler = Callable[[DataFrame], DataFrame]


def _written(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _type() -> Column:
    return F.coalesce(*(F.when(F.col("command") == k, v) for k, v in TYPES.items()))


def handle(handlers: dict[str, Handler], outbox: str) -> Callable[[DataFrame, int], None]:
    """The function for `foreachBatch` over decoded jobs with a column job (their id).

    A handler takes the jobs of its command and returns (job, value); a job without a row in its result has crashed, and a
    command without a handler, or none at all, is unknown.  A job that stands in a batch twice has one result.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, done = batch.sparkSession, f"{outbox}/results/batch={number}"
        if _written(spark, done):
            return
        jobs = materialize(batch.dropDuplicates(["job"]))
        named = jobs.select("job", F.lit("status").alias("kind"), _type().alias("type"), F.lit(PROCESSING).alias("status"), F.lit(None).cast("int").alias("value"), "teamspace", "container")
        named.where("type is not null").write.mode("overwrite").parquet(f"{outbox}/status/batch={number}")
        values = [handler(jobs.where(F.col("command") == command)).select("job", "value") for command, handler in handlers.items()]
        found = spark.createDataFrame([], "job string, value int")
        for more in values:
            found = found.union(more.select(F.col("job").cast("string"), F.col("value").cast("int")))
        once = found.groupBy("job").agg(F.max("value").alias("_value"))
        missing = F.when(F.col("command").isin(*handlers), CRASHED).otherwise(UNKNOWN)
        results = jobs.join(once, "job", "left").select("job", F.lit("result").alias("kind"), _type().alias("type"), F.lit(None).cast("string").alias("status"), F.coalesce("_value", missing).alias("value"), "teamspace", "container")
        results.write.mode("overwrite").parquet(done)

    return run


def work(stream: DataFrame, handlers: dict[str, Handler], outbox: str, checkpoint: str) -> None:
    """Handles all batches that wait, then ends."""
    drain(stream, handle(handlers, outbox), checkpoint)


def _batches(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().toString() for f in fs.listStatus(p) if _written(spark, f.getPath().toString())] if fs.exists(p) else []


def messages(spark: SparkSession, outbox: str) -> DataFrame:
    """(job, kind, ..., batch): all that was announced, and the results of finished batches; of a job that was delivered in several batches the first
    batch's messages count."""
    found = spark.createDataFrame([], f"{MESSAGE}, batch long")
    for kind in ("status", "results"):
        if paths := _batches(spark, f"{outbox}/{kind}"):
            rows = spark.read.schema(MESSAGE).parquet(*paths).withColumn("batch", F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1).cast("long"))
            found = found.unionByName(rows)
    names = [c for c in found.columns if c not in ("job", "kind")]
    first = found.groupBy("job", "kind").agg(F.min_by(F.struct(*names), "batch").alias("m"))
    return first.select("job", "kind", "m.*")
