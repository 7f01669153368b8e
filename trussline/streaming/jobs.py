"""The job queue as a stream of command lines, decoded, handled in batches, and counted.

Delivery is at least once by the checkpoint; `drain` handles what is there and ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode(messages: DataFrame, column: str = "message") -> DataFrame:
    """Adds command, teamspace, container and argument of `import -f`, `processDrawing`, `processClash`
    and `genStash` lines; others have command null."""
    t = F.split(F.trim(F.col(column)), r"\s+")
    word = F.get(t, F.lit(0))
    known = F.when(word.isin("import", "processDrawing", "processClash", "genStash"), word)
    named = word.isin("processClash", "genStash")
    argument = F.when(word == "import", F.get(t, F.lit(2))).when(word == "processDrawing", F.get(t, F.lit(1))).when(named, F.get(t, F.lit(3)))
    return messages.withColumns({"command": known, "teamspace": F.when(named, F.get(t, F.lit(1))), "container": F.when(named, F.get(t, F.lit(2))), "argument": argument})


def job_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    return decode(spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder), "value")


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs `handle` on every batch that is waiting, then ends; a failed batch is handed out again."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_stats(runs: DataFrame) -> DataFrame:
    """Peak memory and summed time of each run."""
    return runs.groupBy("rid").agg(F.max("memory").alias("max_memory"), F.sum("seconds").alias("process_seconds"), F.count("*").alias("samples"))


def latest_values(stream: DataFrame, state_column: str = "value") -> DataFrame:
    """Stream of (resource, value): the value of each resource after every batch, kept as keyed state."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ts, value = state.get if state.exists else (pd.Timestamp.min.value, None)
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "seq"])
            for row in pdf.itertuples():
                if row.ts.value >= ts:
                    ts, value = row.ts.value, (None if row.reset else getattr(row, state_column))
        state.update((ts, value))
        yield pd.DataFrame({"resource": [key[0]], "value": [value]})

    return stream.groupBy("resource").applyInPandasWithState(fold, "resource long, value double", "ts long, value double", "update", "NoTimeout")
