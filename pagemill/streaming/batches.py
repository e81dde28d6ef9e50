"""Page batches as micro-batches, and recognition outcomes merged as they come."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from pagemill.operators.projection import grid_pages
from pagemill.runtime import ship_code


def read_pages(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    """Item files of a folder as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def by_batch(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Runs a stage on every micro-batch and writes its rows once: a batch that is run again replaces its own folder.

    Stages that look at several pages see those of one batch only, as a page-batch session does.
    """

    def write(df: DataFrame, epoch: int) -> None:
        stage(df).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_outcomes(outcomes: DataFrame) -> DataFrame:
    """Running failure state of each document from a stream (doc_id, seq, error, sparse): (doc_id, tasks, failed, fatal, message).

    The state has four values whatever the number of outcomes; the message is that of the least seq.
    """
    ship_code(outcomes.sparkSession)

    def update(key, parts, state):
        tasks, failed, sparse, first, message = state.get if state.exists else (0, 0, False, -1, "")
        for pdf in parts:
            tasks += len(pdf)
            bad = pdf[pdf["error"].notna()].sort_values("seq")
            if len(bad):
                failed += len(bad)
                sparse = bool(sparse or bad["sparse"].fillna(False).any())
                if first < 0 or int(bad["seq"].iloc[0]) < first:
                    first, message = int(bad["seq"].iloc[0]), str(bad["error"].iloc[0])
        state.update((tasks, failed, sparse, first, message))
        fatal = failed == tasks and sparse
        yield pd.DataFrame({"doc_id": [key[0]], "tasks": [tasks], "failed": [failed], "fatal": [fatal], "message": [message if fatal else None]})

    return outcomes.groupBy("doc_id").applyInPandasWithState(
        update, "doc_id long, tasks long, failed long, fatal boolean, message string", "tasks long, failed long, sparse boolean, first long, message string", "update", GroupStateTimeout.NoTimeout
    )


def pages_by_window(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Pages delivered in each window of event time, rows later than `late` left out."""
    return events.withWatermark("delivered_at", late).groupBy(F.window("delivered_at", f"{minutes} minutes"), "snap").agg(F.count("*").alias("pages"))


def page_previews(stream: DataFrame, callback: Callable[[dict], None], checkpoint: str):
    """Calls a function with the text grid of every page of each micro-batch, on the executors, as soon as the batch is there.

    A batch that is run again calls again: the callback must bear that.
    """

    def show(df: DataFrame, epoch: int) -> None:
        grid_pages(df).foreach(lambda r: callback(r.asDict()))

    return stream.writeStream.foreachBatch(show).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
