"""Review of batches as they arrive, resumable."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.review import Reviewer, pending, review_batches
from ..schemas import PROMPTS, REVIEWED
from .progress import watched
from .store import FORMAT, register

FILES_PER_RUN = 256


def read_reviewed(spark: SparkSession, out: str) -> DataFrame:
    """The outcome of each batch so far: its report if there is one, else an error."""
    rows = spark.read.schema(REVIEWED).parquet(f"{out}/run=*")
    best = F.max_by(F.struct("report", "error"), F.col("error").isNull()).alias("_best")
    return rows.groupBy("repo", "batch_id").agg(best).select("repo", "batch_id", "_best.*")


def review_stream(spark: SparkSession, prompts: str, out: str, checkpoint: str,
                  reviewer: Reviewer, files_per_run: int = FILES_PER_RUN,
                  **options) -> StreamingQuery:
    """Review every batch file in `prompts` not seen yet, then stop.

    A backlog is taken in micro-batches of `files_per_run` files, each of them a point to
    resume from. Each micro-batch overwrites its own `run=<id>` folder, so a micro-batch that is replayed
    after a failure leaves no doubles. A second run finds nothing to do.
    """

    def write(frame: DataFrame, run: int) -> None:
        review_batches(frame, reviewer, **options).write.mode("overwrite").parquet(
            f"{out}/run={run}")

    stream = spark.readStream.schema(PROMPTS).option(
        "maxFilesPerTrigger", files_per_run).parquet(prompts)
    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def store_stream(spark: SparkSession, prompts: str, store: str, checkpoint: str,
                 reviewer: Reviewer, files_per_run: int = FILES_PER_RUN,
                 **options) -> StreamingQuery:
    """The same into a review store, which commits each micro-batch as an epoch."""
    register(spark)
    stream = spark.readStream.schema(PROMPTS).option(
        "maxFilesPerTrigger", files_per_run).parquet(prompts)
    return (
        watched(review_batches(stream, reviewer, **options)).writeStream.format(FORMAT)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(store)
    )


def retry_failed(spark: SparkSession, prompts: str, out: str, reviewer: Reviewer,
                 **options) -> None:
    """Review again what has no report yet, into a run folder of its own."""
    waiting = pending(spark.read.schema(PROMPTS).parquet(prompts), read_reviewed(spark, out))
    review_batches(waiting, reviewer, **options).write.parquet(f"{out}/run=retry-{uuid4().hex}")


def observe_progress(reviewed: DataFrame, observation) -> DataFrame:
    """Count done and failed batches while `reviewed` is being written."""
    return reviewed.observe(
        observation,
        F.count_if(F.col("error").isNull()).alias("done"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
