"""Health of repositories while findings and verdicts arrive.

State is kept per finding key, by Spark's own aggregation, in slices by a hash of repository and key, so
that a repository with very many findings spans tasks: the sum of a key's penalties, the time of its
latest verdict and of its latest dismissal. Findings and verdicts come in one stream, in any order
and any number of micro-batches; a verdict that dismisses a key takes its penalty back, a later
one that confirms it puts it on again, and of two at the same time the dismissal holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.findings import finding_key
from ..operators.health import penalty_hundredths, score_columns

SLICES = 16
EVENTS = "repo string, finding_key string, penalty long, verdict string, at long"
_KEYS = "repo string, finding_key string, penalty long"
_PARTITIONS = "spark.sql.shuffle.partitions"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def finding_events(findings: DataFrame) -> DataFrame:
    """EVENTS of findings: their penalty under their key."""
    return findings.select("repo", finding_key().alias("finding_key"),
                           penalty_hundredths().alias("penalty"),
                           F.lit(None).cast("string").alias("verdict"),
                           F.lit(None).cast("long").alias("at"))


def verdict_events(feedback: DataFrame, at: str) -> DataFrame:
    """EVENTS of verdicts; of a key's verdicts that with the largest `at` holds."""
    return feedback.select("repo", "finding_key", F.lit(None).cast("long").alias("penalty"),
                           "verdict", F.col(at).cast("long").alias("at"))


def health_stream(spark: SparkSession, events: DataFrame, out: str, checkpoint: str,
                  slices: int = SLICES) -> StreamingQuery:
    """Keep what counts of each finding key of a stream of EVENTS under `out`, until what is there
    is read.

    Each micro-batch writes the keys it changed into a folder of its own, so there are never
    more rows than events. The number of slices has to stay the same for a checkpoint.
    """
    last = F.max("at")
    dismissed = F.max(F.when(F.col("verdict") == "false_positive", F.col("at")))
    counted = F.when(dismissed == last, F.lit(0)).otherwise(
        F.coalesce(F.sum("penalty"), F.lit(0))).cast("long")
    keys = events.groupBy("repo", "finding_key").agg(counted.alias("penalty"))

    def write(frame: DataFrame, epoch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream = (keys.writeStream.foreachBatch(write).outputMode("update")
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    settings = {_PROVIDER: _ROCKS, _PARTITIONS: str(slices)}
    before = {name: spark.conf.get(name) for name in settings}
    try:  # a stream keeps the settings it was started with
        for name, value in settings.items():
            spark.conf.set(name, value)
        return stream.start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def running_health(spark: SparkSession, out: str, grade_on: str = "raw") -> DataFrame:
    """(repo, score, grade, color) as of the last micro-batch."""
    rows = spark.read.schema(f"{_KEYS}, epoch long").parquet(out)
    latest = rows.groupBy("repo", "finding_key").agg(F.max_by("penalty", "epoch").alias("penalty"))
    return latest.groupBy("repo").agg(F.sum("penalty").alias("penalty")).select(
        "repo", *score_columns(F.col("penalty"), grade_on))
