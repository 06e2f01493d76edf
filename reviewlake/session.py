"""Where intermediate tables go.

Some operators need a result that two later jobs must see identically (for example a range
partitioning). They write it once as Parquet under the session's `spark.checkpoint.dir` and
read it back, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session; an own one only if all executors are in this process."""
    named = spark.conf.get(_KEY, None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError(f"set {_KEY} to a folder every executor can reach")
    return _own_dir(spark.sparkContext.applicationId)


@cache
def _own_dir(application: str) -> str:
    """A temporary folder of a local session, deleted when the process ends."""
    folder = tempfile.TemporaryDirectory(prefix="reviewlake-", ignore_cleanup_errors=True)
    atexit.register(folder.cleanup)
    return folder.name


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a table in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
