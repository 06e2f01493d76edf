"""Files of many repositories in one Parquet table, the entry that scales."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FILES

BUCKETS = 256
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
LOOKUP = 1000  # names in one filter

_STORED = T.StructType([*FILES.fields, T.StructField("buckets", T.IntegerType()),
                        T.StructField("bucket", T.IntegerType())])


def _bucket(repo: Column) -> Column:
    return F.pmod(F.xxhash64(repo), F.col("buckets")).cast("int")


def write_corpus(files: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "append") -> None:
    """Write files(repo, path, content) in folders by hash of the repo, below one for the number
    of buckets, so that readers need not know it.

    A folder per repo would mean millions of folders. Rows are range partitioned and sorted by
    (bucket, repo, path): a large repo spans many files, and the row groups of a file cover few
    repos, so a filter on repo skips the others.
    """
    placed = files.select("repo", "path", "content").withColumn(
        "buckets", F.lit(buckets)).withColumn("bucket", _bucket(F.col("repo")))
    keys = ["bucket", "repo", "path"]
    (placed.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode)
     .option("parquet.bloom.filter.enabled#path", "true")
     .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
     .partitionBy("buckets", "bucket").parquet(path))


def read_corpus(spark: SparkSession, path: str,
                repos: Sequence[str] | None = None) -> DataFrame:
    """files(repo, path, content); of `repos` only, if given, reading only their folders."""
    stored = spark.read.schema(_STORED).parquet(path)
    if repos is not None:
        folder = reduce(or_, [F.col("bucket") == _bucket(F.lit(r)) for r in repos], F.lit(False))
        stored = stored.filter(folder & F.col("repo").isin(*repos))
    return stored.drop("buckets", "bucket")


def read_files(path: str, wanted: DataFrame) -> DataFrame:
    """files(repo, path, content) of the rows of `wanted` (repo, path).

    A few names (LOOKUP) go to the scan as a filter: their buckets, and of these only
    the row groups and pages whose statistics and Bloom filters may hold them. More names meet the
    corpus in a join.
    """
    spark = wanted.sparkSession
    named = wanted.select("repo", "path").distinct()
    few = named.limit(LOOKUP + 1).collect()
    stored = read_corpus(spark, path, sorted({r.repo for r in few if r.repo is not None})
                         if len(few) <= LOOKUP else None)
    if len(few) <= LOOKUP:
        stored = stored.filter(F.col("path").isin(*{r.path for r in few}))
    return stored.join(named, ["repo", "path"], "left_semi")
