"""Running positions inside groups of any size.

A plain window over one group would sort that whole group in one task, and one repository may
hold a third of all rows. Here rows are range partitioned by (group, order), so a large group
spans many tasks. Each task sums its own slice; a table of one row per (group, slice) turns
the slice sums into slice starts.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize


def running_offset(df: DataFrame, group: list[str], order: list[str], size: str,
                   name: str) -> DataFrame:
    """Exclusive running sum of `size` along `order` within each group.

    `order` must be unique within a group. Returns group and order columns plus `name`. The
    partitioned rows are written once, because slice starts and rows must agree on the slices.
    """
    keys = [*group, *order]
    cut = materialize(
        df.select(*keys, F.col(size).cast("long").alias("_size"))
        .repartitionByRange(*keys)
        .withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    before = (W.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*group, "_slice").agg(F.sum("_size").alias("_total"))
        .withColumn("_start", _sum_before(
            "_total", W.partitionBy(*group).orderBy("_slice").rowsBetween(*before)))
        .drop("_total")
    )
    inside = _sum_before(
        "_size", W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(*before))
    return (
        cut.withColumn("_inside", inside)
        .join(starts, [*group, "_slice"])
        .select(*keys, (F.col("_start") + F.col("_inside")).alias(name))
    )


def _sum_before(col: str, window) -> Column:
    return F.coalesce(F.sum(col).over(window), F.lit(0))


def number_rows(df: DataFrame, group: list[str], unit: list[str], within: str,
                name: str) -> DataFrame:
    """0-based position of every row along (unit, within) in its group.

    A unit (a file, a batch) is a piece of the group of bounded size. Only one row per unit
    takes part in the running sum; the wide rows move once, by (group, unit).
    """
    keys = [*group, *unit]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    offsets = running_offset(sizes, group, unit, "_n", "_offset")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(within)) - 1
    return (
        df.withColumn("_rank", rank)
        .join(offsets, keys)
        .withColumn(name, (F.col("_offset") + F.col("_rank")).cast("long"))
        .drop("_rank", "_offset")
    )
