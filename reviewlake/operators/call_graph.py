"""Call graph by bare function name, per repository."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

MAX_CALLERS = 5  # fixed values: names listed per block
MAX_CALLEES = 10


def latest_calls(calls: DataFrame, order: tuple[str, ...] = ("path", "ord")) -> DataFrame:
    """One row per function name: callees of its last definition, `first` = place of its first.

    `order` places definitions within a repo. Both aggregates combine before the shuffle.
    """
    place = F.struct(*order)
    return calls.groupBy("repo", "caller").agg(
        F.max_by("callees", place).alias("callees"), F.min(place).alias("first"))


def callers(graph: DataFrame, k: int = MAX_CALLERS) -> DataFrame:
    """First `k` functions, by place, whose callees contain a name: (repo, name, callers).

    A name like `get` may be called from a third of all functions. The rank filter is applied
    in each task before the shuffle, so no more than k rows per name and task are moved.
    """
    edges = graph.select(
        "repo", "caller", "first", F.explode(F.array_distinct("callees")).alias("name"))
    rank = F.row_number().over(W.partitionBy("repo", "name").orderBy("first"))
    kept = edges.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    listed = F.sort_array(F.collect_list(F.struct("_rank", "caller")))
    return kept.groupBy("repo", "name").agg(
        F.transform(listed, lambda e: e["caller"]).alias("callers"))


def callees(graph: DataFrame, k: int = MAX_CALLEES) -> DataFrame:
    """First `k` callees, repeats kept: (repo, name, callees)."""
    return graph.select(
        "repo", F.col("caller").alias("name"), F.slice("callees", 1, k).alias("callees"))


def call_context(graph: DataFrame) -> DataFrame:
    """(repo, name, callers, callees) for every name that is a function of the graph."""
    return callees(graph).join(callers(graph), ["repo", "name"], "left").select(
        "repo", "name", _listed("callers"), _listed("callees"))


def _listed(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>")).alias(name)


def with_call_context(blocks: DataFrame, graph: DataFrame) -> DataFrame:
    """Blocks with `callers` and `callees`; both NULL where the name is no function.

    Many blocks may share a name. The context is written first, so that the join reads it
    through a shuffle of its own: only then can adaptive execution split a hot name (or, by its
    known size, broadcast the context instead).
    """
    context = materialize(call_context(graph), "context")
    return blocks.join(context, ["repo", "name"], "left")
