"""Verdicts on findings as a table that is updated: last write wins.

Updates are appended, a folder `log/batch=<name>` per batch; a batch written again replaces itself. What
holds is merged when it is read: the snapshot and the batches it does not hold yet. Compaction
writes that as the next snapshot, sorted by key, one row a key. `current.json` names the
snapshot and its batches and is replaced in one step, so readers see either the old state or the new.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import names, place, read_entry, write_entry

KEY = ("repo", "finding_key")
_BATCH = "batch="


def append_feedback(feedback: DataFrame, path: str, batch: str,
                    order: Sequence[str] = ("ts",)) -> None:
    """Add verdicts (repo, finding_key, verdict and `order`) under the name of their batch.

    A batch that a snapshot holds already can't be changed any more: a ValueError.
    """
    files, folder = place(path)
    if batch in read_entry(files, f"{folder}/current.json").get("batches", ()):
        raise ValueError(f"batch {batch} is in the snapshot")
    feedback.select(*KEY, "verdict", *order).write.mode("overwrite").parquet(
        f"{path}/log/{_BATCH}{batch}")


def _state(path: str) -> tuple[str | None, list[str], list[str]]:
    """Snapshot, batches it holds, batches it does not hold."""
    files, folder = place(path)
    current = read_entry(files, f"{folder}/current.json")
    held = current.get("batches", [])
    waiting = [n.removeprefix(_BATCH) for n in names(files, f"{folder}/log")]
    return current.get("snapshot"), held, [b for b in waiting if b not in set(held)]


def _merged(spark: SparkSession, path: str, order: Sequence[str]) -> DataFrame | None:
    snapshot, _, waiting = _state(path)
    rows = [spark.read.parquet(f"{path}/{snapshot}")] if snapshot else []
    if waiting:
        log = spark.read.parquet(*[f"{path}/log/{_BATCH}{b}" for b in waiting])
        log = log.select(*KEY, "verdict", *order)
        both = rows[0].unionByName(log) if rows else log
        last = F.max_by(F.struct("verdict", *order), F.struct(*order)).alias("_last")
        return both.groupBy(*KEY).agg(last).select(*KEY, "_last.*")
    return rows[0] if rows else None


def read_feedback(spark: SparkSession, path: str, order: Sequence[str] = ("ts",)) -> DataFrame:
    """(repo, finding_key, verdict): the last verdict of every key, by `order`."""
    found = _merged(spark, path, order)
    if found is None:
        return spark.createDataFrame([], "repo string, finding_key string, verdict string")
    return found.select(*KEY, "verdict")


def compact(spark: SparkSession, path: str, order: Sequence[str] = ("ts",)) -> None:
    """Fold all batches written so far into the next snapshot; folded files go after that.

    One compaction at a time; batches may be appended meanwhile and are folded by the next one.
    """
    before, held, waiting = _state(path)
    if not waiting:
        return
    snapshot = f"snapshots/{uuid.uuid4().hex}"
    _merged(spark, path, order).repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.parquet(
        f"{path}/{snapshot}")
    files, folder = place(path)
    write_entry(files, f"{folder}/current.json", {"snapshot": snapshot, "batches": held + waiting})
    for gone in [f"log/{_BATCH}{b}" for b in waiting] + ([before] if before else []):
        files.delete_dir(f"{folder}/{gone}")
