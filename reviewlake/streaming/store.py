"""A table of reviewed batches that a stream commits epoch by epoch.

    stream.writeStream.format("review_store").option("checkpointLocation", ...).start(path)

Tasks write Parquet files under `data/`, each under a name of its own. The driver commits an epoch by
one file, `epochs/<epoch>.json`, that names the epoch's files; it takes its name in one step, and
files that no epoch names are not part of the table. An epoch that is replayed after a
failure replaces the files it had before, so a batch lies in the files once. A batch that another
epoch brings again (a stream started anew) is the latest epoch's.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from ..schemas import REVIEWED
from ..sinks.files import delete_file, names, place, read_entry, write_entry

FORMAT = "review_store"


@dataclass
class Written(WriterCommitMessage):
    """The file of a task, if it had rows, and how many batches in it have a report."""
    file: str | None
    rows: int
    done: int


class ReviewStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return REVIEWED

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return StoreWriter(self.options["path"])


class StoreWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = place(self.path)
        name, writer, rows, done = None, None, 0, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                name = f"{uuid.uuid4().hex}.parquet"
                files.create_dir(f"{folder}/data", recursive=True)
                writer = pq.ParquetWriter(f"{folder}/data/{name}", batch.schema, filesystem=files)
            writer.write_batch(batch)
            rows += batch.num_rows
            done += batch.column("error").null_count
        if writer:
            writer.close()
        return Written(name, rows, done)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        files, folder = place(self.path)
        written = [m for m in messages if m is not None and m.file]
        entry = {"epoch": batchId, "files": [m.file for m in written],
                 "rows": sum(m.rows for m in written), "done": sum(m.done for m in written)}
        before = read_entry(files, f"{folder}/epochs/{batchId}.json")
        write_entry(files, f"{folder}/epochs/{batchId}.json", entry)
        for name in before.get("files", ()):
            delete_file(files, f"{folder}/data/{name}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        files, folder = place(self.path)
        for m in messages:
            if m is not None and m.file:
                delete_file(files, f"{folder}/data/{m.file}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReviewStore)


def epochs(path: str) -> list[dict]:
    """What has been committed: epoch, files, rows, done. One small entry per epoch."""
    files, folder = place(path)
    found = [read_entry(files, f"{folder}/epochs/{n}") for n in names(files, f"{folder}/epochs")]
    return sorted(found, key=lambda e: e["epoch"])


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """(repo, batch_id, report, error, epoch) of all rows that committed epochs hold."""
    named = [(name, e["epoch"]) for e in epochs(path) for name in e["files"]]
    if not named:
        return spark.createDataFrame([], REVIEWED).withColumn("epoch", F.lit(0).cast("long"))
    of = spark.createDataFrame(named, "_file string, epoch long")
    rows = spark.read.schema(REVIEWED).parquet(*[f"{path}/data/{name}" for name, _ in named])
    return rows.select("*", F.col("_metadata.file_name").alias("_file")).join(of, "_file").drop(
        "_file")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(repo, batch_id, report, error): for each batch the row of its latest epoch."""
    last = F.max_by(F.struct("report", "error"), "epoch").alias("_last")
    return read_rows(spark, path).groupBy("repo", "batch_id").agg(last).select(
        "repo", "batch_id", "_last.*")


def sweep(path: str) -> int:
    """Delete the files of attempts that were never committed; no stream may be writing."""
    files, folder = place(path)
    kept = {name for e in epochs(path) for name in e["files"]}
    gone = [n for n in names(files, f"{folder}/data") if n not in kept]
    for name in gone:
        delete_file(files, f"{folder}/data/{name}")
    return len(gone)
