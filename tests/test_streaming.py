"""The review store's commits and the progress that a listener collects."""

from __future__ import annotations

import json
import os
import shutil
import sys
from collections import Counter

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from reviewlake.schemas import PROMPTS, REVIEWED
from reviewlake.streaming import store as st
from reviewlake.streaming.progress import ProgressListener, repo_progress
from reviewlake.streaming.reviews import store_stream

N = 60
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "prompts")
    spark.range(N).select(
        F.concat(F.lit("r"), F.col("id") % 3).alias("repo"), F.col("id").alias("batch_id"),
        F.lit("p").alias("prompt")).repartition(6, "batch_id").write.parquet(path)
    return path


def reviewer(repo, batch_id, prompt):
    if batch_id % 10 == 4:
        raise ValueError("no")
    return {"reviews": [], "batch_summary": f"{batch_id}"}


def keys(spark, path):
    return Counter((r.repo, r.batch_id) for r in st.read_rows(spark, path).collect())


EVERY = Counter({(f"r{i % 3}", i): 1 for i in range(N)})


def run(spark, source, path, check, n=2):
    query = store_stream(spark, source, path, check, reviewer, files_per_run=n)
    query.awaitTermination()
    return query


def test_epochs_and_resuming(spark, source, tmp_path):
    path, check = str(tmp_path / "store"), str(tmp_path / "check")
    run(spark, source, path, check)
    assert keys(spark, path) == EVERY
    told = st.epochs(path)
    assert [e["epoch"] for e in told] == [0, 1, 2]
    assert sum(e["rows"] for e in told) == N and sum(e["done"] for e in told) == N - N // 10
    run(spark, source, path, check)  # nothing new
    assert st.epochs(path) == told
    rows = st.read_store(spark, path).collect()
    assert len(rows) == N
    for r in rows:
        assert r.error == ("ValueError: no" if r.batch_id % 10 == 4 else None)
        assert r.error or json.loads(r.report)["batch_summary"] == str(r.batch_id)


def test_a_replayed_epoch_leaves_each_key_once(spark, source, tmp_path):
    """Killed after the store's commit and before the stream's: the epoch comes again."""
    path, check = str(tmp_path / "store"), str(tmp_path / "check")
    run(spark, source, path, check)
    before = st.epochs(path)
    os.remove(f"{check}/commits/2")
    for crc in (f"{check}/commits/.2.crc",):
        if os.path.exists(crc):
            os.remove(crc)
    run(spark, source, path, check)
    after = st.epochs(path)
    assert after[:2] == before[:2] and after[2]["files"] != before[2]["files"]
    assert keys(spark, path) == EVERY
    named = {f for e in after for f in e["files"]}
    assert set(os.listdir(f"{path}/data")) == named  # the first attempt's files are gone


def test_files_of_a_killed_attempt_are_no_part(spark, source, tmp_path):
    """Killed before the store's commit: files lie there that no epoch names."""
    path, check = str(tmp_path / "store"), str(tmp_path / "check")
    run(spark, source, path, check)
    some = st.epochs(path)[0]["files"][0]
    shutil.copy(f"{path}/data/{some}", f"{path}/data/lost.parquet")
    assert keys(spark, path) == EVERY
    assert st.sweep(path) == 1 and st.sweep(path) == 0
    assert keys(spark, path) == EVERY


def test_a_stream_started_anew_replaces_batches(spark, source, tmp_path):
    path = str(tmp_path / "store")
    run(spark, source, path, str(tmp_path / "one"))
    run(spark, source, path, str(tmp_path / "two"), n=6)  # other epochs, the same batches
    assert sorted((r.repo, r.batch_id) for r in st.read_store(spark, path).collect()) == sorted(EVERY)


def test_commit_and_abort(tmp_path):
    path = str(tmp_path / "s")
    writer = st.StoreWriter(f"file:{path}")
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["r", "r"]), pa.array([1, 2]), pa.array(["{}", None]), pa.array([None, "e"])],
        names=REVIEWED.fieldNames())
    one = writer.write(iter([batch, batch.slice(0, 0)]))
    none = writer.write(iter([]))
    assert (one.rows, one.done) == (2, 1) and none.file is None
    assert st.epochs(path) == []
    writer.commit([one, none, None], 7)
    assert [(e["epoch"], e["files"], e["rows"]) for e in st.epochs(path)] == [(7, [one.file], 2)]
    two = writer.write(iter([batch]))
    writer.abort([two, None], 8)
    assert os.listdir(f"{path}/data") == [one.file]
    assert [e["epoch"] for e in st.epochs(path)] == [7]


def test_a_listener_fills_the_progress_table(spark, source, tmp_path):
    path = str(tmp_path / "store")
    with ProgressListener(spark) as listener:
        query = run(spark, source, path, str(tmp_path / "check"), n=1)
        assert listener.wait(query)
    rows = listener.table().orderBy("epoch").collect()
    assert [r.epoch for r in rows] == list(range(6)) and len({r.run for r in rows}) == 1
    assert [(r.rows, r.done) for r in rows] == [(e["rows"], e["done"]) for e in st.epochs(path)]
    assert sum(r.failed for r in rows) == N // 10
    per_repo = repo_progress(spark, path, listener.table()).collect()
    assert sum(r.done for r in per_repo) == N - N // 10
    assert {r.repo for r in per_repo} == {"r0", "r1", "r2"} and len(per_repo) > 6
    first = listener.table().where("epoch < 2")
    assert {r.epoch for r in repo_progress(spark, path, first).collect()} == {0, 1}


def test_no_prompts(spark, tmp_path):
    spark.createDataFrame([], PROMPTS).write.parquet(str(tmp_path / "none"))
    run(spark, str(tmp_path / "none"), str(tmp_path / "store"), str(tmp_path / "check"))
    assert st.read_store(spark, str(tmp_path / "store")).count() == 0
