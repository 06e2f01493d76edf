"""A feedback table against the last write of every key."""

from __future__ import annotations

import os
import random

import pytest

from reviewlake.sinks import feedback as fb

SCHEMA = "repo string, finding_key string, verdict string, ts int"


def batches(seed, n=5):
    rng = random.Random(seed)
    at = rng.sample(range(100_000), 40 * n)  # writes come in any order
    return [[(rng.choice("abc"), f"k{rng.randrange(12)}", rng.choice(["x", "y", None]), at.pop())
             for _ in range(40)] for _ in range(n)]


def last(rows):
    out = {}
    for repo, key, verdict, ts in sorted(rows, key=lambda r: r[3]):
        out[repo, key] = verdict
    return out


def table(spark, path):
    rows = fb.read_feedback(spark, path).collect()
    assert len(rows) == len({(r.repo, r.finding_key) for r in rows})
    return {(r.repo, r.finding_key): r.verdict for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_reads_and_compactions_agree(spark, tmp_path, seed):
    path, seen = f"file:{tmp_path}/t", []
    assert table(spark, path) == {}
    fb.compact(spark, path)
    for i, rows in enumerate(batches(seed)):
        seen += rows
        for _ in range(2):  # a batch written again counts once
            fb.append_feedback(spark.createDataFrame(rows, SCHEMA), path, f"{i}")
        assert table(spark, path) == last(seen)
        if i in (1, 3):
            fb.compact(spark, path)
            assert table(spark, path) == last(seen)
            assert os.listdir(f"{tmp_path}/t/log") == [] or not any(
                n.startswith("batch=") for n in os.listdir(f"{tmp_path}/t/log"))
            assert len(os.listdir(f"{tmp_path}/t/snapshots")) == 1
    with pytest.raises(ValueError):
        fb.append_feedback(spark.createDataFrame(rows, SCHEMA), path, "0")


def test_a_compaction_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "t"), []
    for i, rows in enumerate(batches(3, 2)):
        seen += rows
        fb.append_feedback(spark.createDataFrame(rows, SCHEMA), path, f"{i}")

    def die(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(fb, "write_entry", die)
        with pytest.raises(OSError):
            fb.compact(spark, path)
    assert table(spark, path) == last(seen)
    fb.compact(spark, path)
    assert table(spark, path) == last(seen)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names
               if f.endswith(".parquet"))


def test_fewer_bytes_are_read_after_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(6):
        fb.append_feedback(spark.range(5000).selectExpr(
            "'r' AS repo", "concat('k', id % 50) AS finding_key", "concat('v', id) AS verdict",
            f"CAST(id + {i * 5000} AS INT) AS ts"), path, f"{i}")
    before = size(path)
    fb.compact(spark, path)
    assert size(path) < before / 20
    assert len(table(spark, path)) == 50
    plan = fb.read_feedback(spark, path)._jdf.queryExecution().toString()
    assert "Aggregate" not in plan  # nothing is left to merge
