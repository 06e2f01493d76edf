"""Running health against the batch rule, for any split of the input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import health as ho
from reviewlake.streaming import health as rh

FINDINGS = ("repo string, file_path string, function_name string, line_number int, "
            "severity string, confidence_score int")


def inputs(seed):
    rng = random.Random(seed)
    found = [(rng.choice("abcc"), "f.py", f"g{rng.randrange(6)}", 1,
              rng.choice(["Critical", "High", "Medium", "Low"]), rng.randrange(101))
             for _ in range(60)]
    times = rng.sample(range(1000), 80)
    ruled = [(rng.choice("abcd"), f"f.py_g{rng.randrange(7)}_1",
              rng.choice(["false_positive", "false_positive", "confirmed"]), t) for t in times]
    return found, ruled


@pytest.mark.parametrize("seed,files,per_batch", [(1, 1, 1), (1, 6, 1), (2, 9, 2)])
def test_any_split_gives_the_batch_result(spark, tmp_path, seed, files, per_batch):
    found, ruled = inputs(seed)
    found = spark.createDataFrame(found, FINDINGS)
    ruled = spark.createDataFrame(ruled, "repo string, finding_key string, verdict string, ts int")
    events = rh.finding_events(found).unionByName(rh.verdict_events(ruled, "ts"))
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    events.withColumn("_r", F.rand(seed)).repartition(files, "_r").drop("_r").write.parquet(source)
    stream = spark.readStream.schema(rh.EVENTS).option("maxFilesPerTrigger", per_batch).parquet(source)
    for _ in range(2):  # the second run finds nothing to do
        rh.health_stream(spark, stream, out, str(tmp_path / "check"), slices=3).awaitTermination()
    wanted = {tuple(r) for r in ho.health(found, ho.latest_feedback(ruled)).collect()}
    got = {tuple(r) for r in rh.running_health(spark, out).collect()}
    # a repo that has verdicts only is known to the stream alone
    assert {g for g in got if g[0] != "d"} == wanted


def test_state_is_kept_by_key_in_slices_without_python(spark, tmp_path):
    rows = [("r", "k1", 700, None, None), ("r", "k2", 100, None, None),
            ("r", "k1", None, "false_positive", 5), ("r", "k1", None, "confirmed", 4),
            ("r", "k2", None, "confirmed", 9), ("r", "k2", None, "false_positive", 3)]
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.createDataFrame(rows, rh.EVENTS).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rh.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    run = rh.health_stream(spark, stream, out, str(tmp_path / "check"), slices=3)
    run.awaitTermination()
    state = run.lastProgress["stateOperators"][0]
    assert (state["operatorName"], state["numShufflePartitions"]) == ("stateStoreSave", 3)
    assert state["numRowsTotal"] == 2
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert [tuple(r)[:2] for r in rh.running_health(spark, out).collect()] == [("r", 99)]
