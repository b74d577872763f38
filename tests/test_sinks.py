"""Sinks that fail, streams that stop after a number of events, and state that can be read."""

from __future__ import annotations

import pytest
from telemetry_rows import rows
from pyspark.sql import functions as F

from roundcast.streaming import jobs

SCHEMA = "sequence long, kind string"


def land(spark, path, numbers):
    spark.createDataFrame([(i, "ab"[i % 2]) for i in numbers], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return jobs.read_table_stream(spark, path, "*.parquet")


def test_a_failing_sink_stops_no_other(spark, tmp_path):
    events = land(spark, str(tmp_path / "in"), range(40))
    tries = {"shaky": 0, "broken": 0}

    def writer(name, until):
        store = jobs.write_updates(str(tmp_path / name), "0")

        def write(batch, batch_id):
            tries[name] = tries.get(name, 0) + 1
            if tries[name] <= until:
                raise OSError(f"{name} is down")
            store(batch, batch_id)

        return write

    plan = {"sound": 0, "shaky": 1, "broken": 99}
    sinks = {name: (writer(name, until), str(tmp_path / f"{name}-log")) for name, until in plan.items()}
    report = jobs.run_isolated(events, sinks, restarts=2)
    assert {k: v[:2] for k, v in report.items()} == {"sound": ("complete", 0), "shaky": ("complete", 1), "broken": ("failed", 2)}
    assert "broken is down" in report["broken"][2]
    for name in ("sound", "shaky"):
        assert spark.read.parquet(str(tmp_path / name)).count() == 40
    assert tries["broken"] == 3


@pytest.mark.parametrize("n", [0, 7, 30, 45, 60, 99])
def test_exactly_n_events_across_batches_and_restarts(spark, tmp_path, n):
    source, path, log = (str(tmp_path / name) for name in ("in", "out", "log"))
    for part in (range(30, 60), range(30)):
        jobs.take_first(land(spark, source, part), n, path, log, ["sequence"])
    got = [r["sequence"] for r in rows(spark.read.parquet(path), "sequence")]
    assert got == sorted([*range(30, 60), *range(30)][:n])


def test_a_batch_tried_again_takes_the_same_events(spark, tmp_path):
    batches = [spark.range(k, k + 10).withColumnRenamed("id", "sequence") for k in (0, 10)]
    write = jobs.write_first(str(tmp_path / "out"), 14, ["sequence"], "0")
    for batch_id in (0, 0, 1, 1):
        write(batches[batch_id], batch_id)
    held = spark.read.parquet(str(tmp_path / "out"))
    assert [r["sequence"] for r in rows(held.select("sequence"), "sequence")] == list(range(14))
    with pytest.raises(ValueError):
        jobs.write_first("x", -1, ["sequence"], "0")
