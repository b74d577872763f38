from __future__ import annotations

import json
import random

import pytest
from telemetry_rows import at, event, rows
from pyspark.sql import functions as F

from roundcast.operators import momentum as mo
from roundcast.streaming import jobs
from roundcast.streaming.processor import stream_momentum

SCHEMA = (
    "match_id string, sequence long, timestamp timestamp, event_type string, victim_team string, "
    "headshot boolean, round_number int"
)
NAMES = ("epoch", "kills_ct", "kills_t", "headshots", "ticks", "window_seconds")


@pytest.fixture()
def folder(spark, tmp_path):
    """Three files, read one per micro-batch, each with shuffled rows."""
    rng = random.Random(8)
    items, t = [], 0.0
    for seq in range(180):
        t += rng.choice([0.0, 0.5, 3.0])
        kind = rng.choices(["tick", "kill", "round_start", "round_end", "match_end"], [8, 4, 1, 1, 0.4])[0]
        items.append(
            (rng.choice("ab"), seq, at(t), kind, rng.choice(["CT", "T"]), rng.random() < 0.5, 1)
        )
    path = str(tmp_path / "in")
    for i in range(3):
        part = items[i * 60 : (i + 1) * 60]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path, spark.createDataFrame(items, SCHEMA)


def stream(spark, path):
    jobs.configure_state(spark)
    return jobs.read_table_stream(spark, path, "*.parquet", {"maxFilesPerTrigger": "1"})


def lives(items):
    """Round starts since the last match end, for every row in sequence order."""
    out, seen = {}, {}
    for r in sorted(items, key=lambda r: r["sequence"]):
        own = r["match_id"]
        if r["event_type"] == "match_end":
            seen[own] = 0
        elif r["event_type"] == "round_start":
            seen[own] = seen.get(own, 0) + 1
        out[own, r["sequence"]] = seen.get(own, 0)
    return out


def test_momentum_carries_over_batches_and_equals_the_batch_plan(spark, folder, tmp_path):
    path, batch = folder
    out = stream_momentum(stream(spark, path), span_seconds=5.0, keep=("round_number",))
    done = jobs.run_to_end(out, str(tmp_path / "out"), str(tmp_path / "log"))
    got = {(r["match_id"], r["sequence"]): tuple(r[c] for c in NAMES) for r in rows(spark.read.parquet(done))}
    life = lives(rows(batch))
    want = {
        (r["match_id"], r["sequence"]): (life[r["match_id"], r["sequence"]], *(r[c] for c in NAMES[1:]))
        for r in rows(mo.momentum(batch, span_seconds=5.0, segment_rows=13))
    }
    assert got == want


def test_a_batch_may_bring_a_match_no_tick(spark, tmp_path):
    """Its kills still count for the ticks of a later batch; text columns travel along."""
    path = str(tmp_path / "in")
    batches = [[("a", 1, at(1.0), "kill", "T", True, 1), ("b", 2, at(1.0), "tick", "CT", False, 1)], [("a", 3, at(2.0), "tick", "CT", False, 1)]]
    for items in batches:
        spark.createDataFrame(items, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    out = stream_momentum(stream(spark, path), span_seconds=5.0, keep=("victim_team", "round_number"))
    done = jobs.run_to_end(out, str(tmp_path / "out"), str(tmp_path / "log"), state_partitions=1)
    got = {(r["match_id"], r["sequence"], r["victim_team"], r["kills_ct"], r["headshots"]) for r in rows(spark.read.parquet(done))}
    assert got == {("a", 3, "CT", 1, 1), ("b", 2, "CT", 0, 0)}


def test_nothing_is_kept_of_finished_matches(spark, tmp_path):
    items = [
        (f"m{m}", i, at(float(i)), kind, "CT", False, 1)
        for m in range(20)
        for i, kind in enumerate(["round_start", "tick", "kill", "tick", "match_end"])
    ] + [("open", 1, at(1.0), "tick", "CT", False, 1)]
    path, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame(items, SCHEMA).coalesce(1).write.parquet(path)
    out = stream_momentum(stream(spark, path), span_seconds=5.0)
    jobs.run_to_end(out, str(tmp_path / "out"), log)
    for name in ("kills", "ticks", "marks"):
        held = spark.read.format("statestore").option("stateVarName", name).load(log)
        assert [r["key"]["match_id"] for r in rows(held)] == ["open"]


def test_a_later_arrival_wins_and_runs_do_not_replace_each_other(spark, tmp_path):
    path, kind = str(tmp_path / "table"), "match_id string, sequence long, v int"
    first, second = jobs.write_latest(path, ["match_id"], ["sequence"], ["sequence", "v"]), None
    first(spark.createDataFrame([("a", 9, 1), ("a", 3, 2), ("b", 1, 3)], kind), 0)
    first(spark.createDataFrame([("a", 4, 4)], kind), 1)
    got = {r["match_id"]: (r["sequence"], r["v"]) for r in rows(jobs.read_updates(spark, path, ["match_id"]))}
    assert got == {"a": (4, 4), "b": (1, 3)}
    second = jobs.write_latest(path, ["match_id"], ["sequence"], ["sequence", "v"])
    second(spark.createDataFrame([("b", 2, 5)], kind), 0)
    alive = F.col("v") > 3
    small = jobs.compact_updates(spark, path, str(tmp_path / "small"), ["match_id"], alive)
    for table in (jobs.read_updates(spark, path, ["match_id"], alive), jobs.read_updates(spark, small, ["match_id"])):
        assert {r["match_id"]: r["v"] for r in rows(table)} == {"a": 4, "b": 5}


def test_time_to_live_state_finishes_a_bounded_run(spark, folder, tmp_path):
    path, batch = folder
    out = stream_momentum(stream(spark, path), span_seconds=5.0, ttl_seconds=3600)
    done = jobs.run_to_end(out, str(tmp_path / "out"), str(tmp_path / "log"))
    assert spark.read.parquet(done).count() == batch.filter("event_type = 'tick'").count()


def test_latest_rows_and_routed_tables(spark, folder, tmp_path):
    path, batch = folder
    out = str(tmp_path / "latest")
    write = jobs.write_latest(out, ["match_id"], ["sequence"], ["sequence", "event_type"])
    jobs.run_batches(stream(spark, path), write, str(tmp_path / "log1"))
    got = rows(jobs.read_updates(spark, out, ["match_id"]), "match_id")
    # a batch is a file of 60 rows; the last one decides
    want = rows(batch.groupBy("match_id").agg(F.max("sequence").alias("sequence")), "match_id")
    assert [r["sequence"] for r in got] == [r["sequence"] for r in want]
    routes = {
        k: ((lambda kind: lambda df: df.filter(F.col("event_type") == kind))(k), str(tmp_path / k))
        for k in ("tick", "round_end")
    }
    jobs.run_batches(stream(spark, path), jobs.route_batch(routes), str(tmp_path / "log2"), "append")
    for kind in routes:
        held = spark.read.parquet(str(tmp_path / kind)).count()
        assert held == batch.filter(F.col("event_type") == kind).count()


def test_bad_payloads_do_not_stop_ingest(spark, tmp_path):
    texts = [json.dumps(event("kill", sequence=i)) for i in range(5)] + ["{oops", json.dumps(event("kill", weapon="x"))]
    path = str(tmp_path / "in")
    spark.createDataFrame([(t,) for t in texts], "value string").write.text(path)
    from roundcast.sources.events import read_payload_files

    good, bad = jobs.ingest(read_payload_files(spark, path, streaming=True))
    a = jobs.run_to_end(good.select("match_id", "sequence"), str(tmp_path / "a"), str(tmp_path / "la"))
    b = jobs.run_to_end(bad.select("value", "violations"), str(tmp_path / "b"), str(tmp_path / "lb"))
    assert (spark.read.parquet(a).count(), spark.read.parquet(b).count()) == (5, 2)


def test_served_feed_in_several_micro_batches(spark, tmp_path, monkeypatch):
    """A quarter of the feed that takes several micro-batches has the windows of the batch all the same."""
    from roundcast.functions.features import feature_frame
    from roundcast.operators.momentum import momentum
    from roundcast.plans import bindings as b
    from roundcast.plans import catalog
    from roundcast.streaming import jobs

    def h(salt, top):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(top))

    spark.range(2400).select(
        F.floor(F.col("id") / 3 * 2.5).cast("long").alias("l_orderkey"),
        (h(1, 5000)).alias("l_partkey"),
        (h(2, 2)).alias("l_suppkey"),
        (F.col("id") % 3 + 1 + 3 * (h(3, 2))).cast("int").alias("l_linenumber"),
        (h(4, 50) + 1).cast("double").alias("l_quantity"),
        (h(5, 10) / 100).alias("l_discount"),
        (h(6, 9) / 100).alias("l_tax"),
        F.when(h(7, 3) == 0, "R").when(h(7, 3) == 1, "A").otherwise("N").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("l_shipdate"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(jobs, "FILES_PER_BATCH", 1)
    spark.conf.set(name, "false")
    try:
        got = rows(catalog.stream_model_scoring(spark, str(tmp_path)), "match_id", "sequence")
    finally:
        spark.conf.unset(name)
    windows = momentum(b.feed(spark, str(tmp_path)), span_seconds=b.FEED_SPAN, keep=catalog._FEED_COLUMNS).withColumnsRenamed(
        {"kills_ct": "kills_ct_window", "kills_t": "kills_t_window"}
    )
    kept = ["match_id", "sequence", "kill_delta_window", "engagement_pace"]
    want = feature_frame(windows.filter(F.col("phase").isin("live", "bomb_planted")), ["match_id", "sequence"]).select(*kept)
    assert len({r["match_id"] for r in got}) > 1 and all(r["as_in_batch"] for r in got)
    assert [[r[c] for c in kept] for r in got] == [[r[c] for c in kept] for r in rows(want, "match_id", "sequence")]
