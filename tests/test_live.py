from __future__ import annotations

import random

import numpy as np
import pytest
from telemetry_rows import at, rows
from pyspark.sql import functions as F

from roundcast.operators import live as lv
from roundcast.plans import reports
from roundcast.plans.confidence import score_confidence


def rounds(spark, items, match="m"):
    data = [(match, n, w, f"r{n}", i, i) for i, (n, w) in enumerate(items)]
    return spark.createDataFrame(
        data, "match_id string, round_number int, winner string, reason string, sequence long, score_ct int"
    )


def test_history_sorts_replaces_and_caps(spark):
    got = lv.round_history(rounds(spark, [(3, "CT"), (1, "T"), (2, "CT"), (2, "T")]))
    assert [(r["round_number"], r["winner"]) for r in rows(got, "round_number")] == [
        (1, "T"), (2, "T"), (3, "CT"),
    ]
    many = lv.round_history(rounds(spark, [(n, "CT") for n in range(1, 80)]))
    assert [r["round_number"] for r in rows(many, "round_number")] == list(range(16, 80))


@pytest.mark.parametrize("wins,side,length", [("TCCC", "CT", 3), ("T", "T", 1), ("CCCT", "T", 1), ("CC", "CT", 2)])
def test_streak(spark, wins, side, length):
    h = rounds(spark, [(i + 1, "CT" if w == "C" else "T") for i, w in enumerate(wins)])
    got = rows(lv.history_summary(h))[0]
    assert (got["streak_side"], got["streak_length"]) == (side, length)
    assert got["ct_wins"] == wins.count("C") and got["rounds_played"] == len(wins)
    other = spark.createDataFrame([("x",), ("m",)], "match_id string")
    joined = {r["match_id"]: r for r in rows(lv.with_history(other, lv.history_summary(h)))}
    assert joined["x"]["rounds_played"] == 0 and joined["x"]["streak_side"] is None


def test_latest_arrival_not_highest_sequence(spark):
    df = spark.createDataFrame(
        [("m", 9, 1), ("m", 3, 2)], "match_id string, sequence long, arrival long"
    )
    assert rows(lv.latest_per_match(df, arrival="arrival"))[0]["sequence"] == 3


def test_time_to_live(spark):
    df = spark.createDataFrame([("b", at(0)), ("a", at(10)), ("c", at(-3600))], "match_id string, written_at timestamp")
    now = F.lit(at(5)).cast("timestamp")
    assert [r["match_id"] for r in rows(lv.live_matches(df, now))] == ["a", "b"]


@pytest.mark.parametrize("width", [1, 3, 1 << 20])
def test_scoreline_across_segments(spark, width):
    scores = [1, 1, 2, 3, 3, 3, 4]
    df = spark.createDataFrame([("m", i + 1, s) for i, s in enumerate(scores)], "match_id string, round_number int, score_ct int")
    got = rows(lv.running_scoreline(df, segment_rows=width), "round_number")
    assert [r["round_winner"] for r in got] == ["CT", "T", "CT", "CT", "T", "T", "CT"]


@pytest.mark.parametrize("segment", [0.25, 1.0, 7.0, 1000.0])
def test_throttle_equals_the_greedy_walk(spark, segment):
    rng = random.Random(11)
    items, want = [], {}
    for match in ("a", "b"):
        t, last = 0, None
        for seq in range(300):
            t += rng.choice([0, 60_000, 125_000, 125_000, 400_000, 3_000_000])
            keep = last is None or t - last >= 250_000
            last = t if keep else last
            items.append((match, seq, t))
            want[(match, seq)] = keep
    df = spark.createDataFrame(items, "match_id string, sequence long, us long").repartition(3)
    got = lv.throttle(df, segment_seconds=segment)
    assert {(r["match_id"], r["sequence"]): r["kept"] for r in rows(got)} == want
    counters = rows(lv.throttle_counters(got))[0]
    assert counters["throttled"] == sum(not k for k in want.values())


@pytest.mark.parametrize("segment", [0.25, 1.0, 1000.0])
def test_throttle_with_replays_and_steps_back(spark, segment):
    rng = random.Random(5)
    items, t = [], 0
    for seq in range(200):
        t += rng.choice([-700_000, 0, 60_000, 125_000, 400_000, 900_000])
        items += [("a", seq, t)] * rng.choice([1, 1, 3])
    kept, last = [], None
    for i, (_, _, us) in enumerate(items):
        if last is None or us - last >= 250_000:
            last = us
            kept.append(i)
    want = sorted(items[i] for i in kept)
    df = spark.createDataFrame(items, "match_id string, sequence long, us long").repartition(3)
    got = rows(lv.throttle(df, segment_seconds=segment))
    assert len(got) == len(items)
    assert sorted((r["match_id"], r["sequence"], r["us"]) for r in got if r["kept"]) == want
    back = spark.createDataFrame([("m", i, u) for i, u in enumerate([1_000_000, 0, 250_000])], "match_id string, sequence long, us long")
    assert [r["kept"] for r in rows(lv.throttle(back), "sequence")] == [True, False, False]


def test_latency_by_time_before_sequence(spark):
    df = spark.createDataFrame([(1, "a", 9, 5.0), (2, "b", 1, 7.0)], "at int, match_id string, sequence long, latency_ms double")
    assert rows(lv.latency_report(df, order=("at", "match_id", "sequence"), samples=1))[0]["p50_ms"] == 7.0


def test_snapshot_with_a_prediction_of_its_own(spark):
    items = [("prediction", 0, "{}"), ("round_end", 1, "{}"), ("tick", 2, '{"prediction":{"p":0.7}}'), ("tick", 3, '{"hp":1}')]
    df = spark.createDataFrame([(k, "m", i, at(i), p) for k, i, p in items], "type string, match_id string, sequence long, timestamp timestamp, payload string")
    got = rows(lv.dashboard_state(df))[0]
    assert (got["snapshot"], got["prediction"]) == ('{"hp":1}', '{"p":0.7}')


def test_latency_uses_index_percentiles_of_the_last_rows(spark):
    df = spark.createDataFrame([(i, float(i % 1000)) for i in range(3000)], "sequence long, latency_ms double")
    got = rows(lv.latency_report(df))[0]
    assert (got["count"], got["p50_ms"], got["p95_ms"], got["p99_ms"]) == (1000, 500.0, 950.0, 990.0)
    one = rows(lv.latency_report(df.limit(1)))[0]
    assert one["p99_ms"] == one["p50_ms"]
    assert rows(lv.latency_report(df.limit(0)))[0]["p50_ms"] == 0.0


@pytest.mark.parametrize("block", [9, 1 << 17])
def test_stability_is_the_population_deviation_of_the_last_eight(spark, block):
    rng = random.Random(4)
    values = [rng.random() for _ in range(60)]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)], "match_id string, sequence long, p double")
    got = rows(lv.recent_stability(df, "p", block_rows=block), "sequence")
    for i, r in enumerate(got):
        recent = values[max(0, i - 7) : i + 1]
        want = 1.0 if len(recent) < 3 else max(0.0, 1 - np.std(recent) / 0.15)
        assert r["stability"] == pytest.approx(want)
    before = rows(lv.recent_stability(df, "p", include_current=False, block_rows=block), "sequence")
    for i, r in enumerate(before):
        recent = values[max(0, i - 8) : i]
        want = 1.0 if len(recent) < 3 else max(0.0, 1 - np.std(recent) / 0.15)
        assert r["stability"] == pytest.approx(want)


def test_stability_known_cases(spark):
    cases = {"steady": [0.6] * 8, "wild": [0.3, 0.9, 0.2, 0.7], "gentle": [0.61, 0.6, 0.62, 0.61]}
    df = spark.createDataFrame(
        [(k, i, v) for k, vs in cases.items() for i, v in enumerate(vs)],
        "match_id string, sequence long, p double",
    ).withColumn("support", F.lit(1.0))
    got = {(r["match_id"], r["sequence"]): r for r in rows(score_confidence(df, "p"))}
    assert got[("steady", 7)]["stability"] == pytest.approx(1.0)
    assert got[("wild", 3)]["stability"] < 0.3
    assert got[("gentle", 3)]["stability"] > 0.8
    assert got[("steady", 7)]["limited_by"] == "decisiveness"
    assert got[("steady", 7)]["score"] == pytest.approx((0.2) ** (1 / 3))


def test_systematic_sample_and_timeline(spark):
    df = spark.range(1, 101).select(F.lit("m").alias("match_id"), F.col("id").alias("sequence"))
    got = [r["sequence"] for r in rows(lv.systematic_sample(df, 8, segment_rows=10), "sequence")]
    assert got == list(range(8, 101, 8))
    kinds = df.withColumn("event_type", F.when(F.col("sequence") == 40, "round_end").otherwise("prediction"))
    line = [r["sequence"] for r in rows(lv.probability_timeline(kinds, points=30), "sequence")]
    assert line == list(range(71, 101))
    log = rows(lv.round_log(kinds, rows=3), "position")
    assert [r["sequence"] for r in log] == [100, 99, 98]


def frames(spark, items):
    return spark.createDataFrame(
        [(k, "m", i, at(i), f"{k}{i}") for i, k in enumerate(items)],
        "type string, match_id string, sequence long, timestamp timestamp, payload string",
    )


def test_dashboard_fold(spark):
    got = rows(lv.dashboard_state(frames(spark, ["tick", "prediction", "round_end", "tick"])))[0]
    assert (got["snapshot"], got["prediction"], got["rounds_ended"]) == ("tick3", None, 1)
    got = rows(lv.dashboard_state(frames(spark, ["round_end", "prediction", "tick"])))[0]
    assert (got["prediction"], got["finished"]) == ("prediction1", None)
    got = rows(lv.dashboard_state(frames(spark, ["prediction", "match_end"])))[0]
    assert (got["prediction"], got["finished"]) == (None, "match_end1")


def test_counters_when_nothing_came(spark):
    df = spark.createDataFrame([], "sequence long, arrival long, ok boolean")
    got = rows(lv.consumer_counters(df, F.col("ok")))[0]
    assert (got["success_rate"], got["last_sequence"]) == (1.0, -1)
    assert rows(lv.worker_counters(df, F.col("ok")))[0]["publish_rate"] == 0.0
    assert rows(lv.throttle_counters(df.withColumn("kept", F.lit(True))))[0]["throttle_rate"] == 0.0


def test_reports(spark):
    df = spark.createDataFrame(
        [("m", 0, "tick", None), ("m", 4_000_000, "round_end", "CT"), ("n", 7, "kill", None)],
        "match_id string, us long, event_type string, winner string",
    )
    got = {r["match_id"]: r for r in rows(reports.match_report(df))}
    assert (got["m"]["ct_win_rate"], got["n"]["ct_win_rate"]) == (1.0, 0.0)
    speed = {r["match_id"]: r for r in rows(reports.throughput(df))}
    assert (speed["m"]["events_per_second"], speed["n"]["events_per_second"]) == (0.5, 0.0)
    importance = spark.createDataFrame([("b", 0.7), ("a", 0.2)], "feature string, importance double")
    assert [r["feature"] for r in rows(reports.top_features(importance, 1))] == ["b"]
