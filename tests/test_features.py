from __future__ import annotations

import random

import pytest
from telemetry_rows import rows
from pyspark.sql import functions as F

from roundcast.functions import display, scoring
from roundcast.functions import fixed_values as fv
from roundcast.functions.features import feature_frame, situation_tags, situations, training_set
from roundcast.functions.numeric import distance
from roundcast.operators.summary import describe_features, fit_support, support_score

TICK = dict(
    alive_ct=4, alive_t=2, health_ct=300, health_t=100, seconds_remaining=57.5, bomb_planted=False,
    bomb_seconds=None, money_ct=5000, money_t=10000, equipment_ct=12000, equipment_t=4000,
    losses_ct=1, losses_t=4, score_ct=6, score_t=3, kills_ct_window=2, kills_t_window=1,
    window_seconds=12.0, phase="live", match_id="m", sequence=1, ct_won=1,
)
TYPES = {
    "seconds_remaining": "double", "bomb_planted": "boolean", "bomb_seconds": "double",
    "window_seconds": "double", "phase": "string", "match_id": "string", "sequence": "long",
}
DDL = ", ".join(f"{c} {TYPES.get(c, 'int')}" for c in TICK)


def ticks(spark, *overrides):
    return spark.createDataFrame([tuple({**TICK, **o}.values()) for o in overrides], DDL)


def one(spark, **over):
    return rows(feature_frame(ticks(spark, over)))[0]


def test_known_values_in_order(spark):
    got = one(spark)
    assert tuple(got) == fv.FEATURES
    want = [
        0.8, 0.4, 0.4, 1 / 3, 0.5, 0.5, 0.0, 0.0, -1 / 3, 0.5, -0.6, 3 / 13, 9 / 24, 0.2, 0.25,
    ]
    assert list(got.values()) == pytest.approx(want, abs=1e-12)


def test_edges(spark):
    empty = one(spark, alive_ct=0, alive_t=0, health_ct=0, health_t=0, money_ct=0, money_t=0,
                equipment_ct=0, equipment_t=0, window_seconds=0.0)
    for name in ("alive_ratio", "health_ratio", "money_ratio", "equipment_ratio", "engagement_pace"):
        assert empty[name] == 0.0
    assert one(spark, alive_ct=9)["alive_ct"] == 1.8  # not clamped
    assert one(spark, bomb_planted=True, bomb_seconds=20.0)["bomb_time_fraction"] == 0.5
    assert one(spark, kills_ct_window=99, window_seconds=1.0)["engagement_pace"] == 1.0


def test_sides_swap_antisymmetrically_and_stay_bounded(spark):
    rng = random.Random(77)
    a, b = [], []
    for i in range(200):
        o = {"sequence": i, "seconds_remaining": rng.uniform(0, 115)}
        for name, top in (
            ("alive", 5), ("health", 500), ("money", 60000), ("equipment", 30000),
            ("losses", 8), ("score", 20),
        ):
            o[f"{name}_ct"], o[f"{name}_t"] = rng.randint(0, top), rng.randint(0, top)
        a.append(o)
        swapped = {**o}
        for name in ("alive", "health", "money", "equipment", "losses", "score"):
            swapped[f"{name}_ct"], swapped[f"{name}_t"] = o[f"{name}_t"], o[f"{name}_ct"]
        b.append(swapped)
    left = rows(feature_frame(ticks(spark, *a), ["sequence"]), "sequence")
    right = rows(feature_frame(ticks(spark, *b), ["sequence"]), "sequence")
    odd = [
        "alive_delta", "alive_ratio", "health_ratio", "money_ratio", "equipment_ratio",
        "loss_streak_delta", "score_delta",
    ]
    for x, y in zip(left, right):
        assert [x[c] for c in odd] == pytest.approx([-y[c] for c in odd], abs=1e-12)
        assert all(-1.0 <= x[c] <= 1.0 for c in fv.FEATURES)


def test_old_rows_without_window_columns_read_as_zero(spark):
    df = ticks(spark, {}).drop("kills_ct_window", "kills_t_window", "window_seconds")
    got = rows(feature_frame(df))[0]
    assert (got["kill_delta_window"], got["engagement_pace"]) == (0.0, 0.0)
    off = rows(feature_frame(ticks(spark, {}), with_momentum=False))[0]
    assert (off["kill_delta_window"], off["engagement_pace"]) == (0.0, 0.0)
    with pytest.raises(KeyError):
        training_set(df.drop("ct_won"))


def test_situations_overlap(spark):
    df = ticks(spark, dict(bomb_planted=True, bomb_seconds=9.0, alive_ct=1, alive_t=4,
                           seconds_remaining=20.0))
    tags = rows(df.select(situation_tags(situations()).alias("t")))[0]["t"]
    assert set(tags) == {"post-plant", "t ahead", "lopsided", "clutch", "eco round"}


def test_support(spark):
    df = ticks(spark, *[dict(alive_ct=i % 6, sequence=i) for i in range(60)])
    features = feature_frame(df, ["sequence"])
    fitted = fit_support(features)
    assert {r["support"] for r in rows(support_score(features, None))} == {1.0}
    inside = rows(support_score(features, fitted))
    assert all(0.0 <= r["support"] <= 1.0 for r in inside)
    far = feature_frame(ticks(spark, dict(alive_ct=500)), ["sequence"])
    assert rows(support_score(far, fitted))[0]["support"] < min(r["support"] for r in inside)
    stats = {r["feature"]: r for r in rows(describe_features(features))}
    assert stats["time_fraction"]["std"] == pytest.approx(0.0)
    assert stats["alive_ct"]["std"] == pytest.approx(
        rows(features.select(F.stddev_samp("alive_ct").alias("s")))[0]["s"]
    )


def test_probability_columns_and_bands(spark):
    df = spark.createDataFrame([(0.5,), (0.505,), (0.7,), (0.1,)], "p double")
    got = rows(df.select(*scoring.prediction_columns(F.col("p"))), "ct_win_probability")
    assert [r["favoured_side"] for r in got] == ["T", "even", "even", "CT"]
    assert got[0]["t_win_probability"] == pytest.approx(0.9)
    assert got[3]["confidence"] == pytest.approx(0.4)
    bands = spark.createDataFrame([(0.66,), (0.33,), (0.3299,)], "s double")
    assert [r["b"] for r in rows(bands.select(scoring.confidence_band(F.col("s")).alias("b")))] == [
        "high", "medium", "low",
    ]
    sev = spark.createDataFrame([(0.0999,), (0.1,), (0.25,)], "s double")
    assert [r["b"] for r in rows(sev.select(scoring.severity(F.col("s")).alias("b")))] == [
        "stable", "moderate", "severe",
    ]


def test_display(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, 75.9, None, "de_dust2"), (7, 20000, 30000, 9.2, "ak47", "de_nuke")],
        "losses int, ct int, t int, clock double, weapon string, map string",
    )
    got = rows(
        df.select(
            display.loss_bonus(F.col("losses")).alias("bonus"),
            display.comparison_share(F.col("ct"), F.col("t")).alias("share"),
            display.buy_badge(F.col("ct")).alias("badge"),
            display.clock_label(F.col("clock")).alias("label"),
            display.weapon_label(F.col("weapon")).alias("weapon"),
            display.map_label(F.col("map")).alias("map"),
        ),
        "bonus",
    )
    assert got[0] == dict(bonus=0, share=50.0, badge="limited", label="1:15", weapon="—", map="Dust2")
    assert got[1] == dict(
        bonus=3400, share=40.0, badge="full buy", label="0:09", weapon="AK-47", map="Nuke"
    )
    ladder = spark.createDataFrame([(i,) for i in range(1, 7)], "n int")
    assert [r["b"] for r in rows(ladder.select(display.loss_bonus(F.col("n")).alias("b")))] == [
        1400, 1900, 2400, 2900, 3400, 3400,
    ]
    p = "struct<x:double,y:double,z:double>"
    d = spark.createDataFrame([((0.0, 0.0, 0.0), (2.0, 3.0, 6.0))], f"a {p}, b {p}")
    assert rows(d.select(distance(F.col("a"), F.col("b")).alias("d")))[0]["d"] == 7.0
