from __future__ import annotations

import random

import pytest
from telemetry_rows import rows
from pyspark.sql import functions as F

from roundcast.operators.scan import (
    Running,
    by_position,
    last_rows,
    ranked,
    running,
    spread_segments,
    trailing_range,
    trailing_rows,
)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    out, seq = [], 0
    for key in ("hot",) * 400 + ("a", "b") * 30:
        seq += rng.choice([1, 1, 1, 5])
        out.append((key, seq, rng.choice([None, rng.randint(0, 9)])))
    return out, spark.createDataFrame(out, "k string, seq long, v long").repartition(5)


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_running_equals_one_window_whatever_the_segments(data, width):
    source, df = data
    got = running(
        df,
        ["k"],
        "seq",
        [
            Running("total", "sum", F.coalesce("v", F.lit(0))),
            Running("top", "max", F.col("v")),
            Running("low", "min", F.col("v")),
            Running("seen", "latest", F.col("v")),
        ],
        by_position("seq", width),
    )
    state: dict = {}
    want = {}
    for k, seq, v in source:
        s = state.setdefault(k, dict(total=0, top=None, low=None, seen=None))
        if v is not None:
            s["total"] += v
            s["top"] = v if s["top"] is None else max(s["top"], v)
            s["low"] = v if s["low"] is None else min(s["low"], v)
            s["seen"] = v
        want[(k, seq)] = dict(s)
    assert len(rows(got)) == len(source)
    for r in rows(got):
        assert {c: r[c] for c in ("total", "top", "low", "seen")} == want[(r["k"], r["seq"])]


@pytest.mark.parametrize("slots,size", [(1, 3), (4, 5), (64, 1 << 20)])
def test_spread_segments_rise_with_the_value_and_stay_small(spark, slots, size):
    rng = random.Random(slots)
    values = {rng.random() ** 8 for _ in range(400)} | {0.0, 1.0}
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double").repartition(3)
    out = rows(spread_segments(df, ["k"], "v", F.lit(0.0), F.lit(1.0), slots, size), "v")
    ids = [r["__spread"] for r in out]
    assert ids == sorted(ids) and len(out) == len(values)
    if size < 10:
        assert len(set(ids)) > slots


@pytest.mark.parametrize("span,block", [(1, None), (4, 1), (50, 7), (50, None)])
def test_trailing_range_with_ties_counts_only_earlier_arrivals(spark, span, block):
    rng = random.Random(span)
    t, source = -20, []
    for seq in range(300):
        t += rng.choice([0, 0, 1, 3, 9])
        source.append(("m", seq, t, rng.randint(0, 1)))
    df = spark.createDataFrame(source, "k string, seq long, us long, w long").repartition(3)
    sums = [Running("all", "sum", F.lit(1).cast("long")), Running("ws", "sum", F.col("w"))]
    got = trailing_range(
        running(df, ["k"], "seq", sums),
        ["k"],
        "us",
        "seq",
        span,
        {"n": ("all", F.lit(1).cast("long")), "s": ("ws", F.col("w"))},
        block=block,
    )
    for r in rows(got):
        inside = [x for x in source if x[1] <= r["seq"] and x[2] >= r["us"] - span]
        assert (r["n"], r["s"]) == (len(inside), sum(x[3] for x in inside))
        assert r["oldest"] == min(x[2] for x in inside)
    with pytest.raises(ValueError):
        trailing_range(df, ["k"], "us", "seq", 0, {})


def test_trailing_rows_crosses_blocks(spark):
    df = ranked(spark.range(50).select(F.lit("m").alias("k"), "id"), ["k"], "id", "pos")
    got = trailing_rows(df, ["k"], "pos", 3, {"s": lambda w: F.sum("id").over(w)}, block_rows=5)
    for r in rows(got):
        assert r["s"] == sum(range(max(0, r["id"] - 3), r["id"] + 1))


def test_last_rows_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = last_rows(df, ["k"], [F.col("id")], 4)
    assert sorted(r["id"] for r in rows(got)) == list(range(988, 1000))
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_value_segments_stay_small(spark):
    rng = random.Random(2)
    shapes = {
        "powers": [10.0 ** (-9 * rng.random()) for _ in range(20_000)],
        "even": [rng.random() for _ in range(20_000)],
        "infinite": [*(rng.uniform(-5, 5) for _ in range(20_000)), float("inf"), float("-inf"), 0.0],
        "shifted": [1e9 + k / 50 for k in range(20_000)],
    }
    for name, values in shapes.items():
        df = spark.createDataFrame([("k", v) for v in set(values)], "k string, v double")
        low, high = F.lit(min(values)), F.lit(max(values))
        placed = spread_segments(df, ["k"], "v", low, high, 64, 500)
        found = rows(placed.groupBy("__spread").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")))
        assert max(r["n"] for r in found) <= 5 * 500, name
        ordered = sorted(found, key=lambda r: r["__spread"])
        assert all(x["b"] < y["a"] for x, y in zip(ordered, ordered[1:], strict=False)), name
