from __future__ import annotations

import random

import pytest
from telemetry_rows import rows

from roundcast.operators.isotonic import isotonic_blocks, isotonic_grid


def pooled(points):
    """Plain pooling of (score, label) rows: one (lo, hi, mean) per block."""
    stack = []
    for score in sorted({s for s, _ in points}):
        labels = [y for s, y in points if s == score]
        stack.append([score, score, sum(labels), len(labels)])
        while len(stack) > 1 and stack[-2][2] / stack[-2][3] >= stack[-1][2] / stack[-1][3]:
            _, hi, total, weight = stack.pop()
            stack[-1][1:] = [hi, stack[-1][2] + total, stack[-1][3] + weight]
    return [(lo, hi, total / weight) for lo, hi, total, weight in stack]


def blocks_of(spark, points, segment_blocks):
    df = spark.createDataFrame(points, "score double, label int")
    got = rows(isotonic_blocks(df, "label", "score", segment_blocks), "lo")
    return [(r["lo"], r["hi"], pytest.approx(r["total"] / r["weight"])) for r in got]


@pytest.mark.parametrize("segment_blocks", [4, 1000])
@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "late_drop"])
def test_blocks_equal_plain_pooling(spark, shape, segment_blocks):
    rng = random.Random(7)
    lean = {
        "noise": lambda s: rng.random() < 0.5,
        "rising": lambda s: rng.random() < s,
        "falling": lambda s: rng.random() > s,
        # the last block pulls in what many segments before it hold
        "late_drop": lambda s: s < 0.9 and rng.random() < s,
    }[shape]
    points = [(s, int(lean(s))) for s in (rng.randrange(60) / 60 for _ in range(300))]
    assert blocks_of(spark, points, segment_blocks) == pooled(points)


def test_missing_scores_and_empty_tables(spark):
    points = [(0.1, 0), (None, 1), (0.2, None), (0.3, 1)]
    assert blocks_of(spark, points, 10) == [(0.1, 0.1, 0.0), (0.3, 0.3, 1.0)]
    empty = spark.createDataFrame([], "score double, label int")
    assert isotonic_grid(isotonic_blocks(empty, "label", "score"), 5) == ([], [])


def test_grid_is_linear_between_blocks(spark):
    df = spark.createDataFrame([(0.0, 0), (0.2, 0), (0.6, 1), (0.6, 0), (1.0, 1)], "score double, label int")
    xs, ys = isotonic_grid(isotonic_blocks(df, "label", "score"), 6)
    assert xs == pytest.approx([0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    assert ys == pytest.approx([0.0, 0.0, 0.25, 0.5, 0.75, 1.0])


def test_query_makes_its_rows_once(spark, monkeypatch):
    from roundcast.plans import catalog

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    ticks = spark.range(500).selectExpr("CAST(id % 3 = 0 AS INT) AS ct_won", "(id % 100) / 100D AS ct_win_probability")
    monkeypatch.setattr(catalog, "_scored", lambda *_: ticks.mapInArrow(counted, ticks.schema))
    rows = catalog.QUERIES["isotonic_fit"](spark, "unused").collect()
    assert {r["rows_fitted"] for r in rows} == {500}
    assert made.value == 500
