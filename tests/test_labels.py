from __future__ import annotations

import pytest
from telemetry_rows import rows
from pyspark.sql import functions as F

from roundcast.operators import labels as lb
from roundcast.sources.tables import TICK_SCHEMA, History, reconcile


def ticks(spark, items):
    return spark.createDataFrame(items, "match_id string, sequence long, round_number int, phase string, v int")


def rounds(spark, items):
    return spark.createDataFrame(
        items, "match_id string, round_number int, winner string, reason string, sequence long"
    )


def test_label_join(spark):
    t = ticks(spark, [("m", 1, 1, "live", 0), ("m", 2, 1, "freezetime", 0), ("m", 3, 2, "over", 0),
                      ("m", 4, 3, "live", 0), ("n", 5, 1, "live", 0)])
    r = rounds(spark, [("m", 1, "CT", "t_eliminated", 1), ("m", 2, "T", "bomb_exploded", 2)])
    got = rows(lb.label_ticks(t, r), "sequence")
    assert [(g["sequence"], g["ct_won"], g["round_reason"]) for g in got] == [
        (1, 1, "t_eliminated"), (3, 0, "bomb_exploded"),
    ]
    assert rows(lb.label_balance(lb.label_ticks(t, r)))[0] == dict(ct_rows=1, t_rows=1)
    assert rows(lb.label_balance(lb.label_ticks(t, r.limit(0))))[0] == dict(ct_rows=0, t_rows=0)


def test_dedupe_is_repeatable_and_collapses_before_the_shuffle(spark):
    t = ticks(spark, [("m", 1, 1, "live", v) for v in (3, 1, 2)] * 40 + [("m", 2, 1, "live", None)])
    got = rows(lb.dedupe(t.repartition(7)), "sequence")
    assert [(g["sequence"], g["v"]) for g in got] == [(1, 1), (2, None)]
    plan = lb.dedupe(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_dedupe_deals_its_rows_before_it_sorts_them(spark):
    """One split of many rows: the sort before the shuffle gets parts of the advisory size, not the split."""
    items = spark.range(40_000).select(
        F.concat(F.lit("m"), F.col("id") % 900).alias("match_id"), (F.col("id") % 7).alias("sequence"), F.xxhash64("id").alias("v")
    ).coalesce(1)
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        limited = lb.dedupe(items)
        plan = limited._jdf.queryExecution().executedPlan().toString()
        # the last Sort is the one nearest to the rows
        assert "Exchange" in plan[plan.rindex("Sort ["):]
        dealt = items.hint("rebalance", F.col("v"))
        assert dealt.groupBy(F.spark_partition_id()).count().count() > 4
        assert limited.count() == 6300
    finally:
        spark.conf.set(name, before)


def test_upsert_takes_whole_rows_of_the_last_arrival(spark):
    r = rounds(spark, [("m", 1, "CT", "t_eliminated", 1), ("m", 1, "T", None, 9), ("m", 2, "T", "x", 3)])
    got = rows(lb.upsert(r, ["match_id", "round_number"], ["sequence"]), "round_number")
    assert (got[0]["winner"], got[0]["reason"]) == ("T", None)
    assert len(got) == 2


@pytest.mark.parametrize("n,fraction,held", [(10, 0.2, 2), (10, 0.25, 2), (6, 0.25, 2), (2, 0.01, 1), (14, 0.25, 4)])
def test_split_rounds_half_to_even_and_keeps_matches_whole(spark, n, fraction, held):
    ids = sorted(f"m{i}" for i in range(n))
    df = spark.createDataFrame([(m, i) for m in ids for i in range(10)], "match_id string, i int")
    train, test = lb.split_by_match(df.repartition(5), fraction=fraction)
    assert sorted({r["match_id"] for r in rows(test)}) == ids[-held:]
    assert sorted({r["match_id"] for r in rows(train)}) == ids[:-held]
    assert train.count() + test.count() == 10 * n


def test_split_errors(spark):
    df = spark.createDataFrame([("m", 1)], "match_id string, i int")
    with pytest.raises(ValueError):
        lb.split_by_match(df)
    for bad in (0.0, 1.0):
        with pytest.raises(ValueError):
            lb.split_by_match(df, fraction=bad)


def test_calibrator_split_takes_the_first_half(spark):
    df = spark.createDataFrame([(f"m{i}",) for i in range(7)], "match_id string")
    fit, report = lb.split_for_calibrator(df)
    assert sorted(r["match_id"] for r in rows(fit)) == ["m0", "m1", "m2"]
    assert report.count() == 4


def test_drop_matches(spark):
    df = spark.createDataFrame([("a",), ("b",)], "match_id string")
    assert rows(lb.drop_matches(df, df.filter("match_id = 'a'"))) == [dict(match_id="b")]


def test_reconcile_is_idempotent(spark):
    df = spark.createDataFrame([("m", 1)], "match_id string, sequence long")
    out, added = reconcile(df)
    assert added == [c for c in TICK_SCHEMA if c not in ("match_id", "sequence")]
    first = rows(out)[0]
    assert (first["phase"], first["bomb_planted"], first["timestamp"], first["window_seconds"]) == (
        "", False, None, 0.0,
    )
    assert reconcile(out)[1] == []


def test_history_tables(spark, tmp_path):
    base, _ = reconcile(
        spark.createDataFrame([("m", 1, 1, "live"), ("m", 1, 1, "live"), ("m", 2, 2, "live")],
                              "match_id string, sequence long, round_number int, phase string")
    )
    r = rounds(spark, [("m", 1, "CT", "t_eliminated", 1), ("m", 2, "T", "bomb_exploded", 5)])
    m = spark.createDataFrame([("m", "CT", 13, 2, 9)], "match_id string, winner string, score_ct int, score_t int, sequence long")
    history = History(spark, str(tmp_path / "h"), run="a")
    history.write(base, r, m, 0)
    history.write(base, r, m, 0)  # a retried batch
    history.write(base.limit(0), rounds(spark, [("m", 2, "CT", "bomb_defused", 7)]), m, 1)
    assert history.count("ticks") == 3
    assert history.count("rounds") == 2
    got = rows(history.read("training_data"), "sequence")
    assert [(g["sequence"], g["ct_won"]) for g in got] == [(1, 1), (2, 1)]
    out = history.export(str(tmp_path / "x"))
    assert spark.read.parquet(out).count() == 2
    with pytest.raises(ValueError):
        history.count("nope")
    assert F is not None


def test_older_files_get_defaults_and_writers_keep_apart(spark, tmp_path):
    base, _ = reconcile(
        spark.createDataFrame([("m", 1, 1, "live")], "match_id string, sequence long, round_number int, phase string")
    )
    r = rounds(spark, [("m", 1, "CT", "t_eliminated", 1)])
    m = spark.createDataFrame([("m", "CT", 13, 2, 9)], "match_id string, winner string, score_ct int, score_t int, sequence long")
    root = str(tmp_path / "h")
    old = base.drop("kills_ct_window", "kills_t_window", "window_seconds")
    History(spark, root, run="1").write(old, r, m, 0)
    new = base.withColumn("kills_ct_window", F.lit(3)).withColumn("sequence", F.lit(2).cast("long"))
    later = rounds(spark, [("m", 1, "T", "bomb_exploded", 1)])
    History(spark, root, run="2").write(new, later, m, 0)
    got = rows(History(spark, root).read("ticks"), "sequence")
    assert [(g["kills_ct_window"], g["kills_t_window"], g["window_seconds"]) for g in got] == [(0, 0, 0.0), (3, 0, 0.0)]
    assert [g["winner"] for g in rows(History(spark, root).read("rounds"))] == ["T"]
