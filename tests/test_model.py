from __future__ import annotations

import pytest
from telemetry_rows import rows
from pyspark.sql import functions as F

from roundcast.functions import fixed_values as fv
from roundcast.plans import model as md


@pytest.fixture(scope="module")
def frame(spark):
    """Labelled rows in which manpower decides, from a range and hashes."""

    def h(salt: int, top: int):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(top)).cast("int")

    df = spark.range(6000, numPartitions=4).select(
        "id",
        F.format_string("m%02d", F.col("id") % 20).alias("match_id"),
        F.col("id").alias("sequence"),
        (F.col("id") % 7 + 1).cast("int").alias("round_number"),
        F.when(h(9, 10) == 0, "freezetime").when(h(9, 10) == 1, "over").otherwise("live").alias("phase"),
        (h(1, 1150) / 10.0).alias("seconds_remaining"),
        (h(2, 4) == 0).alias("bomb_planted"),
        F.when(h(2, 4) == 0, h(3, 400) / 10.0).alias("bomb_seconds"),
        h(4, 13).alias("score_ct"),
        h(5, 13).alias("score_t"),
        h(6, 6).alias("alive_ct"),
        h(7, 6).alias("alive_t"),
        h(8, 500).alias("health_ct"),
        h(10, 500).alias("health_t"),
        *[h(11 + i, 30000).alias(c) for i, c in enumerate(("money_ct", "money_t", "equipment_ct", "equipment_t"))],
        h(15, 5).alias("losses_ct"),
        h(16, 5).alias("losses_t"),
        h(17, 4).alias("kills_ct_window"),
        h(18, 4).alias("kills_t_window"),
        (h(19, 150) / 10.0).alias("window_seconds"),
        h(20, 100).alias("noise"),
    )
    lean = 0.5 + (F.col("alive_ct") - F.col("alive_t")) * 0.1
    return df.withColumn("ct_won", (F.col("noise") / 100.0 < lean).cast("int"))


@pytest.fixture(scope="module")
def trained(frame):
    return md.train_model(
        frame, num_rounds=6, params={"maxDepth": 3, "stepSize": 0.3}, calibrate=False, partitions=4
    )


def test_training_beats_the_base_rate_and_finds_manpower(trained):
    found = trained.metadata
    assert found["held_out"]["skill_score"] > 0.05
    assert found["held_out"]["roc_auc"] > 0.65
    top = list(found["model"]["importance"])[:3]
    assert any(name.startswith("alive") for name in top)
    assert sum(found["model"]["importance"].values()) == pytest.approx(1.0, abs=1e-3)
    assert found["data"]["test"]["matches"] == 4 and found["data"]["train"]["matches"] == 16
    assert trained.breakpoints == ((), ())


def test_training_repeats_with_its_seed(frame, trained):
    again = md.train_model(
        frame.repartition(7), num_rounds=6, params={"maxDepth": 3, "stepSize": 0.3}, partitions=4
    )
    assert again.metadata["held_out"]["log_loss"] == pytest.approx(
        trained.metadata["held_out"]["log_loss"], abs=0.02
    )


def test_prediction_is_neutral_where_nothing_can_move(frame, trained):
    out = md.predict(frame, trained, keep=("match_id", "sequence", "phase"))
    got = rows(out)
    assert len(got) == frame.count()
    for r in got:
        assert r["scored"] == (r["phase"] in fv.SCOREABLE_PHASES)
        if not r["scored"]:
            assert (r["ct_win_probability"], r["favoured_side"]) == (0.5, "even")
        assert r["ct_win_probability"] + r["t_win_probability"] == pytest.approx(1.0)


def test_momentum_is_optional(frame, trained):
    blank = frame.withColumns({c: F.lit(0) for c in ("kills_ct_window", "kills_t_window", "window_seconds")})
    with_zero = rows(md.predict(blank, trained), "match_id", "sequence")
    without = rows(md.predict(frame, trained, with_momentum=False), "match_id", "sequence")
    assert with_zero == without


def test_tree_cap_and_contract(frame, trained):
    total = trained.pipeline.stages[-1].getNumTrees
    capped = md.cap_trees(trained.pipeline, 1)
    assert capped.stages[-1].getNumTrees == 1
    p1 = rows(md.predict(frame.limit(50), trained, max_trees=1), "match_id", "sequence")
    assert len(p1) == 50
    for bad in (0, total + 1):
        with pytest.raises(ValueError):
            md.cap_trees(trained.pipeline, bad)
    with pytest.raises(ValueError):
        md.check_contract(trained.pipeline, fv.FEATURES[::-1])


def test_node_table_gives_average_gains_and_capped_margins(spark, frame, trained):
    nodes = md.node_table(spark, md.stored(trained))
    kept = rows(nodes)
    gains = {}
    for r in kept:
        if r["feature"] is not None:
            gains.setdefault(r["feature"], []).append(r["gain"])
    means = {c: sum(g) / len(g) for c, g in gains.items()}
    got = md.average_gain(nodes)
    assert set(got) == set(fv.FEATURES) and list(got.values()) == sorted(got.values(), reverse=True)
    for c in fv.FEATURES:
        assert got[c] == pytest.approx(means.get(c, 0.0) / sum(means.values()), abs=1e-6)
    # leaves are counted in node order, as the model counts them
    for tree in {r["tree"] for r in kept}:
        own = sorted((r["node"], r["leaf"]) for r in kept if r["tree"] == tree and r["leaf"] is not None)
        assert [leaf for _, leaf in own] == list(range(len(own)))
    features = md.feature_frame(frame.limit(200), ["match_id", "sequence"])
    for cap in (1, trained.pipeline.stages[-1].getNumTrees):
        short = md.cap_trees(trained.pipeline, cap)
        out = md.capped_margin(features, short, nodes, cap).select("margin", md.vector_to_array("rawPrediction").alias("raw"))
        for r in rows(out):
            assert r["raw"][1] == pytest.approx(r["margin"], abs=1e-9)


def test_importance_names_features_that_no_tree_uses(frame):
    # the first feature alone varies, so a vector of importances may end with it
    flat = frame.withColumns({c: F.lit(1) for c in ("alive_ct", "alive_t", "health_ct", "health_t", "kills_ct_window", "kills_t_window")})
    model = md.train_model(flat, num_rounds=3, patience=1, params={"maxDepth": 1}, partitions=2)
    short = md.importance(md.cap_trees(model.pipeline, 1))
    assert set(short) == set(fv.FEATURES) and sum(1 for share in short.values() if share) == 1


def test_training_stops_where_held_out_matches_gain_nothing(frame):
    noise = frame.withColumn("ct_won", (F.col("noise") < 50).cast("int"))
    model = md.train_model(noise, num_rounds=30, params={"maxDepth": 2})
    assert 1 <= model.pipeline.stages[-1].getNumTrees < 30


def test_small_gains_do_not_end_training(frame):
    model = md.train_model(frame, num_rounds=25, params={"maxDepth": 2}, partitions=4)
    assert model.pipeline.stages[-1].getNumTrees > 10


def test_best_round_within_the_patience():
    assert md.best_iteration([3.0, 2.0, 2.5, 2.4, 1.0], patience=3) == 4
    assert md.best_iteration([3.0, 2.0, 2.5, 2.4, 2.3, 1.0], patience=3) == 1


def test_stretches_go_on_while_rounds_gain(frame):
    model = md.train_model(frame, num_rounds=12, patience=2, params={"maxDepth": 2}, partitions=4)
    assert model.pipeline.stages[-1].getNumTrees > 4


def test_model_survives_storage(spark, frame, trained, tmp_path):
    path = str(tmp_path / "model")
    md.save_model(trained, path)
    back = md.load_model(spark, path)
    assert back.metadata["model"] == trained.metadata["model"]
    assert rows(back.support) == rows(trained.support)
    assert back.reference.columns == list(fv.FEATURES) and 0 < back.reference.count() <= frame.count()
    a = rows(md.predict(frame.limit(20), back), "match_id", "sequence")
    assert a == rows(md.predict(frame.limit(20), trained), "match_id", "sequence")
    with pytest.raises(FileNotFoundError):
        md.load_model(spark, str(tmp_path / "none"))


def test_calibration_gate_and_errors(frame):
    few = md.train_model(frame, num_rounds=1, params={"maxDepth": 2}, calibrate=True)
    assert few.breakpoints == ((), ())  # four held-out matches are too few
    many = md.train_model(
        frame, num_rounds=2, params={"maxDepth": 2}, test_fraction=0.4, calibrate=True
    )
    assert len(many.breakpoints[0]) == 256
    with pytest.raises(ValueError, match="same outcome"):
        md.train_model(frame.withColumn("ct_won", F.lit(1)), num_rounds=1)
    with pytest.raises(ValueError):
        md.train_model(frame.limit(0), num_rounds=1)


def test_validation_reports(frame, trained):
    out = md.validate(frame, trained)
    names = {r["name"] for r in rows(out["benchmark"])}
    assert "overall" in names and len(names) > 5
    drift = {r["feature"] for r in rows(out["drift"])}
    assert drift == set(fv.FEATURES)
    assert rows(out["verdict"])[0]["severity"] in ("stable", "moderate", "severe", "unknown")


def test_a_stored_model_scores_a_stream_as_it_scores_a_batch(spark, frame, trained, tmp_path):
    """Three arrivals with a restart between them; momentum comes from state, all else from the tick."""
    from roundcast.operators.momentum import momentum
    from roundcast.streaming import jobs

    jobs.configure_state(spark)
    windows = ("kills_ct_window", "kills_t_window", "window_seconds")
    events = frame.drop(*windows).select(
        "*",
        F.timestamp_seconds(F.col("id")).alias("timestamp"),
        F.when(F.col("noise") < 15, "kill").when(F.col("noise") == 15, "round_start").otherwise("tick").alias("event_type"),
        F.when(F.col("id") % 3 == 0, "T").otherwise("CT").alias("victim_team"),
        (F.col("noise") < 5).alias("headshot"),
        F.when(F.col("id") % 2 == 0, F.timestamp_seconds(F.lit(0))).alias("arrived"),
    )
    path, model = str(tmp_path / "in"), md.load_model(spark, md.stored(trained))
    columns = [c for c in frame.columns if c not in ("id", "match_id", "sequence", "noise", "ct_won", *windows)]
    for k in range(3):
        events.filter(F.floor(F.col("id") / 2000) == k).write.mode("append").parquet(path)
        out = jobs.score_stream(
            jobs.read_table_stream(spark, path, "*.parquet"), md.scorer(model), columns, keep=("round_number", "arrived"), span_seconds=90.0
        )
        jobs.run_to_end(jobs.prediction_messages(out), str(tmp_path / "out"), str(tmp_path / "log"), state_partitions=4)
    got = rows(jobs.read_predictions(spark.read.parquet(str(tmp_path / "out"))), "match_id", "sequence")

    held = momentum(events, span_seconds=90.0, keep=columns).withColumnsRenamed({"kills_ct": windows[0], "kills_t": windows[1]})
    want = rows(md.predict(held, trained).filter("scored"), "match_id", "sequence")
    assert [(r["match_id"], r["sequence"]) for r in got] == [(r["match_id"], r["sequence"]) for r in want]
    assert len({r["match_id"] for r in got}) == 20 and len(got) > 1000
    for r, w in zip(got, want):
        assert r["ct_win_probability"] == pytest.approx(w["ct_win_probability"], abs=1e-6)
        assert (r["round_number"], r["favoured_side"]) == (w["round_number"], w["favoured_side"])
        assert r["timestamp"] is not None and (r["latency_ms"] is None) == (r["sequence"] % 2 == 1)
        assert r["latency_ms"] is None or r["latency_ms"] > 0


def test_messages_name_every_field_and_never_wait_less_than_nothing(spark):
    from roundcast.streaming import jobs

    one = spark.range(1).select(
        F.lit("m").alias("match_id"), F.lit(1).cast("long").alias("sequence"), F.lit(None).cast("int").alias("round_number"),
        *[F.lit(0.5).alias(c) for c in ("ct_win_probability", "t_win_probability")], F.lit("even").alias("favoured_side"),
        F.lit(0.0).alias("confidence"), (F.current_timestamp() + F.expr("INTERVAL 1 DAY")).alias("arrived"),
    )
    (message,) = rows(jobs.prediction_messages(one))
    assert bytes(message["key"]) == b"m" and b'"round_number":null' in bytes(message["value"])
    (back,) = rows(jobs.read_predictions(spark.createDataFrame([(bytes(message["value"]),)], "value binary")))
    assert back["latency_ms"] == 0.0 and len(back.asDict() if hasattr(back, "asDict") else back) == 9


def test_rows_to_train_and_to_judge_are_made_once(spark, frame):
    """A row made twice counts twice; a task is tried once on this master."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    few = frame.filter("id < 2000")
    model = md.train_model(few.mapInArrow(counted, few.schema), num_rounds=1, params={"maxDepth": 2}, partitions=2)
    assert made.value == 2000
    md.validate(few.mapInArrow(counted, few.schema), model)["verdict"].collect()
    assert made.value == 4000


def test_rows_that_another_side_has_not_as_often(spark):
    """As by counts on both sides and what they do not share; each side is shuffled once."""
    kind = "match_id string, sequence long, p double"
    now = spark.createDataFrame([("a", 1, 0.5)] * 3 + [("a", 2, 0.5), ("b", 1, None), (None, 1, 0.1), ("c", 1, 0.2)], kind)
    was = spark.createDataFrame([("a", 1, 0.5)] * 2 + [("a", 2, 0.5), ("b", 1, None), (None, 1, 0.1), ("c", 1, 0.3)], kind)
    found = md.oftener(now, was, deal=("match_id", "sequence"))
    assert {(r["match_id"], r["sequence"], r["n_now"], r["n_was"]) for r in rows(found)} == {("a", 1, 3, 2), ("c", 1, 1, 0)}
    assert md.oftener(now, now, deal=("match_id", "sequence")).count() == 0
    plan = md.oftener(now, was, deal=("match_id", "sequence"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
