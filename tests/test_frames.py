"""Live frames and views over several micro-batches, against a plain fold."""

from __future__ import annotations

import random

import pytest
from telemetry_rows import at

from roundcast.streaming import jobs
from roundcast.streaming.frames import stream_frames, stream_view

SCHEMA = "match_id string, sequence long, timestamp timestamp, event_type string, prediction double, payload string"


def events(seed):
    """Three arrivals of shuffled rows with steps back in time, the last one a replay of the first."""
    rng = random.Random(seed)
    parts, t = [[], []], 0.0
    for seq in range(160):
        t += rng.choice([0.0, 0.05, 0.1, 0.4])
        kind = rng.choices(["tick", "kill", "round_end", "match_end"], [12, 2, 2, 0.6])[0]
        p = None if rng.random() < 0.2 else round(rng.random(), 3)
        parts[seq // 80].append((rng.choice("abc"), seq, at(t - (1.0 if rng.random() < 0.1 else 0.0)), kind, p, f"{kind}-{seq}"))
    for part in parts:
        rng.shuffle(part)
    return [*parts, parts[0]]


def fold(parts, timeline, log):
    frames, views = [], {}
    for part in parts:
        for match in "abc":
            last, view = views.get(match, (None, dict(ended=False, rounds=0, snapshot=None, prediction=None, timeline=[], log=[])))
            for _, seq, ts, kind, p, payload in sorted((r for r in part if r[0] == match), key=lambda r: r[1]):
                own = []
                if kind == "tick":
                    if p is not None:
                        own.append(("prediction", p))
                    if last is None or (ts - last).total_seconds() >= 0.25:
                        last = ts
                        own.append(("tick", payload))
                elif kind != "kill":
                    own.append((kind, payload))
                    last = None if kind == "match_end" else last
                for name, content in own:
                    frames.append((match, seq, name, content))
                    if view["ended"]:
                        continue
                    if name == "prediction":
                        view["prediction"] = content
                        view["timeline"].append(content)
                    elif name == "tick":
                        view["snapshot"] = content
                    elif name == "round_end":
                        view.update(prediction=None, timeline=[], rounds=view["rounds"] + 1)
                        view["log"].insert(0, content)
                    else:
                        view["ended"] = True
            view["timeline"], view["log"] = view["timeline"][-timeline:], view["log"][:log]
            views[match] = (last, view)
    return sorted(frames), {m: v for m, (_, v) in views.items()}


@pytest.mark.parametrize("seed", [1, 4])
def test_frames_and_views_as_folded(spark, tmp_path, seed):
    jobs.configure_state(spark)
    parts = events(seed)
    want, views = fold(parts, 5, 3)
    assert any(f[2] == "match_end" for f in want)
    folder, out, view = (str(tmp_path / n) for n in ("in", "out", "view"))
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(folder)
        stream = jobs.read_table_stream(spark, folder, "*.parquet")
        jobs.run_to_end(stream_frames(stream), out, f"{out}-log", state_partitions=2)
        stream = jobs.read_table_stream(spark, folder, "*.parquet")
        seen = stream_view(stream, timeline=5, log=3)
        jobs.run_batches(seen, jobs.write_updates(view, "0"), f"{view}-log", "update", state_partitions=2)
    got = [(r.match_id, r.sequence, r.type, r.prediction if r.type == "prediction" else r.payload) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == want
    for r in jobs.read_updates(spark, view, ["match_id"]).collect():
        w = views[r.match_id]
        assert (r.ended, r.rounds_ended, r.snapshot, r.prediction) == (w["ended"], w["rounds"], w["snapshot"], w["prediction"])
        assert r.timeline_predictions == w["timeline"] and len(r.timeline) == len(w["timeline"]) and r.log == w["log"]


def test_negative_interval(spark):
    rows = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        stream_frames(rows, interval_seconds=-1)
