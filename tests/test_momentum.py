from __future__ import annotations

import random
from datetime import timedelta

import pytest
from telemetry_rows import BASE, at, rows

from roundcast.operators import momentum as mo

SCHEMA = (
    "match_id string, sequence long, timestamp timestamp, event_type string, victim_team string, "
    "headshot boolean, round_number int"
)


def frame(spark, items):
    return spark.createDataFrame(items, SCHEMA).repartition(3)


def ev(seq, seconds, kind, victim="T", hs=False, match="m", rnd=1):
    return (match, seq, at(seconds), kind, victim, hs, rnd)


def fold(items, span):
    """The live window written down plainly."""
    state, out = {}, {}
    for match, seq, ts, kind, victim, hs, _ in sorted(items, key=lambda r: r[1]):
        kills, ticks = state.setdefault(match, ([], []))
        if kind in ("round_start", "match_end"):
            state[match] = ([], [])
        if kind not in ("kill", "tick"):
            continue
        mine = kills if kind == "kill" else ticks
        mine.append((ts, victim, hs))
        while mine[0][0] < ts - timedelta(seconds=span):
            mine.pop(0)
        if kind == "tick":
            spans = [(w[-1][0] - w[0][0]).total_seconds() if len(w) > 1 else 0.0 for w in (kills, ticks)]
            ct = sum(1 for k in kills if k[1] == "T")
            out[(match, seq)] = (
                ct, len(kills) - ct, sum(1 for k in kills if k[2]), len(ticks), max(spans),
            )
    return out


def values(df):
    names = ("kills_ct", "kills_t", "headshots", "ticks", "window_seconds")
    return {(r["match_id"], r["sequence"]): tuple(r[c] for c in names) for r in rows(df)}


@pytest.mark.parametrize("seed,width", [(1, 1 << 20), (2, 11), (3, 64)])
def test_equals_the_live_fold_on_random_matches(spark, seed, width):
    rng = random.Random(seed)
    items, seq, t = [], 0, 0.0
    for _ in range(500):
        seq += 1
        t += rng.choice([0.0, 0.0, 0.5, 2.0, 9.0])
        kind = rng.choices(
            ["tick", "kill", "round_start", "round_end", "match_end"], [10, 5, 1, 1, 0.5]
        )[0]
        items.append(
            ev(seq, t, kind, rng.choice(["CT", "T"]), rng.random() < 0.4, rng.choice(["h", "h", "b"]))
        )
    got = mo.momentum(frame(spark, items), span_seconds=6.0, segment_rows=width)
    assert values(got) == fold(items, 6.0)


def test_a_kill_stays_through_later_ticks(spark):
    items = [ev(0, 0, "kill")] + [ev(i, i * 2, "tick") for i in range(1, 51)]
    got = values(mo.momentum(frame(spark, items)))
    assert got[("m", 50)][0] == 1


def test_old_kills_leave_when_a_newer_kill_arrives(spark):
    items = [ev(0, 0, "kill"), ev(1, 5, "kill"), ev(2, 20, "kill"), ev(3, 20, "tick")]
    assert values(mo.momentum(frame(spark, items), span_seconds=10))[("m", 3)][:2] == (1, 0)


def test_reset_only_at_round_start_and_after_match_end(spark):
    items = [
        ev(0, 0, "kill", rnd=1),
        ev(1, 1, "round_end", rnd=1),
        ev(2, 2, "tick", rnd=2),
        ev(3, 3, "round_start", rnd=2),
        ev(4, 4, "tick", rnd=2),
        ev(5, 5, "kill"),
        ev(6, 6, "match_end"),
        ev(7, 7, "tick"),
    ]
    got = values(mo.momentum(frame(spark, items)))
    assert [got[("m", s)][0] for s in (2, 4, 7)] == [1, 0, 0]


def test_world_damage_counts_for_the_other_side(spark):
    items = [ev(0, 0, "kill", victim="CT", hs=None), ev(1, 1, "tick")]
    assert values(mo.momentum(frame(spark, items)))[("m", 1)][:3] == (0, 1, 0)


def test_span_bounds_and_errors(spark):
    with pytest.raises(ValueError):
        mo.momentum(frame(spark, [ev(0, 0, "tick")]), span_seconds=0)
    one = values(mo.momentum(frame(spark, [ev(0, 0, "tick")])))
    assert one[("m", 0)] == (0, 0, 0, 1, 0.0)


def test_disordered_epochs_follow_arrival_order(spark):
    rng = random.Random(5)
    items = []
    for seq in range(300):
        jitter = rng.choice([0, 0, -7.0]) if 100 <= seq < 200 else 0
        kind = "round_start" if seq % 50 == 0 else rng.choice(["tick", "tick", "kill"])
        items.append(ev(seq, seq * 1.5 + jitter, kind, rng.choice(["CT", "T"])))
    df = frame(spark, items)
    bad = {r["epoch"] for r in rows(mo.disordered_epochs(df, segment_rows=16))}
    assert bad and bad <= {3, 4, 5}
    got = mo.momentum_by_arrival(df, span_seconds=5.0, segment_rows=16)
    assert values(got) == fold(items, 5.0)


@pytest.mark.parametrize("width", [2, 1 << 20])
def test_current_round_and_epoch(spark, width):
    items = [
        ev(0, 0, "kill", rnd=9),
        ev(1, 1, "round_start", rnd=1),
        ev(2, 2, "kill", rnd=9),
        ev(3, 3, "tick", rnd=2),
        ev(4, 4, "match_end"),
        ev(5, 5, "kill", rnd=9),
    ]
    df = frame(spark, items)
    got = [r["current_round"] for r in rows(mo.current_round(df, segment_rows=width), "sequence")]
    assert got == [None, 1, 1, 2, 2, None]
    epochs = [r["epoch"] for r in rows(mo.epochs(df, segment_rows=width), "sequence")]
    assert epochs == [0, 1, 1, 1, 1, 2]
    assert BASE == at(0)
