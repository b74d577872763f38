"""Rows and events that the tests share."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

BASE = datetime(2026, 1, 1, 12, 0, 0, tzinfo=UTC)


def at(seconds: float) -> datetime:
    return BASE + timedelta(seconds=seconds)


def rows(df, *order):
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=lambda r: tuple(r[c] for c in order)) if order else out


def player(i: int, team: str, **over) -> dict:
    base = dict(
        player_id=f"{team}-{i}", name=f"{team} {i}", team=team, health=100, armour=100,
        has_helmet=False, has_defuse_kit=False, money=800, primary_weapon="ak47",
        position=dict(x=1.0, y=2.0, z=3.0), kills=0, deaths=0, assists=0, damage_dealt=0,
    )
    return {**base, **over}


def state(**over) -> dict:
    base = dict(
        match_id="m1", map_name="de_mirage", timestamp="2026-01-01T12:00:00Z", score_ct=3, score_t=5,
        round_state=dict(
            round_number=3, phase="live", seconds_remaining=60.0, bomb_planted=False,
            bomb_seconds_remaining=None, bomb_position=None,
        ),
        players=[player(i, "CT") for i in range(5)] + [player(i, "T") for i in range(5)],
        economy_ct=dict(team="CT", money=5000, equipment_value=12000, consecutive_losses=0),
        economy_t=dict(team="T", money=4000, equipment_value=9000, consecutive_losses=2),
    )
    return {**base, **over}


def event(kind: str, **over) -> dict:
    extra = {
        "match_start": dict(map_name="de_nuke", team_ct_name="a", team_t_name="b"),
        "round_start": dict(round_number=1, score_ct=0, score_t=0),
        "tick": dict(state=state()),
        "kill": dict(
            round_number=1, killer_id="a", victim_id="b", assister_id=None, weapon="ak47",
            headshot=True, victim_team="T", position=None,
        ),
        "bomb_planted": dict(round_number=1, planter_id="a", site="A", position=None),
        "bomb_defused": dict(round_number=1, defuser_id="a", seconds_remaining=4.5),
        "round_end": dict(
            round_number=1, winner="CT", reason="t_eliminated", score_ct=1, score_t=0
        ),
        "match_end": dict(winner="T", score_ct=3, score_t=13),
    }[kind]
    base = dict(match_id="m1", timestamp="2026-01-01T12:00:00Z", sequence=1, event_type=kind)
    return {**base, **extra, **over}
