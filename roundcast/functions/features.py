"""The model's fifteen bounded inputs, defined once for training and serving."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundcast.functions import fixed_values as fv
from roundcast.functions.numeric import balance, clamp

MOMENTUM_COLUMNS = ("kills_ct_window", "kills_t_window", "window_seconds")


def feature_expressions(
    names: Mapping[str, str] | None = None,
    missing: Sequence[str] = (),
    with_momentum: bool = True,
) -> list[Column]:
    """One aliased Column per feature, in training order.

    ``names`` maps a tick column to the caller's column; ``missing`` lists tick
    columns the input does not have (older files), which read as zero.
    """
    names = dict(names or {})

    def num(column: str) -> Column:
        if column in missing:
            return F.lit(0.0)
        return F.col(names.get(column, column)).cast("double")

    def momentum(column: str) -> Column:
        return F.coalesce(num(column), F.lit(0.0)) if with_momentum else F.lit(0.0)

    team = float(fv.PLAYERS_PER_TEAM)
    alive_ct, alive_t = num("alive_ct"), num("alive_t")
    score_ct, score_t = num("score_ct"), num("score_t")
    kills_ct, kills_t, span = (momentum(c) for c in MOMENTUM_COLUMNS)
    pace = F.when(span > 0, (kills_ct + kills_t) / span).otherwise(0.0)
    ladder = float(len(fv.LOSS_LADDER))

    by_name = {
        "alive_ct": alive_ct / team,
        "alive_t": alive_t / team,
        "alive_delta": clamp((alive_ct - alive_t) / team),
        "alive_ratio": balance(alive_ct, alive_t),
        "health_ratio": balance(num("health_ct"), num("health_t")),
        "time_fraction": clamp(num("seconds_remaining") / fv.ROUND_SECONDS, 0.0, 1.0),
        "bomb_planted": num("bomb_planted"),
        "bomb_time_fraction": clamp(
            F.coalesce(num("bomb_seconds"), F.lit(0.0)) / fv.BOMB_SECONDS, 0.0, 1.0
        ),
        "money_ratio": balance(num("money_ct"), num("money_t")),
        "equipment_ratio": balance(num("equipment_ct"), num("equipment_t")),
        "loss_streak_delta": clamp((num("losses_ct") - num("losses_t")) / ladder),
        "score_delta": clamp((score_ct - score_t) / fv.ROUNDS_TO_WIN),
        "round_fraction": clamp((score_ct + score_t) / fv.REGULATION_ROUNDS, 0.0, 1.0),
        "kill_delta_window": clamp((kills_ct - kills_t) / team),
        "engagement_pace": clamp(pace, 0.0, 1.0),
    }
    return [by_name[name].alias(name) for name in fv.FEATURES]


def feature_frame(
    df: DataFrame,
    keep: Sequence[Column | str] = (),
    names: Mapping[str, str] | None = None,
    with_momentum: bool = True,
) -> DataFrame:
    """``keep`` columns followed by the fifteen features."""
    held = set(df.columns)
    resolved = {c: (names or {}).get(c, c) for c in MOMENTUM_COLUMNS}
    missing = [c for c, actual in resolved.items() if actual not in held]
    return df.select(*keep, *feature_expressions(names, missing, with_momentum))


def training_set(
    df: DataFrame, label: str = "ct_won", keep: Sequence[Column | str] = (), **kwargs
) -> DataFrame:
    """Features plus the integer label; raw ticks without a label are an error."""
    if label not in df.columns:
        raise KeyError(f"{label!r} is missing: label the ticks with their rounds first")
    return feature_frame(df, [*keep, F.col(label).cast("int").alias(label)], **kwargs)


def scoreable(phase: Column) -> Column:
    """Only a running round has a probability that can move."""
    return phase.isin(*fv.SCOREABLE_PHASES)


def live(phase: Column) -> Column:
    return phase != "over"


def situations(names: Mapping[str, str] | None = None) -> dict[str, Column]:
    """Overlapping match situations, each a predicate over tick columns."""
    names = dict(names or {})

    def c(column: str) -> Column:
        return F.col(names.get(column, column))

    clock, planted = c("seconds_remaining"), c("bomb_planted")
    ct, t = c("alive_ct"), c("alive_t")
    kit_ct, kit_t = c("equipment_ct"), c("equipment_t")
    return {
        "early round": clock > 80,
        "mid round": (clock > 30) & (clock <= 80),
        "late round": (clock <= 30) & ~planted,
        "post-plant": planted,
        "even manpower": ct == t,
        "ct ahead": ct > t,
        "t ahead": t > ct,
        "lopsided": F.abs(ct - t) >= 3,
        "clutch": F.least(ct, t) <= 1,
        "full buy": F.least(kit_ct, kit_t) > 20_000,
        "eco round": F.least(kit_ct, kit_t) < 10_000,
    }


def situation_tags(predicates: Mapping[str, Column], overall: str | None = None) -> Column:
    """Array of the names of all situations a row belongs to."""
    tags = [F.when(p, F.lit(name)) for name, p in predicates.items()]
    if overall:
        tags.append(F.lit(overall))
    return F.array_compact(F.array(*tags))
