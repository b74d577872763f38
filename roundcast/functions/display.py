"""Presentation columns: economy bars, clocks, labels and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roundcast.functions import fixed_values as fv
from roundcast.functions.numeric import lookup


def loss_bonus(losses: Column) -> Column:
    """Per-player payout after ``losses`` straight defeats, capped at the ladder's top."""
    ladder = F.array(*[F.lit(v) for v in fv.LOSS_LADDER])
    step = F.least(losses, F.lit(len(fv.LOSS_LADDER))).cast("int")
    return F.when(losses <= 0, F.lit(0)).otherwise(F.get(ladder, step - 1))


def full_buy(money: Column) -> Column:
    return money >= fv.FULL_BUY_PER_PLAYER * fv.PLAYERS_PER_TEAM


def buy_badge(money: Column) -> Column:
    return F.when(full_buy(money), "full buy").otherwise("limited")


def comparison_share(ct: Column, t: Column) -> Column:
    """CT's share of a total in percent; two empty sides are an even split."""
    return F.when(ct + t > 0, ct / (ct + t) * 100.0).otherwise(50.0)


def active_clock(seconds: Column, planted: Column, bomb_seconds: Column) -> Column:
    """The bomb timer replaces the round clock once the bomb is down."""
    return F.when(planted & bomb_seconds.isNotNull(), bomb_seconds).otherwise(seconds)


def urgent(planted: Column, bomb_seconds: Column) -> Column:
    return planted & bomb_seconds.isNotNull() & (bomb_seconds <= 10)


def clock_label(seconds: Column) -> Column:
    whole = F.greatest(F.lit(0), F.floor(seconds).cast("int"))
    return F.concat(
        F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0")
    )


def map_label(map_name: Column) -> Column:
    bare = F.regexp_replace(map_name, "^de_", "")
    return F.concat(F.upper(F.substring(bare, 1, 1)), bare.substr(F.lit(2), F.length(bare)))


def health_band(health: Column) -> Column:
    return F.when(health > 60, "healthy").when(health > 25, "hurt").otherwise("critical")


def weapon_label(weapon: Column) -> Column:
    """Display name; an unknown slug stays as it is, no weapon is a dash."""
    known = F.coalesce(lookup(fv.WEAPON_LABEL, weapon), weapon)
    return F.when(weapon.isNull() | (weapon == ""), F.lit("—")).otherwise(known)


def reason_label(reason: Column) -> Column:
    return lookup(fv.REASON_LABEL, reason)


def reliability_label(bin_index: Column, bins: int = fv.CALIBRATION_BINS) -> Column:
    """Percentage band of a calibration bin, such as 60%-70%."""
    edges = [f"{i / bins:.0%}" for i in range(bins + 1)]
    names = {i: f"{edges[i]}-{edges[i + 1]}" for i in range(bins)}
    return lookup(names, bin_index)


def opponent(team: Column) -> Column:
    return F.when(team == "CT", "T").otherwise("CT")


def loadout_value(weapon: Column, armour: Column, helmet: Column, kit: Column) -> Column:
    """Money tied up in a player's weapon, armour and kit."""
    gun = F.coalesce(lookup(fv.WEAPON_COST, weapon), F.lit(0))
    vest = (
        F.when(helmet, fv.KEVLAR_HELMET_COST).when(armour > 0, fv.KEVLAR_COST).otherwise(F.lit(0))
    )
    return gun + vest + F.when(kit, fv.DEFUSE_KIT_COST).otherwise(F.lit(0))


def legal_weapon(team: Column, weapon: Column) -> Column:
    """Whether the side can buy the weapon."""
    allowed = [weapon.isin(*names) & (team == side) for side, names in fv.SIDE_WEAPONS.items()]
    return allowed[0] | allowed[1]
