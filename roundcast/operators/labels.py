"""History tables: replay dedupe, upserts, the label join and the match split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundcast.session import checkpointed


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``.

    Spark keeps one row per key already before the shuffle (group limit), so a
    group of copies costs one row per map task however large it is.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def dedupe(
    df: DataFrame, keys: Sequence[str] = ("match_id", "sequence"), prefer: Sequence[str] = ()
) -> DataFrame:
    """One row per key: the smallest by ``prefer``, then by the other columns.

    All columns break ties, so the survivor does not depend on the input order. The rows are dealt first, by what is no
    key: the group limit sorts all rows of a task before the shuffle, and a split of a well-packed file holds millions,
    which spill. Adaptive execution holds the dealt parts to its advisory size, those of many equal rows too.
    """
    rest = [c for c in df.columns if c not in keys and c not in prefer]
    dealt = df.hint("rebalance", *[F.col(c) for c in (*prefer, *rest)])
    return first_per_key(dealt, keys, [F.col(c).asc_nulls_first() for c in (*prefer, *rest)])


def upsert(
    df: DataFrame, keys: Sequence[str], arrival: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Last arrival per key; every other column comes from that one row.

    ``arrival`` must order the rows of a key totally.
    """
    columns = list(columns or [c for c in df.columns if c not in keys])
    needed = df.select(*dict.fromkeys([*keys, *columns, *arrival]))
    newest = first_per_key(needed, keys, [F.col(c).desc() for c in arrival])
    return newest.select(*keys, *columns)


def label_ticks(
    ticks: DataFrame,
    rounds: DataFrame,
    on: Sequence[str] = ("match_id", "round_number"),
    winner: str = "winner",
    reason: str = "reason",
    phase: str | None = "phase",
    side: str = "CT",
    label: str = "ct_won",
) -> DataFrame:
    """Attach each tick's round outcome; ticks of unfinished rounds drop out.

    Freeze-time ticks are left out after the dedupe (``phase=None`` keeps them).
    The join side is left to the optimizer: rounds broadcast only below the
    session threshold, and adaptive execution splits a skewed match.
    """
    outcome = rounds.select(
        *on, F.col(winner).alias("round_winner"), F.col(reason).alias("round_reason")
    )
    kept = ticks if phase is None else ticks.filter(F.col(phase) != "freezetime")
    labelled = kept.join(outcome, list(on), "inner")
    return labelled.select(
        *ticks.columns,
        "round_winner",
        "round_reason",
        (F.col("round_winner") == side).cast("int").alias(label),
    )


def training_frame(df: DataFrame, order: Sequence[str] = ("match_id", "sequence")) -> DataFrame:
    """The labelled rows in their contractual total order (a range-partitioned sort)."""
    return df.orderBy(*order)


def label_balance(df: DataFrame, label: str = "ct_won", by: Sequence[str] = ()) -> DataFrame:
    """Rows won by each side; zeros when there are none."""
    won = F.coalesce(F.sum(F.col(label)), F.lit(0))
    return df.groupBy(*by).agg(
        won.cast("long").alias("ct_rows"), (F.count(F.lit(1)) - won).cast("long").alias("t_rows")
    )


def holdout_boundary(df: DataFrame, match: str, fraction: float, take: str = "ceil_one") -> tuple:
    """(first held-out id, number of ids, number held out) in id order.

    The distinct ids are sorted once into the shared folder; only one count per
    sorted partition reaches the driver, then one id.
    """
    if not 0.0 < fraction < 1.0:
        raise ValueError("the held-out fraction must be between 0 and 1")
    ids = checkpointed(
        df.select(match).distinct().sort(match).withColumn("__part", F.spark_partition_id())
    )
    sizes = sorted(
        (r["__part"], r["count"]) for r in ids.groupBy("__part").count().toLocalIterator()
    )
    total = sum(n for _, n in sizes)
    if total < 2:
        raise ValueError("a split by match needs at least two matches")
    held = max(1, round(total * fraction)) if take == "ceil_one" else int(total * fraction)
    skip = total - held if take == "ceil_one" else held
    for part, n in sizes:
        if skip < n:
            inside = ids.filter(F.col("__part") == part).sort(match).offset(skip).limit(1)
            return inside.first()[match], total, held
        skip -= n
    raise ValueError("the split leaves no match on one side")


def split_by_match(
    df: DataFrame, match: str = "match_id", fraction: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """Train and test along match boundaries; the last ids are held out.

    Held-out ids are a suffix of the id order, so both sides are plain range
    filters and no id set is shuffled or broadcast.
    """
    first, _, _ = holdout_boundary(df, match, fraction)
    return df.filter(F.col(match) < F.lit(first)), df.filter(F.col(match) >= F.lit(first))


def split_for_calibrator(
    test: DataFrame, match: str = "match_id", share: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """First share of the held-out matches fits the calibrator, the rest reports."""
    first, _, _ = holdout_boundary(test, match, share, take="floor")
    return test.filter(F.col(match) < F.lit(first)), test.filter(F.col(match) >= F.lit(first))


def drop_matches(df: DataFrame, ids: DataFrame, match: str = "match_id") -> DataFrame:
    """Remove the state of the given matches."""
    return df.join(ids.select(match), match, "left_anti")
