"""Ordered computations that never need a whole key in one task.

A window over one match puts that match in one task, which fails when a match
holds a large share of the data. The operators here cut every key into segments
of its order column. Inside a segment an ordinary window runs; between segments
only one summary row each is carried on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundcast.functions.numeric import whole_division

SEGMENT_ROWS = 1 << 20
SEGMENT = "__segment"
HALO = "__halo"


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` is sum, max, min or latest (last non-null)."""

    name: str
    how: str
    value: Column

    def over(self, column: Column, window) -> Column:
        if self.how == "latest":
            return F.last(column, ignorenulls=True).over(window)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.how](column).over(window)

    def total(self, column: Column, order: Column) -> Column:
        if self.how == "latest":
            return F.max_by(column, F.when(column.isNotNull(), order))
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.how](column)

    def joined(self, local: Column, carried: Column) -> Column:
        if self.how == "latest":
            return F.coalesce(local, carried)
        if self.how == "sum":
            return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
        return {"max": F.greatest, "min": F.least}[self.how](local, carried)


def by_position(order: str, rows: int = SEGMENT_ROWS) -> Column:
    """Segment of an integer order column that is unique within a key."""
    return whole_division(F.col(order), rows)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[Running],
    segment: Column | None = None,
) -> DataFrame:
    """Add inclusive running values per key in ascending ``order``.

    One window task per segment, one summary row per segment between them. The
    summaries are hash aggregates of plain columns, combined before the shuffle.
    """
    segment = by_position(order) if segment is None else segment
    hidden = {v.name: f"__in_{v.name}" for v in values}
    rows = df.withColumns({SEGMENT: segment, **{hidden[v.name]: v.value for v in values}})
    totals = rows.groupBy(*keys, SEGMENT).agg(
        *[v.total(F.col(hidden[v.name]), F.col(order)).alias(f"__tot_{v.name}") for v in values]
    )
    inside = (
        Window.partitionBy(*keys, SEGMENT)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    between = (
        Window.partitionBy(*keys)
        .orderBy(SEGMENT)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    )
    local = rows.withColumns(
        {f"__loc_{v.name}": v.over(F.col(hidden[v.name]), inside) for v in values}
    )
    carried = totals.select(
        *keys,
        SEGMENT,
        *[v.over(F.col(f"__tot_{v.name}"), between).alias(f"__car_{v.name}") for v in values],
    )
    kept = [F.col(c) for c in df.columns if c not in hidden]
    return local.join(carried, [*keys, SEGMENT], "left").select(
        *kept,
        *[
            v.joined(F.col(f"__loc_{v.name}"), F.col(f"__car_{v.name}")).alias(v.name)
            for v in values
        ],
    )


def _magnitude(v: Column) -> Column:
    """Rises with v as its logarithm does, on both sides of zero; finite for every double."""
    v = v.cast("double")
    size = F.when(F.isnan(v), 2300.0).when(F.abs(v) == float("inf"), 2200.0).when(v == 0, 0.0)
    # the smallest double is 2^-1074
    return F.when(v < 0, -1.0).otherwise(1.0) * size.otherwise(F.log2(F.abs(v)) + 1100.0)


def spread_segments(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    low: Column,
    high: Column,
    slots: int,
    rows_per_segment: int = SEGMENT_ROWS,
    name: str = "__spread",
) -> DataFrame:
    """Add a segment id that rises with ``value`` and holds few times the wanted rows.

    Slots are equal steps of the values' magnitude between ``low`` and ``high``, so that values which span many powers of
    ten spread as well as even ones, and infinite ones have a place. A slot with more rows than wanted is
    cut again between its own smallest and largest value: within a slot of k octaves, even values crowd to k / 2 times
    the mean at most. Rows are expected to be distinct per key and value, as after counting.
    """
    df = df.withColumn("__size", _magnitude(F.col(value)))
    v, wide, low = F.col("__size"), _magnitude(high) - _magnitude(low), _magnitude(low)
    raw = F.when(wide > 0, F.floor((v - low) / wide * slots)).otherwise(F.lit(0))
    slot = F.greatest(F.lit(0), F.least(F.lit(slots - 1), raw)).cast("long")
    slotted = df.withColumn("__slot", slot)
    sizes = slotted.groupBy(*keys, "__slot").agg(
        F.min("__size").alias("__from"),
        F.max("__size").alias("__to"),
        F.ceil(F.count(F.lit(1)) / rows_per_segment).cast("long").alias("__parts"),
    )
    reach = F.col("__to") - F.col("__from")
    part = F.when(
        (F.col("__parts") > 1) & (reach > 0),
        F.least(
            F.col("__parts") - 1, F.floor((v - F.col("__from")) / reach * F.col("__parts"))
        ),
    ).otherwise(F.lit(0))
    joined = slotted.join(sizes, [*keys, "__slot"])
    wide_id = F.col("__slot") * F.lit(1 << 31) + part.cast("long")
    return joined.withColumn(name, wide_id).drop("__slot", "__size", "__from", "__to", "__parts")


def trailing_range(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: str,
    span: int,
    counts: dict[str, tuple[str, Column]],
    oldest: str = "oldest",
    block: int | None = None,
) -> DataFrame:
    """Counts over the trailing time range [ts - span, ts], in arrival order.

    ``counts`` maps a result name to (its inclusive running count by arrival, the
    row's own share in it); the count in the range is the running count minus
    that of the first row inside. That row is found by merging each row's lower
    bound into the time order, so the cost does not depend on how many rows a
    range holds. Rows that arrive later are not counted, also among equal times.

    Time is cut into blocks one span long: a bound and the first row after it lie
    in the same or the next block, so one shuffle does it and a task holds two
    spans of one key. Where a key may be crowded within a span, give a shorter
    ``block``: rows are then walked back in time with a carry between blocks.
    """
    if span <= 0:
        raise ValueError("span must be positive")
    if block is not None:
        return _walked_back(df, keys, ts, span, counts, oldest, block)
    at_block = whole_division(F.col(ts), span)
    first = F.struct(
        F.col(ts).alias("ts"),
        *[(F.col(total) - share).alias(name) for name, (total, share) in counts.items()],
    )
    nothing = F.lit(None).cast(_struct_type(["ts", *counts]))

    def entry(at: Column, segment: Column, data: Column, probe: bool) -> Column:
        return F.struct(
            at.alias("at"), segment.alias("b"), F.lit(probe).alias("p"), data.alias("d")
        )

    entries = F.array(
        entry(F.col(ts) - span, at_block - 1, nothing, True),
        entry(F.col(ts), at_block - 1, first, False),
        entry(F.col(ts), at_block, first, False),
    )
    rows = df.withColumn("__e", F.explode(entries)).select(
        *[
            F.col(c) if c in (*keys, order) else F.when(F.col("__e.p"), F.col(c)).alias(c)
            for c in df.columns
        ],
        F.col("__e.at").alias("__at"),
        F.col("__e.b").alias(SEGMENT),
        F.col("__e.p").alias("__probe"),
        F.col("__e.d").alias("__first"),
    )
    partition = ", ".join(f"`{k}`" for k in (*keys, SEGMENT))
    ahead = F.expr(
        f"lead(__first) IGNORE NULLS OVER (PARTITION BY {partition} "
        f"ORDER BY __at, __probe DESC, `{order}`)"
    )
    found = rows.withColumn("__lower", ahead).filter("__probe")
    return found.select(
        *df.columns,
        *[(F.col(total) - F.col(f"__lower.{n}")).alias(n) for n, (total, _) in counts.items()],
        F.col("__lower.ts").alias(oldest),
    )


def _struct_type(names: Sequence[str]) -> str:
    return "struct<" + ",".join(f"{n}:bigint" for n in names) + ">"


def _walked_back(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    span: int,
    counts: dict[str, tuple[str, Column]],
    oldest: str,
    block: int,
) -> DataFrame:
    """``trailing_range`` with blocks of any length: smallest values seen so far, backwards."""
    ends = F.array(
        F.struct(F.col(ts).alias("at"), F.lit(False).alias("probe")),
        F.struct((F.col(ts) - span).alias("at"), F.lit(True).alias("probe")),
    )
    probe = F.col("__end.probe")
    lower = {"__low_ts": F.col(ts), **{f"__low_{n}": F.col(c) - s for n, (c, s) in counts.items()}}
    rows = df.withColumn("__end", F.explode(ends)).select(
        *[F.col(c) if c in keys else F.when(probe, F.col(c)).alias(c) for c in df.columns],
        *[F.when(~probe, value).alias(name) for name, value in lower.items()],
        F.col("__end.at").alias("__at"),
        probe.alias("__probe"),
    )
    # Walking back, a row counts for a bound at the same time: it comes first.
    late = F.when(F.col("__probe"), 0).otherwise(1)
    walked = rows.withColumn("__back", -(F.col("__at") * 2 + late))
    found = running(
        walked,
        keys,
        "__back",
        [Running(name, "min", F.col(name)) for name in lower],
        -whole_division(F.col("__at"), block),
    ).filter("__probe")
    return found.select(
        *df.columns,
        *[(F.col(total) - F.col(f"__low_{n}")).alias(n) for n, (total, _) in counts.items()],
        F.col("__low_ts").alias(oldest),
    )


def ranked(df: DataFrame, keys: Sequence[str], order: str, name: str = "rank", **kwargs):
    """Dense position 1..n of every row of a key."""
    return running(df, keys, order, [Running(name, "sum", F.lit(1).cast("long"))], **kwargs)


def trailing_rows(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    back: int,
    values: dict,
    block_rows: int = 1 << 17,
) -> DataFrame:
    """Window over the previous ``back`` rows and the current one.

    ``position`` is the dense 1..n rank of a row in its key; the last ``back``
    rows of a block are copied to the next, so blocks run apart. ``values`` maps
    a name to a function of the window.
    """
    block = whole_division(F.col(position) - 1, block_rows)
    offset = (F.col(position) - 1) % block_rows
    copies = F.when(
        offset >= block_rows - back,
        F.array(
            F.struct(block.alias("b"), F.lit(False).alias("h")),
            F.struct((block + 1).alias("b"), F.lit(True).alias("h")),
        ),
    ).otherwise(F.array(F.struct(block.alias("b"), F.lit(False).alias("h"))))
    rows = (
        df.withColumn("__copy", F.explode(copies))
        .withColumns({SEGMENT: F.col("__copy.b"), HALO: F.col("__copy.h")})
        .drop("__copy")
    )
    frame = Window.partitionBy(*keys, SEGMENT).orderBy(position).rowsBetween(-back, 0)
    return (
        rows.withColumns({name: build(frame) for name, build in values.items()})
        .filter(~F.col(HALO))
        .drop(SEGMENT, HALO)
    )


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The last ``k`` rows of each key; ``order`` lists ascending columns.

    Spark prunes to ``k`` rows per key before the shuffle (group limit), so a
    hot key sends at most k rows per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return (
        df.withColumn("__n", F.row_number().over(window)).filter(F.col("__n") <= k).drop("__n")
    )
