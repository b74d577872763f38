"""Sliding momentum per match: kill and tick windows, epochs, current round.

Rules kept from the live window: it empties at a round start and after a match
end, and each kind evicts only when a row of its own kind arrives. So the kill
window is anchored on the newest kill, not on the tick that reads it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundcast.functions import fixed_values as fv
from roundcast.functions.numeric import micros
from roundcast.operators.scan import SEGMENT_ROWS, Running, by_position, running, trailing_range

KILL_VALUES = ("kills_ct", "kills_t", "headshots", "kill_span")


def _epoch_step(kind: Column) -> Column:
    return F.when(kind.isin("round_start", "match_end"), 1).otherwise(0).cast("long")


def _own_epoch(kind: Column, crossed: Column) -> Column:
    """A match end still belongs to the epoch it closes."""
    return crossed - F.when(kind == "match_end", 1).otherwise(0)


def epochs(
    events: DataFrame,
    match: str = "match_id",
    sequence: str = "sequence",
    kind: str = "event_type",
    name: str = "epoch",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add the number of window resets each event has behind it."""
    counted = running(
        events,
        [match],
        sequence,
        [Running(name, "sum", _epoch_step(F.col(kind)))],
        segment=by_position(sequence, segment_rows),
    )
    return counted.withColumn(name, _own_epoch(F.col(kind), F.col(name)))


def current_round(
    events: DataFrame,
    match: str = "match_id",
    sequence: str = "sequence",
    kind: str = "event_type",
    round_number: str = "round_number",
    name: str = "current_round",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Round as of each event: set by a round start or a tick, unknown after a match end."""
    k = F.col(kind)
    # A match end closes the window after itself, so its marker sits half a step
    # later: the previous row's state is read for the match end row itself.
    mark = (
        F.when(k.isin("round_start", "tick"), F.col(round_number).cast("long"))
        .when(k == "match_end", F.lit(-1).cast("long"))
    )
    values = [
        Running(name, "latest", mark),
        Running("__before_end", "latest", F.when(k != "match_end", mark)),
    ]
    out = running(events, [match], sequence, values, by_position(sequence, segment_rows))
    seen = F.when(k == "match_end", F.col("__before_end")).otherwise(F.col(name))
    return out.withColumn(name, F.when(seen >= 0, seen).cast("int")).drop("__before_end")


def momentum(
    events: DataFrame,
    match: str = "match_id",
    sequence: str = "sequence",
    ts: str = "timestamp",
    kind: str = "event_type",
    victim: str = "victim_team",
    headshot: str = "headshot",
    keep: Sequence[str] = (),
    span_seconds: float = fv.MOMENTUM_SECONDS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Window values at every tick.

    Returns match, sequence, ``keep`` columns, epoch, kills_ct, kills_t,
    headshots, ticks and window_seconds. Event time must not run backwards
    inside an epoch; ``disordered_epochs`` finds those that do and
    ``momentum_by_arrival`` computes them.
    """
    if span_seconds <= 0:
        raise ValueError(f"a window of {span_seconds} seconds holds nothing")
    span = int(round(span_seconds * 1_000_000))
    segment = by_position(sequence, segment_rows)
    narrow = events.filter(
        F.col(kind).isin("tick", "kill", "round_start", "match_end")
    ).select(
        match,
        sequence,
        *[c for c in keep if c not in (match, sequence)],
        micros(F.col(ts)).alias("__us"),
        F.col(kind).alias("__kind"),
        (F.col(victim) == "T").cast("long").alias("__ct"),
        F.coalesce(F.col(headshot), F.lit(False)).cast("long").alias("__hs"),
    )
    extra = [c for c in keep if c not in (match, sequence)]

    # Kills and resets are few; their windows never touch the dense ticks.
    marks = narrow.filter(F.col("__kind") != "tick")
    is_kill = F.when(F.col("__kind") == "kill", 1).otherwise(0).cast("long")
    killed = running(
        marks,
        [match],
        sequence,
        [
            Running("__crossed", "sum", _epoch_step(F.col("__kind"))),
            Running("__sum_ct", "sum", is_kill * F.coalesce(F.col("__ct"), F.lit(0))),
            Running("__sum_hs", "sum", is_kill * F.col("__hs")),
            Running("__sum_all", "sum", is_kill),
        ],
        segment,
    ).filter(F.col("__kind") == "kill")
    own_ct = F.coalesce(F.col("__ct"), F.lit(0))
    windowed = trailing_range(
        killed,
        [match, "__crossed"],
        "__us",
        sequence,
        span,
        {
            "kills_ct": ("__sum_ct", own_ct),
            "headshots": ("__sum_hs", F.col("__hs")),
            "__kills": ("__sum_all", F.lit(1).cast("long")),
        },
    ).withColumns(
        {
            "kills_t": F.col("__kills") - F.col("kills_ct"),
            "kill_span": F.col("__us") - F.col("oldest"),
        }
    )
    base = [match, sequence, *extra, "__us", "__kind"]
    resets = narrow.filter(F.col("__kind").isin("round_start", "match_end"))
    ticks = narrow.filter(F.col("__kind") == "tick")
    # As-of: each tick reads the newest kill's window; a reset reads as zero.
    lanes = (
        ticks.select(*base, *[F.lit(None).cast("long").alias(c) for c in KILL_VALUES])
        .unionByName(windowed.select(*base, *KILL_VALUES))
        .unionByName(
            resets.select(*base, *[F.lit(0).cast("long").alias(c) for c in KILL_VALUES])
        )
    )
    one_tick = F.when(F.col("__kind") == "tick", 1).otherwise(0).cast("long")
    seen = running(
        lanes,
        [match],
        sequence,
        [
            Running("epoch", "sum", _epoch_step(F.col("__kind"))),
            Running("__sum_ticks", "sum", one_tick),
            *[Running(c, "latest", F.col(c)) for c in KILL_VALUES],
        ],
        segment,
    ).filter(F.col("__kind") == "tick")
    timed = trailing_range(
        seen,
        [match, "epoch"],
        "__us",
        sequence,
        span,
        {"ticks": ("__sum_ticks", F.lit(1).cast("long"))},
    )
    tick_span = F.col("__us") - F.col("oldest")
    kill_span = F.coalesce(F.col("kill_span"), F.lit(0))
    return timed.select(
        match,
        sequence,
        *extra,
        "epoch",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("kills_ct", "kills_t", "headshots")],
        "ticks",
        (F.greatest(tick_span, kill_span) / 1_000_000.0).alias("window_seconds"),
    )


def disordered_epochs(
    events: DataFrame,
    match: str = "match_id",
    sequence: str = "sequence",
    ts: str = "timestamp",
    kind: str = "event_type",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """(match, epoch) pairs in which event time runs backwards at least once."""
    timed = epochs(
        events.select(match, sequence, kind, micros(F.col(ts)).alias("__us")),
        match,
        sequence,
        kind,
        segment_rows=segment_rows,
    ).filter(F.col(kind).isin("tick", "kill"))
    newest = running(
        timed,
        [match, "epoch"],
        sequence,
        [Running("__newest", "max", F.col("__us"))],
        segment=by_position(sequence, segment_rows),
    )
    return newest.filter(F.col("__us") < F.col("__newest")).select(match, "epoch").distinct()


def momentum_by_arrival(
    events: DataFrame,
    match: str = "match_id",
    sequence: str = "sequence",
    ts: str = "timestamp",
    kind: str = "event_type",
    victim: str = "victim_team",
    headshot: str = "headshot",
    span_seconds: float = fv.MOMENTUM_SECONDS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """``momentum`` without the ordering requirement.

    Ordered epochs take the window plan. A disordered epoch depends on arrival
    order row by row; its rows stream through a fold that holds one window.
    """
    from roundcast.streaming.window_state import fold_epochs

    names = dict(match=match, sequence=sequence, kind=kind, segment_rows=segment_rows)
    bad = disordered_epochs(events, ts=ts, **names)
    tagged = epochs(events, **names)
    ordered = momentum(
        tagged.join(bad, [match, "epoch"], "left_anti").unionByName(
            # resets keep the epoch count right even where an epoch left the plan
            tagged.join(bad, [match, "epoch"], "left_semi").filter(
                F.col(kind).isin("round_start", "match_end")
            )
        ),
        victim=victim,
        headshot=headshot,
        ts=ts,
        span_seconds=span_seconds,
        **names,
    )
    folded = (
        tagged.join(bad, [match, "epoch"], "left_semi")
        .filter(F.col(kind).isin("tick", "kill"))
        .select(
            match,
            "epoch",
            sequence,
            micros(F.col(ts)).alias("us"),
            F.col(kind).alias("kind"),
            (F.col(victim) == "T").alias("ct"),
            F.coalesce(F.col(headshot), F.lit(False)).alias("hs"),
        )
    )
    schema = (
        f"{match} {dict(events.dtypes)[match]}, {sequence} long, epoch long, kills_ct long, "
        "kills_t long, headshots long, ticks long, window_seconds double"
    )
    slow = (
        folded.repartition(match, "epoch")
        .sortWithinPartitions(match, "epoch", sequence)
        .mapInPandas(fold_epochs(match, sequence, int(round(span_seconds * 1_000_000))), schema)
    )
    return ordered.unionByName(slow)
