"""Live match state as relations: latest snapshot, history, streaks, frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundcast.functions import fixed_values as fv
from roundcast.functions.numeric import once, whole_division
from roundcast.operators.labels import upsert
from roundcast.operators.scan import (
    SEGMENT,
    SEGMENT_ROWS,
    by_position,
    last_rows,
    ranked,
    trailing_rows,
)


# --- latest state -----------------------------------------------------------------
def latest_per_match(
    df: DataFrame, match: str = "match_id", arrival: str = "sequence", columns=None
) -> DataFrame:
    """The last arrival of each match; an aggregate, so a busy match pre-combines."""
    return upsert(df, [match], [arrival], columns)


def unexpired(
    df: DataFrame, written: str, now: Column, ttl_seconds: float = fv.STATE_TTL_SECONDS
) -> DataFrame:
    """Rows whose last write is younger than the time to live."""
    expires = F.col(written).cast("timestamp") + F.make_dt_interval(
        secs=F.lit(float(ttl_seconds))
    )
    return df.filter(expires > now)


def live_matches(
    snapshots: DataFrame,
    now: Column,
    match: str = "match_id",
    written: str = "written_at",
    ttl_seconds: float = fv.STATE_TTL_SECONDS,
) -> DataFrame:
    """Ids holding an unexpired snapshot, sorted."""
    return unexpired(snapshots, written, now, ttl_seconds).select(match).orderBy(match)


# --- round history ----------------------------------------------------------------
def round_history(
    rounds: DataFrame,
    match: str = "match_id",
    round_number: str = "round_number",
    arrival: Sequence[str] = ("sequence",),
    keep: int = fv.RETAINED_ROUNDS,
) -> DataFrame:
    """Latest result per round, the last ``keep`` rounds of each match.

    A replayed round replaces its row. The cap is the feature: history holds at
    most ``keep`` rounds.
    """
    once = upsert(rounds, [match, round_number], arrival)
    return last_rows(once, [match], [F.col(round_number)], keep)


def history_summary(
    history: DataFrame,
    match: str = "match_id",
    round_number: str = "round_number",
    winner: str = "winner",
) -> DataFrame:
    """Rounds played, wins per side and the current streak.

    The streak is every round after the last one the other side won.
    """
    n, won = F.col(round_number), F.col(winner)
    packed = history.groupBy(match).agg(
        F.count(F.lit(1)).alias("rounds_played"),
        F.count_if(won == "CT").alias("ct_wins"),
        F.count_if(won == "T").alias("t_wins"),
        F.max_by(won, n).alias("streak_side"),
        F.max(F.when(won == "CT", n)).alias("__ct"),
        F.max(F.when(won == "T", n)).alias("__t"),
        # at most RETAINED_ROUNDS numbers per match
        F.collect_list(n).alias("__rounds"),
    )
    broken = F.when(F.col("streak_side") == "CT", F.col("__t")).otherwise(F.col("__ct"))
    later = F.filter(
        "__rounds", lambda r: F.col("__broken").isNull() | (r > F.col("__broken"))
    )
    run = F.size(later).cast("long")
    return (
        packed.withColumn("__broken", broken)
        .withColumn("streak_length", run)
        .drop("__ct", "__t", "__rounds", "__broken")
    )


def with_history(
    matches: DataFrame, summary: DataFrame, match: str = "match_id"
) -> DataFrame:
    """Attach the history summary; a match without rounds has an empty one."""
    joined = matches.join(summary, match, "left")
    zero = {c: 0 for c in ("rounds_played", "ct_wins", "t_wins", "streak_length")}
    return joined.fillna(zero)


def running_scoreline(
    rounds: DataFrame,
    match: str = "match_id",
    order: str = "round_number",
    score_ct: str = "score_ct",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Winner of each round from the score change; the score starts at 0.

    The previous score crosses segment borders as one carried value.
    """
    inside = Window.partitionBy(match, "__slot").orderBy(order)
    slotted = rounds.withColumn("__slot", by_position(order, segment_rows))
    ends = slotted.groupBy(match, "__slot").agg(F.max_by(score_ct, order).alias("__end"))
    carried = ends.select(
        match,
        "__slot",
        F.lag("__end").over(Window.partitionBy(match).orderBy("__slot")).alias("__carry"),
    )
    previous = F.coalesce(F.col("__lag"), F.col("__carry"), F.lit(0))
    return (
        slotted.withColumn("__lag", F.lag(score_ct).over(inside))
        .join(carried, [match, "__slot"], "left")
        .withColumn("score_before", previous)
        .withColumn(
            "round_winner",
            F.when(F.col(score_ct) > F.col("score_before"), "CT").otherwise("T"),
        )
        .drop("__slot", "__lag", "__carry")
    )


# --- samples and bounded logs -------------------------------------------------------
def systematic_sample(
    df: DataFrame,
    every: int,
    match: str = "match_id",
    order: str = "sequence",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Every n-th row of a match in order."""
    numbered = ranked(df, [match], order, "__n", segment=by_position(order, segment_rows))
    return numbered.filter(F.col("__n") % every == 0).drop("__n")


def probability_timeline(
    df: DataFrame,
    match: str = "match_id",
    sequence: str = "sequence",
    kind: str = "event_type",
    points: int = fv.TIMELINE_POINTS,
) -> DataFrame:
    """The last ``points`` predictions since the match's last round end."""
    cleared = (
        df.filter(F.col(kind) == "round_end").groupBy(match).agg(F.max(sequence).alias("__end"))
    )
    open_rows = (
        df.filter(F.col(kind) == "prediction")
        .join(cleared, match, "left")
        .filter(F.col("__end").isNull() | (F.col(sequence) > F.col("__end")))
        .drop("__end")
    )
    return last_rows(open_rows, [match], [F.col(sequence)], points)


def round_log(
    rounds: DataFrame,
    match: str = "match_id",
    sequence: str = "sequence",
    rows: int = fv.ROUND_LOG_ROWS,
) -> DataFrame:
    """The newest round results, position 1 first."""
    window = Window.partitionBy(match).orderBy(F.col(sequence).desc())
    return rounds.withColumn("position", F.row_number().over(window)).filter(
        F.col("position") <= rows
    )


# --- stability ------------------------------------------------------------------------
def recent_stability(
    df: DataFrame,
    probability: str,
    keys: Sequence[str] = ("match_id",),
    order: str | Sequence[str] = "sequence",
    samples: int = fv.STABILITY_SAMPLES,
    include_current: bool = True,
    segment_rows: int = SEGMENT_ROWS,
    block_rows: int = 1 << 17,
) -> DataFrame:
    """Add the spread (population deviation) and count of the last predictions.

    Add the epoch to ``keys`` to start over at round borders.
    """
    from roundcast.functions.scoring import settledness

    numbered = ranked(df, list(keys), order, "__rank", segment=by_position(order, segment_rows))
    back = samples - 1 if include_current else samples
    held = F.col(probability)

    def framed(function):
        def build(frame):
            window = frame if include_current else frame_before(frame)
            return function(held).over(window)

        return build

    def frame_before(_):
        return (
            Window.partitionBy(*keys, SEGMENT).orderBy("__rank").rowsBetween(-samples, -1)
        )

    out = trailing_rows(
        numbered,
        keys,
        "__rank",
        back,
        {"recent_deviation": framed(F.stddev_pop), "recent_samples": framed(F.count)},
        block_rows,
    )
    return out.withColumn(
        "stability",
        F.coalesce(settledness(F.col("recent_deviation"), F.col("recent_samples")), F.lit(1.0)),
    ).drop("__rank")


# --- throttle -------------------------------------------------------------------------
def _outline(match: str, interval: int):
    """Per segment: each first row that could be kept in it, and the last row kept then."""

    def outlined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            starts, ends = [], []
            for moments in frame["moments"]:
                us = np.asarray(moments, np.int64)
                after = np.searchsorted(us, us + interval)
                last = list(range(len(us)))
                for i in range(len(us) - 1, -1, -1):
                    if after[i] < len(us):
                        last[i] = last[after[i]]
                # the walk may also skip all early ones and begin at the first moment after them
                early = int(after[0]) + 1
                starts.append(us[:early])
                ends.append(us[np.array(last[:early])])
            yield frame[[match, "__slot"]].assign(starts=starts, ends=ends)

    return outlined


def _kept_moments(match: str, interval: int):
    """Per segment, from the last row kept before it: places of the kept moments."""

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            owners, times = [], []
            for owner, moments, entry in zip(frame[match], frame["moments"], frame["entry"], strict=True):
                us = np.asarray(moments, np.int64)
                after = np.searchsorted(us, us + interval)
                i = 0 if pd.isna(entry) else int(np.searchsorted(us, int(entry) + interval))
                while i < len(us):
                    owners.append(owner)
                    times.append(us[i])
                    i = after[i]
            yield pd.DataFrame({match: pd.Series(owners, dtype=frame[match].dtype), "us": np.array(times, np.int64)})

    return marked


def _entries(match: str, interval: int):
    """Per match, in segment order: the last time kept before each segment."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, None
        for frame in batches:
            before = []
            columns = (frame[match], frame["starts"], frame["ends"])
            for owner, starts, ends in zip(*columns):
                if owner != current:
                    current, kept = owner, None
                before.append(kept)
                at = 0
                if kept is not None:
                    at = int(np.searchsorted(starts, kept + interval, side="left"))
                if at < len(starts):
                    kept = int(ends[at])
            yield pd.DataFrame(
                {
                    match: frame[match],
                    "__slot": frame["__slot"],
                    "entry": pd.array(before, dtype="Int64"),
                }
            )

    return walk


def throttle(
    df: DataFrame,
    interval_seconds: float = fv.FRAME_INTERVAL_SECONDS,
    match: str = "match_id",
    us: str = "us",
    sequence: str = "sequence",
    segment_seconds: float | None = None,
) -> DataFrame:
    """Add ``kept``: at least the interval has passed since the last kept row, in the order of ``sequence``.

    Which row is kept depends on the one kept before, through the whole match. A kept row's time is above all times
    before it, so rows whose time was reached by an earlier row drop out first, replays among them; of rows with one
    sequence and one time a single one can be kept. What is left is cut into time segments; each reports, for every
    first row that could be kept in it, the last row kept then. Chaining those few entries per match (one small row
    per segment, a match in one task) tells each segment how it starts, and segments are marked in parallel. ``us`` is
    event time in microseconds and may step back.
    """
    interval = int(round(interval_seconds * 1_000_000))
    width = int(round((segment_seconds or interval_seconds * 1024) * 1_000_000))
    width = max(width, interval)
    types = dict(df.dtypes)
    moments = (
        df.select(match, sequence, F.col(us).alias("us"))
        .withColumn("__slot", whole_division(F.col("us"), width))
        .groupBy(match, "__slot", "us")
        .agg(F.min(sequence).alias("first"))
    )
    # the earliest row of any later time: within the segment, and in the segments after it
    within = Window.partitionBy(match, "__slot").orderBy(F.col("us").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = Window.partitionBy(match).orderBy(F.col("__slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lowest = moments.groupBy(match, "__slot").agg(F.min("first").alias("lowest"))
    later = lowest.select(match, "__slot", F.min("lowest").over(beyond).alias("later"))
    rising = (
        moments.withColumn("after", F.min("first").over(within))
        .join(later, [match, "__slot"])
        .filter(F.coalesce(F.col("first") < F.least("after", "later"), F.lit(True)))
    )
    segments = rising.groupBy(match, "__slot").agg(F.sort_array(F.collect_list("us")).alias("moments"))
    shape = f"{match} {types[match]}, __slot long, starts array<long>, ends array<long>"
    entry = (
        segments.mapInPandas(_outline(match, interval), shape)
        .repartition(match)
        .sortWithinPartitions(match, "__slot")
        .mapInPandas(
            _entries(match, interval), f"{match} {types[match]}, __slot long, entry long"
        )
    )
    times = segments.join(entry, [match, "__slot"], "left").mapInPandas(
        _kept_moments(match, interval), f"{match} {types[match]}, us long"
    )
    chosen = times.join(rising.select(match, "us", "first"), [match, "us"]).select(
        F.col(match).alias("__match"), F.col("us").alias("__us"), F.col("first").alias("__first"), F.lit(True).alias("__kept")
    )
    same = Window.partitionBy(match, sequence, us).orderBy(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]))
    return (
        df.withColumn("__copy", F.row_number().over(same))
        .join(
            chosen,
            (F.col(match) == F.col("__match")) & (F.col(sequence) == F.col("__first")) & (F.col(us) == F.col("__us")) & (F.col("__copy") == 1),
            "left",
        )
        .withColumn("kept", F.coalesce(F.col("__kept"), F.lit(False)))
        .drop("__kept", "__match", "__us", "__first", "__copy")
    )


def throttle_counters(throttled: DataFrame) -> DataFrame:
    """Rows seen, suppressed, and their share."""
    return throttled.agg(
        F.count(F.lit(1)).alias("ticks_seen"), F.count_if(~F.col("kept")).alias("throttled")
    ).withColumn(
        "throttle_rate",
        F.when(F.col("ticks_seen") > 0, F.col("throttled") / F.col("ticks_seen")).otherwise(0.0),
    )


# --- latency --------------------------------------------------------------------------
def latency_report(
    df: DataFrame,
    latency: str = "latency_ms",
    order: str | Sequence[str] = "sequence",
    samples: int = fv.LATENCY_SAMPLES,
    fractions: Sequence[float] = (0.50, 0.95, 0.99),
) -> DataFrame:
    """Mean and index percentiles of the most recent scored rows.

    The percentile is the sorted value at index min(n-1, int(f*n)). Only the last
    ``samples`` values (the feature's bound) are gathered. ``order`` names one column or several, for example time,
    match and sequence where sequences count per match.
    """
    by = [order] if isinstance(order, str) else list(order)
    recent = df.select(*by, latency).orderBy(*[F.col(c).desc() for c in by]).limit(samples)
    packed = recent.agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(latency).alias("mean_ms"),
        F.sort_array(F.collect_list(latency)).alias("__sorted"),
    )
    n = F.col("count")

    def at(fraction: float) -> Column:
        index = F.least(n - 1, F.floor(F.lit(fraction) * n)).cast("int")
        return F.when(n > 0, F.get("__sorted", index)).otherwise(0.0)

    return packed.select(
        "count",
        F.coalesce("mean_ms", F.lit(0.0)).alias("mean_ms"),
        *[at(f).alias(f"p{round(f * 100)}_ms") for f in fractions],
    )


# --- frames ---------------------------------------------------------------------------
FRAME_COLUMNS = ("type", "match_id", "sequence", "timestamp", "payload")


def frame(df: DataFrame, kind: str, payload: Sequence[Column]) -> DataFrame:
    """Tagged frames of one type; the payload is compact JSON."""
    return df.select(
        F.lit(kind).alias("type"),
        "match_id",
        "sequence",
        "timestamp",
        F.to_json(F.struct(*payload)).alias("payload"),
    )


def frame_stream(
    predictions: DataFrame | None,
    snapshots: DataFrame,
    rounds: DataFrame,
    matches: DataFrame | None = None,
    interval_seconds: float = fv.FRAME_INTERVAL_SECONDS,
) -> DataFrame:
    """All frames of all matches: predictions every tick, snapshots throttled.

    Inputs carry match_id, sequence, timestamp and a struct column ``body``.
    """
    timed = snapshots.withColumn("us", F.unix_micros(F.col("timestamp").cast("timestamp")))
    state = throttle(timed, interval_seconds).filter("kept")
    parts = [frame(state, "tick", [F.col("body.*")]), frame(rounds, "round_end", [F.col("body.*")])]
    if predictions is not None:
        parts.append(frame(predictions, "prediction", [F.col("body.*")]))
    if matches is not None:
        parts.append(frame(matches, "match_end", [F.col("body.*")]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dashboard_state(frames: DataFrame) -> DataFrame:
    """Fold frames to what a viewer sees: one row per match.

    A round end or match end clears the prediction; a snapshot that carries one of its own, as ``prediction`` in its
    payload, sets it, also after a round end, and any other snapshot keeps the last one.
    """
    kind, seq = F.col("type"), F.col("sequence")
    own = F.when(kind == "tick", F.get_json_object("payload", "$.prediction"))
    said = F.when(kind == "prediction", F.col("payload")).otherwise(own)
    # at one sequence the snapshot comes last
    place = F.when(said.isNotNull(), F.struct(seq, (kind == "tick").alias("later")))

    def newest(name: str, value: Column) -> Column:
        return F.max_by(value, F.when(kind == name, seq))

    folded = frames.groupBy("match_id").agg(
        newest("tick", F.col("payload")).alias("snapshot"),
        F.max_by(said, place).alias("__prediction"),
        F.max(F.when(said.isNotNull(), seq)).alias("__predicted_at"),
        F.max(F.when(kind.isin("round_end", "match_end"), seq)).alias("__cleared_at"),
        newest("match_end", F.col("payload")).alias("finished"),
        F.count_if(kind == "round_end").alias("rounds_ended"),
    )
    stale = F.col("__cleared_at") > F.col("__predicted_at")
    return folded.withColumn(
        "prediction", F.when(~F.coalesce(stale, F.lit(False)), F.col("__prediction"))
    ).drop("__prediction", "__predicted_at", "__cleared_at")


# --- counters -------------------------------------------------------------------------
def consumer_counters(
    df: DataFrame, valid: Column, sequence: str = "sequence", arrival: str = "arrival"
) -> DataFrame:
    """Consumed, failed, success rate (1 when nothing came) and last sequence (-1 then)."""
    return df.agg(
        F.count_if(valid).alias("events_consumed"),
        F.count_if(~valid).alias("events_failed"),
        F.coalesce(F.max_by(sequence, F.when(valid, F.col(arrival))), F.lit(-1)).alias(
            "last_sequence"
        ),
    ).withColumn(
        "success_rate",
        F.when(
            F.col("events_consumed") + F.col("events_failed") > 0,
            F.col("events_consumed") / (F.col("events_consumed") + F.col("events_failed")),
        ).otherwise(1.0),
    )


def worker_counters(ticks: DataFrame, scored: Column) -> DataFrame:
    """Ticks seen, published, skipped and the publish rate (0 when nothing came)."""
    return ticks.agg(
        F.count(F.lit(1)).alias("ticks_seen"),
        F.count_if(scored).alias("predictions_published"),
        F.count_if(~scored).alias("skipped"),
    ).withColumn(
        "publish_rate",
        F.when(
            F.col("ticks_seen") > 0, F.col("predictions_published") / F.col("ticks_seen")
        ).otherwise(0.0),
    )
