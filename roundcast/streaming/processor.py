"""Per-match momentum as stateful processing: the streaming twin of ``momentum``."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roundcast.functions import fixed_values as fv
from roundcast.functions.numeric import micros
from roundcast.streaming.window_state import VALUES, MatchWindows, Trail

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Bounded runs end although time-to-live state asks for processing time.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class MomentumProcessor(StatefulProcessor):
    """Keeps one match's kill and tick windows, its epoch and current round.

    Rows of one micro-batch are folded in sequence order; across batches the arrival order counts, so a late event is
    folded late. The input's admission limit bounds a micro-batch. State is one window of one match; nothing of it is
    left after a match end, where epochs start at 0 again, or after the time to live.
    """

    def __init__(self, span: int, keep: tuple[str, ...], ttl_seconds: float | None):
        self.span, self.keep = span, keep
        self.ttl = None if ttl_seconds is None else int(ttl_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        window = "us array<long>, ct array<long>, hs array<long>"
        self.kills = handle.getValueState("kills", window, self.ttl)
        self.ticks = handle.getValueState("ticks", window, self.ttl)
        self.marks = handle.getValueState("marks", "epoch long, round int", self.ttl)

    def _load(self, state) -> Trail:
        # each call to a state goes to the JVM and back, so a missing value is told by the same call that gets it
        held = state.get()
        return Trail(self.span) if held is None else Trail(self.span, *map(list, held))

    def handleInputRows(
        self, key, rows: Iterator[pd.DataFrame], timerValues
    ) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        columns = {c: np.concatenate([p[c].to_numpy() for p in parts]) for c in parts[0].columns}
        order = np.argsort(columns["sequence"], kind="stable")
        columns = {c: v[order] for c, v in columns.items()}
        windows = MatchWindows(self.span, self._load(self.kills), self._load(self.ticks))
        marks = self.marks.get()
        epoch, current = (0, None) if marks is None else marks
        live = marks is not None
        at, epochs, values = [], [], []
        plain = [columns[c].tolist() for c in ("kind", "us", "ct", "hs", "round")]
        for i, (kind, us, ct, hs, number) in enumerate(zip(*plain, strict=True)):
            live = kind != "match_end"
            if kind == "kill":
                windows.kills.enter(us, ct, hs)
            elif kind == "tick":
                windows.ticks.enter(us)
                current = number
                at.append(i)
                epochs.append(epoch)
                values.append(windows.row())
            else:
                windows = MatchWindows(self.span)
                epoch, current = (epoch + 1, number) if live else (0, None)
        if live:
            self.kills.update(windows.kills.held())
            self.ticks.update(windows.ticks.held())
            self.marks.update((int(epoch), None if current is None else int(current)))
        else:
            for state in (self.kills, self.ticks, self.marks):
                state.clear()
        if not at:
            # rows of a match without a tick give no frame: columns without values have no type that Arrow takes for text
            return
        out = {"match_id": [key[0]] * len(at), "sequence": columns["sequence"][at]}
        out |= {name: columns[f"keep_{i}"][at] for i, name in enumerate(self.keep)}
        out["epoch"] = epochs
        out |= dict(zip(VALUES, zip(*values, strict=True), strict=True))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def stream_momentum(
    events: DataFrame,
    match: str = "match_id",
    sequence: str = "sequence",
    ts: str = "timestamp",
    kind: str = "event_type",
    victim: str = "victim_team",
    headshot: str = "headshot",
    round_number: str = "round_number",
    keep: tuple[str, ...] = (),
    span_seconds: float = fv.MOMENTUM_SECONDS,
    ttl_seconds: float | None = fv.STATE_TTL_SECONDS,
    output_mode: str = "append",
) -> DataFrame:
    """Window values at every tick of a streaming event input.

    ``keep`` columns travel with the tick. The state of a match leaves with its
    match end, and without one after the time to live.
    """
    if span_seconds <= 0:
        raise ValueError(f"a window of {span_seconds} seconds holds nothing")
    narrow = events.filter(
        F.col(kind).isin("tick", "kill", "round_start", "match_end")
    ).select(
        F.col(match).alias("match_id"),
        F.col(sequence).cast("long").alias("sequence"),
        micros(F.col(ts)).alias("us"),
        F.col(kind).alias("kind"),
        F.coalesce(F.col(victim) == "T", F.lit(False)).cast("long").alias("ct"),
        F.coalesce(F.col(headshot), F.lit(False)).cast("long").alias("hs"),
        F.coalesce(F.col(round_number).cast("int"), F.lit(0)).alias("round"),
        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)],
    )
    schema = T.StructType(
        [
            T.StructField("match_id", narrow.schema["match_id"].dataType),
            T.StructField("sequence", T.LongType()),
            *[T.StructField(c, events.schema[c].dataType) for c in keep],
            *[
                T.StructField(c, T.LongType())
                for c in ("epoch", "kills_ct", "kills_t", "headshots", "ticks")
            ],
            T.StructField("window_seconds", T.DoubleType()),
        ]
    )
    processor = MomentumProcessor(int(round(span_seconds * 1_000_000)), tuple(keep), ttl_seconds)
    return narrow.groupBy("match_id").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=schema,
        outputMode=output_mode,
        timeMode="None" if ttl_seconds is None else "ProcessingTime",
    )


# Workers get this code with the task, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
