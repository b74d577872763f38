"""Frames of live matches and what a viewer sees, as stateful processing: twins of ``frame_stream`` and ``dashboard_state``.

A tick gives its prediction and, once the interval has passed since the last snapshot shown, a snapshot; round and match
ends are never held back. A viewer folds the frames: snapshot, prediction, the timeline of predictions since the last
round end, and a log of rounds, newest first. Within a micro-batch the sequence orders a match's events; across batches
their arrival does, so a replay comes late, and its time lets no snapshot through.
"""

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

_KINDS = ("tick", "round_end", "match_end")


def _in_order(rows: Iterator[pd.DataFrame]) -> list[tuple]:
    """sequence, us, kind, prediction and payload of a match's new events."""
    names = ("sequence", "us", "kind", "prediction", "payload")
    parts = list(rows)
    columns = {c: np.concatenate([p[c].to_numpy() for p in parts]) for c in names}
    order = np.argsort(columns["sequence"], kind="stable")
    return list(zip(*[columns[c][order].tolist() for c in names], strict=True))


class _LiveMatches(StatefulProcessor):
    """Knows when a match's snapshot was last shown. Its state ends with the match or after the time to live."""

    def __init__(self, interval: int, ttl_seconds: float | None):
        self.interval = interval
        self.ttl = None if ttl_seconds is None else int(ttl_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getValueState("shown", "us long", self.ttl)

    def frames(self, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        """type, sequence, us and content of the frames of new events; the content of a prediction is a number."""
        last = self.shown.get()[0] if self.shown.exists() else None
        out = []
        for sequence, us, kind, prediction, payload in _in_order(rows):
            if kind != "tick":
                out.append((kind, sequence, us, payload))
                if kind == "match_end":
                    last = None
                continue
            if prediction is not None and prediction == prediction:
                out.append(("prediction", sequence, us, prediction))
            if last is None or us - last >= self.interval:
                last = us
                out.append(("tick", sequence, us, payload))
        if last is not None:
            self.shown.update((int(last),))
        elif self.shown.exists():
            self.shown.clear()
        return out

    def close(self) -> None:
        pass


class FrameProcessor(_LiveMatches):
    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.frames(rows)
        yield pd.DataFrame(
            {
                "match_id": [key[0]] * len(found),
                "sequence": [f[1] for f in found],
                "us": [f[2] for f in found],
                "type": [f[0] for f in found],
                "prediction": [f[3] if f[0] == "prediction" else None for f in found],
                "payload": [None if f[0] == "prediction" else f[3] for f in found],
            }
        )


class ViewProcessor(_LiveMatches):
    """What is seen of a match stays as it is once the match has ended."""

    def __init__(self, interval: int, ttl_seconds: float | None, timeline: int, log: int):
        super().__init__(interval, ttl_seconds)
        self.most = (timeline, log)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.view = handle.getValueState("view", "ended boolean, rounds long, snapshot string, prediction double", self.ttl)
        self.timeline = handle.getListState("timeline", "sequence long, prediction double", self.ttl)
        self.log = handle.getListState("log", "payload string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended, rounds, snapshot, prediction = self.view.get() if self.view.exists() else (False, 0, None, None)
        timeline = [tuple(r) for r in self.timeline.get()] if self.timeline.exists() else []
        log = [r[0] for r in self.log.get()] if self.log.exists() else []
        for kind, sequence, _, content in self.frames(rows):
            if ended:
                break
            if kind == "prediction":
                prediction = float(content)
                timeline.append((int(sequence), prediction))
            elif kind == "tick":
                snapshot = content
            elif kind == "round_end":
                rounds += 1
                prediction, timeline = None, []
                log.insert(0, content)
            else:
                ended = True
        timeline, log = timeline[-self.most[0] :], log[: self.most[1]]
        self.view.update((bool(ended), int(rounds), snapshot, prediction))
        for state, held in ((self.timeline, timeline), (self.log, [(x,) for x in log])):
            if held:
                state.put(held)
            elif state.exists():
                state.clear()
        yield pd.DataFrame(
            {
                "match_id": [key[0]],
                "ended": [ended],
                "rounds_ended": [rounds],
                "snapshot": [snapshot],
                "prediction": pd.array([prediction], dtype="Float64"),
                "timeline": [[s for s, _ in timeline]],
                "timeline_predictions": [[p for _, p in timeline]],
                "log": [log],
            }
        )


def _narrow(events: DataFrame, match: str, sequence: str, ts: str, kind: str, prediction: str, payload: str) -> DataFrame:
    return events.filter(F.col(kind).isin(*_KINDS)).select(
        F.col(match).alias("match_id"),
        F.col(sequence).cast("long").alias("sequence"),
        micros(F.col(ts)).alias("us"),
        F.col(kind).alias("kind"),
        F.col(prediction).cast("double").alias("prediction"),
        F.col(payload).cast("string").alias("payload"),
    )


def _interval(seconds: float) -> int:
    if seconds < 0:
        raise ValueError(f"an interval of {seconds} seconds")
    return int(round(seconds * 1_000_000))


def stream_frames(
    events: DataFrame,
    match: str = "match_id",
    sequence: str = "sequence",
    ts: str = "timestamp",
    kind: str = "event_type",
    prediction: str = "prediction",
    payload: str = "payload",
    interval_seconds: float = fv.FRAME_INTERVAL_SECONDS,
    ttl_seconds: float | None = fv.STATE_TTL_SECONDS,
) -> DataFrame:
    """Frames of a streaming event input: ``type`` is prediction, tick, round_end or match_end.

    A tick without a prediction has no prediction frame. ``payload`` is what a snapshot or an end shows.
    """
    narrow = _narrow(events, match, sequence, ts, kind, prediction, payload)
    schema = T.StructType(
        [T.StructField("match_id", narrow.schema["match_id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("sequence", "us")]
        + [T.StructField("type", T.StringType()), T.StructField("prediction", T.DoubleType()), T.StructField("payload", T.StringType())]
    )
    return narrow.groupBy("match_id").transformWithStateInPandas(
        statefulProcessor=FrameProcessor(_interval(interval_seconds), ttl_seconds),
        outputStructType=schema,
        outputMode="append",
        timeMode="None" if ttl_seconds is None else "ProcessingTime",
    )


def stream_view(
    events: DataFrame,
    match: str = "match_id",
    sequence: str = "sequence",
    ts: str = "timestamp",
    kind: str = "event_type",
    prediction: str = "prediction",
    payload: str = "payload",
    interval_seconds: float = fv.FRAME_INTERVAL_SECONDS,
    ttl_seconds: float | None = fv.STATE_TTL_SECONDS,
    timeline: int = fv.TIMELINE_POINTS,
    log: int = fv.ROUND_LOG_ROWS,
) -> DataFrame:
    """What a viewer sees of each match that a micro-batch has events of; later rows of a match replace earlier ones."""
    narrow = _narrow(events, match, sequence, ts, kind, prediction, payload)
    schema = T.StructType(
        [
            T.StructField("match_id", narrow.schema["match_id"].dataType),
            T.StructField("ended", T.BooleanType()),
            T.StructField("rounds_ended", T.LongType()),
            T.StructField("snapshot", T.StringType()),
            T.StructField("prediction", T.DoubleType()),
            T.StructField("timeline", T.ArrayType(T.LongType())),
            T.StructField("timeline_predictions", T.ArrayType(T.DoubleType())),
            T.StructField("log", T.ArrayType(T.StringType())),
        ]
    )
    return narrow.groupBy("match_id").transformWithStateInPandas(
        statefulProcessor=ViewProcessor(_interval(interval_seconds), ttl_seconds, timeline, log),
        outputStructType=schema,
        outputMode="update",
        timeMode="None" if ttl_seconds is None else "ProcessingTime",
    )


# Workers get this code with the task, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
