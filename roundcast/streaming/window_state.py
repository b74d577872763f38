"""Trailing windows in order of arrival, for streaming state and for disordered epochs."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle


class Trail:
    """Times inside one trailing window, with running totals of two flags.

    Whatever enters is counted once and whatever leaves is taken off once, so a value costs the same however many
    rows the window holds. Rows leave from the front only, when a later arrival has moved on by more than the span.
    """

    def __init__(self, span: int, us=(), ct=(), hs=()):
        self.span, self.front = span, 0
        self.us, self.ct, self.hs = list(us), list(ct), list(hs)
        self.n_ct, self.n_hs = sum(self.ct), sum(self.hs)

    def enter(self, us: int, ct: int = 0, hs: int = 0) -> None:
        self.us.append(us)
        self.ct.append(ct)
        self.hs.append(hs)
        self.n_ct += ct
        self.n_hs += hs
        oldest = us - self.span
        while self.us[self.front] < oldest:
            self.n_ct -= self.ct[self.front]
            self.n_hs -= self.hs[self.front]
            self.front += 1

    def __len__(self) -> int:
        return len(self.us) - self.front

    def reach(self) -> int:
        """Microseconds from the first to the last row."""
        return self.us[-1] - self.us[self.front] if len(self) > 1 else 0

    def held(self) -> tuple[list[int], list[int], list[int]]:
        """What a later batch needs."""
        return tuple([int(v) for v in x[self.front :]] for x in (self.us, self.ct, self.hs))


class MatchWindows:
    """Kill and tick windows of one epoch; ``row`` gives the values at a tick."""

    def __init__(self, span: int, kills: Trail | None = None, ticks: Trail | None = None):
        self.span = span
        self.kills, self.ticks = kills or Trail(span), ticks or Trail(span)

    def row(self) -> tuple[int, int, int, int, float]:
        seconds = max(self.ticks.reach(), self.kills.reach()) / 1_000_000.0
        return self.kills.n_ct, len(self.kills) - self.kills.n_ct, self.kills.n_hs, len(self.ticks), seconds


VALUES = ("kills_ct", "kills_t", "headshots", "ticks", "window_seconds")


def fold_epochs(match: str, sequence: str, span: int):
    """Window values at every tick of rows sorted by match, epoch and arrival."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, windows = None, MatchWindows(span)
        for frame in batches:
            is_kill = (frame["kind"] == "kill").to_numpy()
            values = []
            pairs = zip(frame[match], frame["epoch"], strict=True)
            for own, kill, us, ct, hs in zip(pairs, is_kill, *(frame[c].tolist() for c in ("us", "ct", "hs")), strict=True):
                if own != owner:
                    owner, windows = own, MatchWindows(span)
                if kill:
                    windows.kills.enter(us, int(ct), int(hs))
                else:
                    windows.ticks.enter(us)
                    values.append(windows.row())
            out = frame.loc[~is_kill, [match, sequence, "epoch"]].reset_index(drop=True)
            columns = zip(*values, strict=True) if values else [()] * len(VALUES)
            yield out.assign(**{c: np.array(x, float if c == "window_seconds" else np.int64) for c, x in zip(VALUES, columns, strict=True)})

    return fold


# Workers get this code with the task, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
