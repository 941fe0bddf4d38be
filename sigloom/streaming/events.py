"""Change-point detection on signals that arrive in pieces: state is both detectors, the last samples, and the open event's sums.

A read's samples come in order across micro-batches (within one, any order). Scores of a position need the
samples of a long window after it, so detection runs that many samples behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigloom.kernels.detect import Detection, PeakFinder

_STATE = "seen long, start long, done long, tail array<double>, total double, squares double, masked array<long>, at array<long>, value array<double>, valid array<boolean>"
_OUT = "read long, start long, length long, mean double, stdv double"


class Online:
    """Feed samples, get finished events; ``finish`` gives the last one."""

    def __init__(self, p: Detection = Detection(), state: tuple | None = None):
        self.p, self.find = p, PeakFinder(p)
        self.keep = 2 * max(p.short, p.long)
        self.seen, self.start, self.done = 0, 0, 0
        self.tail: list[float] = []  # samples from position seen - len(tail) on
        if state:
            self.seen, self.start, self.done, tail, _, _, masked, at, value, valid = state
            self.tail = list(tail)
            for d, s in zip((self.find.short, self.find.long), zip(masked, at, value, valid, strict=True), strict=True):
                d.load(s)

    def state(self) -> tuple:
        cols = list(zip(self.find.short.state(), self.find.long.state(), strict=True))
        return (self.seen, self.start, self.done, self.tail, 0.0, 0.0, *[list(c) for c in cols])

    def _score(self, i: int, w: int, last: bool) -> float:
        base = self.seen - len(self.tail)
        if i < w or i + w > self.seen:
            return 0.0
        a, b = (np.array(self.tail[x - base : x - base + w]) for x in (i - w, i))
        return float(abs(b.mean() - a.mean()) / np.sqrt(max(a.var() + b.var(), np.finfo(np.float32).tiny) / w))

    def _event(self, end: int) -> tuple:
        base = self.seen - len(self.tail)
        x = np.array(self.tail[self.start - base : end - base])
        out = (self.start, len(x), float(x.mean()), float(x.std()))
        self.start = end
        return out

    def _advance(self, to: int, last: bool = False) -> list[tuple]:
        out, cuts = [], []
        for i in range(self.done, to):
            cuts += self.find.see(i, self._score(i, self.p.short, last), self._score(i, self.p.long, last))
        self.done = max(self.done, to)
        for c in sorted(cuts):
            if self.start < c:
                out.append(self._event(c))
        base = self.seen - len(self.tail)
        need = min(self.start, self.done - self.keep)
        if need > base:
            self.tail = self.tail[need - base :]
        return out

    def feed(self, x) -> list[tuple]:
        self.tail += [float(v) for v in x]
        self.seen += len(x)
        return self._advance(self.seen - max(self.p.short, self.p.long))

    def finish(self) -> list[tuple]:
        out = self._advance(self.seen, True)
        if self.start < self.seen:
            out.append(self._event(self.seen))
        return out


def detect_stream(samples: DataFrame, params: Detection = Detection(), idle_ms: int | None = 60_000) -> DataFrame:
    """Events of a stream of (read long, i long, x double), as they close.

    A read that is idle for idle_ms ends, and its last events come out; None keeps reads open, which a trigger that
    stops by itself needs (a pending timeout always asks for another batch).
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        online = Online(params, state.get if state.exists else None)
        if state.hasTimedOut:
            rows = online.finish()
            state.remove()
        else:
            frame = pd.concat(list(parts)).sort_values("i")
            rows = online.feed(frame["x"].to_numpy())
            state.update(online.state())
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["read", "start", "length", "mean", "stdv"])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return samples.groupBy("read").applyInPandasWithState(run, _OUT, _STATE, "append", timeout)
