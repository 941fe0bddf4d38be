"""Change-point detection on one signal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Detection:
    """Two windows; a peak counts beyond its threshold and stands out by ``height``."""

    short: int = 3
    long: int = 6
    short_threshold: float = 1.4
    long_threshold: float = 9.0
    height: float = 0.2


def cumulative(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exclusive running sums of x and of its square, one longer than x."""
    x = np.asarray(x, float)
    return np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))


def t_statistic(x: np.ndarray, w: int) -> np.ndarray:
    """Absolute t between the w samples before and from each position; 0 where a window doesn't fit."""
    n, out = len(x), np.zeros(len(x))
    if w < 2 or n < 2 * w:
        return out
    x = np.asarray(x, float)
    v = np.lib.stride_tricks.sliding_window_view(x - x.mean(), w)
    mean, var = v.mean(axis=1), v.var(axis=1)
    at = np.arange(w, n - w + 1)
    both = np.maximum(var[at - w] + var[at], np.finfo(np.float32).tiny)
    out[at] = np.abs(mean[at] - mean[at - w]) / np.sqrt(both / w)
    return out


class Detector:
    """One window's peak finder: it follows the score down, then up, and holds a peak until the score has fallen by ``height``."""

    def __init__(self, window: int, threshold: float, height: float):
        self.window, self.threshold, self.height = window, threshold, height
        self.masked_to = 0
        self.reset(np.inf)

    def reset(self, value: float) -> None:
        self.at, self.value, self.valid = -1, value, False

    def see(self, i: int, now: float) -> int | None:
        """The peak that sample i confirms, if any."""
        if self.masked_to >= i:
            return None
        if self.at < 0:
            if now < self.value:
                self.value = now
            elif now - self.value > self.height:
                self.at, self.value = i, now
            return None
        if now > self.value:
            self.at, self.value = i, now
        elif self.value - now > self.height and self.value > self.threshold:
            self.valid = True
        return self.at if self.valid and i - self.at > self.window // 2 else None

    def state(self) -> tuple:
        return self.masked_to, self.at, self.value, self.valid

    def load(self, state: tuple) -> None:
        self.masked_to, self.at, self.value, self.valid = state


class PeakFinder:
    """Both detectors on a stream of scores.

    While the short one holds a peak over its threshold, from the sample after the peak began on, it silences the
    long one for its window.
    """

    def __init__(self, p: Detection = Detection()):
        self.short = Detector(p.short, p.short_threshold, p.height)
        self.long = Detector(p.long, p.long_threshold, p.height)

    def see(self, i: int, short: float, long: float) -> list[int]:
        found = []
        holding = self.short.at >= 0
        for d, now in ((self.short, short), (self.long, long)):
            peak = d.see(i, now)
            if d is self.short and holding and d.value > d.threshold:
                self.long.masked_to = d.at + d.window
                self.long.reset(np.inf)
            if peak is not None:
                found.append(peak)
                d.reset(now)
        return found


def peaks(short: np.ndarray, long: np.ndarray, p: Detection = Detection()) -> np.ndarray:
    """Sorted positions of change points."""
    finder, out = PeakFinder(p), []
    for i, (a, b) in enumerate(zip(short.tolist(), long.tolist(), strict=True)):
        out += finder.see(i, a, b)
    return np.array(sorted(out), np.int64)


def events_from(x: np.ndarray, cuts: np.ndarray) -> dict[str, np.ndarray]:
    """start, length, mean, stdv of the half-open pieces between cuts; one event where there is no cut. stdv is the population's."""
    x = np.asarray(x, float)
    inner = np.unique(cuts[(cuts > 0) & (cuts < len(x))])
    start = np.concatenate(([0], inner)).astype(np.int64) if len(x) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(x)))
    if not len(start):
        return {"start": start, "length": length, "mean": np.zeros(0), "stdv": np.zeros(0)}
    mean = np.add.reduceat(x, start) / length
    dev = x - np.repeat(mean, length)
    return {"start": start, "length": length, "mean": mean, "stdv": np.sqrt(np.add.reduceat(dev * dev, start) / length)}


def detect(x: np.ndarray, p: Detection = Detection()) -> dict[str, np.ndarray]:
    return events_from(x, peaks(t_statistic(x, p.short), t_statistic(x, p.long), p))


# ---- trimming and normalisation -----------------------------------------------------------------------------
def mad(x: np.ndarray) -> float:
    return float(np.median(np.abs(x - np.median(x))) * 1.4826) if len(x) > 1 else 0.0


def medmad(x: np.ndarray) -> np.ndarray | None:
    """(x - median) / MAD; zero for one sample, None where the MAD is 0."""
    x = np.asarray(x, float)
    if len(x) == 1:
        return np.zeros(1)
    scale = mad(x)
    return (x - np.median(x)) / scale if scale > 0 else None


def trim_by_mad(x: np.ndarray, chunk: int = 100, quantile: float = 0.0) -> tuple[int, int]:
    """Leading and trailing chunks whose MAD is at most the quantile of all chunks' MADs are cut. MADs stay unscaled: a factor's rounding can make unequal ones equal."""
    n = len(x) // chunk
    if not n:
        return 0, 0
    parts = np.asarray(x[: n * chunk], float).reshape(n, chunk)
    mads = np.median(np.abs(parts - np.median(parts, axis=1, keepdims=True)), axis=1)
    loud = np.flatnonzero(mads > np.quantile(mads, quantile))
    return (int(loud[0]) * chunk, int(loud[-1] + 1) * chunk) if len(loud) else (0, 0)


def trim(x: np.ndarray, head: int = 200, tail: int = 10, chunk: int = 100, quantile: float = 0.0) -> tuple[int, int]:
    """trim_by_mad, then head samples less in front and tail behind; (0, 0) if nothing is left."""
    start, end = trim_by_mad(x, chunk, quantile)
    start, end = start + head, end - tail
    return (start, end) if start < end else (0, 0)
