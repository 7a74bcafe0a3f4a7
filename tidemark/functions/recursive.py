"""Filters with a state of a few numbers, cut into chunks: a chunk's effect on the state is summarised, the summaries are folded in
order, and each chunk then runs from the state it is entered with.  Results do not depend on where the series is cut.

A summary or a state is a list of doubles, so the table that is folded has one short row per chunk.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

NONE = float("nan")


@dataclass(frozen=True)
class Ewm:
    """Exponentially weighted mean or standard deviation; weights go on fading over missing values.

    The state is ``[mean, biased variance, sum of weights, sum of squared weights]``; the mean is NaN before the first value.
    """

    alpha: float
    adjust: bool = False
    std: bool = False

    def _steps(self, x: np.ndarray, state: list[float], out: np.ndarray | None = None) -> tuple[list[float], float]:
        """The state after ``x`` and the share that the first of its values keeps in the mean (without ``adjust``)."""
        fade, new, keep = 1 - self.alpha, 1.0 if self.adjust else self.alpha, 1.0
        mean, var, w, w2 = state
        for i, v in enumerate(x.tolist()):
            if mean == mean:
                w, w2 = w * fade, w2 * fade * fade
                if v == v:
                    old, total = mean, w + new
                    keep *= w / total
                    mean = (w * old + new * v) / total
                    var = (w * (var + (old - mean) ** 2) + new * (v - mean) ** 2) / total
                    w, w2 = (total, w2 + new * new) if self.adjust else (1.0, (w2 + new * new) / (total * total))
            elif v == v:
                mean, var, w, w2 = v, 0.0, 1.0, 1.0
            if out is not None:
                spread = w * w - w2
                out[i] = mean if not self.std else math.sqrt(w * w / spread * var) if mean == mean and spread > 0 else NONE
        return [mean, var, w, w2], keep

    def summary(self, x: np.ndarray) -> list[float]:
        known = np.flatnonzero(~np.isnan(x))
        end, keep = self._steps(x, [NONE, 0.0, 1.0, 1.0])
        return [float(len(x)), float(known[0]), float(x[known[0]]), keep, *end] if len(known) else [float(len(x)), -1.0, NONE, 1.0, *end]

    def _after(self, state: list[float], summary: list[float]) -> list[float]:
        n, first, value, keep, *end = summary
        mean, var, w, w2 = state
        if mean != mean:
            return end
        if first < 0:
            return [mean, var, w * (1 - self.alpha) ** n, w2 * (1 - self.alpha) ** (2 * n)]
        if self.adjust:  # two piles of weights
            w, w2 = w * (1 - self.alpha) ** n, w2 * (1 - self.alpha) ** (2 * n)
            total = w + end[2]
            return [(w * mean + end[2] * end[0]) / total, (w * var + end[2] * end[1]) / total + w * end[2] / total ** 2 * (mean - end[0]) ** 2, total, w2 + end[3]]
        # take the first value from the state; of the pile after it, the share ``keep`` is left at the end of the chunk
        gap = [mean, var, w * (1 - self.alpha) ** first, w2 * (1 - self.alpha) ** (2 * first)]
        (mean, var, _, w2), _ = self._steps(np.array([value]), gap)
        rest = 1 - keep
        if rest > 0:
            other = (end[0] - keep * value) / rest
            spread = max(0.0, end[1] / rest - keep * (value - other) ** 2)
            mean, var = keep * mean + rest * other, keep * var + rest * spread + keep * rest * (mean - other) ** 2
        return [mean, var, end[2], end[3] + (w2 - 1) * (keep * end[2]) ** 2]

    def enter(self, summaries: list[list[float]]) -> list[list[float]]:
        states = [[NONE, 0.0, 1.0, 1.0]]
        for s in summaries[:-1]:
            states.append(self._after(states[-1], s))
        return states

    def run(self, x: np.ndarray, state: list[float]) -> np.ndarray:
        out = np.empty(len(x))
        self._steps(x, list(state), out)
        return out


@dataclass(frozen=True)
class KalmanLevel:
    """One-dimensional level filter with state ``[level, variance]``; it starts at the first value (0 if that is missing), variance 1.

    In homogeneous coordinates ``(s, s * variance, s * level)`` a step is linear, so a chunk is a 3 by 3 matrix.
    """

    process: float
    measurement: float

    def summary(self, x: np.ndarray) -> list[float]:
        q, r = self.process, self.measurement
        s1, v1, l1, s2, v2, l2, d = 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0
        for v in x.tolist():
            v1, v2 = v1 + q * s1, v2 + q * s2
            if v == v:
                l1, l2, d = r * l1 + v1 * v, r * l2 + v2 * v, r * d
                s1, v1, s2, v2 = v1 + r * s1, r * v1, v2 + r * s2, r * v2
                scale = s1 + s2
                s1, v1, l1, s2, v2, l2, d = s1 / scale, v1 / scale, l1 / scale, s2 / scale, v2 / scale, l2 / scale, d / scale
        return [float(x[0]) if len(x) else NONE, s1, v1, l1, s2, v2, l2, d]

    def start(self, first: float) -> list[float]:
        return [first if first == first else 0.0, 1.0]

    def enter(self, summaries: list[list[float]]) -> list[list[float]]:
        states = [self.start(summaries[0][0])]
        for _, s1, v1, l1, s2, v2, l2, d in summaries[:-1]:
            level, var = states[-1]
            s = s1 + s2 * var
            states.append([(l1 + l2 * var + d * level) / s, (v1 + v2 * var) / s])
        return states

    def run(self, x: np.ndarray, state: list[float]) -> np.ndarray:
        level, var = state
        out = np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            var += self.process
            if v == v:
                gain = var / (var + self.measurement)
                level += gain * (v - level)
                var *= 1 - gain
            out[i] = level
        return out
