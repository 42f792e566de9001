"""A small network whose output is a weight, and the gradient of the Sharpe ratio of its net returns.

The net return of a day is a sum over names of weight times target, less the cost of what changed
since the day before. The ratio depends on the days' returns through their sum and their sum of
squares alone, and its gradient is (a sum r' + b sum r r') with a and b known from these two. So a
range of days, given the day before it, adds five things: days, sum of r, of r^2, of r' and of r r'.
Ranges can be worked on anywhere and in any order, and one pass gives the loss and its gradient.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

from plumbline.functions.sharpe import DAYS

#: Fixed values of the network: floors of the layer normalisation and of the deviation in the ratio.
NORM_FLOOR, DEVIATION_FLOOR = 1e-5, 1e-8


@dataclass(frozen=True)
class Shape:
    """Inputs and the sizes of the inner layers; each is linear, normalised, rectified and thinned, the last is linear."""

    inputs: int
    hidden: tuple[int, ...] = (128, 64, 32)
    dropout: float = 0.3

    def _pieces(self) -> list[tuple[int, ...]]:
        out, width = [], self.inputs
        for h in self.hidden:
            out += [(width, h), (h,), (h,), (h,)]
            width = h
        return [*out, (width, 1), (1,)]

    @property
    def size(self) -> int:
        return sum(math.prod(p) for p in self._pieces())

    def unpack(self, theta: np.ndarray) -> list[np.ndarray]:
        """Matrix, offset, gain and shift of every inner layer, then matrix and offset."""
        out, at = [], 0
        for p in self._pieces():
            out.append(theta[at : at + math.prod(p)].reshape(p))
            at += math.prod(p)
        return out

    def start(self, seed: int) -> np.ndarray:
        """Uniform within one over the root of the inputs of a layer; gains are one, shifts zero."""
        rng, out = np.random.default_rng(seed), []
        for p in self._pieces():
            if len(p) == 2:
                bound = 1 / math.sqrt(p[0])
                out += [rng.uniform(-bound, bound, p).ravel(), rng.uniform(-bound, bound, p[1])]
        parts = iter(out)
        whole = []
        for _ in self.hidden:
            matrix, offset = next(parts), next(parts)
            whole += [matrix, offset, np.ones(len(offset)), np.zeros(len(offset))]
        return np.concatenate([*whole, next(parts), next(parts)])


def thinning(shape: Shape, day: np.ndarray, draw: tuple[int, int]) -> list[np.ndarray]:
    """Factors of the inner values of rows in order of day and name: those of a day depend on ``draw`` and the day alone."""
    firsts = np.flatnonzero(np.diff(day, prepend=day[:1] - 1)) if len(day) else np.zeros(0, dtype=int)
    rows = np.diff(np.append(firsts, len(day)))
    kept = [np.random.default_rng([*draw, int(day[a])]).random((n, sum(shape.hidden))) >= shape.dropout for a, n in zip(firsts, rows, strict=True)]
    whole = (np.concatenate(kept) if kept else np.zeros((0, sum(shape.hidden)), dtype=bool)) / (1 - shape.dropout)
    return np.split(whole, np.cumsum(shape.hidden)[:-1], axis=1) if shape.hidden else []


def scores(theta: np.ndarray, shape: Shape, x: np.ndarray, thin: list[np.ndarray] | None = None) -> tuple[np.ndarray, list]:
    """The last layer's output for each row, and what the way back needs."""
    pieces, kept = shape.unpack(theta), []
    for k in range(len(shape.hidden)):
        matrix, offset, gain, shift = pieces[4 * k : 4 * k + 4]
        h = x @ matrix + offset
        h = h - h.mean(axis=1, keepdims=True)
        spread = np.sqrt((h * h).mean(axis=1, keepdims=True) + NORM_FLOOR)
        h = h / spread
        out = np.maximum(gain * h + shift, 0.0)
        factor = (out > 0) * (thin[k] if thin else 1.0)
        kept.append((x, h, spread, factor))
        x = out * thin[k] if thin else out
    return (x @ pieces[-2] + pieces[-1])[:, 0], [*kept, x]


def backward(theta: np.ndarray, shape: Shape, kept: list, d: np.ndarray) -> np.ndarray:
    """The gradient by the parameters of the sum of ``d`` times the scores."""
    pieces, out = shape.unpack(theta), []
    d = d[:, None]
    out = [kept[-1].T @ d, d.sum(axis=0)]
    d = d @ pieces[-2].T
    for k in reversed(range(len(shape.hidden))):
        x, h, spread, factor = kept[k]
        matrix, _, gain, _ = pieces[4 * k : 4 * k + 4]
        d = d * factor
        scaled = d * gain
        inner = (scaled - scaled.mean(axis=1, keepdims=True) - h * (scaled * h).mean(axis=1, keepdims=True)) / spread
        out = [x.T @ inner, inner.sum(axis=0), (d * h).sum(axis=0), d.sum(axis=0), *out]
        d = inner @ matrix.T
    return np.concatenate([p.ravel() for p in out])


@dataclass(frozen=True)
class Rows:
    """Rows of consecutive days in order of day and name: day, number of the name, names of that day, target, features."""

    day: np.ndarray
    name: np.ndarray
    names: np.ndarray
    target: np.ndarray
    x: np.ndarray

    def of(self, keep: np.ndarray) -> Rows:
        return Rows(self.day[keep], self.name[keep], self.names[keep], self.target[keep], self.x[keep])


def _before(rows: Rows) -> np.ndarray:
    """For each row the row of the same name on the day before, or -1."""
    order = np.lexsort((rows.day, rows.name))
    same = (np.diff(rows.name[order]) == 0) & (np.diff(rows.day[order]) == 1)
    out = np.full(len(order), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


@dataclass(frozen=True)
class Sums:
    """What ranges of days add up to: days, sums of returns and squares, of turnover, of r' and of r r'."""

    days: float
    r: float
    rr: float
    turnover: float
    slope: np.ndarray
    weighted: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray) -> Sums:
        n = (len(flat) - 4) // 2
        return cls(*map(float, flat[:4]), flat[4 : 4 + n], flat[4 + n :])

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.days, self.r, self.rr, self.turnover], self.slope, self.weighted])

    def ratio(self) -> float:
        """The annualised Sharpe ratio, with the sample's deviation; 0 under two days."""
        if self.days < 2:
            return 0.0
        return self.r / self.days / (self._deviation() + DEVIATION_FLOOR) * math.sqrt(DAYS)

    def _deviation(self) -> float:
        return math.sqrt(max(self.rr - self.r * self.r / self.days, 0.0) / (self.days - 1))

    def loss_gradient(self) -> np.ndarray:
        """Of minus the ratio."""
        n, s = self.days, self._deviation() if self.days >= 2 else 0.0
        if s == 0:
            return np.zeros_like(self.slope)
        m, d = self.r / n, s + DEVIATION_FLOOR
        curve = m / ((n - 1) * s * d * d)
        return -math.sqrt(DAYS) * ((1 / (n * d) + curve * m) * self.slope - curve * self.weighted)


def range_sums(theta: np.ndarray, shape: Shape, rows: Rows, first: int, last: int, cost: float, opening: bool = False, draw: tuple[int, int] | None = None, gradient: bool = True) -> Sums:
    """The sums of the days from ``first`` up to ``last``; ``rows`` also hold the day before, unless the days are ``opening``, which start from cash.

    ``cost`` is charged per unit of turnover. ``draw`` names the thinning, None is none.
    """
    rows = rows.of((rows.day >= first - (not opening)) & (rows.day < last))
    n = max(last - first, 0)
    score, kept = scores(theta, shape, rows.x, thinning(shape, rows.day, draw) if draw is not None else None)
    share = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
    weight = share / rows.names
    before = _before(rows)
    there = before >= 0
    was = np.where(there, weight[before], 0.0)
    leaves = np.ones(len(weight), dtype=bool)
    leaves[before[there]] = False
    at = rows.day - first
    inside, leaves = at >= 0, leaves & (at + 1 < n)
    change = weight - was
    gross = np.bincount(at[inside], (weight * rows.target)[inside], minlength=n)
    turnover = np.bincount(at[inside], np.abs(change)[inside], minlength=n) + np.bincount((at + 1)[leaves], weight[leaves], minlength=n)
    r = gross - cost * turnover
    slopes = []
    for u in (np.ones(n), r) if gradient else ():
        d = np.zeros(len(weight))
        d[inside] = u[at[inside]] * (rows.target - cost * np.sign(change))[inside]
        carried = there & inside
        np.add.at(d, before[carried], (cost * np.sign(change) * u[np.maximum(at, 0)])[carried])
        d[leaves] -= cost * u[(at + 1)[leaves]]
        slopes.append(backward(theta, shape, kept, d * weight * (1 - share)))
    empty = np.zeros(len(theta) if gradient else 0)
    return Sums(float(n), float(r.sum()), float((r * r).sum()), float(turnover.sum()), *(slopes or (empty, empty)))


@dataclass(frozen=True)
class Adam:
    """Steps by moments of the gradient, which is cut to length one first."""

    rate: float = 1e-3
    decay: float = 1e-5
    longest: float = 1.0
    moments: tuple[float, float] = (0.9, 0.999)
    floor: float = 1e-8
    step: int = 0
    mean: np.ndarray | float = 0.0
    square: np.ndarray | float = 0.0

    def moved(self, theta: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, Adam]:
        length = float(np.linalg.norm(gradient))
        g = gradient * min(1.0, self.longest / (length + 1e-6)) + self.decay * theta
        (a, b), step = self.moments, self.step + 1
        mean, square = a * self.mean + (1 - a) * g, b * self.square + (1 - b) * g * g
        new = theta - self.rate * (mean / (1 - a**step)) / (np.sqrt(square / (1 - b**step)) + self.floor)
        return new, replace(self, step=step, mean=mean, square=square)
