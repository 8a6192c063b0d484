"""Logistic regressions with an elastic net, all penalties of a table in the same steps of Newton's method."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A step that promises less than this ends a fit: steps converge quadratically, so it is the last that matters.
PROMISE = 1e-12
#: Added to the curvature, where rounding could leave it singular; the optimum stays the same.
RIDGE = 1e-10


@dataclass
class Logistic:
    """Probability 1 / (1 + exp(-(intercept + sum of weight * column))); with one class only its own."""

    weights: dict[str, float]
    intercept: float
    steps: int
    converged: bool

    def sql(self) -> str:
        if np.isinf(self.intercept):
            return "1.0D" if self.intercept > 0 else "0.0D"
        terms = "".join(f" + ({w!r}D) * `{n}`" for n, w in self.weights.items() if w)
        return f"1.0D / (1.0D + exp(-(({self.intercept!r}D){terms})))"


class _Fit:
    """One penalty's way: the last good point, and the point to try next."""

    def __init__(self, start: np.ndarray, l1: float, l2: float):
        self.at, self.trial, self.l1, self.l2 = start, start, l1, l2
        self.value, self.way, self.rate, self.promise = np.inf, np.zeros_like(start), 1.0, 0.0
        self.steps, self.done, self.converged = 0, False, False

    def penalty(self, b: np.ndarray) -> float:
        return self.l1 * np.abs(b[:-1]).sum() + self.l2 / 2 * (b[:-1] ** 2).sum()

    def take(self, loss: float, gradient: np.ndarray, curvature: np.ndarray, most: int) -> None:
        """Goes on from the mean loss and its derivatives at the trial point."""
        self.steps += 1
        value = loss + self.penalty(self.trial)
        if value <= self.value + 1e-4 * self.rate * self.promise + 1e-15 * abs(value):
            self.at, self.value, self.rate = self.trial, value, 1.0
            weight = np.r_[np.ones(len(self.at) - 1), 0.0]
            h = curvature + RIDGE * np.eye(len(self.at))
            goal = elastic_quadratic(h + self.l2 * np.diag(weight), h @ self.at - gradient, self.l1 * weight, self.at)
            self.way = goal - self.at
            self.promise = min(0.0, gradient @ self.way + self.penalty(goal) - self.penalty(self.at))
            if -self.promise <= PROMISE * max(1.0, abs(value)):
                self.at, self.done, self.converged = goal, True, True
                return
        else:
            self.rate /= 2
        self.trial = self.at + self.rate * self.way
        self.done = self.steps >= most or self.rate < 1e-10


def elastic_quadratic(a: np.ndarray, q: np.ndarray, l1: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The x with the least x a x / 2 - q x + sum of l1 |x|, for a positive definite, by feature-sign search.

    Solves for the columns in use with their signs held; on the way there it stops at the best change of a sign. A column
    comes into use when its gradient exceeds its l1. Each solution lowers the objective, so no signs come back; where rounding
    in an almost singular a keeps it from that, coordinates descend one by one."""
    cost = lambda x: x @ a @ x / 2 - q @ x + l1 @ np.abs(x)
    x, sign = start.copy(), np.sign(start)
    for _ in range(100 * len(q)):
        use = (sign != 0) | (l1 == 0)
        goal = np.zeros_like(x)
        goal[use] = np.linalg.solve(a[np.ix_(use, use)], (q - l1 * sign)[use])
        turns = use & (l1 > 0) & (np.sign(goal) != sign)
        if turns.any():
            points = [goal]
            for j in np.flatnonzero(turns & (x != 0)):
                point = x + (x[j] / (x[j] - goal[j])) * (goal - x)
                point[j] = 0.0
                points.append(point)
            best = min(points, key=cost)
            if cost(best) >= cost(x):
                break
            x = best
            sign = np.sign(x)
            continue
        if cost(goal) > cost(x) + 1e-12 * abs(cost(x)):
            break
        x = goal
        excess = np.where(use, -1.0, np.abs(a @ x - q) - l1)
        j = int(excess.argmax())
        if excess[j] <= 1e-12 * max(1.0, np.abs(q).max()):
            return x
        sign[j] = -np.sign((a @ x - q)[j])
    for _ in range(1000):
        before = x.copy()
        for j in range(len(x)):
            r = q[j] - a[j] @ x + a[j, j] * x[j]
            x[j] = np.sign(r) * max(abs(r) - l1[j], 0.0) / a[j, j]
        if np.abs(x - before).max() <= 1e-12 * max(1.0, np.abs(x).max()):
            break
    return x


def fit_logistic(rows: DataFrame, names: list[str], y: str, penalties: list[tuple[float, float]], most: int) -> list[Logistic]:
    """For every (l1, l2): the least mean log loss + l1 |w| + l2 w w / 2, w being the weights of the columns divided by their
    standard deviations; the intercept is free. rows are read once a step, whatever the number of penalties, and should be a table.

    A task adds up its rows' loss, gradient and curvature; the totals, a few for each pair of columns, reach the driver."""
    spread = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("y"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))]).first()
    n, rate = spread["n"], spread["y"]
    if not n:
        raise ValueError("no_training_rows")
    if rate in (0.0, 1.0):
        return [Logistic({}, np.inf if rate else -np.inf, 0, True) for _ in penalties]
    varied = [i for i in range(len(names)) if spread[f"hi{i}"] > spread[f"lo{i}"]]  # the deviation of a constant may round to more than 0
    used = [names[i] for i in varied]
    mean, scale = (np.array([spread[f"{k}{i}"] for i in varied], dtype=float) for k in "ms")
    data = rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(used)], F.col(y).cast("double").alias("y"))
    start = np.r_[np.zeros(len(used)), np.log(rate / (1 - rate))]
    fits = [_Fit(start, l1, l2) for l1, l2 in penalties]
    while open_ := [f for f in fits if not f.done]:
        totals = _totals(data, np.array([f.trial for f in open_]), mean, scale) / n
        for f, t in zip(open_, totals, strict=True):
            f.take(*_unpacked(t, len(start)), most)
    return [Logistic(dict(zip(used, (f.at[:-1] / scale).tolist(), strict=True)), float(f.at[-1] - (f.at[:-1] / scale) @ mean), f.steps, f.converged) for f in fits]


def _unpacked(t: np.ndarray, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    h = np.zeros((width, width))
    h[np.triu_indices(width)] = t[1 + width :]
    return float(t[0]), t[1 : 1 + width], h + np.triu(h, 1).T


def _totals(data: DataFrame, points: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A row for each point: loss, gradient and upper half of the curvature, added up over data."""
    import pyarrow as pa

    upper = np.triu_indices(points.shape[1])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(points), 1 + points.shape[1] + len(upper[0])))
        for batch in batches:
            *columns, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.ones((len(y), points.shape[1]))
            for i, c in enumerate(columns):
                x[:, i] = (c - mean[i]) / scale[i]
            for own, b in zip(total, points, strict=True):
                m = x @ b
                p = np.exp(-np.logaddexp(0.0, -m))
                curvature = x.T @ (x * (p * (1 - p))[:, None])
                own += np.concatenate([[(np.logaddexp(0.0, m) - y * m).sum()], x.T @ (p - y), curvature[upper]])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["t"])

    sums = data.mapInArrow(add, "t array<double>").select(F.posexplode("t").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(len(points) * (1 + points.shape[1] + len(upper[0])))
    for r in sums.collect():  # a row for each total
        out[r["i"]] = r["v"]
    return out.reshape(len(points), -1)
