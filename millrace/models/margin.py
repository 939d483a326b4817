"""Linear support vector machines: hinge loss for classes, the flat-zone (epsilon-insensitive) loss for numbers.

The objective is lambda / 2 * |w|^2 plus the mean loss, on features scaled to unit deviation, with a free offset.
Both losses have a corner, which is rounded over a width ``delta``; each width's optimum is found by Newton's method
in a trusted radius and starts the next, ten times smaller one. Rounding changes a loss by at most delta / 2, so what is left
to the optimum is known: the method stops at ``WIDTHS[-1] / 2`` plus ``TOLERANCE`` (in deviations of the target, for numbers).

A step is one aggregate: tasks add up losses, gradients and curvatures of their rows in numpy, Spark adds those of the tasks,
and the driver solves systems of the width of the features. Classes, settings and folds are problems of
the same scans, so a search over a grid reads the table no more often than one fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.operators.stats import moments
from millrace.session import cut_lineage

WIDTHS = (3.0, 0.3, 0.03, 0.003, 0.001)
TOLERANCE = 1e-4
MAX_SCANS = 100


@dataclass
class Margins:
    """Scores w.x + b, one for numbers and two classes, else one for each class, whose largest wins."""

    features: tuple[str, ...]
    weights: list[list[float]]
    offsets: list[float]
    classes: int
    gap: float

    def scores(self):
        out = []
        for w, b in zip(self.weights, self.offsets):
            score = F.lit(float(b))
            for f, v in zip(self.features, w):
                score = score + col(f).cast("double") * F.lit(float(v))
            out.append(score)
        return out

    def prediction(self):
        """The number, or the number of the class, as an expression."""
        scores = self.scores()
        if not self.classes:
            return scores[0]
        if self.classes <= 2:
            return (scores[0] > 0).cast("double")
        every = F.array(*scores)
        return (F.array_position(every, F.array_max(every)) - 1).cast("double")

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.prediction())

    def importance(self) -> list[tuple[str, float]]:
        return list(zip(self.features, np.abs(np.array(self.weights)).sum(axis=0).tolist()))


class _Problem:
    """One optimisation: its setting, where it stands, and the step it tries."""

    def __init__(self, spec: int, size: int, target: int, skip: int | None, ridge: float, epsilon: float, scale: float):
        self.spec, self.target, self.skip, self.ridge, self.epsilon, self.scale = spec, target, skip, ridge, epsilon, scale
        self.w, self.trial, self.level = np.zeros(size), np.zeros(size), 0
        self.value = self.left = np.inf
        self.radius, self.hoped = 1.0, None
        self.slope = self.curvature = None
        self.done = False

    @property
    def delta(self) -> float:
        return WIDTHS[self.level] * self.scale

    def told(self, total: np.ndarray) -> None:
        """Take loss, gradient and curvature at the trial point; choose the next one within the radius that is trusted."""
        size = len(self.w)
        n = max(total[1], 1.0)
        ridge = np.full(size, self.ridge)
        ridge[-1] = 0.0
        value = total[0] / n + 0.5 * float(ridge @ (self.trial**2))
        if self.hoped is not None:
            share = (self.value - value) / max(self.hoped, 1e-300)
            length = float(np.linalg.norm(self.trial - self.w))
            if share < 1e-4 and self.hoped > 1e-13 * (1 + abs(self.value)):
                self.radius = length / 4
                return self._try()
            if share > 0.5 and length > 0.9 * self.radius:
                self.radius *= 3
        self.w, self.value = self.trial, value
        self.slope = total[2 : 2 + size] / n + ridge * self.w
        self.curvature = total[2 + size :].reshape(size, size) / n + np.diag(ridge)
        self._try()

    def _try(self) -> None:
        """The best point of the quadratic model within the radius; a width is done if it hopes for nothing there."""
        more, step = 1e-12, None
        while step is None or np.linalg.norm(step) > self.radius:
            step = -np.linalg.lstsq(self.curvature + more * np.eye(len(self.w)), self.slope, rcond=None)[0]
            more = max(more * 3, 1e-9)
        self.hoped = self.left = -float(self.slope @ step + 0.5 * step @ self.curvature @ step)
        # Wider ones only start the next.
        slack = 1.0 if self.level == len(WIDTHS) - 1 else 30.0
        if self.left <= slack * TOLERANCE * self.scale * WIDTHS[self.level]:
            self.radius, self.hoped, self.trial = max(self.radius, 0.1), None, self.w
            self.done = self.level == len(WIDTHS) - 1
            self.level = min(self.level + 1, len(WIDTHS) - 1)
            return
        self.trial = self.w + step


def _totals(rows: DataFrame, names: Sequence[str], centre: np.ndarray, spread: np.ndarray, open_: list[_Problem], classes: int) -> dict[int, np.ndarray]:
    """Loss, rows, gradient and curvature of every open problem, added up in tasks and then by Spark."""
    w = np.array([p.trial for p in open_])
    delta, epsilon = np.array([p.delta for p in open_]), np.array([p.epsilon for p in open_])
    target, skip = np.array([p.target for p in open_]), np.array([-1 if p.skip is None else p.skip for p in open_])
    size, fields = w.shape[1], list(names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(w), 2 + size + size * size))
        for batch in batches:
            x = np.stack([np.asarray(batch[c], float) for c in fields] + [np.zeros(batch.num_rows)], axis=1) if fields else np.zeros((batch.num_rows, 1))
            x[:, :-1] = (x[:, :-1] - centre) / spread
            x[:, -1] = 1.0
            label, fold = np.asarray(batch["__label"], float), np.asarray(batch["__fold"])
            score = x @ w.T
            if classes:
                side = np.where(label[:, None] == target, -1.0, 1.0)
                z = 1.0 + side * score
            else:
                z = score - label[:, None]
                side = np.sign(z)
                z = np.abs(z) - epsilon
            seen = (fold[:, None] != skip).astype(float)
            inner = (z > 0) & (z < delta)
            total[:, 0] += (seen * np.where(inner, z * z / (2 * delta), np.where(z > 0, z - delta / 2, 0.0))).sum(axis=0)
            total[:, 1] += seen.sum(axis=0)
            total[:, 2 : 2 + size] += ((seen * side * np.clip(z / delta, 0.0, 1.0)).T @ x)
            for i, heavy in enumerate((seen * inner / delta).T):
                some = heavy > 0
                total[i, 2 + size :] += ((x[some] * heavy[some, None]).T @ x[some]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(w)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["problem", "sums"])

    parts = rows.mapInArrow(add, "problem int, sums array<double>").select("problem", F.posexplode("sums").alias("at", "value"))
    out = {i: np.zeros(2 + size + size * size) for i in range(len(open_))}
    for r in parts.groupBy("problem", "at").agg(F.sum("value").alias("value")).collect():
        out[r["problem"]][r["at"]] = r["value"]
    return out


def fit_many(data: DataFrame, features: Sequence[str], classes: int, specs: Sequence[dict], fold: str | None = None) -> list[Margins]:
    """A model for each of ``specs``: regParam (lambda) or C (lambda is 1 / (C n)), epsilon, and skip, a fold that is left out.

    ``data`` has whole features and ``__label``: the number of the class, or a number if ``classes`` is 0.
    """
    features = list(features)
    kept = data.select(*[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col("__label").cast("double").alias("__label"), (col(fold).cast("int") if fold else F.lit(-2)).alias("__fold"))
    rows = cut_lineage(kept)
    names = [f"x{i}" for i in range(len(features))]
    known = moments(rows, [*names, "__label"], ["mean", "std"])
    centre = np.array([known[c]["mean"] or 0.0 for c in names])
    spread = np.array([known[c]["std"] if known[c]["std"] and known[c]["std"] > 0 else 1.0 for c in names])
    scale = 1.0 if classes else float(known["__label"]["std"] or 1.0)
    n = max(rows.count(), 1)
    problems = []
    for i, spec in enumerate(specs):
        ridge = spec.get("regParam")
        ridge = 1.0 / (spec.get("C", 1.0) * n) if ridge is None else max(float(ridge), 1e-10)
        for target in range(classes) if classes > 2 else (1,):
            p = _Problem(i, len(names) + 1, target, spec.get("skip"), ridge, float(spec.get("epsilon", 0.1)), scale)
            if not classes:
                p.trial[-1] = known["__label"]["mean"] or 0.0
            problems.append(p)
    for _ in range(max([int(s.get("maxIter", MAX_SCANS)) for s in specs], default=0)):
        open_ = [p for p in problems if not p.done]
        if not open_:
            break
        for i, total in _totals(rows, names, centre, spread, open_, classes).items():
            open_[i].told(total)
    out = []
    for i in range(len(specs)):
        own = [p for p in problems if p.spec == i]
        w = [p.w[:-1] / spread for p in own]
        gap = max(p.left + p.delta / 2 for p in own)
        out.append(Margins(tuple(features), [v.tolist() for v in w], [float(p.w[-1] - v @ centre) for p, v in zip(own, w)], classes, float(gap)))
    return out
