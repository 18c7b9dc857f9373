"""Sums of vectors over all rows, minimising of a loss that is such a sum, and means that don't depend on the order of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partitions whose sums the driver adds up itself; more are added up by so many tasks first.
DIRECT, MERGED = 64, 32


def steady_mean(x: Column) -> Column:
    """Mean of doubles, an aggregate: the same number in whatever order rows and partial sums come, null without values.

    Each value is cut into a whole part and two of 32 bits behind the point, which are summed as integers. Values of 2^31 and
    more, those with bits beyond the 64th behind the point and those that aren't finite are summed as doubles, as avg does.
    """
    x = x.cast("double")
    whole = F.when(F.abs(x) < 2.0**31, x.cast("long"))
    high = (x - whole) * 2.0**32
    low = (high - high.cast("long")) * 2.0**32
    fits = low == low.cast("long")
    of = lambda part: F.coalesce(F.sum(F.when(fits, part.cast("long"))), F.lit(0))
    rest = F.coalesce(F.sum(F.when(fits, None).otherwise(x)), F.lit(0.0))
    return F.when(F.count(x) > 0, (of(whole) + (of(high) + of(low) / 2.0**32) / 2.0**32 + rest) / F.count(x))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for v in b.column(0).to_pylist():
            x = np.frombuffer(v, np.float64)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])


class Passes:
    """Passes over a table that is kept (cached or written)."""

    def __init__(self, table: DataFrame):
        self.table, self.many = table, table.rdd.getNumPartitions() > DIRECT

    def total(self, add: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
        """The sum of the vectors of `width` doubles that add gives for the batches; a vector for each partition leaves its task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for b in batches:
                if b.num_rows:
                    total += add(b)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

        parts = self.table.mapInArrow(run, "v binary")
        if self.many:
            parts = parts.repartition(MERGED).mapInArrow(_merge, "v binary")
        total = np.zeros(width)
        for r in parts.collect():
            total += np.frombuffer(bytes(r["v"]), np.float64)
        return total


def minimise(losses: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, most: int = 200, tolerance: float = 1e-5, gain: float = 1e-10) -> np.ndarray:
    """Points [problem, variable] that minimise convex losses, each for itself, by L-BFGS with halved steps.

    losses: of trial points the values [problem] and gradients [problem, variable]; called once a step for all problems.
    A problem is done where its largest slope is below tolerance or a step lowers its loss by less than gain of it.
    """
    x = start.copy()
    f, g = losses(x)
    past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in x]
    step, aim, done = np.ones(len(x)), -g, np.abs(g).max(axis=1, initial=0) < tolerance
    for _ in range(most):
        if done.all():
            break
        trial = np.where(done[:, None], x, x + step[:, None] * aim)
        f1, g1 = losses(trial)
        for i in np.flatnonzero(~done):
            if f1[i] > f[i] + 1e-4 * step[i] * (g[i] @ aim[i]) and step[i] > 1e-6:
                step[i] /= 2
                continue
            s, y = trial[i] - x[i], g1[i] - g[i]
            if s @ y > 1e-14:
                past[i] = [*past[i][-9:], (s, y)]
            gone = f[i] - f1[i]
            x[i], f[i], g[i], step[i] = trial[i], f1[i], g1[i], 1.0
            q, used = g[i].copy(), []
            for s, y in reversed(past[i]):
                used.append((s @ q) / (s @ y))
                q -= used[-1] * y
            if past[i]:
                s, y = past[i][-1]
                q *= (s @ y) / (y @ y)
            for (s, y), a in zip(past[i], reversed(used), strict=True):
                q += (a - (y @ q) / (s @ y)) * s
            aim[i] = -q
            done[i] = np.abs(g[i]).max() < tolerance or gone < gain * max(1.0, abs(f[i]))
    return x
