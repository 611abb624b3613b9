"""Logistic regressions of many experiments in one fit.

rows: feats array<double>, label double, train and test array<int>: the experiments that a row trains and tests. Each
evaluation is one job that adds up losses and gradients of all experiments; every experiment keeps an
L-BFGS state of its own on the driver, a few vectors of its coefficients each. A thousand experiments take as many jobs as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.storage import ship

#: Logits that a step holds at a time.
CELLS = 1 << 20
#: Corrections that an L-BFGS state keeps.
KEPT = 10
FAN = 32


def _lists(column: pa.Array, n: int):
    """(row numbers, values) of a list column."""
    width = np.diff(column.offsets.to_numpy())
    start = column.offsets.to_numpy()
    return np.repeat(np.arange(n), width), column.values.to_numpy()[start[0] : start[-1]].astype(np.int64)


def _steps(batches, which: str, experiments: int, free: int):
    """(features with a one, labels, experiments at hand, membership) of slices whose logits fit CELLS."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, CELLS // (experiments * free))
        for i in range(0, batch.num_rows, step):
            b = batch.slice(i, step)
            flat = b.column(b.schema.get_field_index("feats"))
            x = flat.flatten().to_numpy().reshape(b.num_rows, -1)
            row, exp = _lists(b.column(b.schema.get_field_index(which)), b.num_rows)
            here = np.unique(exp)
            member = np.zeros((b.num_rows, len(here)))
            np.add.at(member, (row, np.searchsorted(here, exp)), 1)
            if len(here):
                yield np.hstack([x, np.ones((b.num_rows, 1))]), b.column(b.schema.get_field_index("label")).to_numpy().astype(np.int64), here, member


def _logits(x, w):
    """rows x experiments x classes; two classes share one row of coefficients."""
    e, free, p = w.shape
    z = (x @ w.reshape(e * free, p).T).reshape(len(x), e, free)
    return np.concatenate([np.zeros((len(x), e, 1)), z], 2) if free == 1 else z


def _summed(parts: DataFrame, tasks: int) -> np.ndarray:
    """The sum of the blobs of tasks, added up FAN at a time."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in t["blob"])
        return pa.table([t["part"].slice(0, 1).combine_chunks(), pa.array([total.tobytes()], pa.binary())], names=["part", "blob"])

    while tasks > 1:
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("part", F.pmod("part", F.lit(tasks)).cast("int")).groupBy("part").applyInArrow(add, "part int, blob binary")
    found = parts.collect()
    return sum((np.frombuffer(r.blob) for r in found), np.zeros(1)) if found else None


class Fit:
    """Coefficients of all experiments: w[experiment, class, feature], the intercept last (one class where there are two)."""

    def __init__(self, rows: DataFrame, experiments: int, classes: int, dims: int, c: float = 1.0, max_iter: int = 100, tol: float = 1e-7):
        self.rows, self.experiments, self.free = rows.select("feats", "label", "train", "test"), experiments, 1 if classes == 2 else classes
        self.c, self.evaluations = c, 0
        self.tasks = self.rows.rdd.getNumPartitions()
        self.sent = ship(rows.sparkSession).sparkContext
        self.w = np.zeros((experiments, self.free, dims + 1))
        self.n = None
        self._fit(max_iter, tol)

    def _pass(self, w: np.ndarray, which: str, work, size: int) -> np.ndarray:
        sent, experiments, free = self.sent.broadcast(w), self.experiments, self.free

        def run(batches):
            from pyspark import TaskContext

            total = np.zeros(size)
            for x, y, here, member in _steps(batches, which, experiments, free):
                work(total, x, y, here, member, sent.value[here])
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "blob"])

        self.evaluations += 1
        out = _summed(self.rows.mapInArrow(run, "part int, blob binary"), self.tasks)
        sent.destroy()
        return np.zeros(size) if out is None else out

    def _loss(self, w: np.ndarray):
        """(loss of each experiment, gradient): mean log-loss of its rows and c's share of the squared coefficients."""
        e, free, p = w.shape

        def work(total, x, y, here, member, mine):
            z = _logits(x, mine)
            z -= z.max(2, keepdims=True)
            prob = np.exp(z)
            norm = prob.sum(2)
            at = (np.arange(len(y))[:, None], np.arange(len(here))[None], y[:, None])
            total[:e][here] += (member * (np.log(norm) - z[at])).sum(0)
            total[e : 2 * e][here] += member.sum(0)
            prob /= norm[:, :, None]
            prob[at] -= 1
            prob = (prob * member[:, :, None])[:, :, -free:]
            total[2 * e :].reshape(e, free * p)[here] += (prob.reshape(len(x), -1).T @ x).reshape(len(here), free * p)

        got = self._pass(w, "train", work, 2 * e + w.size)
        n = np.maximum(got[e : 2 * e], 1)
        strength = 1 / (self.c * n)
        plain = w.copy()
        plain[:, :, -1] = 0
        loss = got[:e] / n + strength / 2 * (plain**2).sum((1, 2))
        return loss, got[2 * e :].reshape(w.shape) / n[:, None, None] + strength[:, None, None] * plain

    def _fit(self, max_iter: int, tol: float) -> None:
        shape = self.w.shape
        loss, grad = self._loss(self.w)
        moves: list = []  # (steps, changes of gradients) of all experiments
        live = np.ones(shape[0], bool)
        for _ in range(max_iter):
            live &= np.abs(grad).max((1, 2)) > tol
            if not live.any():
                break
            q, used = grad.copy(), []
            for s, y, rho in reversed(moves):
                a = rho * (s * q).sum((1, 2))
                q -= a[:, None, None] * y
                used.append(a)
            if moves:
                s, y, _ = moves[-1]
                yy = (y * y).sum((1, 2))
                q *= np.where(yy > 0, (s * y).sum((1, 2)) / np.where(yy > 0, yy, 1), 1)[:, None, None]
            for (s, y, rho), a in zip(moves, reversed(used)):
                q += (a - rho * (y * q).sum((1, 2)))[:, None, None] * s
            slope = -(grad * q).sum((1, 2))
            size = np.where(live, 1.0, 0.0)
            if not moves:
                size = size / np.maximum(1, np.sqrt((q * q).sum((1, 2))))
            while True:
                w = self.w - size[:, None, None] * q
                new, after = self._loss(w)
                short = (size > 1e-10) & (new > loss + 1e-4 * size * slope + 1e-15)
                if not short.any():
                    break
                size = np.where(short, size / 2, size)
            s, y = w - self.w, after - grad
            sy = (s * y).sum((1, 2))
            good = sy > 1e-18
            moves = [*moves[1 - KEPT :], (np.where(good[:, None, None], s, 0), np.where(good[:, None, None], y, 0), np.where(good, 1 / np.where(good, sy, 1), 0))]
            live &= (s != 0).any((1, 2))
            self.w, loss, grad = w, new, after

    def accuracies(self) -> list[float]:
        """Of each experiment over its test rows; nan where there are none."""
        e = self.experiments

        def work(total, x, y, here, member, mine):
            hit = _logits(x, mine).argmax(2) == y[:, None]
            total[:e][here] += (member * hit).sum(0)
            total[e:][here] += member.sum(0)

        got = self._pass(self.w, "test", work, 2 * e)
        return [float(h / n) if n else float("nan") for h, n in zip(got[:e], got[e:])]
