"""Training with local steps: tasks go on from the same matrices, each over batches of its own, and are averaged.

A step for each batch of sentences takes as many jobs as there are batches. Here a round deals tasks * steps batches in turn to
tasks; a task takes a step of the optimizer for each of its batches, in their order, on its own copy of the matrices. The
round ends with the mean of the copies and of their moments, weighted by steps taken. One task gives the very
steps of Trainer; several give others, as tasks don't see each other's steps within a round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.sgns import Trainer, batch_gradient, capped, step_means
from vecloom.operators.sharded import PART, added
from vecloom.operators.storage import drop, ship

#: Rows of a matrix in one blob.
ROWS = 4096
#: Rows of examples that a gradient is worked out for at a time.
EXAMPLES = 4096


@dataclass
class LocalTrainer(Trainer):
    """Trainer over examples with a column `batch` whose rounds take `local_steps` steps in each of `tasks` tasks. A task holds both
    matrices, their moments and the examples of its batches of one round. One step's figures are logged a round."""

    tasks: int = 8
    local_steps: int = 16

    def _shares(self, df: DataFrame) -> None:
        raise ValueError("local steps take examples with a column batch, see batch_examples()")

    def _batches(self, df: DataFrame) -> None:
        table, count = self._kept(df)
        each = self.tasks * self.local_steps
        for first in range(0, count, each):
            self._pace()
            mine = table.where((F.col("batch") >= first) & (F.col("batch") < first + each))
            means = self._round(mine, self.epoch * count, min(self.local_steps, -(-(count - first) // self.tasks)))
            if means is not None:
                self._log(means)
        drop(table)

    def _round(self, examples: DataFrame, base: int, steps: int) -> dict | None:
        spark = ship(examples.sparkSession)
        kind, lr, t0, cap, dims = type(self.state), self.state.lr, self.state.t, self.max_norm, self.dims
        sent = spark.sparkContext.broadcast((self.params, self.state.m, self.state.v))
        noisy = self._noisy(examples, F.lit(base).cast("long") + F.col("batch"), ("batch",))
        dealt = noisy.select(F.pmod("batch", F.lit(self.tasks)).cast("int").alias("task"), "batch", "inputs", "target", "n", "neg")

        def run(t: pa.Table) -> pa.Table:
            params, m, v = (dict(x) for x in sent.value)
            own, sums, taken = kind(lr=lr, t=t0, m=m, v=v), np.zeros(6), 0
            t = t.sort_by([("batch", "ascending"), ("target", "ascending"), ("n", "ascending")])
            numbers = t["batch"].to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
            for a, b in zip(ends[:-1], ends[1:]):
                grads, one = [np.zeros_like(params[s]) for s in ("input", "output")], np.zeros(6)
                for r in t.slice(a, b - a).select(["inputs", "target", "n", "neg"]).to_batches(EXAMPLES):
                    one += batch_gradient(r, params["input"], params["output"], grads)
                own.step(params, {s: g / one[0] for s, g in zip(("input", "output"), grads)})
                params = {s: capped(x, cap) for s, x in params.items()}
                sums, taken = sums + one, taken + 1
            task, rows = t["task"][0].as_py(), []
            for name, mats in (("", params), ("m-", own.m), ("v-", own.v)):
                for side, x in mats.items():
                    for k in range(0, len(x), ROWS):
                        # figures go with one blob of a task
                        figures = [taken, *sums] if name == "" and side == "input" and k == 0 else [0.0] * 7
                        rows.append((name + side, k // ROWS, task, (x[k : k + ROWS] * taken).tobytes(), [float(f) for f in figures]))
            names = ["side", "shard", "part", "blob", "sums"]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64()))
            return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows = added(dealt.groupBy("task").applyInArrow(run, PART), self.tasks).collect()
        sent.destroy()
        if not rows:
            return None
        figures = sum(np.array(r.sums) for r in rows)
        into = {"": self.params, "m-": self.state.m, "v-": self.state.v}
        for r in sorted(rows, key=lambda r: (r.side, r.shard)):
            prefix, side = (r.side[:2], r.side[2:]) if r.side[1] == "-" else ("", r.side)
            mats = into[prefix]
            if r.shard == 0:
                mats[side] = np.empty((self.vocab, dims))
            mats[side][r.shard * ROWS : (r.shard + 1) * ROWS] = np.frombuffer(r.blob).reshape(-1, dims) / figures[0]
        self.state.t += steps
        return step_means(figures[1:])
