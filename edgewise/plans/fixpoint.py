"""Loop to a fixed point over a DataFrame state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from edgewise.plans.scratch import Scratch, Table


@dataclass
class LoopResult:
    """Final state, with what happened on the way."""

    state: DataFrame
    iterations: int
    converged: bool
    changes: list[int] = field(default_factory=list)


def iterate(
    scratch: Scratch,
    start: Table,
    step: Callable[[DataFrame, int], DataFrame],
    max_iters: int | None = None,
    changed: Column | None = None,
    stop: Callable[[object], bool] | None = None,
    carry: Callable[[dict], int] = lambda row: row["n"],
    n: int = 0,
) -> LoopResult:
    """Apply `step` until a round changes nothing, or for `max_iters` rounds if given.

    `step(state, n)` gets the last state and its row count. `changed` is an
    aggregate over the new state (default: `sum(changed)`). It and the row count are
    observed by the job that writes the state, which counts each output partition once, so a
    retried task cannot inflate them and a round is one job.
    """
    state, changes, done = start, [], False
    measure = F.sum(F.col("changed").cast("bigint")) if changed is None else changed
    rounds = 0
    while not done and (max_iters is None or rounds < max_iters):
        told = Observation()
        new = scratch.write(
            step(state.df, n).observe(told, F.coalesce(measure, F.lit(0)).alias("changed"), F.count(F.lit(1)).alias("n"))
        )
        seen = told.get
        state.drop()
        state, n = new, carry(seen)
        rounds += 1
        changes.append(seen["changed"])
        done = stop(seen["changed"]) if stop else seen["changed"] == 0
    return LoopResult(state.df, rounds, done, changes)
