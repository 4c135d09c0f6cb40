"""A solver's time loop: steps on checkpointed tables, with output at equal or given times."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..plans.cuts import cut


@dataclass
class OutputPolicy:
    """EQUISPACED: every ``interval``; PREDEFINED: at ``times``."""

    interval: float | None = None
    times: tuple[float, ...] = ()
    done: int = field(default=0)

    def due(self, now: float) -> bool:
        if self.interval is not None:
            return now + 1e-14 >= self.done * self.interval
        return self.done < len(self.times) and now + 1e-14 >= self.times[self.done]

    def next_after(self, now: float) -> float | None:
        if self.interval is not None:
            return (self.done + 1) * self.interval
        return next((t for t in self.times if t > now + 1e-14), None)


def run(state: DataFrame, step: Callable[[DataFrame, float], DataFrame], time_step: Callable[[DataFrame], float], end: float, policy: OutputPolicy | None = None, save: Callable[[DataFrame, float, int], None] | None = None, max_iterations: int = 1_000_000, adapt: Callable[[DataFrame], DataFrame] | None = None, adapt_every: int = 10) -> tuple[DataFrame, float, int]:
    """Steps until ``end``; each step's table is checkpointed, so plans don't grow. Returns the last state, time and iteration."""
    now, iteration = 0.0, 0
    while now < end - 1e-14 and iteration < max_iterations:
        if policy and save and policy.due(now):
            save(state, now, iteration)
            policy.done += 1
        dt = min(time_step(state), end - now)
        if adapt and iteration and iteration % adapt_every == 0:
            state = cut(adapt(state))
        state = cut(step(state, dt))
        now += dt
        iteration += 1
    if policy and save and policy.due(now):
        save(state, now, iteration)
        policy.done += 1
    return state, now, iteration
