"""Totals that a pass over rows leaves behind, without a pass of their own."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation


@dataclass
class Watch:
    """Observed steps by name; those whose name lacks `only` are not observed and cost nothing."""

    only: str = ""
    steps: dict[str, Observation] = field(default_factory=dict)
    times: dict[str, list[float]] = field(default_factory=dict)

    def on(self, df: DataFrame, name: str, **totals: Column) -> DataFrame:
        """df, whose next action also gives these aggregates."""
        if self.only not in name:
            return df
        self.steps[name] = Observation(name)
        return df.observe(self.steps[name], *(c.alias(n) for n, c in totals.items()))

    def totals(self, name: str) -> dict:
        """The aggregates of a step, once an action has run; none where it is not observed."""
        return self.steps[name].get if name in self.steps else {}

    def timed(self, name: str, action):
        """The result of an action; its seconds are kept under the name."""
        began = time.perf_counter()
        result = action()
        if self.only in name:
            self.times.setdefault(name, []).append(time.perf_counter() - began)
        return result

    def seconds(self, name: str) -> tuple[int, float, float]:
        """(steps, total, mean) of a name."""
        own = self.times.get(name, [])
        return len(own), sum(own), sum(own) / max(1, len(own))
