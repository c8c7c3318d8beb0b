"""A log of the steps of a run, and counts that Spark takes on the way."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Step:
    name: str
    status: str = "pending"
    started: float | None = None
    ended: float | None = None
    details: dict = field(default_factory=dict)

    @property
    def seconds(self) -> float:
        return (self.ended - self.started) if self.started is not None and self.ended is not None else 0.0


class StepLog:
    """pending, then running, then completed or failed."""

    def __init__(self, clock=time.monotonic):
        self.clock, self.steps = clock, {}

    def start(self, name: str, **details) -> Step:
        step = self.steps.setdefault(name, Step(name))
        step.status, step.started = "running", self.clock()
        step.details |= details
        return step

    def _end(self, name: str, status: str, details: dict) -> None:
        step = self.steps[name]
        step.status, step.ended = status, self.clock()
        step.details |= details

    def complete(self, name: str, **details) -> None:
        self._end(name, "completed", details)

    def fail(self, name: str, reason: str) -> None:
        self._end(name, "failed", {"reason": reason})

    @contextmanager
    def step(self, name: str, **details) -> Iterator[Step]:
        """Starts a step, and completes it, or lets it fail with what was raised."""
        step = self.start(name, **details)
        try:
            yield step
        except BaseException as e:
            self.fail(name, str(e))
            raise
        self.complete(name)

    def reset(self) -> None:
        self.steps.clear()

    def summary(self) -> str:
        """A line for each step: state, name, seconds, details."""
        marks = {"pending": " ", "running": "~", "completed": "+", "failed": "!"}
        rows = [f"{marks[s.status]} {s.name:<12} {s.seconds:8.2f} s  " + ", ".join(f"{k}={v}" for k, v in s.details.items()) for s in self.steps.values()]
        done = sum(s.status == "completed" for s in self.steps.values())
        cells = 20 * done // max(1, len(self.steps))
        return "\n".join([*(r.rstrip() for r in rows), "█" * cells + "░" * (20 - cells)])

    def timing(self) -> dict[str, float]:
        """Seconds of each step and in all."""
        out = {s.name: s.seconds for s in self.steps.values()}
        return out | {"total": sum(out.values())}


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and its row count as soon as some action has run over it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
