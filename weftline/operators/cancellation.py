"""Cancellation of running work: a request first lets what runs come to its end, a second one stops it."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNNING, WAITING, CANCELING = "running", "waiting", "canceling"


class Canceled(RuntimeError):
    """Work that was refused, or stopped, because of a request to cancel."""


class Cancellation:
    """The state of one run and of the parts that inherit from it. Slow: the first request refuses new work and waits for what
    runs, the second stops it. Fast: the first request stops it. Jobs are found by their tag."""

    def __init__(self, spark: SparkSession, fast: bool = False, parent: Cancellation | None = None):
        self.spark, self.fast, self.parent = spark, fast, parent
        self.tag, self._own, self._parts, self._lock = f"run-{uuid.uuid4().hex}", RUNNING, [], threading.Lock()

    def child(self) -> Cancellation:
        """Of a part of the work: the parent's requests hold for it, its own don't hold for the parent."""
        part = Cancellation(self.spark, self.fast, self)
        self._parts.append(part)
        return part

    @property
    def state(self) -> str:
        above = self.parent.state if self.parent else RUNNING
        return max(self._own, above, key=(RUNNING, WAITING, CANCELING).index)

    def cancel(self) -> str:
        """One request; the state after it."""
        with self._lock:
            self._own = CANCELING if self.fast or self._own != RUNNING else WAITING
        if self._own == CANCELING:
            self._stop()
        return self.state

    def _stop(self) -> None:
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        for part in self._parts:
            part._stop()

    @contextmanager
    def _tagged(self) -> Iterator[None]:
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            yield
        finally:
            context.removeJobTag(self.tag)

    def run(self, plan: Callable[[], DataFrame], action: Callable[[DataFrame], object]) -> object:
        """The action on the plan, whose jobs a request can stop. Raises Canceled if it is refused or stopped."""
        if self.state != RUNNING:
            raise Canceled(self.state)
        try:
            with self._tagged():
                return action(plan())
        except Exception as e:
            if self.state == CANCELING:
                raise Canceled(CANCELING) from e
            raise
