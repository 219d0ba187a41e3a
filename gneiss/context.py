"""Headers that travel with a query's tasks, and state that tasks of one worker keep for a while."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import TaskContext
from pyspark.sql import SparkSession

PREFIX = "gneiss.header."


@contextmanager
def headers(spark: SparkSession, **values: str) -> Iterator[None]:
    """Sets headers for the jobs that are started within; tasks read them with header()."""
    sc = spark.sparkContext
    before = {k: sc.getLocalProperty(PREFIX + k) for k in values}
    for k, v in values.items():
        sc.setLocalProperty(PREFIX + k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            sc.setLocalProperty(PREFIX + k, v)


def header(name: str) -> str | None:
    """A header of the running task, None outside of tasks or where it was not set."""
    task = TaskContext.get()
    return task.getLocalProperty(PREFIX + name) if task else None


class Kept:
    """Values by key that expire when they have not been used for `idle` seconds, at most `most` of
    them (the least recently used go first)."""

    def __init__(self, idle: float = 600.0, most: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.idle, self.most, self.clock = idle, most, clock
        self._values: dict[Any, tuple[float, Any]] = {}

    def __len__(self) -> int:
        self._expire()
        return len(self._values)

    def get(self, key: Any, make: Callable[[], Any]) -> Any:
        self._expire()
        value = self._values.pop(key)[1] if key in self._values else make()
        self._values[key] = (self.clock(), value)
        while len(self._values) > self.most:
            del self._values[next(iter(self._values))]
        return value

    def forget(self, key: Any) -> None:
        self._values.pop(key, None)

    def _expire(self) -> None:
        since = self.clock() - self.idle
        for key in [k for k, (used, _) in self._values.items() if used < since]:
            del self._values[key]
