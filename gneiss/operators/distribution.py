"""Explicit placement: repartitioning, coalescing, unions with shares of tasks, task identity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.joins import apart


def by_hash(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    return df.repartition(parts, *keys)


def by_range(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    return df.repartitionByRange(parts, *keys)


def round_robin(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts)


def coalesced(df: DataFrame, parts: int = 1) -> DataFrame:
    return df.coalesce(parts)


def shares(weights: list[float], budget: int, most: list[int | None] | None = None) -> list[int]:
    """How many of `budget` tasks each child gets: whole shares by weight, the rest by the largest
    remainders, none beyond its cap.  The sum is the budget unless all are at their caps; a child may
    get none."""
    cap = [budget if m is None else min(m, budget) for m in most or [None] * len(weights)]
    total = sum(weights)
    exact = [budget * w / total if total else budget / len(weights) for w in weights]
    out = [min(c, int(e)) for e, c in zip(exact, cap, strict=True)]
    order = sorted(range(len(weights)), key=lambda i: (not exact[i], int(exact[i]) - exact[i], i))
    while sum(out) < budget and (able := [i for i in order if out[i] < cap[i]]):
        for i in [i for i in able if exact[i]] or able:
            if sum(out) < budget:
                out[i] += 1
    return out


def isolated_union(children: list[DataFrame], budget: int, weights: list[float] | None = None, most: list[int | None] | None = None) -> DataFrame:
    """UNION ALL in which each child keeps to its own share of the tasks.  Children without a share are
    dealt in turn over those that have one and share their tasks."""
    count = shares(weights or [1.0] * len(children), budget, most)
    owners = [i for i, n in enumerate(count) if n]
    if not owners:
        raise ValueError("no child may have a task")
    guests = [i for i, n in enumerate(count) if not n]
    out = None
    alone = all(count[i] == 1 for i in owners)
    for turn, i in enumerate(owners):
        part = children[i]
        for g in guests[turn :: len(owners)]:
            part = part.unionByName(children[g])
        part = part.coalesce(count[i])
        if alone:
            part = apart(part)
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class TaskCount:
    """A wish (desired) or a bound (maximum) for the number of tasks of a part of the plan."""

    desired: int | None = None
    maximum: int | None = None

    def __or__(self, other: TaskCount) -> TaskCount:
        """Both together: the larger wish and the smaller bound."""
        wishes = [n for n in (self.desired, other.desired) if n is not None]
        bounds = [n for n in (self.maximum, other.maximum) if n is not None]
        return TaskCount(max(wishes, default=None), min(bounds, default=None))

    def resolve(self, now: int) -> int:
        """The number of tasks for a part that has `now`: a bound beats a wish."""
        n = self.desired or now
        return max(1, min(n, self.maximum) if self.maximum is not None else n)


def with_task_count(df: DataFrame, *hints: TaskCount) -> DataFrame:
    """df in as many tasks as the hints together ask for: fewer without a shuffle, more with one."""
    merged = TaskCount()
    for hint in hints:
        merged = merged | hint
    now = df.rdd.getNumPartitions()
    n = merged.resolve(now)
    return df if n == now else df.coalesce(n) if n < now else df.repartition(n)


def interleaved(children: list[DataFrame], parts: int, *keys: str) -> DataFrame:
    """UNION ALL of children dealt alike by their keys: partition i of the result holds partition i of
    every child, so what follows on these keys needs no further shuffle."""
    out = children[0].repartition(parts, *keys)
    for child in children[1:]:
        out = out.unionByName(child.repartition(parts, *keys))
    return out


def with_task(df: DataFrame) -> DataFrame:
    """df with the number of the partition each row is in."""
    return df.withColumn("task", F.spark_partition_id())
