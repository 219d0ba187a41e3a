"""What a session is doing, as text: jobs, their stages and tasks, executors and their memory.

python -m gneiss.console runs nothing by itself; call watch(spark) from a thread of the application.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class StageProgress:
    job: int
    stage: int
    name: str
    tasks: int
    done: int
    running: int
    failed: int


def progress(spark: SparkSession) -> list[StageProgress]:
    """The stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    out = []
    for job in tracker.getActiveJobsIds():
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            s = tracker.getStageInfo(stage)
            if s:
                out.append(StageProgress(job, stage, s.name, s.numTasks, s.numCompletedTasks, s.numActiveTasks, s.numFailedTasks))
    return out


def executors(spark: SparkSession) -> dict[str, tuple[int, int]]:
    """Address of each executor: bytes of storage memory in use and in all."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    it, out = status.iterator(), {}
    while it.hasNext():
        pair = it.next()
        most, left = pair._2()._1(), pair._2()._2()
        out[pair._1()] = (most - left, most)
    return out


def render(stages: list[StageProgress], width: int = 30) -> str:
    lines = []
    for s in stages:
        filled = width * s.done // max(1, s.tasks)
        lines.append(f"job {s.job} stage {s.stage} [{'#' * filled}{'.' * (width - filled)}] {s.done}/{s.tasks} ({s.running} running, {s.failed} failed) {s.name[:60]}")
    return "\n".join(lines) or "idle"


def watch(spark: SparkSession, until: Callable[[], bool], every: float = 0.5, say: Callable[[str], None] = print) -> None:
    """Says what runs until told to stop."""
    while not until():
        say(render(progress(spark)))
        time.sleep(every)
