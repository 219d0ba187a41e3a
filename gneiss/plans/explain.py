"""Plans as stages, and runs with their measurements (the role of EXPLAIN ANALYZE)."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame

_EXCHANGES = ("Exchange", "BroadcastExchange")


def _children(node) -> list:
    out = node.children()
    return [out.apply(i) for i in range(out.size())]


def _final(node):
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _final(node.executedPlan())
    if name in {"ShuffleQueryStageExec", "BroadcastQueryStageExec", "TableCacheQueryStageExec", "ResultQueryStageExec"}:
        return _final(node.plan())
    return node


def stages(df: DataFrame) -> list[list[str]]:
    """Operators of each stage, the result's stage first; exchanges end a stage."""
    out: list[list[str]] = []

    def walk(node, stage: list[str]) -> None:
        node = _final(node)
        name = node.nodeName()
        stage.append(name)
        for child in _children(node):
            if name.startswith(_EXCHANGES) or "Exchange" in name:
                below: list[str] = []
                out.append(below)
                walk(child, below)
            else:
                walk(child, stage)

    head: list[str] = []
    out.append(head)
    walk(df._jdf.queryExecution().executedPlan(), head)
    return out


def render(df: DataFrame) -> str:
    """The stages as boxes of text."""
    lines = []
    for k, operators in enumerate(stages(df)):
        width = max(len(o) for o in operators) + 2
        lines += [f"┌ stage {k} " + "─" * max(0, width - len(f" stage {k} ")) + "┐"]
        lines += [f"│ {o}".ljust(width + 1) + "│" for o in operators]
        lines += ["└" + "─" * width + "┘"]
    return "\n".join(lines)


def graphviz(df: DataFrame) -> str:
    """The stages as a Graphviz digraph."""
    boxes = [f'  s{k} [shape=box,label="stage {k}\\n' + "\\n".join(o.replace('"', "'") for o in ops) + '"];' for k, ops in enumerate(stages(df))]
    return "digraph plan {\n" + "\n".join(boxes) + "\n}"


@dataclass
class Report:
    rows: int
    seconds: float
    plan: str
    metrics: dict[str, int]


def analyze(df: DataFrame) -> Report:
    """Runs df once, without keeping its rows, and tells rows, duration and the operators' metrics."""
    began = time.perf_counter()
    execution = df._jdf.queryExecution()
    rows = execution.toRdd().count()  # runs this very plan, so that its metrics fill
    took = time.perf_counter() - began
    metrics: dict[str, int] = {}

    def walk(node) -> None:
        node = _final(node)
        it = node.metrics().iterator()
        while it.hasNext():
            pair = it.next()
            key = f"{node.nodeName()}.{pair._1()}"
            metrics[key] = metrics.get(key, 0) + pair._2().value()
        for child in _children(node):
            walk(child)

    walk(execution.executedPlan())
    return Report(rows, took, render(df), metrics)


@dataclass
class StageTasks:
    """A stage that ran, and its tasks' durations (milliseconds), rows and bytes."""

    stage: int
    tasks: int
    durations: dict[str, float]
    per_task: list[dict[str, int]]


def analyze_tasks(df: DataFrame) -> tuple[Report, list[StageTasks]]:
    """As analyze, with what each task of each stage took: durations by percentile, and per task its
    duration, rows and bytes read and written, and spill."""
    sc = df.sparkSession.sparkContext
    group = f"gneiss-analyze-{uuid.uuid4().hex}"
    sc.setJobGroup(group, "analyze")
    try:
        report = analyze(df)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    ids = sorted({s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds})
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, out = sc._jsc.sc().statusStore(), []
    for stage in ids:
        listed = store.taskList(stage, 0, 1_000_000)
        rows = []
        for i in range(listed.size()):
            task = listed.apply(i)
            took, metrics = task.duration(), task.taskMetrics()
            if took.isEmpty() or metrics.isEmpty():
                continue
            m = metrics.get()
            rows.append({
                "task": task.index(),
                "milliseconds": took.get(),
                "rows_read": m.inputMetrics().recordsRead() + m.shuffleReadMetrics().recordsRead(),
                "bytes_read": m.inputMetrics().bytesRead() + m.shuffleReadMetrics().localBytesRead() + m.shuffleReadMetrics().remoteBytesRead(),
                "rows_written": m.shuffleWriteMetrics().recordsWritten(),
                "bytes_written": m.shuffleWriteMetrics().bytesWritten(),
                "bytes_spilled": m.diskBytesSpilled(),
            })
        if rows:
            out.append(StageTasks(stage, len(rows), percentiles([float(r["milliseconds"]) for r in rows]), sorted(rows, key=lambda r: r["task"])))
    return report, out


def percentiles(values: list[float]) -> dict[str, float]:
    """min, max, avg and nearest-rank p50, p75, p95 and p99."""
    ordered = sorted(values)
    at = lambda p: ordered[max(0, -(-len(ordered) * p // 100) - 1)]
    return {"min": ordered[0], "max": ordered[-1], "avg": sum(ordered) / len(ordered)} | {f"p{p}": at(p) for p in (50, 75, 95, 99)}
