"""Running a join and telling what it took: rows, seconds, throughput, and the executed plan's own metrics by phase."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

#: Phase of a plan node, by the start of its name.
PHASES = {"Scan": "scan", "Range": "scan", "Exchange": "partition", "BroadcastExchange": "build", "ShuffledHashJoin": "join", "BroadcastHashJoin": "join", "SortMergeJoin": "join", "Sort": "sort", "Window": "align", "Generate": "expand", "HashAggregate": "aggregate", "ObjectHashAggregate": "aggregate"}


@dataclass
class JoinMetrics:
    algorithm: str
    r_rows: int
    s_rows: int
    matches: int
    seconds: float
    mrec_per_s: float
    phases: dict[str, dict[str, int]] = field(default_factory=dict)
    plan: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return asdict(self)


def _children(node) -> list:  # noqa: ANN001  a plan node of the JVM
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return [node.executedPlan()]
    if "QueryStage" in name:
        return [node.plan()]
    kids = node.children()
    return [kids.apply(i) for i in range(kids.size())]


def plan_metrics(df_jvm) -> tuple[dict[str, dict[str, int]], list[str]]:  # noqa: ANN001  a query execution of the JVM
    """Metrics of an executed plan summed by phase, and the names of its nodes from the top."""
    phases: dict[str, dict[str, int]] = {}
    names, todo = [], [df_jvm.executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        names.append(name)
        phase = next((p for start, p in PHASES.items() if name.startswith(start)), None)
        if phase:
            own, entries = phases.setdefault(phase, {}), node.metrics().toSeq()
            for i in range(entries.size()):
                key, value = entries.apply(i)._1(), entries.apply(i)._2().value()
                own[key] = own.get(key, 0) + max(0, value)
        todo += reversed(_children(node))
    return phases, names


def measured(algorithm: str, rows: DataFrame, r_rows: int, s_rows: int) -> JoinMetrics:
    """Run a join's rows to the end, counting them, and tell what it took. Throughput is (|R| + |S|) / time in million rows a second."""
    execution = rows._jdf.queryExecution()
    began = time.perf_counter()
    matches = execution.toRdd().count()
    seconds = time.perf_counter() - began
    phases, names = plan_metrics(execution)
    return JoinMetrics(algorithm, r_rows, s_rows, matches, round(seconds, 4), round((r_rows + s_rows) / seconds / 1e6, 4), phases, names)
