"""Building a task set: union of sources, held-out tests, splits, uniqueness, quality gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.operators import contamination, splits


class ContaminatedError(ValueError):
    """Raised by the gate; findings has counts by kind."""

    def __init__(self, findings: dict[str, int]):
        super().__init__(f"the task set is contaminated: {findings}")
        self.findings = findings


def build(sources: list[DataFrame], hold_out: bool = False, visible: int = 1, fractions: dict[str, float] | None = None, seed: int = 20260601, threshold: float = 0.92, gate: bool = True, name: str | None = None, version: str | None = None) -> dict:
    """tasks in order of ids, findings, and the manifest. With gate, findings raise."""
    tasks = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    if hold_out:
        tasks = tasks.withColumns(splits.hold_out(visible=visible))
    if fractions is not None:
        tasks = splits.assign(tasks, fractions, seed)
    tasks = splits.require_unique(tasks)
    report = contamination.quality_report(tasks, threshold)
    counts = {name: frame.count() for name, frame in report.items()}
    if gate and any(counts.values()):
        raise ContaminatedError(counts)
    by_split = {r["split"]: r["count"] for r in tasks.groupBy("split").count().orderBy("split").collect()}
    without = tasks.where(F.size("hidden_tests") == 0).count()
    manifest = {"tasks": sum(by_split.values()), "split_counts": by_split, "findings": counts, "passed": not any(counts.values()), "without_hidden_tests": without, "seed": seed, "name": name, "version": version}
    return {"tasks": tasks.orderBy("task_id"), "findings": report, "manifest": manifest}
