"""Traces of agents: arrays of steps with kind, code, observation and a tool's result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.stats import rate


def steps_of(rows: DataFrame, trace: str, position: str, *columns: str) -> DataFrame:
    """Rows of steps as one trace each, in order of position."""
    steps = F.array_sort(F.collect_list(F.struct(F.col(position).alias("position"), *columns)))
    return rows.groupBy(trace).agg(steps.alias("steps"))


def count_kind(steps: Column, kind: str) -> Column:
    return F.size(F.filter(steps, lambda s: s["kind"] == kind))


def first_step(steps: Column, kind: str) -> Column:
    return F.get(F.filter(steps, lambda s: s["kind"] == kind), F.lit(0))


def last_step(steps: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(steps, lambda s: s["kind"] == kind), F.lit(-1))


def kpis(traces: DataFrame, revision: str, tool: Column) -> DataFrame:
    """One row: traces, pass rate, mean reward, tool calls, revisions, share of traces with a revision.
    traces has steps, passed, reward; tool says of a step whether it called a tool (over alias s)."""
    calls, revisions = F.size(F.filter("steps", lambda s: tool(s))), count_kind(F.col("steps"), revision)
    return traces.agg(
        F.count("*").alias("traces"),
        rate(F.count_if("passed"), F.count("*")).alias("pass_rate"),
        F.coalesce(F.avg("reward"), F.lit(0.0)).alias("mean_reward"),
        F.coalesce(F.avg(calls), F.lit(0.0)).alias("mean_tool_calls"),
        F.coalesce(F.avg(revisions), F.lit(0.0)).alias("mean_revisions"),
        rate(F.count_if(revisions > 0), F.count("*")).alias("revision_rate"),
    )


def to_rollouts(traces: DataFrame, shaped: Column, sample_index: Column | None = None) -> DataFrame:
    """A rollout for each trace, with its shaped reward."""
    return traces.select("task_id", (F.lit(0) if sample_index is None else sample_index).cast("int").alias("sample_index"), "prompt", F.col("raw_completion"), F.col("final_code").alias("code"), F.size("steps").alias("n_steps"), shaped.alias("reward"), "passed")
