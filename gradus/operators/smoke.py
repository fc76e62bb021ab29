"""Runs of several steps without a model's weights: each step makes rollouts, scores them, and tells its metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.operators import evaluate, repair, rewards, rollouts


def _scored(tasks: DataFrame, generator: rollouts.Generator, runner: Callable[[DataFrame], DataFrame], samples: int, seed: int, scorer) -> DataFrame:
    made = repair.apart(rollouts.generate(tasks, generator, samples, seed, lambda d: runner(d.withColumn("code", F.col("parsed.code")))))
    return rewards.scored(made, {"scheme": scorer or rewards.scorer()}).withColumn("reward", F.col("scheme.reward")).withColumn("passed", F.coalesce("execution.passed", F.lit(False)))


def _metrics(step: int, frame: DataFrame, made: DataFrame) -> dict:
    """A step's metrics, with its pass rate and share of failed parses, as one row on the driver."""
    more = made.agg(F.count("*").alias("rollouts"), F.coalesce(F.avg(F.col("passed").cast("int")), F.lit(0.0)).alias("pass_rate"), F.coalesce(F.avg((F.col("parsed.status") != "ok").cast("int")), F.lit(0.0)).alias("parse_failure_rate"))
    return {"step": step, **frame.crossJoin(more).first().asDict()}  # one row each


def group_relative(tasks: DataFrame, generator: rollouts.Generator, runner: Callable[[DataFrame], DataFrame], steps: int = 1, group: int = 4, seed: int = 20260601, stop_below: float = 0.0, scorer=None) -> tuple[list[dict], DataFrame]:
    """(metrics of each step, the last step's rollouts with advantages). Ends after a step whose share of
    informative tasks is below stop_below; its metrics say so. A step's seed is seed plus its number."""
    if steps < 1 or group < 1:
        raise ValueError("steps and group must be positive")
    told, last = [], tasks
    for step in range(1, steps + 1):
        last = evaluate.standardized(_scored(tasks, generator, runner, group, seed + step, scorer))
        row = _metrics(step, evaluate.step_metrics(last), last)
        told.append({**row, "stopped_early": row["informative"] < stop_below})
        if told[-1]["stopped_early"]:
            break
    return told, last


def with_critic(tasks: DataFrame, generator: rollouts.Generator, runner: Callable[[DataFrame], DataFrame], steps: int = 1, samples: int = 4, seed: int = 20260601, clip: float = 0.2, value_weight: float = 0.5, scorer=None) -> tuple[list[dict], DataFrame]:
    """(metrics of each step, the last step's rollouts)."""
    if steps < 1 or samples < 1:
        raise ValueError("steps and samples must be positive")
    told, last = [], tasks
    for step in range(1, steps + 1):
        last = _scored(tasks, generator, runner, samples, seed + step, scorer)
        told.append(_metrics(step, evaluate.clipped_smoke_step(last, clip, value_weight), last))
    return told, last
