"""Learning curves: a row for each cycle of a run, from what the cycle has written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.stats import rate


def cycle_of(path: Column, fallback: Column | None = None) -> Column:
    n = F.regexp_extract(path, r"cycle_0*(\d+)/[^/]*$", 1).try_cast("int")
    return n if fallback is None else F.coalesce(n, fallback)


def points(rollouts: DataFrame, metrics: DataFrame | None = None, checkpoints: DataFrame | None = None, evaluations: DataFrame | None = None) -> DataFrame:
    """A row for each cycle: rollouts, pass rate, mean reward; mean losses (null values ignored, none
    at all: 0); optimizer steps, those flagged or else what the checkpoint counts; evaluation."""
    out = rollouts.groupBy("cycle").agg(F.count("*").alias("rollouts"), rate(F.count_if("passed"), F.count("*")).alias("pass_rate"), F.coalesce(F.avg("reward"), F.lit(0.0)).alias("mean_reward"))
    if metrics is not None:
        names = [c for c in metrics.columns if c not in ("cycle", "optimizer_step")]
        m = metrics.groupBy("cycle").agg(F.count_if("optimizer_step").alias("__steps"), *(F.avg(F.col(n).cast("double")).alias(n) for n in names))
        out = out.join(m, "cycle", "full_outer").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})
        if checkpoints is not None:
            out = out.join(checkpoints.select("cycle", F.col("optimizer_step_count").alias("__ckpt")), "cycle", "left")
        steps = [F.nullif("__steps", F.lit(0)), *([F.col("__ckpt")] if checkpoints is not None else []), F.lit(0)]
        out = out.withColumn("optimizer_steps", F.coalesce(*steps).cast("long")).drop("__steps", "__ckpt")
    return out if evaluations is None else out.join(evaluations, "cycle", "left")


def long_form(curve: DataFrame, keys: tuple[str, ...] = ("cycle",)) -> DataFrame:
    """(keys, metric, value) of all numbers that aren't null."""
    values = [c for c, t in curve.dtypes if c not in keys and t in ("double", "float", "int", "bigint")]
    return curve.select(*keys, *(F.col(c).cast("double").alias(c) for c in values)).unpivot([*keys], values, "metric", "value").where("value is not null")


def last_metric(rows: DataFrame, order: str) -> DataFrame:
    return rows.agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def labelled(runs: dict[str, DataFrame]) -> DataFrame:
    """The curves of many runs as one, by label."""
    out = None
    for label, df in runs.items():
        part = df.withColumn("label", F.lit(label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no runs")
    return out
