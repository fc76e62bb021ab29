"""Experiment matrices, selection of runs, and comparison of algorithms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.text import short_number

AXES = ("seed", "group_size", "kl_beta", "curriculum_mode", "reward_name")


def matrix(spark: SparkSession, max_steps: int, **axes: tuple) -> DataFrame:
    """All combinations of the axes, numbered in nested order: a range of numbers whose mixed digits are places
    in the axes. Cross joins of lists would make as many tasks as their partitions' product."""
    rows = math.prod(len(axes[n]) for n in AXES)
    out, below = spark.range(0, rows, 1, 1 + rows // 100_000).withColumnRenamed("id", "ord"), rows
    for name in AXES:
        above, below = below, below // max(1, len(axes[name]))
        out = out.withColumn(name, F.get(_values(axes[name]), F.expr(f"ord % {max(1, above)} div {max(1, below)}").cast("int")))
    return out.withColumn("max_steps", F.lit(max_steps)).withColumn("slug", slug()).select("ord", *AXES, "max_steps", "slug")


def _values(values: tuple) -> Column:
    """An axis as an array; integers are bigint."""
    whole = all(isinstance(v, int) and not isinstance(v, bool) for v in values if v is not None)
    return F.array(*(F.lit(v).cast("bigint") if whole else F.lit(v) for v in values))


def slug():
    return F.concat_ws("_", F.concat(F.lit("g"), F.col("group_size").cast("string")), F.concat(F.lit("kl"), F.replace(short_number(F.col("kl_beta")), F.lit("."), F.lit("p"))), F.col("curriculum_mode"), F.col("reward_name"), F.concat(F.lit("seed"), F.col("seed").cast("string")))


def best_run(runs: DataFrame, metric: str = "mean_reward", skip_stopped: bool = True, least_informative: float = 0.0) -> DataFrame:
    """The run with the greatest metric, then informative share, pass rate, and least parse failures; ties to the first."""
    ok = runs.where(F.col("informative") >= least_informative)
    ok = ok.where(~F.coalesce("stopped_early", F.lit(False))) if skip_stopped else ok
    return ok.orderBy(F.desc(metric), F.desc("informative"), F.desc("pass_rate"), "parse_failure_rate", "ord").limit(1)


def seed_averages(runs: DataFrame, keys: tuple[str, ...] = ("group_size", "kl_beta", "curriculum_mode", "reward_name"), metrics: tuple[str, ...] = ("mean_reward", "informative", "with_variance", "pass_rate", "parse_failure_rate")) -> DataFrame:
    """Unweighted means over seeds, and how many runs."""
    kinds = dict(runs.dtypes)
    name = F.concat_ws("|", *(short_number(F.col(k)) if kinds[k] in ("double", "float") else F.col(k).cast("string") for k in keys))
    return runs.groupBy(name.alias("variant")).agg(F.count("*").alias("runs"), *(F.avg(m).alias(m) for m in metrics))


def compare_algorithms(a: DataFrame, b: DataFrame, metrics: tuple[str, ...] = ("mean_reward", "pass_rate")) -> DataFrame:
    """Two frames of one row: their metrics, b less a, and whether both had the same budget of rollouts."""
    left, right = (x.select(*(F.col(c).alias(f"{n}_{c}") for c in (*metrics, "rollouts"))) for n, x in (("a", a), ("b", b)))
    out = left.crossJoin(F.broadcast(right))
    return out.select("*", *((F.col(f"b_{m}") - F.col(f"a_{m}")).alias(f"delta_{m}") for m in metrics), (F.col("a_rollouts") == F.col("b_rollouts")).alias("same_budget"))


def weighted_mean(steps: DataFrame, value: str = "mean_reward", weight: str = "records_used") -> DataFrame:
    return steps.agg(F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight).cast("double")), F.lit(0.0)).alias(value))
