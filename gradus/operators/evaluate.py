"""Summaries of rollouts: per task, overall, and by metadata fields.

A rollout has task_id, sample_index, passed, reward and, where asked for, text and metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.stats import pass_at_k, rate


def cap_samples(rollouts: DataFrame, most: int | None, order: tuple[str, ...] = ("sample_index",)) -> DataFrame:
    """The first rollouts of each task; planned with a limit below the shuffle."""
    if most is None:
        return rollouts
    if most <= 0:
        raise ValueError("the number of samples must be positive")
    rn = F.row_number().over(Window.partitionBy("task_id").orderBy(*order))
    return rollouts.withColumn("__rn", rn).where(F.col("__rn") <= most).drop("__rn")


def by_task(rollouts: DataFrame, ks: tuple[int, ...] = (1, 5, 10), keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Counts, rewards and pass@k of each task. Null rewards count as 0, null passed as not."""
    reward, passed = F.coalesce("reward", F.lit(0.0)), F.coalesce("passed", F.lit(False))
    extra = [F.count_if("degenerate").alias("degenerate")] if "degenerate" in rollouts.columns else []
    extra += [F.sum("tokens").alias("tokens")] if "tokens" in rollouts.columns else []
    got = rollouts.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.count_if(passed).alias("correct"), F.avg(reward).alias("mean_reward"), F.min(reward).alias("min_reward"), F.max(reward).alias("max_reward"), F.sum(reward).alias("reward_sum"), *extra
    )
    return got.withColumns({f"pass_at_{k}": pass_at_k(F.col("samples").cast("int"), F.col("correct").cast("int"), k) for k in ks})


def _outputs(rollouts: DataFrame) -> list[Column]:
    """Shares of failed parses and degenerate outputs and token counts, of those of the columns parse_status, degenerate and tokens that there are."""
    out = []
    if "parse_status" in rollouts.columns:
        out.append(rate(F.count_if(F.coalesce("parse_status", F.lit("")) != "ok"), F.count("*")).alias("parse_failure_rate"))
    if "degenerate" in rollouts.columns:
        out.append(rate(F.count_if("degenerate"), F.count("*")).alias("degenerate_rate"))
    if "tokens" in rollouts.columns:
        out += [F.coalesce(x, F.lit(0.0)).alias(f"{n}_tokens") for n, x in (("mean", F.avg("tokens")), ("median", F.percentile("tokens", F.lit(0.5))), ("max", F.max("tokens").cast("double")))]
    return out


def _rewards() -> list[Column]:
    reward = F.coalesce("reward", F.lit(0.0))
    found = (("mean_reward", F.avg(reward)), ("median_reward", F.percentile(reward, F.lit(0.5))), ("min_reward", F.min(reward)), ("max_reward", F.max(reward)), ("std_reward", F.stddev_pop(reward)))
    return [F.coalesce(x, F.lit(0.0)).alias(n) for n, x in found]


def overall(rollouts: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: counts, rates, mean, median, range and population deviation of rewards, share of
    informative tasks (some passed and some not), and mean pass@k over tasks; with the columns parse_status,
    degenerate and tokens also shares of failed parses and degenerate outputs, and mean, median and greatest token count."""
    tasks = by_task(rollouts, ks).agg(
        F.count("*").alias("tasks"),
        F.sum("samples").alias("rollouts"),
        rate(F.sum("correct"), F.sum("samples")).alias("pass_rate"),
        rate(F.count_if((F.col("correct") > 0) & (F.col("correct") < F.col("samples"))), F.count("*")).alias("informative"),
        *(F.coalesce(F.avg(f"pass_at_{k}"), F.lit(0.0)).alias(f"pass_at_{k}") for k in ks),
    )
    return tasks.crossJoin(rollouts.agg(*_rewards(), *_outputs(rollouts)))  # one row each


def field(source: Column, path: str, is_json: bool = False) -> Column:
    """A dotted path as group name: what is null is called missing."""
    value = F.get_json_object(source, f"$.{path}") if is_json else source
    return F.coalesce(value.cast("string"), F.lit("missing"))


def by_fields(rollouts: DataFrame, fields: dict[str, Column], ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """The summary within each value of each field, every field for itself: one pass, in which a
    rollout counts once for each field; a task is counted within its group."""
    named = F.array(*(F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in fields.items()))
    flat = rollouts.withColumn("__g", F.explode(named)).select("*", "__g.field", "__g.value").drop("__g")
    tasks = by_task(flat, ks, ("field", "value", "task_id"))
    summed = tasks.groupBy("field", "value").agg(
        F.count("*").alias("tasks"), F.sum("samples").alias("rollouts"), rate(F.sum("correct"), F.sum("samples")).alias("pass_rate"), (F.sum("reward_sum") / F.sum("samples")).alias("mean_reward"), *(F.avg(f"pass_at_{k}").alias(f"pass_at_{k}") for k in ks)
    )
    if not (more := _outputs(flat)):
        return summed
    outputs = flat.groupBy("field", "value").agg(*[x for x, n in zip(_rewards(), ("mean", "median", "min", "max", "std"), strict=True) if n in ("median", "min", "max")], *more)
    return summed.join(outputs, ["field", "value"])


def spread_above(reward: Column, least: float) -> Column:
    """Aggregate: whether the population deviation is above least.

    A deviation within 1e-9 of least is decided in whole numbers of 1e-9, n * sum(r * r) - sum(r)^2
    against (n * least)^2, where rounding can't tip it.
    """
    std, x, n = F.stddev_pop(reward), F.round(reward * 1e9).cast("decimal(19,0)"), F.count(reward).cast("decimal(10,0)")
    total = F.sum(x).cast("decimal(19,0)")
    squares = n * F.sum((x * x).cast("decimal(28,0)")).cast("decimal(28,0)") - total * total
    edge = F.lit(round(least * 1e9)).cast("decimal(14,0)") * n
    return F.when(F.abs(std - least) > 1e-9, std > least).otherwise(squares > edge * edge)


def standardized(rollouts: DataFrame, least_std: float = 0.0) -> DataFrame:
    """Rollouts with advantage, the z-score of reward within its task by population deviation;
    0 where the deviation isn't above least_std. Order and other columns stay.

    Means come from an aggregation joined back, so a task with very many rollouts is not one window.
    """
    stats = rollouts.groupBy("task_id").agg(
        F.avg("reward").alias("group_mean"), F.stddev_pop("reward").alias("group_std"), F.count_if("passed").alias("group_correct"), F.count("*").alias("group_size"), spread_above(F.col("reward"), least_std).alias("group_spread")
    )
    z = F.when(F.col("group_spread"), (F.col("reward") - F.col("group_mean")) / F.col("group_std")).otherwise(0.0)
    return rollouts.join(stats, "task_id").withColumn("advantage", z).drop("group_spread")


def step_metrics(scored: DataFrame) -> DataFrame:
    """One row about a training step, from rollouts with advantages."""
    tasks = scored.groupBy("task_id").agg(F.first("group_correct").alias("c"), F.first("group_size").alias("n"), F.first("group_std").alias("std"))
    return scored.agg(F.avg("reward").alias("mean_reward"), F.coalesce(F.stddev_pop("reward"), F.lit(0.0)).alias("std_reward"), F.avg(F.abs("advantage")).alias("mean_abs_advantage")).crossJoin(
        tasks.agg(rate(F.count_if((F.col("c") > 0) & (F.col("c") < F.col("n"))), F.count("*")).alias("informative"), rate(F.count_if(F.col("std") > 0), F.count("*")).alias("with_variance"))
    )


def clipped_smoke_step(rollouts: DataFrame, clip: float = 0.2, value_weight: float = 0.5) -> DataFrame:
    """One row about a critic step with a mean baseline and placeholder ratios from sample_index."""
    base = rollouts.agg(F.avg("reward").alias("__mean"))
    ratio = 1 + (F.pmod(F.col("sample_index"), F.lit(5)) - 2) * 0.08
    adv = F.col("reward") - F.col("__mean")
    bounded = F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), ratio))
    return rollouts.crossJoin(F.broadcast(base)).agg(  # base is one row
        F.avg("reward").alias("mean_reward"),
        F.avg(F.least(ratio * adv, bounded * adv)).alias("objective"),
        rate(F.count_if(F.abs(ratio - 1) > clip), F.count("*")).alias("clip_fraction"),
        (F.avg(adv * adv) * value_weight).alias("value_loss"),
    )
