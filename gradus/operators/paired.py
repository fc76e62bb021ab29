"""Paired comparison of two systems over the same tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.functions.stats import binomial_two_sided, hash_unit, low_quantile, rate, sign_flip_p
from gradus.sources.records import flat_rollouts, read_rollouts


#: Draws of one row of the bootstrap.
_CHUNK = 10_000


def one_per_task(rollouts: DataFrame, sample_index: int = 0, ties: tuple[str, ...] = ("reward", "passed")) -> DataFrame:
    """The rollout with that sample_index, else that with the lowest; of those alike the first by ties."""
    best = F.row_number().over(Window.partitionBy("task_id").orderBy((F.col("sample_index") == sample_index).desc(), "sample_index", *ties))
    return rollouts.withColumn("__rn", best).where("__rn = 1").drop("__rn")


def outcomes(base: DataFrame, candidate: DataFrame, sample_index: int = 0) -> DataFrame:
    """task_id, and passed and reward of both systems, of the tasks that both have."""
    a, b = (one_per_task(x, sample_index).select("task_id", F.coalesce("passed", F.lit(False)).alias(f"{n}_passed"), F.coalesce("reward", F.lit(0.0)).alias(f"{n}_reward")) for n, x in (("base", base), ("candidate", candidate)))
    return a.join(b, "task_id")


def cells(pairs: DataFrame) -> DataFrame:
    a, b = F.col("base_passed"), F.col("candidate_passed")
    return pairs.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("base_only"), F.count_if(~a & b).alias("candidate_only"), F.count_if(~a & ~b).alias("neither"))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """The four cells, how many disagree, and the exact p."""
    c = cells(pairs).withColumn("discordant", F.col("base_only") + F.col("candidate_only"))
    return c.withColumn("p_value", binomial_two_sided(F.least("base_only", "candidate_only"), F.col("discordant")))


def permutation(pairs: DataFrame, samples: int = 10_000, seed: int = 20260601, exact: int = 20) -> DataFrame:
    """Sign-flip test over the tasks where the systems differ: exact for up to `exact` of them, else
    by `samples` random flips with one added to both counts.

    Flips are bits of a hash, so results don't depend on partitions. All deltas are +1 or
    -1: a sample needs no more than how many of its flips turn signs; the grid of samples and
    deltas is made row by row and summed up before it is shuffled.
    """
    c = cells(pairs).select(F.col("candidate_only").alias("plus"), (F.col("candidate_only") + F.col("base_only")).alias("n"))
    closed = c.select("n", "plus", sign_flip_p(F.col("n"), F.col("plus")).alias("exact_p"))
    differ = pairs.where(F.col("base_passed") != F.col("candidate_passed"))
    delta = F.when(F.col("candidate_passed"), 1).otherwise(-1)
    grid = differ.select("task_id", delta.alias("d"), F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // 32))).alias("word"))
    word = hash_unit(F.lit(seed), F.col("word"), F.col("task_id"))
    bits = grid.select("word", "d", word.alias("h"))
    sums = bits.groupBy("word").agg(*(F.sum(F.when(F.shiftright("h", i).bitwiseAND(F.lit(1)) == 1, F.col("d")).otherwise(-F.col("d"))).alias(f"s{i}") for i in range(32)))
    each = sums.select("word", F.posexplode(F.array(*(F.col(f"s{i}") for i in range(32)))).alias("bit", "total")).where(F.col("word") * 32 + F.col("bit") < samples)
    far = each.crossJoin(F.broadcast(closed)).agg(F.count_if(F.abs("total") >= F.abs(2 * F.col("plus") - F.col("n"))).alias("extreme"))  # one row
    return closed.crossJoin(far).select(
        "n",
        (2 * F.col("plus") - F.col("n")).alias("observed"),
        (F.col("n") <= exact).alias("is_exact"),
        F.when(F.col("n") <= exact, F.col("exact_p")).otherwise((F.col("extreme") + 1) / (samples + 1)).alias("p_value"),
    )


def bootstrap(pairs: DataFrame, samples: int = 2000, seed: int = 20260601, confidence: float = 0.95) -> DataFrame:
    """Interval of the difference in pass rates over tasks drawn with replacement.

    A draw picks one of n ranks by hash; only the four kinds of outcome matter, so ranks are laid
    out kind by kind and no draw needs a join: its rank says whether its delta is +1, -1 or 0. Draws are
    made in chunks and summed up before they are shuffled, so no row grows with the tasks.
    """
    c = cells(pairs).select(F.col("candidate_only").alias("up"), F.col("base_only").alias("down"), (F.col("both") + F.col("base_only") + F.col("candidate_only") + F.col("neither")).alias("n"))
    spark = pairs.sparkSession
    reps = spark.range(samples).withColumnRenamed("id", "rep").crossJoin(F.broadcast(c)).where("n > 0")
    parts = reps.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_CHUNK).cast("long"))))
    draws = parts.withColumn("i", F.explode(F.sequence("low", F.least(F.col("low") + _CHUNK, F.col("n")) - 1)))
    at = F.pmod(hash_unit(F.lit(seed), F.col("rep"), F.col("i")), F.col("n"))
    delta = F.when(at < F.col("up"), 1).when(at < F.col("up") + F.col("down"), -1).otherwise(0)
    means = draws.groupBy("rep").agg((F.sum(delta) / F.count("*")).alias("m"))
    tail = (1 - confidence) / 2
    all_means = F.collect_list("m")  # as many as samples
    return means.agg(F.avg("m").alias("mean"), low_quantile(all_means, tail).alias("low"), low_quantile(all_means, 1 - tail).alias("high"))


def effects(pairs: DataFrame) -> DataFrame:
    """Pass rates, their difference in points, lift, reduction of errors, standardized reward difference; null where undefined."""
    a, b = F.avg(F.col("base_passed").cast("int")), F.avg(F.col("candidate_passed").cast("int"))
    d = F.col("candidate_reward") - F.col("base_reward")
    return pairs.agg(
        F.count("*").alias("tasks"),
        a.alias("base_rate"),
        b.alias("candidate_rate"),
        ((b - a) * 100).alias("delta_points"),
        F.try_divide(b - a, F.nullif(a, F.lit(0.0))).alias("relative_lift"),
        F.try_divide(b - a, F.nullif(1 - a, F.lit(0.0))).alias("error_reduction"),
        F.avg(d).alias("reward_delta"),
        F.try_divide(F.avg(d), F.nullif(F.stddev_pop(d), F.lit(0.0))).alias("standardized_reward_delta"),
    )


def compare(base: DataFrame, candidate: DataFrame, sample_index: int = 0, **kwargs) -> dict[str, DataFrame]:
    """All of the above on one frame of outcomes; raises if no task is shared."""
    pairs = outcomes(base, candidate, sample_index).cache()
    if pairs.isEmpty():
        raise ValueError("the systems share no task")
    return {"outcomes": pairs, "mcnemar": mcnemar(pairs), "permutation": permutation(pairs, **{k: v for k, v in kwargs.items() if k == "seed"}), "bootstrap": bootstrap(pairs, **{k: v for k, v in kwargs.items() if k in ("seed", "confidence")}), "effects": effects(pairs)}


def compare_files(spark: SparkSession, base: str, candidate: str, **kwargs) -> dict[str, DataFrame]:
    """compare, over two JSONL files of rollouts."""
    return compare(*(flat_rollouts(read_rollouts(spark, p)) for p in (base, candidate)), **kwargs)


def changed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of the tasks that only the candidate passes, and of those that only the base does."""
    return tuple(pairs.where((F.col("candidate_passed") == up) & (F.col("base_passed") != up)).select("task_id") for up in (True, False))


def curve_rate(pairs: DataFrame) -> DataFrame:
    return pairs.agg(rate(F.count_if("candidate_passed"), F.count("*")).alias("rate"))
