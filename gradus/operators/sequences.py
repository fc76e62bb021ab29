"""Arithmetic over token arrays: masks, masked means, advantages, returns and losses.

Everything stays in higher-order functions on one row; nothing is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.text import tokens


def response_mask(prompt: Column, response: Column, pad: Column) -> Column:
    zeros, ones = (lambda n: F.array_repeat(F.lit(0), n)), F.array_repeat(F.lit(1), response)
    return F.struct(F.concat(F.array_repeat(F.lit(1), prompt), F.array_repeat(F.lit(0), response + pad)).alias("prompt_mask"), F.concat(zeros(prompt), ones, zeros(pad)).alias("response_mask"), F.concat(F.array_repeat(F.lit(1), prompt + response), zeros(pad)).alias("attention_mask"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mask_sum(values: Column, mask: Column) -> Column:
    same = F.when(F.size(values) != F.size(mask), F.raise_error(F.lit("values and mask differ in length")))
    return F.coalesce(same.cast("double"), _sum(F.zip_with(values, mask, lambda v, m: F.when(m == 1, v.cast("double")).otherwise(0.0))))


def mask_mean(values: Column, mask: Column) -> Column:
    n = F.size(F.filter(mask, lambda m: m == 1))
    return F.when(n > 0, mask_sum(values, mask) / n).otherwise(0.0)


def masked(values: Column, mask: Column) -> Column:
    """The values where mask is 1."""
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"].cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def exp_clamped(x: Column, limit: float = 20.0) -> Column:
    return F.exp(clamp(x, -limit, limit))


def truncate(ids: Column, most: int, side: str = "right") -> Column:
    """Keeps the first (right) or the last (left) ids."""
    if most == 0:
        return F.slice(ids, 1, 0)
    return F.slice(ids, 1, most) if side == "right" else F.when(F.size(ids) > most, F.slice(ids, -most, most)).otherwise(ids)


def token_ids(tokens: Column) -> Column:
    """Ids of words: first 8 bytes of SHA-256, plus 1; unsigned, hence decimals. Collisions aren't resolved."""
    return F.transform(tokens, lambda t: F.conv(F.substring(F.sha2(t.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)") + 1)


def encoded(text: Column, most: int | None = None, side: str = "right") -> Column:
    """Ids of a text's words, cut to at most so many, whether any were cut, and on which side (null without a limit)."""
    if most is not None and most < 0:
        raise ValueError("a limit can't be negative")
    if side not in ("left", "right"):
        raise ValueError(f"unknown side {side!r}")
    ids = token_ids(tokens(text))
    cut = ids if most is None else truncate(ids, most, side)
    return F.struct(cut.alias("token_ids"), (F.size(cut) != F.size(ids)).alias("truncated"), F.lit(None if most is None else side).cast("string").alias("truncation_side"))


def pad(a: Column, length: Column | int, value: float = 0.0) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(F.lit(0), length - F.size(a))))


def advantages(rewards: Column, values: Column, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Generalized advantages: a recurrence from the last step back, one fold."""
    step = F.zip_with(rewards, values, lambda r, v: F.struct(r.cast("double").alias("r"), v.cast("double").alias("v")))
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("next_v"), F.lit(0.0).alias("next_a"))

    def back(acc: Column, s: Column) -> Column:
        a = s["r"] + gamma * acc["next_v"] - s["v"] + gamma * lam * acc["next_a"]
        return F.struct(F.concat(acc["out"], F.array(a)).alias("out"), s["v"].alias("next_v"), a.alias("next_a"))

    return F.reverse(F.aggregate(F.reverse(step), start, back, lambda acc: acc["out"]))


def sparse_rewards(reward: Column, n: Column) -> Column:
    """All at the last step."""
    return F.concat(F.array_repeat(F.lit(0.0), n - 1), F.array(reward.cast("double")))


def normalize(frame: DataFrame, column: str = "advantages", least_std: float = 1e-8) -> DataFrame:
    """z-scores over all tokens of the frame; 0 where the deviation isn't above least_std."""
    moments = frame.agg(F.sum(F.aggregate(column, F.lit(0.0), lambda a, v: a + v)).alias("__s1"), F.sum(F.aggregate(column, F.lit(0.0), lambda a, v: a + v * v)).alias("__s2"), F.sum(F.size(column)).alias("__n"))
    mean = F.col("__s1") / F.col("__n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("__s2") / F.col("__n") - mean * mean))
    out = frame.crossJoin(F.broadcast(moments))  # one row
    return out.withColumn(column, F.transform(column, lambda v: F.when(std > least_std, (v - mean) / std).otherwise(0.0))).drop("__s1", "__s2", "__n")


def policy_loss(policy: Column, old: Column, advantage: Column, reference: Column | None = None, clip: float = 0.2, kl_beta: float = 0.0, limit: float = 20.0, clamp_both: bool = True) -> Column:
    """Clipped surrogate and k3 divergence of one sample; inputs are arrays over response tokens.

    clamp_both: the divergence clamps its argument wherever it stands; else in the exponent only.
    """
    adv = advantage
    terms = F.transform(F.arrays_zip(policy.alias("p"), old.alias("o"), adv.alias("a")), lambda x: F.struct(exp_clamped(x["p"] - x["o"], limit).alias("r"), x["a"].alias("a")))
    n = F.size(terms)
    low, high = 1 - clip, 1 + clip
    loss = -_sum(F.transform(terms, lambda x: F.least(x["r"] * x["a"], clamp(x["r"], low, high) * x["a"]))) / n
    clipped = F.size(F.filter(terms, lambda x: F.abs(clamp(x["r"], low, high) - x["r"]) > 1e-12))
    kl = F.lit(0.0)
    if reference is not None:
        delta = F.zip_with(reference, policy, lambda r, p: r - p)
        kl = _sum(F.transform(delta, lambda d: exp_clamped(d, limit) - (clamp(d, -limit, limit) if clamp_both else d) - 1)) / n
    ratio = _sum(F.transform(terms, lambda x: x["r"])) / n
    return F.struct(n.alias("tokens"), loss.alias("policy_loss"), (kl_beta * kl).alias("kl_loss"), kl.alias("kl_k3"), (loss + kl_beta * kl).alias("total_loss"), ratio.alias("mean_ratio"), clipped.alias("clipped_tokens"))


def value_loss(values: Column, old: Column, returns: Column, clip: float | None = 0.2) -> Column:
    """Larger of the squared errors of value and of value kept within clip of the old one; and how many were clipped."""
    terms = F.arrays_zip(values.alias("v"), old.alias("o"), returns.alias("r"))

    def one(x: Column) -> Column:
        plain = F.pow(x["v"] - x["r"], F.lit(2.0))
        kept = F.pow(x["o"] + clamp(x["v"] - x["o"], -clip, clip) - x["r"], F.lit(2.0)) if clip is not None else plain
        return F.struct(F.greatest(plain, kept).alias("loss"), (kept > plain + 1e-12).alias("clipped"))

    each = F.transform(terms, one)
    return F.struct((_sum(F.transform(each, lambda e: e["loss"])) / F.size(each)).alias("value_loss"), F.size(F.filter(each, lambda e: e["clipped"])).alias("clipped_values"))


def response_positions(mask: Column) -> Column:
    """Places, from 0, of the response's tokens."""
    return F.filter(F.transform(mask, lambda m, i: F.when(m != 0, i)), lambda i: i.isNotNull())


def response_rewards(reward: Column, rewards: Column, mask: Column) -> Column:
    """Rewards of the response's tokens: the reward at the last one if rewards is null; those of the
    response's places if rewards is as long as the mask; rewards itself if it is as long as the response."""
    at = response_positions(mask)
    wrong = F.raise_error(F.lit("rewards must be as long as the input or the response")).cast("array<double>")
    return F.when(rewards.isNull(), sparse_rewards(reward, F.size(at))).when(F.size(rewards) == F.size(mask), F.transform(at, lambda i: F.get(rewards, i).cast("double"))).when(F.size(rewards) == F.size(at), rewards.cast("array<double>")).otherwise(wrong)


def critic_losses(samples: DataFrame, clip: float = 0.2, value_clip: float | None = 0.2, value_coef: float = 0.5, entropy_coef: float = 0.0, kl_beta: float = 0.0, gamma: float = 1.0, lam: float = 0.95, limit: float = 20.0, normalized: bool = False) -> DataFrame:
    """samples with targets, from rewards and values of the response's tokens, and loss: clipped policy loss, value loss,
    entropy bonus and divergence, weighted, and their sum.

    samples has arrays over the response's tokens: rewards, values, old_values, policy and old, and where asked for
    reference (with kl_beta) and entropy. Returns are advantages plus old values; advantages are normalized after that.
    """
    if kl_beta and "reference" not in samples.columns:
        raise ValueError("a divergence needs reference log-probabilities")
    made = samples.withColumn("advantages", advantages(F.col("rewards"), F.col("old_values"), gamma, lam))
    made = made.withColumn("returns", F.zip_with("advantages", "old_values", lambda a, v: a + v))
    made = normalize(made) if normalized else made
    reference = F.col("reference") if "reference" in samples.columns else None
    policy = policy_loss(F.col("policy"), F.col("old"), F.col("advantages"), reference, clip, kl_beta, limit, clamp_both=False)
    made = made.withColumn("__p", policy).withColumn("__v", value_loss(F.col("values"), F.col("old_values"), F.col("returns"), value_clip))
    mean_entropy = _sum(F.col("entropy")) / F.size("entropy") if "entropy" in samples.columns else F.lit(0.0)
    parts = {"policy_loss": F.col("__p.policy_loss"), "value_loss": value_coef * F.col("__v.value_loss"), "entropy_loss": -entropy_coef * mean_entropy, "kl_loss": F.col("__p.kl_loss")}
    more = {"tokens": F.col("__p.tokens"), "mean_ratio": F.col("__p.mean_ratio"), "clipped_tokens": F.col("__p.clipped_tokens"), "clipped_values": F.col("__v.clipped_values"), "mean_entropy": mean_entropy}
    loss = F.struct(*(x.alias(n) for n, x in {**parts, "total_loss": sum(parts.values(), F.lit(0.0)), **more}.items()))
    return made.withColumn("loss", loss).drop("__p", "__v")


def batch_loss(samples: DataFrame, column: str = "loss") -> DataFrame:
    """Loss of a batch: the mean over samples of their means; clip fraction over tokens."""
    c = F.col(column)
    return samples.agg(F.count("*").alias("samples"), F.sum(c["tokens"]).alias("tokens"), F.avg(c["policy_loss"]).alias("policy_loss"), F.avg(c["kl_loss"]).alias("kl_loss"), F.avg(c["total_loss"]).alias("total_loss"), F.try_divide(F.sum(c["clipped_tokens"]), F.sum(c["tokens"])).alias("clip_fraction"))


def logprob_summary(policy: Column, old: Column, reference: Column, mask: Column, limit: float = 20.0) -> Column:
    """Means over response tokens: log-probabilities, plain difference to the reference, clamped ratio."""
    plain = F.zip_with(policy, reference, lambda p, r: p - r)
    ratio = F.zip_with(policy, old, lambda p, o: exp_clamped(p - o, limit))
    return F.struct(*(mask_mean(x, mask).alias(n) for n, x in (("policy", policy), ("old", old), ("reference", reference), ("kl_plain", plain), ("ratio", ratio))))


def microbatches(frame: DataFrame, size: int, order: tuple[str, ...]) -> DataFrame:
    """Numbers of fixed-size batches in order. The order is total, so one task numbers rows: for batches of training steps, not for corpora."""
    return frame.withColumn("microbatch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("int"))


def first_batches(batches: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of the first so many microbatches."""
    if most is not None and most < 1:
        raise ValueError("the number of batches must be positive")
    return batches if most is None else batches.where(F.col("microbatch") < most)


def with_estimates(samples: DataFrame, estimates: DataFrame, keys: tuple[str, ...] = ("task_id", "sample_index")) -> DataFrame:
    """samples with the columns of their value estimates; a sample without one fails the query and is named."""
    found = samples.join(estimates.withColumn("__found", F.lit(True)), list(keys), "left")
    missing = F.raise_error(F.concat(F.lit("no value estimate for "), F.concat_ws(":", *keys)))
    return found.where(F.when(F.col("__found"), F.lit(True)).otherwise(missing.isNotNull())).drop("__found")


def group_samples(samples: DataFrame) -> DataFrame:
    """Samples of a task as one sorted array."""
    rest = [c for c in samples.columns if c != "task_id"]
    return samples.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("sample_index", *(c for c in rest if c != "sample_index")))).alias("samples"))
