"""Statistics as columns; division by zero gives 0 where rates are asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that at least one of k samples, drawn from n with c right ones, is right.

    No samples: 0. Fewer than k wrong ones: 1, even where no sample is right.
    """
    miss = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1 - F.lit(float(k)) / i))
    return F.when(n <= 0, 0.0).when(n - c < k, 1.0).when(c <= 0, 0.0).otherwise(1 - miss)


def log_choose_tail(k: Column, n: Column) -> Column:
    """P(X <= k) of a fair binomial with n trials, in logarithms: (log C(n, i) - n log 2) summed up."""
    start = F.struct(F.lit(0.0).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log - n * F.log(F.lit(2.0)))).alias("sum"))

    return F.when(k < 0, 0.0).when(k == 0, F.exp(-n * F.log(F.lit(2.0)))).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), start, step, lambda a: a["sum"]))


def binomial_two_sided(fewer: Column, total: Column) -> Column:
    """Exact two-sided p of a fair binomial; 1 without trials."""
    return F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * log_choose_tail(fewer, total)))


def sign_flip_p(total: Column, plus: Column) -> Column:
    """Exact p of a sign-flip test over total deltas of +1 or -1, plus of them +1: the share of
    flips whose sum is at least as far from 0. Closed form of the enumeration."""
    far = F.abs(2 * plus - total)
    # |2i - n| >= far  <=>  i <= (n - far) / 2 or i >= (n + far) / 2
    return F.when((total == 0) | (far == 0), 1.0).otherwise(F.least(F.lit(1.0), 2 * log_choose_tail(((total - far) / 2).cast("int"), total)))


def minimum_detectable_effect(n: Column, p: Column, z: float = 1.96) -> Column:
    """In percentage points, for two groups of n tasks with pass rate p."""
    return 2 * z * F.sqrt(p * (1 - p) / n) * 100


def low_quantile(values: Column, p: float) -> Column:
    """The element at floor(p (n - 1)) of the sorted values: lower, not interpolated."""
    at = F.floor(p * (F.size(values) - 1) + 1e-12)
    return F.get(F.array_sort(values), F.greatest(F.lit(0), F.least(F.size(values) - 1, at)).cast("int"))


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 2^32) from the md5 of parts joined by ':'; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")
