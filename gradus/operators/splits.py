"""Seeded splits, quotas, uniqueness and fingerprints of task sets."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.late import late

#: Names of splits, in the order in which quotas are dealt (fixed values).
SPLITS = ("train", "dev", "test_public", "test_private", "stress")


def quotas(total: int, fractions: dict[str, float]) -> dict[str, int]:
    """Truncated quotas; what is left goes to test_private, even if its fraction is 0."""
    if any(s not in SPLITS for s in fractions) or any(f < 0 for f in fractions.values()) or sum(fractions.values()) > 1 + 1e-9:
        raise ValueError("fractions must be of known splits, not negative, and sum up to at most 1")
    out = {s: int(total * fractions.get(s, 0.0)) for s in ("train", "dev", "test_public")}
    return out | {"test_private": total - sum(out.values())}


def assign(tasks: DataFrame, fractions: dict[str, float], seed: int = 20260601, id_column: str = "task_id") -> DataFrame:
    """tasks with the column split: ranks by md5 of seed and id are cut at the quotas.

    The rank isn't taken over one window: counts of ranges of the hash are summed up first, so
    only the range in which a row lies is sorted.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")).cast("binary"))
    rows = tasks.withColumn("__h", h).withColumn("__r", F.substring("__h", 1, 2))
    counts = rows.groupBy("__r").agg(F.count("*").alias("n"))
    before = counts.select("__r", (F.sum("n").over(Window.orderBy("__r")) - F.col("n")).alias("__before"), F.sum("n").over(Window.partitionBy()).alias("__total"))  # 256 rows
    within = F.row_number().over(Window.partitionBy("__r").orderBy("__h", id_column))
    ranked = rows.join(F.broadcast(before), "__r").withColumn("__rank", F.col("__before") + within - 1)
    split, end = F.lit("test_private"), F.lit(0).cast("long")
    rules = []
    for s in ("train", "dev", "test_public"):
        end = end + F.floor(F.col("__total") * fractions.get(s, 0.0)).cast("long")
        rules.append((s, end))
    for s, stop in reversed(rules):
        split = F.when(F.col("__rank") < stop, s).otherwise(split)
    return ranked.withColumn("split", split).drop("__h", "__r", "__before", "__total", "__rank")


def duplicates(tasks: DataFrame, id_column: str = "task_id") -> DataFrame:
    return tasks.groupBy(id_column).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(tasks: DataFrame, id_column: str = "task_id") -> DataFrame:
    """tasks itself; raises, naming some, if ids repeat."""
    if bad := [r[0] for r in duplicates(tasks, id_column).orderBy(id_column).take(5)]:
        raise ValueError(f"ids repeat: {bad}")
    return tasks


@late("string")
def canonical_json(x: pd.Series) -> pd.Series:
    """JSON with sorted keys, as the fingerprint takes it."""
    return x.map(lambda s: json.dumps(json.loads(s), sort_keys=True) if s is not None else None)


def fingerprint(rows: DataFrame, order: str, text: str = "canonical") -> DataFrame:
    """One row: SHA-256 of all texts in order, joined by line feeds. A fingerprint of the whole
    needs the whole in one place; it is for task sets, of thousands of rows."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n")
    return rows.agg(F.sha2(whole.cast("binary"), 256).alias("fingerprint"), F.count("*").alias("n"))


def hold_out(public: str = "public_tests", hidden: str = "hidden_tests", visible: int = 1) -> dict:
    """Columns: public tests beyond the first become hidden ones, where there are none; and whether so."""
    splits = (F.size(hidden) == 0) & (F.size(public) > visible)
    moved = F.transform(F.slice(public, visible + 1, F.greatest(F.size(public) - visible, F.lit(1))), lambda t: t.withField("visibility", F.lit("hidden")).withField("name", F.when(F.startswith(t["name"], F.lit("public")), F.regexp_replace(t["name"], "^public", "hidden")).otherwise(F.lit("hidden"))))
    return {"was_split": splits, hidden: F.when(splits, moved).otherwise(F.col(hidden)), public: F.when(splits, F.slice(public, 1, visible)).otherwise(F.col(public))}
