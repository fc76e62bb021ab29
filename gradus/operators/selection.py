"""Choosing rows in order, and reading optional fields of metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.operators.splits import SPLITS


def by_split(tasks: DataFrame, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; known: {', '.join(SPLITS)}")
    return tasks.where(F.col("split") == split)


def get(tasks: DataFrame, task_id: str, id_column: str = "task_id") -> DataFrame:
    """The one row with this id; raises if there is none."""
    found = tasks.where(F.col(id_column) == task_id).limit(1)
    if found.isEmpty():
        raise KeyError(task_id)
    return found


def first_rows(df: DataFrame, order: str | list[str], limit: int | None = None) -> DataFrame:
    """The first rows in an order, all if there is no limit; a top-k, not a sort, under a limit."""
    if limit is not None and limit < 0:
        raise ValueError("a limit can't be negative")
    ordered = df.orderBy(order)
    return ordered if limit is None else ordered.limit(limit)


def curriculum(tasks: DataFrame, mode: str, limit: int | None = None) -> DataFrame:
    """Tasks in the order of a curriculum: as they come if it is static, else those with hidden tests first, by id."""
    if mode == "static":
        return first_rows(tasks, "ord", limit)
    return first_rows(tasks.withColumn("__bare", F.size("hidden_tests") <= 0), ["__bare", "task_id"], limit).drop("__bare")


def chunks(df: DataFrame, size: int, order: str, group: str) -> DataFrame:
    """Numbers of chunks of size rows within each group."""
    if size < 1:
        raise ValueError("chunks have at least one row")
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size).cast("int"))


def optional_number(payload: Column, path: str) -> Column:
    """A number at a dotted path of JSON, true and false as 1 and 0; null for anything else."""
    v = F.get_json_object(payload, f"$.{path}")
    return F.when(v.isin("true", "false"), (v == "true").cast("double")).otherwise(F.when(v.rlike(r"^-?[0-9][0-9.eE+-]*$"), v.try_cast("double")))


def objects_at(payload: Column, path: str) -> Column:
    """The objects of an array at a dotted path, as JSON; other elements are dropped, and what is no array has none."""
    each = F.from_json(F.get_json_object(payload, f"$.{path}"), "array<string>")
    return F.filter(F.coalesce(each, F.array().cast("array<string>")), lambda x: F.startswith(F.ltrim(x), F.lit("{")))


def scalar_metadata(payload: Column, prefix: str = "") -> Column:
    """The entries of a JSON object that are neither objects, arrays nor null, by prefixed key, as text."""
    entries = F.map_filter(F.from_json(payload, "map<string,string>"), lambda _, v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]"))
    return F.transform_keys(F.coalesce(entries, F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit(prefix), k))


def merged(target: Column, source: Column) -> Column:
    """Both maps in one; keys of source win."""
    rest = F.map_filter(target, lambda k, _: ~F.array_contains(F.map_keys(source), k))
    return F.map_concat(rest, source)
