"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key; within a source the documents are ordered by it, their
sizes are summed up along that order, and the source is cut at its exact budget. A source whose
budget is above its size is passed over again (epochs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import hex_digits, keep, word_count


def targets(sizes: DataFrame, weight=None, epochs: int = 3) -> DataFrame:
    """source, source_size -> with target: a share of the total by weight, at most epochs times
    the size, what is above reshared by weight among the others until none is above.

    Resharing ends at target = min(epochs * size, level * weight) with one level for all; going
    up by size / weight, the sources before a point are full and the rest share what is left.
    Without weight, sources weigh 1, 2, 3, 1, ... by code point, null last. One row per source
    goes through a single window; its number doesn't grow with the documents.
    """
    if weight is None:
        rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        weight = (1 + (rank - 1) % 3).cast("long")
    s = sizes.withColumn("weight", weight)
    s = s.withColumn("full", F.lit(epochs) * F.col("source_size"))
    order = Window.orderBy((F.col("full") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(rest).alias("sharing"),
    )
    s = s.withColumn("is_full", F.col("full") * F.col("sharing") <= F.col("left") * F.col("weight"))
    level = F.max(F.when(~F.col("is_full"), F.col("left") / F.col("sharing"))).over(whole)
    return s.withColumn("level", level).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("is_full"), F.col("full").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"),
    )


def _mixed(docs: DataFrame, seed: str, weight, epochs: int, rows_per_bucket: int) -> DataFrame:
    """The rows of mix() with key and passes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), _key(seed).alias("key"))
    rows = keep(rows, "mix")
    digits = hex_digits(rows.count(), rows_per_bucket)
    # A stand-in without nulls keeps null sources in ordinary equi-joins.
    rows = rows.withColumn("name", _name()).withColumn("range", F.substring("key", 1, digits))
    ranges = rows.groupBy("name", "source", "range").agg(F.sum("size").alias("n"))
    goal = targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), weight, epochs)
    # Three digits at a time, so that no window has more than 4096 rows, whatever a source's size.
    ranges = ranges.withColumn("block", F.substring("range", 1, 3))
    blocks = ranges.groupBy("name", "block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("name", "block", F.coalesce(F.sum("m").over(Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_block"))
    inner = Window.partitionBy("name", "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(blocks, ["name", "block"])
    goal = goal.select(_name().alias("name"), "source_size", "target")
    ranges = ranges.join(goal, "name").select("name", "range", (F.col("before") + F.col("before_block")).alias("before"), "source_size", "target")
    within = Window.partitionBy("name", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(ranges, ["name", "range"])
    size, source_size = F.col("size"), F.col("source_size")
    passes = F.when(source_size > 0, F.floor(F.round("target").cast("long") / F.greatest(source_size, F.lit(1)))).otherwise(0).cast("long")
    rows = rows.withColumn("start", F.col("before") + F.sum("size").over(within) - size).withColumn("budget", F.round("target").cast("long")).withColumn("passes", passes)
    taken = F.col("passes") * size + F.greatest(F.lit(0), F.least(size, F.col("budget") - F.col("passes") * source_size - F.col("start")))
    return rows.select("doc_id", "source", "name", "key", "size", "source_size", "target", "passes", taken.cast("long").alias("taken"))


def _key(seed: str):
    return _key_of(seed, F.col("doc_id"))


def _key_of(seed: str, doc_id):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))).cast("binary"))


def _name():
    return _name_of(F.col("source"))


def _name_of(source):
    return F.concat(F.when(source.isNull(), "n").otherwise("s"), F.coalesce(source, F.lit("")))


def mix(docs: DataFrame, seed: str = "mix-1", weight=None, epochs: int = 3, rows_per_bucket: int = 2000) -> DataFrame:
    """Words that the mix takes of each document: doc_id, source, size, source_size, target, taken.

    The order within a source is by md5 of seed and doc_id, so reruns agree. That key is uniform:
    its leading digits cut a source into ranges of about rows_per_bucket rows or, of 16^6 ranges,
    more, however large the source is; sums of ranges are summed up first, then rows within a
    range. The document at the budget's end is taken up to the word where the budget ends.

    Null text: size 0, taken 0. Null source: a source of its own. Equal doc_ids: ordered by size;
    rows alike in both are interchangeable. Texts are counted whole, however long. An empty
    table gives an empty result. Extra columns are not read.
    """
    return _mixed(docs, seed, weight, epochs, rows_per_bucket).select("doc_id", "source", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, seed: str = "mix-1", weight=None, epochs: int = 3, rows_per_bucket: int = 2000, most_sources: int = 100_000) -> DataFrame:
    """The rows of docs, all columns, as often as the mix passes over them, whole.

    A source's budget ends at a place in the order by (key, doc_id, size); its rows up to there
    stay once more than those behind. So each row is decided from its own columns and its source's
    place, and no text is shuffled: places are broadcast if there are at most most_sources
    sources, and else joined. Rows alike in doc_id, source and size go together. Rows without
    words go. The document at a budget's end isn't cut. Nulls, ties, long texts and an empty
    table as in mix(); columns of any name are kept as they are.
    """
    mixed = _mixed(docs, seed, weight, epochs, rows_per_bucket).where("size > 0")
    order = F.struct("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("id"), "size")
    ends = mixed.groupBy("name").agg(F.max("passes").alias("passes"), F.max(F.when(F.col("taken") > F.col("passes") * F.col("size"), order)).alias("last"))
    ends = keep(ends, "ends")
    ends = F.broadcast(ends) if ends.count() <= most_sources else ends
    names = docs.columns
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    plain = plain.select("row", _name_of(F.col("row.source")).alias("name"), _key_of(seed, F.col("row.doc_id")).alias("key"), F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"), word_count(F.col("row.text")).alias("size"))
    rows = plain.where("size > 0").join(ends, "name")
    times = F.col("passes") + F.when(F.struct("key", "id", "size") <= F.col("last"), 1).otherwise(0)
    return rows.where(times > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("row.*")
