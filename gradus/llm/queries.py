"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import ann, decontaminate, html, licenses, mixing, ngram_join, quality, sharding, token_counts, warc
from gradus.llm.common import keep, shared_dir, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents, each applied twice to no further effect:
    inserts with counts estimated from n_chars, revisions to the exact counts, and deletes of all
    but the first row of each text. What is left is tokens of distinct texts."""
    docs = table(spark, sf_dir, "documents")
    counted = token_counts.token_counts(docs.withColumn("copy_of", F.md5(F.coalesce("text", F.lit("")).cast("binary"))), columns=("doc_id", "source", "lang", "n_chars", "copy_of"))
    counted = keep(counted.withColumn("tokenizer_version", F.lit("byte_bpe_50k")).withColumn("row", F.monotonically_increasing_id()), "counted")
    estimate = F.ceil(F.coalesce("n_chars", F.lit(0)) / 4)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = keep(counted.groupBy("copy_of").agg(F.min(order).alias("first")), "first")
    copies = counted.join(first, "copy_of").where(F.col("first.row") != F.col("row"))
    rollup = token_counts.Rollup(spark, f"{shared_dir(spark)}/rollups/{uuid.uuid4().hex}")
    for batch, changes in (
        ("load", token_counts.inserted(counted.withColumn("tokens", estimate))),
        ("recount", token_counts.revised(counted.withColumn("old_tokens", estimate))),
        ("copies", token_counts.deleted(copies)),
    ):
        for _ in range(2):
            rollup.apply(batch, changes)
    return rollup.totals()


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each archive begins with a torn record, so that every page comes back through the salvage reader."""
    return warc.round_trip(table(spark, sf_dir, "pages"), torn=True)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_token_counts, op3_ann, op4_licenses, op5_mixing, op6_quality, op7_warc, op8_html, op9_decontaminate, op10_ngram_join)}
