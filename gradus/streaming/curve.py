"""Learning curves while a run is still writing, and replay of metrics into sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.stats import rate

ROLLOUT = "task_id string, sample_index int, passed boolean, reward double"


def rollout_stream(spark: SparkSession, folder: str, schema: str = ROLLOUT, files_per_trigger: int = 1000) -> DataFrame:
    """Rollouts of cycle_* folders as they appear, with cycle from the path."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "rollouts*.json*").option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return rows.withColumn("cycle", F.regexp_extract("_metadata.file_path", r"cycle_(\d+)/[^/]*$", 1).try_cast("int")).where("cycle is not null")


def curve(rows: DataFrame) -> DataFrame:
    """A row for each cycle; state grows with cycles, not with rollouts."""
    return rows.groupBy("cycle").agg(F.count("*").alias("rollouts"), rate(F.count_if("passed"), F.count("*")).alias("pass_rate"), F.coalesce(F.avg("reward"), F.lit(0.0)).alias("mean_reward"))


def windowed(events: DataFrame, time: str = "ts", width: str = "1 day", late: str = "2 hours", *keys: str) -> DataFrame:
    """Counts and sums in tumbling windows of event time; rows later than `late` are dropped, as is state before."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def replay(frame: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Feeds each batch of a stream to a sink(frame, batch_id) once it is there, then ends."""
    return frame.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def jsonl_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A folder for each batch, so a batch that comes again overwrites itself."""
    return lambda frame, batch: frame.write.mode("overwrite").json(f"{path}/batch={batch}")


def null_sink(frame: DataFrame, batch: int) -> None:
    frame.write.format("noop").mode("overwrite").save()


#: Sinks by name; sinks of services are registered by their users.
SINKS: dict[str, Callable] = {"jsonl": jsonl_sink, "null": lambda _path: null_sink}


def make_sink(name: str, path: str):
    """The sink of that name; jsonl where it isn't known."""
    return SINKS.get(name, jsonl_sink)(path)
