"""Structured Streaming forms: late duplicates are dropped, sessions close behind the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream of messages, with `at` as an event time."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, key: str = "event_id", late: str = "2 seconds") -> DataFrame:
    """One row of each key, however often sources send it again within the allowed lateness."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows of a key with their counts; the state of a key is its open sessions."""
    w = F.session_window("at", gap)
    x = stream.withWatermark("at", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("messages"))
    return x.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages")


def weekly(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages of each week."""
    x = stream.withWatermark("at", late).groupBy(F.window("at", "7 days").alias("w")).agg(F.count(F.lit(1)).alias("messages"))
    return x.select(F.col("w.start").alias("week"), "messages")


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream over what is there now, exactly once, into Parquet. Its state is in RocksDB, which timers and lists need; the session's setting stays as it was."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        conf.set(key, before) if before else conf.unset(key)
