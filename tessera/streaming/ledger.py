"""The step ledger as a stream, and windows over event streams. These extend the batch ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Ledger or event files of a folder as they come."""
    return spark.readStream.schema(schema).parquet(path)


def once(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The stream without repeats of a key that come within the lateness; state is dropped behind the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def latest(stream: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The value of the latest entry of each key so far, for output mode update or complete."""
    return stream.groupBy(*keys).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def tumbling(stream: DataFrame, at: str, width: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Count and sum of `value` per window and key, once the watermark has passed the window."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Count per session of each key: runs of entries without a gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything there is now, written as Parquet, with a checkpoint to go on from; ends by itself."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q
