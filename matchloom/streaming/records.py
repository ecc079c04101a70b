"""Streaming normalization and audit: the batch expressions over readStream; an addition, as all reference stages are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def normalized(records: DataFrame) -> DataFrame:
    """Row-wise, so stateless: any sink and output mode will do."""
    return features.normalize_unicode(records, "business_name", "business_address", "country")


def activity(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and value sums by window and type; state is bounded by the watermark."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    out = grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived, append it as Parquet, and stop; a rerun goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
