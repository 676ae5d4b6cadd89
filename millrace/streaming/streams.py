"""Structured Streaming over a folder of events; an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(spark: SparkSession, source: str, folder: str, late: str = "400 days") -> DataFrame:
    """(hour, event_type, n): all files of ``source``, read as a stream until none is left, counted in windows of an hour.

    The watermark drops events later than ``late``; windows that it has passed are
    appended once, and those still open when the stream ends are counted with it, as
    the stream is written in complete mode. State and results lie under ``folder``.
    """
    schema = spark.read.parquet(source).schema
    root, _, name = source.rpartition("/")
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(root)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = counts.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder + "/counts")

    query = out.writeStream.outputMode("complete").option("checkpointLocation", folder + "/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(folder + "/counts")
