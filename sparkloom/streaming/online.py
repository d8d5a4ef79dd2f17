"""Online features over a stream of impressions.

The features are a projection and stream-static joins, so the batch builder's
expressions run unchanged; lookup tables and encoders are fitted beforehand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import features


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def online(stream: DataFrame, tables: dict[str, DataFrame], encoders: DataFrame) -> DataFrame:
    return features.online(stream, tables, encoders, fit=False)[0]


def append_available(df: DataFrame, path: str, checkpoint: str):
    """Writes all that is there by now and stops; a restart goes on where it stopped."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def revenue_windows(stream: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Impressions, buyers and revenue per time window and country; windows close `late` after their end."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "country").agg(F.count("*").alias("impressions"), F.sum("buyer_d7").alias("buyers"), F.sum("iap_revenue_d7").alias("revenue")).select("w.start", "w.end", "country", "impressions", "buyers", "revenue")
