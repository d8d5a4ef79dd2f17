"""Stores of fitted state and results: lookup tables, encoders, features, soft labels, submissions."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKUP_SCHEMA = "key string, buyer_rate double, avg_rev_d7 double, whale_rate double, count long"
LOOKUPS = ("bundle", "category", "country", "segment")


def save_lookups(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").format(kind).save(f"{folder}/{name}_stats")


def load_lookups(spark: SparkSession, folder: str, kind: str = "parquet") -> dict[str, DataFrame]:
    """The lookup tables; a missing one is empty."""
    out = {}
    for name in LOOKUPS:
        try:
            out[name] = spark.read.schema(LOOKUP_SCHEMA).format(kind).load(f"{folder}/{name}_stats")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            out[name] = spark.createDataFrame([], LOOKUP_SCHEMA)
    return out


def save_encoders(codes: DataFrame, folder: str) -> None:
    """Codes of all encoded columns: (column, value, code)."""
    codes.write.mode("overwrite").parquet(f"{folder}/encoders")


def load_encoders(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/encoders")


def save_feature_names(df: DataFrame, folder: str) -> None:
    df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{folder}/features")


def load_feature_names(spark: SparkSession, folder: str) -> list[str]:
    return [f["name"] for f in json.loads(spark.read.text(f"{folder}/features").first()[0])["fields"]]


def cache_key(windows: tuple[str, ...], features: list[str], version: int = 2) -> str:
    """Name of a feature table: its windows, a digest of its features, and the version."""
    return "_".join([*windows, hashlib.sha256("\0".join(features).encode()).hexdigest()[:12], f"v{version}"])


def cached_features(spark: SparkSession, folder: str, key: str, build, rebuild: bool = False) -> DataFrame:
    """The feature table `key`; built and written if it is missing or to be rebuilt.  Targets live in its rows."""
    path = f"{folder}/{key}"
    if not rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_windows(df: DataFrame, path: str, column: str = "datetime") -> None:
    """Writes hourly partitions, replacing only those that `df` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


SOFT_LABELS = ["row_id", "p_buyer", "log_rev", "y_buyer", "y_log_rev"]


def save_soft_labels(df: DataFrame, path: str) -> None:
    df.select(*SOFT_LABELS).write.mode("overwrite").parquet(path)


def load_soft_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*SOFT_LABELS)


def check_submission(df: DataFrame, expected_rows: int | None = None) -> dict[str, int]:
    """Counts of rows, missing and negative predictions, in one aggregate; raises if any is wrong."""
    row = df.agg(F.count("*").alias("rows"), F.count_if(F.col("row_id").isNull() | F.col("iap_revenue_d7").isNull()).alias("missing"), F.count_if(F.col("iap_revenue_d7") < 0).alias("negative")).first().asDict()
    if row["missing"] or row["negative"] or expected_rows not in (None, row["rows"]):
        raise ValueError(f"not a submission: {row}")
    return row


def write_submission(df: DataFrame, path: str, expected_rows: int | None = None) -> dict[str, int]:
    out = df.select(F.col("row_id").cast("string").alias("row_id"), F.col("iap_revenue_d7").cast("double").alias("iap_revenue_d7"))
    row = check_submission(out, expected_rows)
    out.write.mode("overwrite").csv(path, header=True)
    return row
