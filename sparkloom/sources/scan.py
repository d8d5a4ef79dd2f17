"""Windowed scans of hourly partitioned tables, shard scans, batches and path times.

A table lies in ``<root>/datetime=YYYY-MM-DD-HH-MM/``; the partition value is a
string and windows compare as strings, which prunes partitions.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.scalar import path_timestamp


def window(df: DataFrame, start: str | None = None, end: str | None = None, closed: bool = True, column: str = "datetime") -> DataFrame:
    """Rows of [start, end], or of [start, end) if not `closed`."""
    if start is not None:
        df = df.where(F.col(column) >= start)
    if end is not None:
        df = df.where(F.col(column) <= end if closed else F.col(column) < end)
    return df


def day(df: DataFrame, prefix: str, column: str = "datetime") -> DataFrame:
    return df.where(F.col(column).startswith(prefix))


@dataclass(frozen=True)
class Windows:
    train_start: str
    train_end: str
    val_start: str
    val_end: str
    test_start: str | None = None
    test_end: str | None = None

    def __post_init__(self):
        if self.train_start <= self.val_end and self.val_start <= self.train_end:
            raise ValueError("the training and validation windows overlap")


class Loader:
    """Train, validation and test scans of two roots."""

    def __init__(self, spark: SparkSession, train_path: str, test_path: str | None = None, windows: Windows | None = None):
        self.spark, self.train_path, self.test_path, self.windows = spark, train_path, test_path, windows

    def read(self, path: str) -> DataFrame:
        """The table; a missing path fails when it is read."""
        return self.spark.read.parquet(path)

    def load_train(self, validation_split: bool = True) -> tuple[DataFrame, DataFrame | None]:
        """Both windows, ends included; without a split the whole table."""
        df = self.read(self.train_path)
        if not validation_split:
            return df, None
        w = self.windows
        return window(df, w.train_start, w.train_end), window(df, w.val_start, w.val_end)

    def load_test(self) -> DataFrame:
        return window(self.read(self.test_path), self.windows.test_start, self.windows.test_end)

    def load_labelled(self, start: str, end: str, target: str = "iap_revenue_d7") -> DataFrame:
        """The test window if it has the target, else a window of the training table."""
        test = self.load_test() if self.test_path else None
        return test if test is not None and target in test.columns else window(self.read(self.train_path), start, end)


def glob_scan(spark: SparkSession, root: str, pattern: str = "datetime=*") -> DataFrame:
    return spark.read.option("basePath", root).parquet(f"{root}/{pattern}")


def files_of(spark: SparkSession, root: str) -> list[str]:
    """All data files of a table, sorted, as Spark lists them (in any store it reads)."""
    return sorted(spark.read.option("recursiveFileLookup", "true").parquet(root).inputFiles())


def shard_scan(spark: SparkSession, root: str, n: int, seed: int = 42, columns: list[str] | None = None) -> DataFrame:
    """Rows of n files drawn without replacement (all, if there are fewer), in order of their path's time; unreadable files are skipped."""
    files = files_of(spark, root)
    drawn = random.Random(seed).sample(files, min(n, len(files)))
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(*sorted(drawn)).withColumn("datetime", path_timestamp(F.col("_metadata.file_path")))
    return (df.select(*columns, "datetime") if columns else df).orderBy("datetime")


def first_files(spark: SparkSession, root: str, k: int = 3) -> DataFrame:
    return spark.read.parquet(*files_of(spark, root)[:k])


def _packed(rows: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, len(part), rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as stream:
                    stream.write_batch(part.slice(k, rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

    return run


def arrow_batches(df: DataFrame, rows: int = 100_000) -> Iterator[pa.Table]:
    """The table as Arrow tables of `rows` rows, across the ends of partitions; the rest comes last.

    Tasks pack their rows as Arrow streams, so the driver makes no row objects;
    it holds one table and one packed batch.
    """
    held, n = [], 0
    for row in df.mapInArrow(_packed(rows), "data binary").toLocalIterator():
        held.append(pa.ipc.open_stream(row[0]).read_all())
        n += len(held[-1])
        while n >= rows:
            whole = pa.concat_tables(held)
            yield whole.slice(0, rows)
            held, n = [whole.slice(rows)], n - rows
    if n:
        yield pa.concat_tables(held)


def batches(df: DataFrame, rows: int = 100_000) -> Iterator[pd.DataFrame]:
    """As arrow_batches(), as pandas frames."""
    return (table.to_pandas() for table in arrow_batches(df, rows))
