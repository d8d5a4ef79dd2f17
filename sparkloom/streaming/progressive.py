"""Progressive loads: a table is read a few files at a time, and a load that was killed goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.sources import scan


def load(spark: SparkSession, source: str, path: str, build: Callable[[DataFrame], DataFrame], window: tuple[str, str] | None = None, files: int = 64, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """What `build` makes of the rows of `source` (of an hourly window, both ends in it), `files` files a batch, written to `path`.

    A file stream that takes all files that are there and ends.  A batch's rows
    replace what a killed run of the same batch left, so every row is there
    once; a restart takes up the batches that the checkpoint doesn't have, and
    files that came since.  `progress` hears the number of each batch and its
    rows.  `build` must give one row for each row: the counts are compared.
    """
    whole = spark.read.parquet(source)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", files).parquet(source)
    own = stream if window is None else scan.window(stream, *window)

    def put(batch: DataFrame, number: int) -> None:
        at = f"{path}/rows/batch={number}"
        build(batch).write.mode("overwrite").parquet(at)
        if progress is not None:
            progress(number, spark.read.parquet(at).count())

    query = own.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{path}/rows").drop("batch")
    wanted, got = (whole if window is None else scan.window(whole, *window)).count(), out.count()
    if wanted != got:
        raise ValueError(f"{got} rows were written of {wanted}")
    return out
