"""Checkpoints and written tables in the folder that the cluster names, and joins that a hot group doesn't slow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows (of a few short columns) that a join broadcasts; more are shuffled.
BROADCAST = 500_000
#: Members from which a group is hot.  There are at most rows / HOT such groups.
HOT = 1000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a temporary folder; a
    cluster needs one that all its machines share, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder; lost executors only cost a read of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a compressed table in the shared folder, of which later steps read the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def with_rows(docs: DataFrame, **more) -> DataFrame:
    """`docs` written as (_row, _all, *more): a key of each row, as ids may be null or repeated, all its columns whatever their names, and further columns."""
    every = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    return written(docs.select(every.alias("_all"), F.monotonically_increasing_id().alias("_row"), *(c.alias(n) for n, c in more.items())))


def packed(docs: DataFrame, name: str) -> Column:
    """A column of `docs` in the table that with_rows() wrote."""
    return F.col(f"_all.c{docs.columns.index(name)}")


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that with_rows() packed, under their names."""
    return rows.select(*(F.col(f"_all.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def hinted(table: DataFrame) -> DataFrame:
    """`table`, which should be kept, for a join that broadcasts it if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST else table


def few(table: DataFrame) -> DataFrame:
    """`table`, written once, for a join that broadcasts it if it has few rows."""
    return hinted(kept(table))


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """`rows` with the row of `groups` that has their key (inner join; both tables are read twice, so they should be kept).

    Groups of more than HOT rows by the column `size` are joined on their own:
    they are few, and a broadcast leaves their rows where they are.  No group of
    the rest outgrows a task.
    """
    hot = groups.where(F.col(size) > HOT)
    n = hot.count()
    if not n:
        return rows.join(groups, key)
    hot = F.broadcast(hot) if n <= BROADCAST else hot
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(size) <= HOT), key)
    return rows.join(hot, key).unionByName(rest)
