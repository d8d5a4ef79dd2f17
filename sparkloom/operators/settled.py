"""Fitted state that is small is computed once; what is not stays distributed."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which fitted state is held by the driver and broadcast in joins.
MOST_ROWS = 200_000


def settled(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """`df` as a local relation if it has at most `most` rows, else `df` itself.

    One job checks the size and fetches the rows, so that joins with them don't
    compute them again.
    """
    table = df.limit(most + 1).toArrow()
    return df.sparkSession.createDataFrame(table, df.schema) if table.num_rows <= most else df


def settled_by(df: DataFrame, column: str, values: list[str], most: int = MOST_ROWS) -> dict[str, DataFrame]:
    """The part of `df` for each of the values, without the column; each part of at most `most` rows is local.

    One job fetches all if that is little; else one counts and one fetches the
    small parts, and a large part is left to its own plan, where the filter on
    the column is pushed to the scan.
    """
    spark, schema = df.sparkSession, df.drop(column).schema
    small, held = values, df.limit(most + 1).toArrow()
    if held.num_rows > most:
        size = {r[0]: r[1] for r in df.groupBy(column).count().collect()}
        small = [v for v in values if size.get(v, 0) <= most]
        held = df.where(F.col(column).isin(small)).toArrow()
    out = {}
    for v in values:
        if v in small:
            own = held.filter(pc.equal(held[column], v)).drop_columns([column])
            out[v] = spark.createDataFrame(own, schema)
        else:
            out[v] = df.where(F.col(column) == v).drop(column)
    return out


def hinted(df: DataFrame, part: DataFrame | None = None) -> DataFrame:
    """`part` (or `df`) for a join: broadcast if `df` is settled, else left to a shuffle."""
    own = df if part is None else part
    return F.broadcast(own) if df.isLocal() else own
