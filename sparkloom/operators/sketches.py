"""Distinct counts and quantiles of any window of hours from sketches that are stored by hour and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.scan import window

#: Logarithm of a distinct-count sketch's slots (standard error about 1.04 / sqrt(2 ** LG_SLOTS): 0.8 %).
LG_SLOTS = 14
#: Size of a quantile sketch: ranks are wrong by about 0.7 % at this size.
SIZE = 400


def hourly(df: DataFrame, distinct: list[str], values: list[str], hour: str = "datetime") -> DataFrame:
    """(hour, rows, a sketch of each column): at most some tens of KB a column and hour, whatever the rows.

    One partial aggregation and one small shuffle.  Nulls count for nothing.  An
    hour that is computed again and stored over itself changes nothing.
    """
    counts = [F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), F.lit(LG_SLOTS)).alias(f"distinct_{c}") for c in distinct]
    ranks = [F.kll_sketch_agg_double(F.col(f"`{c}`").cast("double"), F.lit(SIZE)).alias(f"values_{c}") for c in values]
    return df.groupBy(hour).agg(F.count("*").alias("rows"), *counts, *ranks)


def distinct_counts(sketches: DataFrame, start: str | None = None, end: str | None = None, hour: str = "datetime") -> DataFrame:
    """(column, n): about how many distinct values each column has in the hours from `start` to `end` (both in it)."""
    columns = [c for c in sketches.columns if c.startswith("distinct_")]
    merged = window(sketches, start, end, column=hour).agg(*(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in columns))
    each = F.array(*(F.struct(F.lit(c.removeprefix("distinct_")).alias("column"), F.col(c).cast("long").alias("n")) for c in columns))
    return merged.select(F.explode(each).alias("e")).select("e.*")


def quantiles(sketches: DataFrame, at: list[float], start: str | None = None, end: str | None = None, hour: str = "datetime") -> DataFrame:
    """(column, q, value): values whose rank in the window is about q; no rows for a column without values."""
    columns = [c for c in sketches.columns if c.startswith("values_")]
    merged = window(sketches, start, end, column=hour).agg(*(F.kll_merge_agg_double(c).alias(c) for c in columns))
    # A sketch of nothing has no quantiles.
    of = lambda c, q: F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(float(q))))
    each = F.array(*(F.struct(F.lit(c.removeprefix("values_")).alias("column"), F.lit(float(q)).alias("q"), of(c, q).alias("value")) for c in columns for q in at))
    return merged.select(F.explode(each).alias("e")).select("e.*").where("value is not null")
