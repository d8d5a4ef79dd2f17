"""Encoders: values to codes, fitted on the rows they are given and applied by join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.scalar import MISSING, UNKNOWN_CODE
from sparkloom.operators.ranks import running
from sparkloom.operators.settled import hinted, settled, settled_by
from sparkloom.sources.scratch import once


def _numbered(values: DataFrame, order: list[str], group: tuple[str, ...] = ()) -> DataFrame:
    """`values` with a code: how many of its group come before it."""
    if values.isLocal():  # few
        return settled(values.withColumn("code", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1))
    found = running(values.withColumn("_one", F.lit(1)), order, ["_one"], group)
    return once(found.select(*values.columns, F.col("_one_before").cast("int").alias("code")))


def fit_codes(df: DataFrame, c: str) -> DataFrame:
    """(value, code): distinct non-null values in string order, numbered from 0."""
    values = df.select(F.col(c).cast("string").alias("value")).where("value is not null").distinct()
    return _numbered(settled(values), ["value"])


def first_seen_codes(df: DataFrame, c: str, order: str) -> DataFrame:
    """(value, code): distinct non-null values numbered from 0 by their first row in `order`, ties by value."""
    firsts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.min(order).alias("_first"))
    return _numbered(settled(firsts), ["_first", "value"]).drop("_first")


def fit_encoders(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code) of several columns in one scan; columns without values have no rows."""
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns if c in df.columns))
    values = df.select(F.explode(entries).alias("e")).select("e.*").where("value is not null").distinct()
    return _numbered(settled(values), ["value"], ("column",))


def apply_codes(df: DataFrame, c: str, codes: DataFrame, name: str | None = None) -> DataFrame:
    """`df` with the code of `c`; nulls and values that the encoder doesn't know are -1."""
    table = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    out = df.join(hinted(codes, table), F.col(c).cast("string") == F.col("_value"), "left")
    return out.withColumn(name or c, F.coalesce("_code", F.lit(UNKNOWN_CODE))).drop("_value", "_code")


def apply_encoders(df: DataFrame, encoders: DataFrame, columns: list[str]) -> DataFrame:
    """All columns of `df` in `columns` replaced by their codes.

    Each column's table is settled or not on its own: one column of very many
    values doesn't turn the joins of the others into shuffles.
    """
    own = [c for c in columns if c in df.columns]
    tables = settled_by(encoders, "column", own)
    out = df
    for i, c in enumerate(own):
        table = tables[c].select(F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}"))
        out = out.join(hinted(tables[c], table), F.col(c).cast("string") == F.col(f"_value{i}"), "left").withColumn(c, F.coalesce(f"_code{i}", F.lit(UNKNOWN_CODE))).drop(f"_value{i}", f"_code{i}")
    return out


def ordered_statistics(df: DataFrame, columns: list[str], target: str, row: str, prior: float, weight: float = 1.0, seed: int = 42, suffix: str = "_ts") -> DataFrame:
    """`df` with a number for each of the categories `columns`: the mean of `target` over the rows of its value that come earlier in a random order.

    The order is that of a digest of the unique key `row`; `weight` rows of the
    `prior` are added to each mean, so no row's own target is in its number and
    the first row of a value gets the prior.  Missing values are a value of
    their own; rows without a target count for nothing.  All columns share one
    pass of running sums over ranges of the order, so a value that a third of
    the rows have is not one task's.
    """
    entries = F.array(*(F.struct(F.lit(c).alias("_column"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("_value")) for c in columns))
    key = F.col(row).alias("_row")
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string"))).alias("_order")
    long = df.select(key, shuffled, F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("_y"), F.col(target).isNotNull().cast("long").alias("_n"), F.explode(entries).alias("e")).select("_row", "_order", "_y", "_n", "e.*")
    found = running(long, ["_order", "_row"], ["_y", "_n"], ("_column", "_value"))
    mean = (F.col("_y_before") + weight * prior) / (F.col("_n_before") + weight)
    wide = found.groupBy("_row").agg(*(F.max(F.when(F.col("_column") == c, mean)).alias(f"{c}{suffix}") for c in columns))
    out = df.join(wide, F.col(row) == F.col("_row"), "left").drop("_row")
    return out.withColumns({f"{c}{suffix}": F.coalesce(f"{c}{suffix}", F.lit(float(prior))) for c in columns})


def target_statistics(df: DataFrame, columns: list[str], target: str, prior: float, weight: float = 1.0) -> DataFrame:
    """(column, value, statistic) of all rows of `df`, for rows that aren't in it: what ordered_statistics() would give a last row."""
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value")) for c in columns))
    long = df.where(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("_y"), F.explode(entries).alias("e")).select("_y", "e.*")
    return long.groupBy("column", "value").agg(((F.sum("_y") + weight * prior) / (F.count("*") + weight)).alias("statistic"))


def apply_statistics(df: DataFrame, statistics: DataFrame, columns: list[str], prior: float, suffix: str = "_ts") -> DataFrame:
    """`df` with the statistic of each category; unknown values get the prior."""
    tables = settled_by(statistics, "column", columns)
    out = df
    for i, c in enumerate(columns):
        table = tables[c].select(F.col("value").alias(f"_value{i}"), F.col("statistic").alias(f"_statistic{i}"))
        own = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
        out = out.join(hinted(tables[c], table), own == F.col(f"_value{i}"), "left").withColumn(f"{c}{suffix}", F.coalesce(f"_statistic{i}", F.lit(float(prior)))).drop(f"_value{i}", f"_statistic{i}")
    return out


def label_encode(df: DataFrame, c: str, name: str) -> DataFrame:
    """Codes fitted on the very rows they are applied to."""
    return apply_codes(df, c, fit_codes(df, c), name)


def map_values(df: DataFrame, c: str, table: DataFrame, name: str) -> DataFrame:
    """`df` with the (key, value) table's value of `c`, null on a miss; of a repeated key the smallest value, so rows stay as they are."""
    pairs = table.groupBy(F.col("key").alias("_key")).agg(F.min("value").alias(name))
    return df.join(pairs, F.col(c) == F.col("_key"), "left").drop("_key")


def align_categories(df: DataFrame, c: str, categories: DataFrame, name: str) -> DataFrame:
    """Nulls become MISSING, and values outside the (value) table become null."""
    own = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    table = categories.select(F.col("value").alias("_value")).distinct()
    return df.join(table, own == F.col("_value"), "left").withColumn(name, F.when(own == MISSING, MISSING).otherwise(F.col("_value"))).drop("_value")
