"""Bin-weighted and stratified sampling, shuffles and splits, all by hashed row order.

Draws depend on the seed and the row's key alone, so a retried task draws the
same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.binning import cut, qcut
from sparkloom.operators.ranks import draws, kth

BINS, WEIGHTS = [0.0, 1.0, 3.0, 6.0, 10.0, math.inf], [0.3, 1.0, 2.0, 3.0, 10.0]
#: Draws with replacement that one row of the plan stands for.
LOT = 100_000
BITS = 60


def hashed(seed: int, *parts: str) -> Column:
    """A number of BITS bits from a digest that other engines have too, so a draw can be checked there."""
    return F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts))), F.lit(BITS // 4)), 16, 10).cast("long")


def sample_plan(df: DataFrame, revenue: str = "iap_revenue_d7", bins: list[float] = BINS, weights: list[float] = WEIGHTS) -> DataFrame:
    """(bin, n_original, weight, n_samples) of each bin that has rows: floor(n * weight) samples."""
    if len(weights) != len(bins) - 1:
        raise ValueError("one weight for each bin")
    own = df.select(cut(revenue, bins).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n_original"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("bin") + 1)
    return own.select("bin", "n_original", weight.alias("weight"), F.floor(F.col("n_original").cast("double") * weight).alias("n_samples"))


def _ranked(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """`df` with _rank from 1 within each group, by hash; the parts of a group that windows hold follow the number of rows."""
    bits = draws(df.count()).bit_length() - 1
    own = df.withColumn("_hash", hashed(seed, key)).withColumn("_part", F.shiftright("_hash", BITS - bits))
    sizes = own.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_hash", key))
    return own.withColumn("_within", within).join(before, [group, "_part"]).withColumn("_rank", F.col("_within") + F.col("_before")).drop("_within", "_before", "_part", "_hash")


def bin_sample(df: DataFrame, key: str, revenue: str = "iap_revenue_d7", bins: list[float] = BINS, weights: list[float] = WEIGHTS, seed: int = 42) -> DataFrame:
    """floor(n * weight) rows of each bin: without replacement up to weight 1, else with.

    Draws with replacement are made, a bounded number in one row, as hashed row
    numbers and joined to the rows by bin and number.  They may be more than the
    rows and the planner only sees the few rows they come from, so the join is
    told to sort and not to broadcast.  Rows outside the bins are left out.
    """
    plan = sample_plan(df, revenue, bins, weights)
    few = F.broadcast(plan)  # only for joins of its own: what is made of a hinted table is broadcast too
    ranked = _ranked(df.withColumn("bin", cut(revenue, bins)).where("bin is not null"), "bin", key, seed)
    without = ranked.join(few, "bin").where("weight <= 1 and _rank <= n_samples").select(*df.columns, "bin")
    lots = plan.where("weight > 1 and n_samples > 0").select("bin", "n_original", "n_samples", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_samples"), F.lit(LOT).cast("long"))).alias("_from")).repartition("bin", "_from")
    each = lots.select("bin", "n_original", F.explode(F.sequence("_from", F.least(F.col("_from") + LOT - 1, F.col("n_samples")))).alias("_draw"))
    drawn = each.select("bin", (F.pmod(hashed(seed, "bin", "_draw"), F.col("n_original")) + 1).alias("_rank"))
    again = drawn.hint("merge").join(ranked.join(few.where("weight > 1").select("bin"), "bin"), ["bin", "_rank"]).select(*df.columns, "bin")
    return without.unionByName(again)


def stratified_plan(df: DataFrame, revenue: str, strata: int = 5, fraction: float = 0.1) -> DataFrame:
    """(stratum, n_original, n_samples): of each quantile stratum at least one row."""
    own = qcut(df, revenue, strata, "stratum").where("stratum is not null").groupBy("stratum").agg(F.count("*").alias("n_original"))
    return own.withColumn("n_samples", F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_original") * F.lit(fraction))))


def stratified_sample(df: DataFrame, key: str, revenue: str, strata: int = 5, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    ranked = _ranked(qcut(df, revenue, strata, "stratum").where("stratum is not null"), "stratum", key, seed)
    return ranked.join(F.broadcast(stratified_plan(df, revenue, strata, fraction)), "stratum").where("_rank <= n_samples").select(*df.columns, "stratum")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hashed(seed, key), key)


def oversample(df: DataFrame, condition: Column, times: int) -> DataFrame:
    """Rows that meet the condition `times` over, the others once."""
    return df.withColumn("_copy", F.explode(F.when(condition, F.sequence(F.lit(1), F.lit(times))).otherwise(F.array(F.lit(1))))).drop("_copy")


def ordered_split(df: DataFrame, by: str, key: str, fraction: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """The first floor(fraction * n) rows in the order of (by, key), nulls first, and the rest.

    The row at the boundary is found by counting; rows that are level with it
    are in the rest, and every row is in one of the two.
    """
    edge = kth(df, [by, key], math.floor(fraction * df.count()))
    if edge is None:
        return df, df.where(F.lit(False))
    first = F.struct(by, key) < edge
    return df.where(first), df.where(~first)
