"""Running sums, order statistics and quantiles, exact; what a window or a buffer holds doesn't grow with the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.settled import hinted, settled
from sparkloom.sources.scratch import once

#: Rows that a range is to hold.
RANGE = 100_000
#: Bounds that one pass of kth() counts around.
BOUNDS = 63
#: Of approximate quantiles, whose ranks are wrong by at most n / ACCURACY.
ACCURACY = 10_000


def _literal(row, schema) -> Column:
    return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)))


def _bounds(rows: DataFrame, k: int) -> list[Column]:
    """At most k rows (a struct `me`), drawn by hash and sorted, as literals."""
    schema = rows.schema["me"].dataType
    drawn = rows.orderBy(F.xxhash64("me")).limit(k).distinct().orderBy("me").collect()
    return [_literal(r["me"], schema) for r in drawn]


def ranged(df: DataFrame, order: list[str], each: int = RANGE) -> DataFrame:
    """`df`, written once, with `_range`: ranges of `order` (ascending, nulls first) of about `each` rows, numbered in that order.

    There are as many ranges as the rows need.  Rows level in `order` are told
    apart by a hash, so a value that a third of the rows have fills several.
    """
    parts = -(-df.count() // each)
    if parts <= 1:
        return df.withColumn("_range", F.lit(0))
    dealt = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(parts, *order, "_tie")
    return once(dealt.drop("_tie").withColumn("_range", F.spark_partition_id()))


def running(df: DataFrame, order: list[str], sums: list[str], group: tuple[str, ...] = (), each: int = RANGE) -> DataFrame:
    """`df` with, for every column x of `sums`, x_before and x_total of the row's group.

    x_before sums the rows before it in `order` (ascending, nulls first; rows
    level in it are in any order).  Sums over ranged() parts are made first, so
    a window holds the rows of one range, and one row for each range.
    """
    own = ranged(df, order, each)
    parts = own.groupBy(*group, "_range").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    keys = [F.col(g).alias(f"_key{i}") for i, g in enumerate(group)]
    parts = parts.select(*keys, F.col("_range").alias("_part"), *(F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}0") for s in sums), *(F.sum(f"_{s}").over(whole).alias(f"{s}_total") for s in sums))
    inner = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({f"_{s}1": F.coalesce(F.sum(s).over(inner), F.lit(0)) for s in sums})
    same = F.col("_range") == F.col("_part")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_key{i}"))
    out = own.join(parts if group else hinted(settled(parts)), same)
    return out.select(*df.columns, *((F.col(f"_{s}0") + F.col(f"_{s}1")).alias(f"{s}_before") for s in sums), *(f"{s}_total" for s in sums))


def kth(df: DataFrame, order: list[str], k: int, few: int = 10_000) -> Column | None:
    """A struct literal of the columns `order`: the row that has k rows before it (nulls first), None if there are no more than k.

    The columns are written once.  Each pass counts the rows around a few drawn
    bounds and goes on between two of them; what is left when few rows are is
    ordered.
    """
    left = df.select(F.struct(*order).alias("me"))
    schema = left.schema["me"].dataType
    n = left.count()
    left = once(left) if n > few else left
    while n > few:
        if k >= n:
            return None
        bounds = _bounds(left, BOUNDS)
        row = left.agg(*(F.count_if(F.col("me") < b) for b in bounds), *(F.count_if(F.col("me") <= b) for b in bounds)).first()
        below, upto = row[: len(bounds)], row[len(bounds) :]
        inside = next((i for i in range(len(bounds)) if below[i] <= k < upto[i]), None)
        if inside is not None:
            return bounds[inside]
        i = sum(u <= k for u in upto)
        if i:
            left = left.where(F.col("me") > bounds[i - 1])
            k -= upto[i - 1]
        if i < len(bounds):
            left = left.where(F.col("me") < bounds[i])
        n = left.count()
    found = left.orderBy("me").offset(k).limit(1).first()
    return None if found is None else _literal(found["me"], schema)


def _quantiles(counts: DataFrame, at: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, q, value) of counted values (*by, _x, _in, _n); null where a value is needed whose _in is false."""
    ranked = running(counts, ["_x", "_in"], ["_n"], by)
    place = lambda q: F.lit(float(q)) * (F.col("_n_total") - 1)
    holds = lambda k: (k >= F.col("_n_before")) & (k < F.col("_n_before") + F.col("_n"))
    ends = F.array(*(F.struct(F.lit(float(q)).alias("q"), F.floor(place(q)).alias("low"), F.ceil(place(q)).alias("high"), place(q).alias("at")) for q in at))
    met = ranked.withColumn("_ends", F.filter(ends, lambda e: holds(e["low"]) | holds(e["high"]))).where(F.size("_ends") > 0).select(*by, F.when(F.col("_in"), F.col("_x")).alias("_x"), "_n", "_n_before", F.explode("_ends").alias("_e"))
    of = lambda end: F.max(F.when(holds(F.col(f"_e.{end}")), F.col("_x")))
    out = met.groupBy(*by, F.col("_e.q").alias("q"), F.col("_e.low").alias("_low"), F.col("_e.high").alias("_high"), F.col("_e.at").alias("_at")).agg(of("low").alias("_a"), of("high").alias("_b"))
    value = F.when((F.col("_low") == F.col("_high")) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise((F.col("_high") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.col("_low")) * F.col("_b"))
    return out.select(*by, "q", value.alias("value"))


def quantiles_by(df: DataFrame, c: str, at: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, q, value): linearly interpolated quantiles of the non-null values of `c` in each group that has some.

    Values are counted first; what meets in one place are two values for each
    quantile.
    """
    return _quantiles(df.where(F.col(c).isNotNull()).groupBy(*by, F.col(c).cast("double").alias("_x"), F.lit(True).alias("_in")).agg(F.count("*").alias("_n")), at, by)


def quantile_values(df: DataFrame, c: str, at: list[float]) -> list[float | None]:
    """The quantiles `at`, in that order, to the driver; None where there are no values.

    Approximate quantiles a little below and above each one enclose it, so only
    values between those are counted one by one; should one not be enclosed,
    all are.
    """
    wanted = sorted(set(map(float, at)))
    x = F.col("_x")
    rows = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("_x"))
    sides = [min(1.0, max(0.0, q + d)) for q in wanted for d in (-3 / ACCURACY, 3 / ACCURACY)]
    n, about = rows.agg(F.count("*"), F.percentile_approx("_x", sides, ACCURACY)).first()
    found = {}
    if n > 2 * ACCURACY:
        value, inside = F.lit(float("inf")), F.lit(False)
        for low, high in sorted(set(zip(about[::2], about[1::2])), reverse=True):
            value, inside = F.when(x <= high, F.greatest(x, F.lit(low))).otherwise(value), F.when(x <= high, x >= low).otherwise(inside)
        counts = rows.groupBy(value.alias("_x"), inside.alias("_in")).agg(F.count("*").alias("_n"))
        found = {r["q"]: r["value"] for r in _quantiles(counts, wanted).collect()}
    if n and None in map(found.get, wanted):
        found = {r["q"]: r["value"] for r in quantiles_by(rows, "_x", wanted).collect()}
    return [found.get(float(q)) for q in at]


def draws(n: int) -> int:
    """Parts for n rows, a power of two."""
    return 1 << max(6, math.ceil(math.log2(max(1, n / RANGE))))
