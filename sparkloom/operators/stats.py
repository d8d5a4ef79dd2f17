"""Grouped statistics, lookup tables and descriptive statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkloom.functions.scalar import joined_key
from sparkloom.operators.ranks import quantile_values, quantiles_by
from sparkloom.operators.settled import settled_by
from sparkloom.sources.scan import window

WHALE_LOG = 10.0


def with_targets(df: DataFrame, whale_threshold: float = WHALE_LOG) -> DataFrame:
    """Adds buyer_d7, log_rev_d7 and is_whale (log revenue above the threshold) where they are missing."""
    new = {"buyer_d7": (F.col("iap_revenue_d7") > 0).cast("int"), "log_rev_d7": F.log1p("iap_revenue_d7"), "is_whale": (F.log1p("iap_revenue_d7") > whale_threshold).cast("int")}
    return df.withColumns({k: v for k, v in new.items() if k not in df.columns})


def _stats() -> list[Column]:
    return [F.avg("buyer_d7").alias("buyer_rate"), F.avg("iap_revenue_d7").alias("avg_rev_d7"), F.avg("is_whale").alias("whale_rate"), F.count("buyer_d7").alias("count")]


def group_stats(df: DataFrame, key: str | Column, whale_threshold: float = WHALE_LOG) -> DataFrame:
    """(key, buyer_rate, avg_rev_d7, whale_rate, count) per key; rows without a key are dropped."""
    key = F.col(key) if isinstance(key, str) else key
    return with_targets(df, whale_threshold).select(key.cast("string").alias("key"), "buyer_d7", "iap_revenue_d7", "is_whale").where("key is not null").groupBy("key").agg(*_stats())


def segment_key() -> Column:
    return joined_key("country", "dev_os")


def lookup_tables(df: DataFrame, whale_threshold: float = WHALE_LOG) -> dict[str, DataFrame]:
    """The four lookup tables, from one scan and one shuffle by grouping sets."""
    keys = {"bundle": F.col("advertiser_bundle"), "category": F.col("advertiser_category"), "country": F.col("country"), "segment": segment_key()}
    base = with_targets(df, whale_threshold)
    entries = F.array(*(F.struct(F.lit(name).alias("table"), key.cast("string").alias("key")) for name, key in keys.items()))
    every = base.select(F.explode(entries).alias("e"), "buyer_d7", "iap_revenue_d7", "is_whale").select("e.*", "buyer_d7", "iap_revenue_d7", "is_whale")
    return settled_by(every.where("key is not null").groupBy("table", "key").agg(*_stats()), "table", list(keys))


def hourly_state(df: DataFrame, whale_threshold: float = WHALE_LOG, hour: str = "datetime") -> DataFrame:
    """(hour, table, key, n, buyers, valued, revenue, whales): sums from which the lookup tables of any window of hours follow.

    One scan and one shuffle, as lookup_tables(); rows of the state are as many
    as the keys of each hour.  A stored hour that is computed again is replaced
    by itself, so late files cost their own hours only.
    """
    keys = {"bundle": F.col("advertiser_bundle"), "category": F.col("advertiser_category"), "country": F.col("country"), "segment": segment_key()}
    entries = F.array(*(F.struct(F.lit(name).alias("table"), key.cast("string").alias("key")) for name, key in keys.items()))
    every = with_targets(df, whale_threshold).select(hour, F.explode(entries).alias("e"), "buyer_d7", "iap_revenue_d7", "is_whale").select(hour, "e.*", "buyer_d7", "iap_revenue_d7", "is_whale")
    sums = [F.count("buyer_d7").alias("n"), F.sum("buyer_d7").alias("buyers"), F.count("iap_revenue_d7").alias("valued"), F.sum("iap_revenue_d7").alias("revenue"), F.sum("is_whale").alias("whales")]
    return every.where("key is not null").groupBy(hour, "table", "key").agg(*sums)


def tables_of_state(state: DataFrame, start: str | None = None, end: str | None = None, hour: str = "datetime") -> dict[str, DataFrame]:
    """The lookup tables of the hours from `start` to `end` (both in it): hours are added, no impression is read again."""
    own = window(state, start, end, column=hour)
    rates = [F.try_divide(F.sum("buyers"), F.sum("n")).alias("buyer_rate"), F.try_divide(F.sum("revenue"), F.sum("valued")).alias("avg_rev_d7"), F.try_divide(F.sum("whales"), F.sum("valued")).alias("whale_rate"), F.sum("n").alias("count")]
    return settled_by(own.groupBy("table", "key").agg(*rates), "table", ["bundle", "category", "country", "segment"])


def out_of_fold(df: DataFrame, key: str, row: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """`df` with buyer_rate and avg_rev_d7 of its key over the rows of the other folds (null where they have none).

    A row's fold is a hash of the column `row`, so no row's own target is in its
    rates.  Sums per key and fold are made first; a key meets `folds` rows.
    """
    own = df.withColumn("_fold", F.pmod(F.xxhash64(F.col(row), F.lit(seed)), F.lit(folds)))
    sums = own.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), "_fold").agg(F.count("buyer_d7").alias("n"), F.sum("buyer_d7").alias("b"), F.sum("iap_revenue_d7").alias("r"))
    whole = sums.groupBy("_key").agg(*(F.sum(c).alias(f"{c}0") for c in "nbr"))
    rest = sums.join(whole, "_key").select("_key", F.col("_fold").alias("_own"), F.try_divide(F.col("b0") - F.col("b"), F.col("n0") - F.col("n")).alias("buyer_rate"), F.try_divide(F.col("r0") - F.col("r"), F.col("n0") - F.col("n")).alias("avg_rev_d7"))
    return own.join(rest, (F.col(key) == F.col("_key")) & (F.col("_fold") == F.col("_own")), "left").drop("_key", "_own", "_fold")


def filled(df: DataFrame, constants: dict | None = None, means: list[str] | None = None) -> DataFrame:
    """`df` with missing values of columns replaced: by a constant of their own, or by the mean of the column."""
    means = [c for c in means or [] if c in df.columns]
    average = df.agg(*(F.avg(c).alias(c) for c in means)).first().asDict() if means else {}
    values = {c: v for c, v in (constants or {}).items() if c in df.columns} | {c: v for c, v in average.items() if v is not None}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()}) if values else df


def n_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): distinct non-null values of each column; they are counted in groups, not in one buffer."""
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(entries).alias("e")).select("e.*").where("value is not null").distinct().groupBy("column").agg(F.count("*").alias("n"))


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows in the order of the columns."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)


def group_means(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Mean of each column in each group."""
    return df.groupBy(by).agg(*(F.avg(c).alias(c) for c in columns))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("count"))


def relative_frequency(df: DataFrame, c: str) -> DataFrame:
    """Share of each value among the rows that have one."""
    counts = value_counts(df, c)
    return counts.withColumn("freq", F.col("count") / F.sum("count").over(Window.partitionBy())).drop("count")


def top_k(df: DataFrame, c: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return value_counts(df, c).orderBy(F.desc("count"), c).limit(k)


def in_top_k(df: DataFrame, c: str, k: int) -> DataFrame:
    return df.join(F.broadcast(top_k(df, c, k).select(c)), c, "left_semi")


def null_share(df: DataFrame) -> DataFrame:
    """(column, null_pct) of all columns, in one pass."""
    shares = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in df.columns))
    return shares.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("null_pct")) for c in df.columns))).alias("e")).select("e.*")


def drop_sparse(df: DataFrame, most: float = 1.0) -> DataFrame:
    """Without the columns of which at least `most` is null (1.0: those that are all null)."""
    gone = [r["column"] for r in null_share(df).where(F.col("null_pct") >= most).collect()]
    return df.drop(*gone)


def describe(df: DataFrame, c: str) -> DataFrame:
    x = F.col(c).cast("double")
    low, middle, high = (F.lit(v).cast("double") for v in quantile_values(df, c, [0.25, 0.5, 0.75]))
    return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).select("count", "mean", "std", "min", low.alias("q25"), middle.alias("q50"), high.alias("q75"), "max")


def quantiles(df: DataFrame, c: str, at: list[float]) -> DataFrame:
    """(q, value), linearly interpolated; no rows without values."""
    return quantiles_by(df, c, at)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def nested_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def _products(columns: list[str], centre: list[float]):
    """Sums of all pairs of columns over the rows that have both: one row for each pair and partition."""
    k, (first, second) = len(columns), np.triu_indices(len(columns), 1)

    def run(batches):
        sums = np.zeros((6, k, k))
        for batch in batches:
            x = np.column_stack([np.asarray(c.cast("float64").fill_null(0.0)) for c in batch.columns]) - centre
            there = np.column_stack([np.asarray(c.is_valid(), np.float64) for c in batch.columns])
            x = np.where(there > 0, x, 0.0)
            n, sx, sxx = there.T @ there, x.T @ there, (x * x).T @ there
            sums += np.stack([n, sx, sx.T, sxx, sxx.T, x.T @ x])
        if len(first):
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), *(pa.array(s[first, second]) for s in sums)], names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    return run


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of columns, a before b, over the rows that have both; null where one of them doesn't vary.

    A pass for the means, which values are taken from so that sums stay small,
    and one for the products: each task multiplies the matrix of its rows with
    itself and passes on one row for each pair, so plan and buffers follow the
    columns and not their pairs times the rows.
    """
    own = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    centre = own.agg(*(F.avg(c) for c in own.columns)).first() if columns else []
    parts = own.mapInArrow(_products(columns, [0.0 if m is None or m != m else m for m in centre]), "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    whole = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    spread = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread)
    names = F.array(*map(F.lit, columns))
    return whole.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), F.when(spread > 0, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("r"))


def strongest(df: DataFrame, target: str, k: int) -> DataFrame:
    """(column, r): the numeric columns that correlate most with `target`, by |r|."""
    others = [c for c in numeric_columns(df) if c != target]
    row = df.agg(*(F.corr(c, target).alias(c) for c in others))
    each = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("r")) for c in others))).alias("e")).select("e.*")
    return each.where("r is not null").orderBy(F.desc(F.abs("r")), "column").limit(k)


def target_encoding(df: DataFrame, c: str, target: str, min_samples: int = 200) -> DataFrame:
    """(c, te): the global mean and the group's, mixed by a sigmoid of the group's size."""
    sums = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(target).alias("n"), F.sum(target).alias("s"))
    overall = df.agg(F.avg(target)).first()[0]
    weight = 1 / (1 + F.exp(-(F.col("n") - min_samples).cast("double")))
    mean = F.try_divide("s", "n")
    return sums.select(c, (F.lit(overall) * (1 - weight) + mean * weight).alias("te"))


def whale_rate(df: DataFrame, c: str, revenue: str = "iap_revenue_d7", q: float = 0.8) -> DataFrame:
    """(c, whale_rate): share of rows at or above the quantile of revenue."""
    threshold = quantile_values(df, revenue, [q])[0]
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.avg((F.col(revenue) >= F.lit(threshold)).cast("int")).alias("whale_rate"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): rows over twice the rows of the class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.select(label, (F.sum("n").over(Window.partitionBy()) / (2 * F.col("n"))).alias("weight"))


def histogram(df: DataFrame, c: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, count) of equal-width bins over [low, high]; the highest edge is in the last bin."""
    x = F.col(c).cast("double")
    n = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(x.between(low, high)).groupBy(n.alias("bin")).agg(F.count("*").alias("count"))


def box(df: DataFrame, by: str, c: str) -> DataFrame:
    """Smallest value, quartiles and largest value of each group that has values."""
    names = {0.0: "low", 0.25: "q25", 0.5: "q50", 0.75: "q75", 1.0: "high"}
    return quantiles_by(df, c, list(names), (by,)).groupBy(by).agg(*(F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in names.items()))


def schema_difference(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns that only one of two tables has, and those of which the types differ."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return {"missing": sorted(x.keys() - y.keys()), "extra": sorted(y.keys() - x.keys()), "changed": sorted(c for c in x.keys() & y.keys() if x[c] != y[c])}


def integrity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_a, only_b, both): distinct keys of two tables compared."""
    side = lambda df, n: df.select(key).distinct().withColumn(n, F.lit(1))
    both = side(a, "_a").join(side(b, "_b"), key, "full")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; columns that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
