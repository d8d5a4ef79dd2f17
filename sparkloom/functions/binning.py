"""Fixed-edge and quantile bins, right-closed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.nested import col
from sparkloom.operators.ranks import quantile_values


def cut(c: str | Column, edges: list[float]) -> Column:
    """Bin of (edges[i], edges[i + 1]], the lowest edge included; null outside."""
    if sorted(set(edges)) != list(edges) or len(edges) < 2:
        raise ValueError("edges must increase")
    x, out = col(c).cast("double"), None
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        above = x >= low if i == 0 else x > low
        inside = above if math.isinf(high) else above & (x <= high)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def quantile_edges(df: DataFrame, c: str, q: int) -> list[float]:
    """Distinct linearly interpolated quantiles 0, 1/q, ..., 1 (q + 1 numbers at most, so they go to the driver)."""
    return sorted({x for x in quantile_values(df, c, [i / q for i in range(q + 1)]) if x is not None})


def qcut(df: DataFrame, c: str, q: int, name: str) -> DataFrame:
    """`df` with the quantile bin of `c`; equal edges fall together, and nulls have no bin."""
    edges = quantile_edges(df, c, q)
    x = F.col(c).cast("double")
    below = sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(0))
    return df.withColumn(name, F.when(x.isNotNull(), F.greatest(below - 1, F.lit(0))))
