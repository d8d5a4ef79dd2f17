"""Column expressions over maps and arrays.

Null and empty collections count as nothing: sizes, sums, maxima, means and
deviations are 0, and so is the value of a missing key.  Everything stays in
the JVM, with higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def list_len(a: str | Column) -> Column:
    return F.when(col(a).isNull(), 0).otherwise(F.size(col(a)))


def list_unique(a: str | Column) -> Column:
    return F.when(col(a).isNull(), 0).otherwise(F.size(F.array_distinct(col(a))))


def map_len(m: str | Column) -> Column:
    return F.when(col(m).isNull(), 0).otherwise(F.size(col(m)))


def map_values(m: str | Column) -> Column:
    """Values as doubles, without nulls and NaN; an empty array for a null map."""
    values = F.transform(F.map_values(col(m)), lambda v: F.nanvl(v.cast("double"), F.lit(None).cast("double")))
    return F.coalesce(F.filter(values, lambda v: v.isNotNull()), F.array().cast("array<double>"))


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def map_sum(m: str | Column) -> Column:
    return array_total(map_values(m))


def map_max(m: str | Column) -> Column:
    return F.coalesce(F.array_max(map_values(m)), F.lit(0.0))


def map_min(m: str | Column) -> Column:
    return F.coalesce(F.array_min(map_values(m)), F.lit(0.0))


def map_mean(m: str | Column) -> Column:
    return F.coalesce(F.try_divide(map_sum(m), F.size(map_values(m))), F.lit(0.0))


def map_std(m: str | Column) -> Column:
    """Population standard deviation; 0 for fewer than two values."""
    values, mean = map_values(m), map_mean(m)
    return F.when(F.size(values) > 1, F.sqrt(F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)), F.size(values)))).otherwise(0.0)


def map_get(m: str | Column, key: str | Column) -> Column:
    """Value of `key`, 0 if the map, the key or the entry is missing."""
    return F.coalesce(F.try_element_at(col(m), col(key)).cast("double"), F.lit(0.0))


def top_values(m: str | Column, k: int = 5) -> list[Column]:
    """The k largest values, descending, padded with 0."""
    ordered = F.sort_array(map_values(m), asc=False)
    return [F.coalesce(F.get(ordered, F.lit(i)), F.lit(0.0)) for i in range(k)]


def entropy(values: Column, eps: float = 1e-10) -> Column:
    """-sum p ln(p + eps) of an array of weights; 0 if their total isn't positive."""
    total = array_total(values)
    return F.when(total > 0, -F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v / total * F.log(v / total + eps))).otherwise(0.0)


def map_entropy(m: str | Column, eps: float = 1e-10) -> Column:
    return entropy(map_values(m), eps)


def multiplicities(a: str | Column) -> Column:
    """How often each distinct element of a list occurs."""
    return F.coalesce(F.transform(F.array_distinct(col(a)), lambda x: F.size(F.filter(col(a), lambda y: y.eqNullSafe(x))).cast("double")), F.array().cast("array<double>"))


def compressed(a: str | Column, prefix: str) -> list[Column]:
    """Length, mean multiplicity and entropy of a list of values."""
    n = multiplicities(a)
    return [
        list_len(col(a)).alias(f"{prefix}_len"),
        F.coalesce(F.try_divide(array_total(n), F.size(n)), F.lit(0.0)).alias(f"{prefix}_mean"),
        entropy(n, 1e-9).alias(f"{prefix}_entropy"),
    ]


def dict_features(m: str, aggregations: tuple[str, ...] = ("mean", "std", "max", "min")) -> list[Column]:
    known = {"mean": map_mean, "std": map_std, "max": map_max, "min": map_min, "sum": map_sum}
    return [known[a](m).alias(f"{m}_{a}") for a in aggregations] + [map_len(m).alias(f"{m}_count")]


def list_features(a: str) -> list[Column]:
    return [list_len(a).alias(f"{a}_count"), list_unique(a).alias(f"{a}_unique")]


def histogram_features(m: str, top_k: int = 5) -> list[Column]:
    return [c.alias(f"{m}_top{i + 1}") for i, c in enumerate(top_values(m, top_k))] + [map_entropy(m).alias(f"{m}_entropy")]
