"""Edge cases of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import binning, nested, scalar


def one(spark, schema, value, *columns):
    return tuple(spark.createDataFrame([(value,)], f"x {schema}").select(*columns).first())


@pytest.mark.parametrize(("value", "expected"), [(None, (0, 0, 0, 0, 0)), ({}, (0, 0, 0, 0, 0)), ({"a": 2.0}, (2, 2, 1, 2, 0)), ({"a": 1.0, "b": 3.0}, (4, 3, 2, 2, 1)), ({"a": float("nan"), "b": 3.0}, (3, 3, 2, 3, 0))])
def test_map_statistics(spark, value, expected):
    assert one(spark, "map<string,double>", value, nested.map_sum("x"), nested.map_max("x"), nested.map_len("x"), nested.map_mean("x"), nested.map_std("x")) == expected


def test_map_lookup(spark):
    get = lambda m, k: one(spark, "map<string,double>", m, nested.map_get("x", F.lit(k).cast("string")))[0]
    assert [get({"a": 2.0}, "a"), get({"a": 2.0}, "z"), get({"a": 2.0}, None), get(None, "a")] == [2, 0, 0, 0]


def test_entropy_and_top(spark):
    assert one(spark, "map<string,double>", {"a": 1.0, "b": 1.0}, nested.map_entropy("x"))[0] == pytest.approx(0.693147, abs=1e-6)
    assert one(spark, "map<string,double>", {"a": 0.0}, nested.map_entropy("x"))[0] == 0
    assert one(spark, "map<string,double>", {"a": 1.0, "b": 3.0}, *nested.top_values("x")) == (3, 1, 0, 0, 0)


@pytest.mark.parametrize(("value", "expected"), [(None, (0, 0)), ([], (0, 0)), (["x", "x", "y"], (3, 2))])
def test_lists(spark, value, expected):
    assert one(spark, "array<string>", value, nested.list_len("x"), nested.list_unique("x")) == expected


def test_compressed(spark):
    n, mean, entropy = one(spark, "array<string>", ["x", "x", "y"], *nested.compressed("x", "h"))
    assert (n, mean) == (3, 1.5) and entropy == pytest.approx(-(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)), abs=1e-6)
    assert one(spark, "array<string>", None, *nested.compressed("x", "h")) == (0, 0, 0)


@pytest.mark.parametrize(("hour", "bin_", "night", "evening"), [("0", 0, 1, 0), ("6", 0, 1, 0), ("7", 1, 0, 0), ("12", 1, 0, 0), ("13", 2, 0, 0), ("18", 2, 0, 1), ("19", 3, 0, 1), ("23", 3, 0, 1), ("xx", 0, 1, 0), (None, 0, 1, 0)])
def test_hours(spark, hour, bin_, night, evening):
    assert one(spark, "string", hour, scalar.hour_bin("x"), *scalar.hour_flags("x")) == (bin_, night, evening)


@pytest.mark.parametrize(("time", "days"), [("2025-10-07 23:00:00", 0), ("2025-10-09 01:00:00", -2), (None, 9999), ("never", 9999)])
def test_days_ago(spark, time, days):
    assert one(spark, "string", time, scalar.days_ago("x"))[0] == days


def test_strings(spark):
    assert [one(spark, "string", v, scalar.os_major("x"))[0] for v in ("14.2.1", "x.1", None, "9")] == [14, -1, -1, 9]
    assert [one(spark, "string", v, scalar.to_double("x", 0.0))[0] for v in ("1.5", "n/a", None)] == [1.5, 0, 0]
    assert one(spark, "string", "s3/datetime=2025-10-01-05-00/part-0.parquet", F.date_format(scalar.path_timestamp("x"), "yyyy-MM-dd HH:mm"))[0] == "2025-10-01 05:00"
    assert one(spark, "string", "no/time.parquet", scalar.path_timestamp("x"))[0] is None
    assert one(spark, "string", None, scalar.joined_key("x", F.lit("ios")))[0] == "None_ios"


def test_batches_of_days():
    got = scalar.date_batches("2025-10-01-00-00", "2025-10-03-23-00", 1)
    assert got == [(f"2025-10-0{d}-00-00", f"2025-10-0{d}-23-00") for d in (1, 2, 3)]
    assert scalar.date_batches("2025-10-01-00-00", "2025-10-02-05-00", 7) == [("2025-10-01-00-00", "2025-10-02-05-00")]
    assert scalar.window_of_days(7) == ("2025-10-01-00-00", "2025-10-07-23-00")
    with pytest.raises(ValueError):
        scalar.window_of_days(8)


@pytest.mark.parametrize(("x", "bin_"), [(0, 0), (1, 0), (1.5, 1), (3, 1), (6, 2), (10, 3), (10.01, 4), (-1, None), (None, None)])
def test_cut(spark, x, bin_):
    assert one(spark, "double", None if x is None else float(x), binning.cut("x", [0, 1, 3, 6, 10, math.inf]))[0] == bin_


def test_qcut_collapses(spark):
    df = spark.createDataFrame([(float(x),) for x in [0] * 97 + [1, 2, 3]] + [(None,)], "x double")
    assert {r["b"] for r in binning.qcut(df, "x", 5, "b").where("x is not null").collect()} == {0}
    assert binning.qcut(df, "x", 5, "b").where("x is null").first()["b"] is None
