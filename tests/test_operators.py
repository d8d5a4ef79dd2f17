"""Operators on small frames: sampling, encoders, metrics, stores, scans, models, streams."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import encoding, evaluate, features, model, ranks, sampling, stats
from sparkloom.plans import pipelines, train
from sparkloom.plans.fixture import impressions
from sparkloom.sources import scan, stores
from sparkloom.streaming import online


def revenues(spark, values):
    return spark.createDataFrame(list(enumerate(map(float, values))), "row_id long, iap_revenue_d7 double")


def test_bin_sample_sizes(spark):
    df = revenues(spark, [0.5] * 7 + [2] * 3 + [20] * 2)
    counts = {r["bin"]: r["n"] for r in sampling.bin_sample(df, "row_id").groupBy("bin").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 2, 1: 3, 4: 20}
    first = sampling.bin_sample(df, "row_id").where("bin < 4").collect()
    assert sorted(first) == sorted(sampling.bin_sample(df.repartition(3), "row_id").where("bin < 4").collect())
    with pytest.raises(ValueError):
        sampling.sample_plan(df, weights=[1.0])
    assert sampling.bin_sample(revenues(spark, [0.5]), "row_id").count() == 0


def joins(df):
    """The joins that ran, with their keys, after the plan was adapted."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"(\w+Join) (\[.*?\]), ", plan) for x in [" ".join(x)]]


def test_draws_are_not_broadcast(spark):
    df = revenues(spark, [0.5] * 50 + [20] * 3000)
    out = sampling.bin_sample(df, "row_id")
    found = [x for x in joins(out) if x.endswith("[bin, cast(_rank as bigint)]") or x.endswith("[bin, _rank]")]
    assert found and all(x.startswith("SortMergeJoin") for x in found)
    assert out.groupBy("bin").count().where("bin = 4").first()["count"] == 30_000


def test_strata_and_splits(spark):
    df = revenues(spark, [0] * 97 + [1, 2, 3])
    assert sampling.stratified_sample(df, "row_id", "iap_revenue_d7").count() == 10
    a, b = sampling.ordered_split(df.withColumn("t", F.col("row_id") % 7), "t", "row_id")
    want = sorted((i % 7, i) for i in range(100))
    assert sorted((r["t"], r["row_id"]) for r in a.collect()) == want[:85] and b.count() == 15
    assert sampling.oversample(df, F.col("iap_revenue_d7") >= 2, 4).count() == 98 + 8


def test_encoders(spark):
    df = spark.createDataFrame([("US",), ("UK",), (None,)], "c string")
    codes = encoding.fit_codes(df, "c")
    more = spark.createDataFrame([("US",), ("UK",), ("FR",), (None,)], "c string")
    assert {r["c"]: r["k"] for r in encoding.apply_codes(more, "c", codes, "k").collect()} == {"US": 1, "UK": 0, "FR": -1, None: -1}
    assert encoding.fit_codes(spark.createDataFrame([(None,)], "c string"), "c").count() == 0
    aligned = encoding.align_categories(more, "c", spark.createDataFrame([("US",)], "value string"), "k")
    assert {r["c"]: r["k"] for r in aligned.collect()} == {"US": "US", "UK": None, "FR": None, None: "__MISSING__"}


def test_metrics_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.randrange(20) / 20) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert evaluate.auc_roc(df, "y", "s").first()[0] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
    area, last = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        said = [y for y, s in rows if s >= t]
        recall = sum(said) / len(pos)
        area += (recall - last) * sum(said) / len(said)
        last = recall
    assert evaluate.average_precision(df, "y", "s").first()[0] == pytest.approx(area, abs=1e-12)


def test_metric_edges(spark):
    tie = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, s double")
    assert evaluate.auc_roc(tie, "y", "s").first()[0] == 0.5
    none = spark.createDataFrame([(0, 0.1), (1, 0.2)], "y int, s double")
    report = evaluate.classifier_report(none, "y", "s").first()
    assert (report["precision"], report["f1"], report["accuracy"]) == (0, 0, 0.5)
    clipped = spark.createDataFrame([(0.0, -5.0)], "y double, p double")
    assert evaluate.regressor_report(clipped, "y", "p").first()["msle"] == 0
    gate = spark.createDataFrame([(0.5, math.log(3)), (0.49, math.log(3))], "p double, r double").select(evaluate.gate("p", "r")).collect()
    assert [round(r[0], 9) for r in gate] == [2.0, 0.0]
    assert evaluate.auc_roc(tie.where("y = 1"), "y", "s").first()[0] is None
    assert list(evaluate.lines_of({"cls_f1": 1.0, "reg_mae": 2.0}))[0] == "[cls]"


def test_lookup_misses_keep_rows(spark):
    df = spark.createDataFrame([(1, "b1", "c", "US", "ios", 5.0), (2, "new", None, None, None, 0.0)], "row_id long, advertiser_bundle string, advertiser_category string, country string, dev_os string, iap_revenue_d7 double")
    tables = stats.lookup_tables(df.where("row_id = 1"))
    rows = {r["row_id"]: r for r in features.enrich(df, tables).collect()}
    assert rows[1]["bundle_avg_rev_d7"] == 5 and rows[2]["bundle_avg_rev_d7"] == 0 and rows[2]["segment_buyer_rate"] == 0 and len(rows) == 2
    assert {r["key"] for r in stats.lookup_tables(df)["segment"].collect()} == {"US_ios", "None_None"}


def test_missing_columns_give_fewer_features(spark):
    df = spark.createDataFrame([(1, "US", {"a": 1.0}, {"x": 4.0, "y": 2.0})], "row_id long, country string, num_buys_bundle map<string,double>, avg_duration map<string,double>")
    out, encoders = features.offline(df, rich=True)
    row = out.first().asDict()
    assert row["total_buys"] == 1 and row["buys_bundle_mean"] == 1 and row["avg_duration"] == 3 and row["country"] == 0 and "hour_sin" not in row
    assert encoders.count() == 1
    flat = features.flatten_all(df, ["num_buys_bundle"], ["nothing"], ["avg_duration"]).first().asDict()
    assert flat["num_buys_bundle_count"] == 1 and flat["avg_duration_top1"] == 4


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "row_id long, c string, y int, s double, iap_revenue_d7 double")
    assert evaluate.auc_roc(empty, "y", "s").first()[0] is None
    assert sampling.bin_sample(empty, "row_id").count() == 0
    assert stats.value_counts(empty, "c").count() == 0
    a, b = sampling.ordered_split(empty, "c", "row_id")
    assert (a.count(), b.count()) == (0, 0)


def test_scans(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.range(48).withColumn("datetime", F.date_format(F.timestamp_seconds(F.lit(1759276800) + F.col("id") * 3600), "yyyy-MM-dd-HH-mm"))
    stores.append_windows(df, root)
    windows = scan.Windows("2025-10-01-00-00", "2025-10-01-11-00", "2025-10-02-00-00", "2025-10-02-23-00")
    train, val = scan.Loader(spark, root, windows=windows).load_train()
    assert (train.count(), val.count()) == (12, 24)
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(datetime" in plan
    assert scan.Loader(spark, root).load_train(False)[0].count() == 48
    assert scan.glob_scan(spark, root, "datetime=2025-10-01-0*").count() == 10
    shard = scan.shard_scan(spark, root, 5)
    assert shard.count() == 5 and shard.where("datetime is null").count() == 0
    assert scan.first_files(spark, root, 3).count() == 3
    assert [len(b) for b in scan.batches(df, 20)] == [20, 20, 8]
    with pytest.raises(ValueError):
        scan.Windows("2025-10-01", "2025-10-06", "2025-10-06", "2025-10-07")
    stores.append_windows(df.where("id < 2").withColumn("id", F.lit(99).cast("long")), root)
    assert spark.read.parquet(root).where("id = 99").count() == 2 and spark.read.parquet(root).count() == 48


def test_stores(spark, small, tmp_path):
    df = impressions(spark, small)
    tables = stats.lookup_tables(df)
    for kind in ("json", "parquet"):
        stores.save_lookups({"country": tables["country"]}, str(tmp_path / kind), kind)
        loaded = stores.load_lookups(spark, str(tmp_path / kind), kind)
        assert sorted(loaded["country"].collect()) == sorted(tables["country"].select(loaded["country"].columns).collect()) and loaded["bundle"].count() == 0
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    key = stores.cache_key(("a", "b"), ["x"])
    for rebuild in (False, False, True):
        assert stores.cached_features(spark, str(tmp_path), key, build, rebuild).count() == 3
    assert len(calls) == 2
    stores.save_feature_names(df, str(tmp_path))
    assert stores.load_feature_names(spark, str(tmp_path)) == df.columns
    good = df.select("row_id", "iap_revenue_d7")
    assert stores.write_submission(good, str(tmp_path / "csv"))["rows"] == df.count()
    for bad in (good.withColumn("iap_revenue_d7", F.lit(-1.0)), good.withColumn("iap_revenue_d7", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            stores.write_submission(bad, str(tmp_path / "bad"))
    codes = encoding.fit_encoders(df, ["country", "dev_os", "absent"])
    stores.save_encoders(codes, str(tmp_path))
    assert stores.load_encoders(spark, str(tmp_path)).count() == codes.count()


def test_models(spark, small, tmp_path):
    df = impressions(spark, small).withColumn("h", F.col("hour").cast("double")).select("row_id", "h", "user_id", "iap_revenue_d7", "buyer_d7")
    names = ["h", "user_id"]
    teachers = model.fit_teachers(df, names, model.Boosting(2, 2))
    teachers.save(str(tmp_path / "m"))
    a, b = (sorted(m.score(df).select("row_id", "gated").collect()) for m in (teachers, model.load(str(tmp_path / "m"), names)))
    assert a == b and all(r["gated"] >= 0 for r in a)
    labels = model.soft_labels(teachers, df)
    stores.save_soft_labels(labels, str(tmp_path / "l"))
    students = model.fit_students(df.select("row_id", *names), stores.load_soft_labels(spark, str(tmp_path / "l")), names, model.Boosting(2, 2))
    assert students.score(df).where("p_buyer < 0 or p_buyer > 1").count() == 0
    assert [n for n, _ in teachers.importances()] and len(teachers.importances()) == 2


def test_stream_equals_batch(spark, small, tmp_path):
    df = impressions(spark, small)
    df.write.parquet(str(tmp_path / "in"))
    tables, encoders = stats.lookup_tables(df), encoding.fit_encoders(df, ["country", "dev_os"])
    stream = online.read_files(spark, str(tmp_path / "in"), df.schema)
    online.append_available(online.online(stream, tables, encoders), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = features.online(df, tables, encoders, fit=False)[0]
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_tables_compared(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2, 1.0)], "k int, w double")
    assert stats.schema_difference(a, b) == {"missing": ["v"], "extra": ["w"], "changed": []}
    assert tuple(stats.integrity(a, b, "k").first()) == (1, 1, 0)
    assert stats.drop_sparse(a.withColumn("n", F.lit(None).cast("int"))).columns == ["k", "v"]
    assert features.feature_sets(a)["dense"] == ["k", "v"]
    assert stats.union_all(a, b).columns == ["k", "v", "w"]


def test_split_keeps_null_rows(spark):
    df = spark.createDataFrame([(None, 1), ("b", None), ("a", 2), (None, None), ("b", 3)], "t string, k long")
    for few in (10_000, 1):
        a, b = sampling.ordered_split(df, "t", "k", 0.6)
        assert sorted(map(str, a.collect() + b.collect())) == sorted(map(str, df.collect())) and a.count() == 3
        assert a.where("t = 'b'").count() == 0
        edge = ranks.kth(df, ["t", "k"], 3, few)
        assert spark.range(1).select(edge.alias("e")).first()["e"] == ("b", None)
    assert ranks.kth(df, ["t", "k"], 5) is None


def test_running_sums_over_ranges(spark):
    rng = random.Random(2)
    values = [(rng.choice("xy"), i, rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(values, "g string, i int, n int")
    for each in (10_000, 7):
        rows = ranks.running(df, ["i"], ["n"], ("g",), each).collect()
        for r in rows:
            own = [n for g, i, n in values if g == r["g"]]
            assert r["n_total"] == sum(own) and r["n_before"] == sum(n for g, i, n in values if g == r["g"] and i < r["i"])
        assert len(rows) == 300


def test_quantiles_of_many_values(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros(15_000), rng.exponential(size=15_000), [np.nan]])
    at = [0.0, 0.25, 0.5, 0.77, 0.999]
    got = ranks.quantile_values(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", at)
    assert got == pytest.approx(np.quantile(np.where(np.isnan(x), 1e9, x), at).tolist())  # NaN is the largest
    assert ranks.quantile_values(spark.createDataFrame([], "x double"), "x", at) == [None] * 5


def test_metrics_with_odd_scores(spark):
    df = spark.createDataFrame([(1, float("nan")), (0, float("inf")), (1, 0.3), (0, float("-inf")), (None, 0.1), (1, None)], "y int, s double")
    assert evaluate.auc_roc(df, "y", "s").first()[0] == pytest.approx(3 / 4)


def test_out_of_fold_leaves_own_rows_out(spark):
    rows = [(i, "ab"[i % 2], i % 3 == 0, float(i)) for i in range(40)] + [(40, None, True, 1.0), (41, "c", True, 1.0)]
    df = spark.createDataFrame([(i, k, int(b), v) for i, k, b, v in rows], "row_id long, c string, buyer_d7 int, iap_revenue_d7 double")
    found = stats.out_of_fold(df, "c", "row_id", 3).withColumn("fold", F.pmod(F.xxhash64("row_id", F.lit(42)), F.lit(3))).collect()
    assert len(found) == 42
    for r in found:
        rest = [x["iap_revenue_d7"] for x in found if x["c"] == r["c"] and x["fold"] != r["fold"] and r["c"] is not None]
        assert r["avg_rev_d7"] == (pytest.approx(sum(rest) / len(rest)) if rest else None)


def test_a_large_table_does_not_hold_back_small_ones(spark):
    from sparkloom.operators.settled import settled_by

    df = spark.createDataFrame([("big", i) for i in range(20)] + [("small", 1)], "t string, k int")
    parts = settled_by(df, "t", ["big", "small", "none"], 5)
    assert parts["small"].isLocal() and not parts["big"].isLocal() and [parts[x].count() for x in ("big", "small", "none")] == [20, 1, 0]


def test_repeated_keys_do_not_multiply_rows(spark):
    df = spark.createDataFrame([("a",), ("b",)], "c string")
    table = spark.createDataFrame([("a", 2), ("a", 1)], "key string, value int")
    assert sorted(map(tuple, encoding.map_values(df, "c", table, "v").collect()), key=str) == [("a", 1), ("b", None)]
    assert encoding.first_seen_codes(df.withColumn("o", F.when(F.col("c") == "a", 2).otherwise(1)), "c", "o").collect() == [("b", 0), ("a", 1)]


def test_labelled_rows_and_batches_of_features(spark, tmp_path):
    root, test = str(tmp_path / "t"), str(tmp_path / "u")
    df = spark.range(72).withColumn("datetime", F.date_format(F.timestamp_seconds(F.lit(1759276800) + F.col("id") * 3600), "yyyy-MM-dd-HH-mm")).withColumn("iap_revenue_d7", F.lit(1.0))
    stores.append_windows(df, root)
    stores.append_windows(df.drop("iap_revenue_d7"), test)
    windows = scan.Windows("2025-10-01-00-00", "2025-10-01-23-00", "2025-10-02-00-00", "2025-10-02-23-00", "2025-10-03-00-00", "2025-10-03-23-00")
    loader = scan.Loader(spark, root, test, windows)
    assert loader.load_test().count() == 24 and loader.load_labelled("2025-10-02-00-00", "2025-10-02-05-00").count() == 6
    assert scan.Loader(spark, root, root, windows).load_labelled("", "").count() == 24
    calls = []

    def build(part):
        calls.append(part.count())
        return part.select("id", "datetime")

    got = pipelines.progressive_features(spark.read.parquet(root), build, str(tmp_path / "f"), ("2025-10-01-00-00", "2025-10-03-11-00"), 1)
    assert calls == [24, 24, 12] and got.count() == 60


def test_settings_and_arguments(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"train_path": "t", "boosting": {"trees": 3}}')
    assert pipelines.Settings.read(spark, str(path)).boosting == {"trees": 3}
    path.write_text('{"other": 1}')
    with pytest.raises(ValueError):
        pipelines.Settings.read(spark, str(path))
    a = train.arguments(["in", "out", "--full", "--batch-days", "2", "--eval-test"])
    assert (a.mode, a.batch_days, a.eval_test, a.days) == ("full", 2, True, None)


def test_revenue_windows(spark, small, tmp_path):
    df = impressions(spark, small).select("ts", "country", "buyer_d7", "iap_revenue_d7")
    df.write.parquet(str(tmp_path / "in"))
    stream = online.read_files(spark, str(tmp_path / "in"), df.schema)
    online.append_available(online.revenue_windows(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
