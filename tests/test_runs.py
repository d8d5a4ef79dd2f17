"""Stored runs, progressive loads, compiled models, ordered statistics and ranges."""

import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import compiled, encoding, features, model, ranks, stats
from sparkloom.operators.model import Boosting
from sparkloom.plans import pipelines, train
from sparkloom.plans.fixture import impressions, with_history
from sparkloom.sources import manifest, scan
from sparkloom.streaming import progressive

WINDOWS = ("2024-01-01", "2024-01-20"), ("2024-01-21", "2024-02-01")


@pytest.fixture(scope="module")
def source(spark, small, tmp_path_factory):
    """Impressions with some nested columns, at a full hour or 37 minutes past one, two times a day."""
    path = str(tmp_path_factory.mktemp("source") / "impressions")
    at = F.concat(F.substring("datetime", 1, 10), F.when(F.col("row_id") % 2 == 0, "-00-00").otherwise("-13-37"))
    few = ["bundles_ins", "num_buys_bundle", "country_hist"]
    with_history(spark, small).select(*impressions(spark, small).columns, *few).withColumn("datetime", at).repartition(1).write.parquet(path)
    return path


def rows(df, *columns):
    return sorted(map(str, df.select(*(columns or sorted(df.columns))).collect()))


def test_two_training_windows_in_one_folder(spark, source, tmp_path, monkeypatch):
    """The validation window's features follow from the training window, and so do the models."""
    stub = model.fit_teachers
    monkeypatch.setattr(model, "fit_teachers", lambda own, names, *more: stub(own, names, Boosting(1, 1)))
    seen = []
    monkeypatch.setattr(pipelines, "report", lambda models, df, name: seen.append(df))
    df = spark.read.parquet(source)
    val = scan.window(df, *WINDOWS[1])
    first, second = scan.window(df, "2024-01-01", "2024-01-10"), scan.window(df, "2024-01-05", "2024-01-20")
    for own, folder in ((first, "a"), (second, "a"), (second, "b")):
        pipelines.teacher_run(own, val, str(tmp_path / folder), Boosting(1, 1))
    built = [rows(x, "row_id", "country_avg_rev_d7") for x in seen]
    assert built[1] == built[2] != built[0]
    kinds = [p.name.split("-")[0] for p in (tmp_path / "a").iterdir()]
    assert kinds.count("teachers") == 2 and kinds.count("features") == 4


def test_what_has_no_manifest_is_made_again(spark, tmp_path):
    store = manifest.Store(spark, str(tmp_path))
    calls = []

    def build():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("killed")
        return spark.range(len(calls))

    with pytest.raises(RuntimeError):
        store.table("t", {"a": 1}, build)
    assert store.table("t", {"a": 1}, build).count() == 2 and store.table("t", {"a": 1}, build).count() == 2
    held = store.table("t", {"a": 1}, build)
    assert store.table("t", {"a": 1}, build, rebuild=True).count() == 3 and held.count() == 2
    assert store.table("t", {"a": 2}, build).count() == 4 and len(calls) == 4
    assert store.address("t", {"a": 1}) != store.address("u", {"a": 1}) == store.address("u", {"a": 1})
    with pytest.raises(ValueError):
        store.recorded("x")
    (tmp_path / "u" / "manifest").mkdir(parents=True)  # begun, never finished
    assert store.manifest("u") is None


def test_digest_of_rows(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}), (2, None), (2, None)], "k int, m map<string,int>")
    same = df.repartition(3).select("m", "k")
    assert manifest.digest(df) == manifest.digest(same) != manifest.digest(df.limit(2))
    assert len({manifest.digest(x) for x in (df, df.dropDuplicates(["k"]), df.withColumn("k", F.col("k") + 1), df.withColumnRenamed("k", "l"), df.limit(0))}) == 5


def test_batches_lose_no_minutes(spark, source, tmp_path):
    df = spark.read.parquet(source).select("row_id", "datetime")
    first, last = df.agg(F.min("datetime"), F.max("datetime")).first()
    assert df.where("datetime not like '%-00'").count() > 0
    heard = []
    out = pipelines.progressive_features(df, lambda x: x, str(tmp_path / "f"), (first, last), 2, lambda *x: heard.append(x))
    assert rows(out, "row_id", "datetime") == rows(df, "row_id", "datetime") and heard[0][0] == first and heard[-1][1] == last
    with pytest.raises(ValueError):
        pipelines.progressive_features(df, lambda x: x.limit(1), str(tmp_path / "g"), (first, last), 9)


def test_killed_load_goes_on(spark, source, tmp_path):
    """Every row once, though the load stopped in the middle of a batch; files that come later are taken up."""
    root = str(tmp_path / "in")
    df = spark.read.parquet(source).select("row_id", "datetime", "country")
    df.repartitionByRange(6, "datetime").sortWithinPartitions("datetime").write.parquet(root)
    calls, heard = [], []

    def build(batch):
        calls.append(batch.count())
        if len(calls) == 3:
            raise RuntimeError("killed")
        return batch.withColumn("x", F.upper("country"))

    with pytest.raises(Exception, match="killed"):
        progressive.load(spark, root, str(tmp_path / "out"), build, files=1)
    out = progressive.load(spark, root, str(tmp_path / "out"), build, files=1, progress=lambda *x: heard.append(x))
    assert rows(out, "row_id", "datetime") == rows(df, "row_id", "datetime") and "batch" not in out.columns
    assert len(calls) == 7 and [n for n, _ in heard] == [2, 3, 4, 5] and sum(n for _, n in heard) < df.count()
    df.limit(5).write.mode("append").parquet(root)
    assert progressive.load(spark, root, str(tmp_path / "out"), build, files=9).count() == df.count() + 5
    part = progressive.load(spark, root, str(tmp_path / "part"), lambda x: x, window=("2024-01-05", "2024-01-20"))
    assert part.count() == scan.window(spark.read.parquet(root), "2024-01-05", "2024-01-20").count() > 0
    with pytest.raises(ValueError):
        progressive.load(spark, root, str(tmp_path / "short"), lambda x: x.limit(1))


def test_teacher_run_by_stream_equals_one_go(spark, source, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(pipelines, "report", lambda models, df, name: seen.append(df))
    a, b = pipelines.split(spark.read.parquet(source), *WINDOWS)
    for folder, how in (("a", {}), ("b", {"source": source, "batch_files": 1})):
        pipelines.teacher_run(a, b, str(tmp_path / folder), Boosting(1, 1), **how)
    names = sorted(set(seen[0].columns) & set(seen[1].columns))
    assert len(names) > 20 and set(names) == set(seen[0].columns)
    assert rows(seen[0], *names) == rows(seen[1], *names)


@pytest.fixture(scope="module")
def fitted(spark, small):
    own = impressions(spark, small).withColumns({"h": F.col("hour").cast("double"), "u": F.when(F.col("user_id") % 7 > 0, F.col("user_id")), "odd name": F.length("advertiser_category")})
    own = own.select("row_id", "h", "u", "odd name", "iap_revenue_d7", "buyer_d7")
    return own, model.fit_teachers(own, ["h", "u", "odd name"], Boosting(4, 3, rate=0.3))


def close(a, b):
    a, b = ({r["row_id"]: r for r in x} for x in (a, b))
    assert a.keys() == b.keys() and len(a) > 0
    for k, row in a.items():
        for c in ("p_buyer", "log_rev", "gated", "soft"):
            assert row[c] == pytest.approx(b[k][c], abs=1e-9, rel=1e-9)


def test_compiled_models_score_the_same(spark, fitted, tmp_path):
    df, teachers = fitted
    odd = df.where("row_id in (1, 5, 9)").withColumns({"h": F.lit(float("nan")), "u": F.lit(None).cast("long"), "row_id": F.col("row_id") + 10_000_000})
    every = df.unionByName(odd)
    scorer = teachers.compiled()
    columns = ["row_id", "p_buyer", "log_rev", "gated", "soft"]
    want = teachers.score(every).select(columns).collect()
    close(want, scorer.score(every).select(columns).collect())
    scorer.save(spark, str(tmp_path / "m"))
    again = compiled.Scorer.load(spark, str(tmp_path / "m"))
    assert again == scorer and again.sql("t") == scorer.sql("t") and scorer.features()
    every.na.fill(0.0).createOrReplaceTempView("scored_rows")
    close(want, spark.sql(scorer.sql("scored_rows").replace('"', "`")).collect())
    every.na.fill(0.0).write.parquet(str(tmp_path / "rows"))
    answer = duckdb.sql(scorer.sql(f"'{tmp_path}/rows/*.parquet'"))
    close(want, [dict(zip(answer.columns, r)) for r in answer.fetchall()])


def test_compiled_students_and_plan(spark, fitted):
    df, teachers = fitted
    soft = model.soft_labels(teachers, df)
    half = df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1")
    students = model.fit_students(half[0], soft, ["h", "odd name"], Boosting(30, 2, tolerance=0.5), validation=(half[1], soft))
    assert students.buyer.stages[-1].getNumTrees < 30 or students.revenue.stages[-1].getNumTrees < 30  # stopped
    scorer = students.compiled()
    close(students.score(df).collect(), scorer.score(df).collect())
    plan = scorer.score(df).select("gated")._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "WholeStageCodegen" in spark._jvm.PythonSQLUtils.explainString(scorer.score(df).select("gated")._jdf.queryExecution(), "codegen")
    assert compiled.Ensemble([], []).features() == [] and compiled.Ensemble([compiled.Node(value=2.0)], [0.5]).sql() == "(0e0 + 0.5e0 * 2.0e0)"


def test_codes_in_compiled_trees(spark):
    tree = compiled.Node(feature="c", codes=[0.0, 2.0], left=compiled.Node(value=1.0), right=compiled.Node(value=-1.0))
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "c int")
    got = [r[0] for r in df.select(compiled.Ensemble([tree], [3.0]).column()).collect()]
    assert got == [3.0, -3.0, 3.0, -3.0]
    duck = duckdb.sql(f"SELECT {compiled.Ensemble([tree], [3.0]).sql()} FROM (VALUES (0), (1), (2), (NULL)) t(c)").fetchall()
    assert [r[0] for r in duck] == got


def test_no_row_sees_its_own_target(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice("xy"), rng.choice([0, 1, 1, None])) for i in range(200)] + [(200, "once", "x", 1)]
    df = spark.createDataFrame(data, "row_id long, c string, d string, y int")
    got = {r["row_id"]: r for r in encoding.ordered_statistics(df, ["c", "d"], "y", "row_id", 0.25, 3.0).collect()}
    place = {i: hashlib.md5(f"42:{i}".encode()).hexdigest() for i, *_ in data}
    for k, name in ((1, "c"), (2, "d")):
        for row in data:
            earlier = [x[3] for x in data if x[k] == row[k] and place[x[0]] < place[row[0]] and x[3] is not None]
            assert got[row[0]][f"{name}_ts"] == pytest.approx((sum(earlier) + 0.75) / (len(earlier) + 3.0), abs=1e-12)
    assert got[200]["c_ts"] == 0.25 and len(got) == len(data)
    table = encoding.target_statistics(df, ["c", "d"], "y", 0.25, 3.0)
    new = spark.createDataFrame([(1, "a", "x"), (2, "new", None), (3, None, "y")], "row_id long, c string, d string")
    rest = {r["row_id"]: r for r in encoding.apply_statistics(new, table, ["c", "d"], 0.25).collect()}
    own = [x[3] for x in data if x[1] is None and x[3] is not None]
    assert rest[2]["c_ts"] == rest[2]["d_ts"] == 0.25 and rest[3]["c_ts"] == pytest.approx((sum(own) + 0.75) / (len(own) + 3.0))


@pytest.mark.parametrize("n", [2_000, 200_000])
def test_ranges_stay_bounded(spark, n):
    """A hundred times the rows, ranges of the same size; a value that a third of the rows have fills several."""
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 31 % n).alias("x"))
    sizes = [r["count"] for r in ranks.ranged(df, ["x"], 500).groupBy("_range").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 4 * 500
    edges = ranks.ranged(df, ["x"], 500).groupBy("_range").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("_range").collect()
    assert all(p["b"] <= q["a"] for p, q in zip(edges, edges[1:]))


def test_encoders_are_settled_each_on_its_own(spark, monkeypatch):
    from sparkloom.operators import settled

    monkeypatch.setattr(settled.settled, "__defaults__", (50,))
    monkeypatch.setattr(settled.settled_by, "__defaults__", (50,))
    df = spark.range(300).select("id", F.concat(F.lit("u"), F.col("id")).alias("user"), (F.col("id") % 3).cast("string").alias("few"))
    out = encoding.apply_encoders(df, encoding.fit_encoders(df, ["user", "few"]), ["user", "few"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1
    assert sorted(r["user"] for r in out.collect()) == list(range(300)) and {(r["id"] % 3, r["few"]) for r in out.collect()} == {(0, 0), (1, 1), (2, 2)}


def test_state_gives_the_tables_of_any_window(spark, source, tmp_path):
    from sparkloom.sources import stores

    df = spark.read.parquet(source)
    path = str(tmp_path / "state")
    state = stats.hourly_state(df)
    stores.append_windows(state, path)
    stores.append_windows(state.where("datetime < '2024-01-03'"), path)  # hours that come again replace themselves
    stored = spark.read.parquet(path)
    for window in ((None, None), ("2024-01-05", "2024-01-06"), ("2024-01-05", "2024-01-20")):
        want, got = stats.lookup_tables(scan.window(df, *window)), stats.tables_of_state(stored, *window)
        for name in want:
            a, b = ({r["key"]: r for r in t.collect()} for t in (want[name], got[name]))
            assert a.keys() == b.keys()
            for k in a:
                assert tuple(b[k][c] for c in ("buyer_rate", "avg_rev_d7", "whale_rate", "count")) == pytest.approx(tuple(a[k][c] for c in ("buyer_rate", "avg_rev_d7", "whale_rate", "count")))
    plan = stats.window(stored, "2024-01-05", "2024-01-06")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(datetime" in plan


def test_research_run(spark, source):
    a, b = pipelines.split(spark.read.parquet(source), *WINDOWS)
    teachers, students, report = pipelines.research_run(a, b, Boosting(2, 2), Boosting(2, 2), test=b)
    assert {"country_ts", "country_rev_ts", "dev_os_ts"} <= set(teachers.features) and set(students.features) < set(teachers.features)
    assert not {"country", "dev_os", "iap_revenue_d7", "buyer_d7"} & set(teachers.features)
    values = {(r["model"], r["metric"]): r["value"] for r in report.collect()}
    assert {m for m, _ in values} == {"research", "research_student", "research_test", "research_student_test"}
    assert values["research", "rank_auc_roc"] == values["research_test", "rank_auc_roc"]


def test_command_line(spark, source, tmp_path, capsys):
    """Teachers, students and a submission; then the variants, reported on the test window."""
    root = str(tmp_path / "in")
    hour = F.date_format(F.timestamp_seconds(F.lit(1759276800) + F.pmod(F.col("row_id"), F.lit(11)) * 86400), "yyyy-MM-dd-HH-mm")
    spark.read.parquet(source).withColumn("datetime", hour).repartition("datetime").write.partitionBy("datetime").parquet(root)
    common = [root, str(tmp_path / "out"), "--days", "4", "--trees", "2", "--depth", "2"]
    train.main([*common, "--test-path", root, "--students", "--submission", str(tmp_path / "csv"), "--eval-test", "--batch-files", "3"])
    said = capsys.readouterr().out
    assert all(f"\n{x}\n" in said for x in ("teacher", "student", "test")) and "built 1" in said
    sent = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert sent.count() == scan.window(spark.read.parquet(root), "2025-10-08-00-00", "2025-10-11-23-00").count() and sent.columns == ["row_id", "iap_revenue_d7"]
    train.main([*common, "--simple", "--test-path", root, "--eval-test"])
    said = capsys.readouterr().out
    assert "simple\n" in said and "simple_test\n" in said
    with pytest.raises(SystemExit):
        train.main([*common, "--simple", "--students"])
    assert json.loads(compiled.Ensemble([compiled.Node(value=1.0)], [1.0]).text())["trees"] == [{"value": 1.0}]
    assert features.RESEARCH_LEAKS


def test_bucketed_tables_join_without_a_shuffle(spark, small, tmp_path):
    """Features, targets and soft labels by row_id; also where the session has yet to learn of the tables."""
    df = impressions(spark, small)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = manifest.Store(spark, str(tmp_path))
        builds = {"features": df.select("row_id", "hour", "country"), "targets": df.select("row_id", "iap_revenue_d7"), "soft": df.select("row_id", (F.col("hour") / 24).alias("p_buyer"))}
        for _ in range(2):
            a, b, c = (store.bucketed(n, {"of": n}, lambda own=own: own, buckets=4) for n, own in builds.items())
            joined = a.join(b, "row_id").join(c, "row_id")
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
            want = builds["features"].join(builds["targets"], "row_id").join(builds["soft"], "row_id")
            assert rows(joined) == rows(want)
            for t in spark.catalog.listTables():
                if t.name.startswith("bucketed_"):
                    spark.sql(f"DROP TABLE {t.name}")  # the data stay
        assert store.bucketed("soft", {"of": "soft"}, lambda: None, buckets=4).count() == df.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_arrow_batches_cross_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select("id", F.array("id").alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("s"))
    parts = list(scan.arrow_batches(df, 300))
    assert [len(t) for t in parts] == [300, 300, 300, 100]
    assert sorted(v for t in parts for v in t["id"].to_pylist()) == list(range(1000)) and parts[0]["a"].to_pylist()[3] == [parts[0]["id"].to_pylist()[3]]
    assert list(scan.arrow_batches(df.limit(0), 5)) == [] and [len(x) for x in scan.batches(df.where("id < 5"), 10)] == [5]


def test_correlations_of_odd_columns(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1.0, (400, 12))
    x[:, 1] = x[:, 0] + rng.normal(0, 0.1, 400)
    x[:, 2] = 5.0
    gone = rng.random(x.shape) < 0.2
    gone[:, 11] = True
    df = spark.createDataFrame([tuple(None if g else float(v) for v, g in zip(r, m)) for r, m in zip(x, gone)], ", ".join(f"`c {i}` double" for i in range(12)))
    got = {(r["a"], r["b"]): r["r"] for r in stats.correlations(df.repartition(5), df.columns).collect()}
    assert len(got) == 66
    for (a, b), r in got.items():
        i, j = int(a[2:]), int(b[2:])
        both = ~gone[:, i] & ~gone[:, j]
        constant = 2 in (i, j) or 11 in (i, j)
        want = None if constant else np.corrcoef(x[both, i], x[both, j])[0, 1]
        assert (r, want) == (None, None) if constant else r == pytest.approx(want, abs=1e-9)
    plan = stats.correlations(df, df.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 6000 and stats.correlations(df, df.columns[:1]).count() == 0


def test_sketches_of_hours_merge(spark, tmp_path):
    from sparkloom.operators import sketches

    df = spark.range(60_000).select(F.concat(F.lit("2024-01-0"), (F.col("id") % 4 + 1).cast("string")).alias("datetime"), (F.col("id") % 20_000).alias("u"), (F.col("id") * 7919 % 60_000).cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    stored = sketches.hourly(df, ["u"], ["x", "none"])
    for start, end in ((None, None), ("2024-01-02", "2024-01-03")):
        own = scan.window(df, start, end)
        exact = own.agg(F.count_distinct("u")).first()[0]
        assert sketches.distinct_counts(stored, start, end).first()["n"] == pytest.approx(exact, rel=0.04)
        values = sorted(r["x"] for r in own.select("x").collect())
        for r in sketches.quantiles(stored, [0.1, 0.5, 0.99], start, end).collect():
            assert r["column"] == "x" and abs(sum(v <= r["value"] for v in values) / len(values) - r["q"]) < 0.02
    assert sketches.distinct_counts(stored, "2030").first()["n"] == 0 and sketches.quantiles(stored, [0.5], "2030").count() == 0
