"""Runs from scan to report on the small tables."""

from sparkloom.operators.model import Boosting
from sparkloom.plans import pipelines
from sparkloom.plans.fixture import with_history


def test_runs(spark, small, tmp_path):
    path = str(tmp_path / "impressions")
    with_history(spark, small).write.parquet(path)
    train, val = pipelines.split(spark.read.parquet(path), ("2024-01-01", "2024-01-20"), ("2024-01-21", "2024-02-01"))
    fitted, teacher = pipelines.teacher_run(train, val, str(tmp_path), Boosting(2, 2))
    _, _, student = pipelines.student_run(train, val, str(tmp_path), Boosting(2, 2))
    metrics = {(r["model"], r["metric"]): r["value"] for r in teacher.unionByName(student).collect()}
    assert {m for m, _ in metrics} == {"teacher", "student"} and 0 <= metrics["student", "rank_auc_roc"] <= 1
    assert pipelines.score_run(val, fitted, str(tmp_path / "csv"))["rows"] == val.count()
    assert pipelines.Predictor(fitted).predict_file(spark, path).where("gated < 0").count() == 0
    _, simple = pipelines.simple_run(train, val, Boosting(2, 2))
    assert simple.where("metric = 'gated_msle'").count() == 1
