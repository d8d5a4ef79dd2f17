"""Command line: python -m sparkloom.plans.train TRAIN_PATH FOLDER --mode subset|full [--days N] [--batch-days N] ..."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from sparkloom.functions.scalar import window_of_days
from sparkloom.operators import evaluate
from sparkloom.operators.model import Boosting
from sparkloom.plans import pipelines
from sparkloom.session import session
from sparkloom.sources import scan

#: Days of training that a mode stands for.
DAYS = {"subset": 1, "full": 5}


def arguments(words: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Teachers (or the simple variant) from an hourly table, with a report on the validation window")
    p.add_argument("train_path")
    p.add_argument("folder", help="where features, models and labels are kept")
    p.add_argument("--test-path")
    p.add_argument("--start", default="2025-10-01-00-00", help="first hour of training")
    p.add_argument("--mode", choices=[*DAYS], default="subset")
    p.add_argument("--subset", dest="mode", action="store_const", const="subset")
    p.add_argument("--full", dest="mode", action="store_const", const="full")
    p.add_argument("--days", type=int, help="days of training, 1 to 7; overrides the mode")
    p.add_argument("--val", nargs=2, metavar=("START", "END"), default=("2025-10-06-00-00", "2025-10-06-23-00"))
    p.add_argument("--batch-days", type=int, help="build features this many days at a time")
    p.add_argument("--batch-files", type=int, help="build features by a stream over this many files at a time, which a restart goes on with")
    p.add_argument("--students", action="store_true", help="fit the students too, on the teachers' soft labels")
    p.add_argument("--submission", help="write the submission of the test window here (of the students, if they are fitted)")
    p.add_argument("--research", action="store_true", help="the research variant, with its students")
    p.add_argument("--eval-test", action="store_true", help="report on the test window too")
    p.add_argument("--test", nargs=2, metavar=("START", "END"), default=("2025-10-08-00-00", "2025-10-11-23-00"))
    p.add_argument("--eval-fallback-start", help="window of the training table if the test table has no targets")
    p.add_argument("--eval-fallback-end")
    p.add_argument("--rebuild-cache", action="store_true")
    p.add_argument("--simple", action="store_true", help="the variant without nested columns")
    p.add_argument("--trees", type=int, default=20)
    p.add_argument("--depth", type=int, default=5)
    p.add_argument("--rate", type=float, default=0.1)
    return p.parse_args(words)


def main(words: Sequence[str] | None = None) -> None:
    a = arguments(words)
    train = window_of_days(a.days or DAYS[a.mode], a.start)
    windows = scan.Windows(*train, *a.val, *a.test)
    loader = scan.Loader(session("train"), a.train_path, a.test_path, windows)
    own, val = loader.load_train()
    boosting = Boosting(a.trees, a.depth, a.rate)
    if a.simple or a.research:
        if a.submission or a.students:
            raise SystemExit("--submission and --students go with the teachers")
        test = loader.load_labelled(a.eval_fallback_start or a.val[0], a.eval_fallback_end or a.val[1]) if a.eval_test else None
        report = (pipelines.simple_run if a.simple else pipelines.research_run)(own, val, boosting, test=test)[-1]
    else:
        source = a.train_path if a.batch_files else None
        said = lambda *x: print("built", *x, flush=True)
        fitted, report = pipelines.teacher_run(own, val, a.folder, boosting, rebuild=a.rebuild_cache, batch_days=a.batch_days, source=source, batch_files=a.batch_files or 64, progress=said)
        if a.students:
            report = report.unionByName(pipelines.student_run(own, val, a.folder, rebuild=a.rebuild_cache)[-1])
        if a.eval_test:
            labelled = loader.load_labelled(a.eval_fallback_start or a.val[0], a.eval_fallback_end or a.val[1])
            built = pipelines.features.offline(labelled, fitted.tables, fitted.encoders)[0]
            report = report.unionByName(pipelines.report(fitted.teachers, pipelines._with_targets(built, labelled), "test"))
        if a.submission:
            test = loader.load_test()
            print("rows", (pipelines.student_submission(test, a.folder, a.submission) if a.students else pipelines.score_run(test, fitted, a.submission))["rows"])
    for name, rows in _by_model(report.collect()).items():
        print(name, *evaluate.lines_of(rows), sep="\n")


def _by_model(rows) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for r in rows:
        if r["value"] is not None:
            out.setdefault(r["model"], {})[r["metric"]] = r["value"]
    return out


if __name__ == "__main__":
    main()
