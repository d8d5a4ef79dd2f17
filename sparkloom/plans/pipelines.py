"""Runs from scan to report: teachers, students, the simple and research variants, and scoring."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.scalar import date_batches
from sparkloom.operators import encoding, evaluate, features, model, stats
from sparkloom.operators.model import Boosting
from sparkloom.operators.settled import settled, settled_by
from sparkloom.sources import manifest, scan, stores
from sparkloom.sources.scratch import once
from sparkloom.streaming import progressive

TARGETS = ["iap_revenue_d7", "buyer_d7"]
#: Columns that say or follow from the targets: never features.
LEAKS = {*TARGETS, "log_rev_d7", "is_whale"}


@dataclass(frozen=True)
class Settings:
    """What a run needs to know; read from a JSON text, or YAML where that is installed."""

    train_path: str = ""
    test_path: str | None = None
    windows: dict[str, str] = field(default_factory=dict)
    folder: str = "models"
    boosting: dict[str, float] = field(default_factory=dict)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Settings:
        """Settings from a file in any store that Spark reads; unknown names are refused."""
        text = spark.read.text(path, wholetext=True).first()[0]
        if path.endswith((".yaml", ".yml")):
            import yaml

            found = yaml.safe_load(text)
        else:
            found = json.loads(text)
        known = {f.name for f in fields(cls)}
        if unknown := set(found) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**found)


@dataclass
class Fitted:
    """What a teacher run leaves for students and scoring."""

    tables: dict[str, DataFrame]
    encoders: DataFrame
    names: list[str]
    teachers: model.TwoStage


def _numeric(df: DataFrame) -> list[str]:
    return [c for c in stats.numeric_columns(df) if c != "row_id" and c not in LEAKS]


def _with_targets(built: DataFrame, raw: DataFrame) -> DataFrame:
    """Features and targets of the same rows, by row_id."""
    own = stats.with_targets(raw.select("row_id", "iap_revenue_d7"))
    return built.join(own, "row_id")


def progressive_features(df: DataFrame, build, path: str, window: tuple[str, str], days: int, progress=None) -> DataFrame:
    """Features of a window (both ends in it), built and stored a batch of days at a time.

    `build` gets a batch of rows and returns their features with datetime;
    partitions of a batch that is built again are replaced.  A batch goes up to
    the next one's start, whatever minutes the rows have; the counts of rows
    are compared at the end.  `progress` hears each batch's window.
    """
    starts = [start for start, _ in date_batches(*window, days)]
    for start, end in zip(starts, [*starts[1:], None]):
        part = scan.window(df, start, end, closed=False) if end is not None else scan.window(df, start, window[1])
        stores.append_windows(build(part), path)
        if progress is not None:
            progress(start, end or window[1])
    out = scan.window(df.sparkSession.read.schema(df.sparkSession.read.parquet(path).schema).parquet(path), *window)
    wanted, got = scan.window(df, *window).count(), out.count()
    if wanted != got:
        raise ValueError(f"{got} rows were written of {wanted}")
    return out


def _features(store: manifest.Store, name: str, df: DataFrame, build, made_of: dict, rebuild: bool, batch_days: int | None, source: str | None, batch_files: int, progress) -> DataFrame:
    """The stored features of a window: in one go, some days at a time, or by a stream over the files of `source`."""
    first, last = df.agg(F.min("datetime"), F.max("datetime")).first() if "datetime" in df.columns else (None, None)
    if first is not None and source is not None:
        load = lambda path: progressive.load(df.sparkSession, source, path, build, (first, last), batch_files, progress).sparkSession
        # Under a fixed name a load that was killed goes on; to build anew takes another.
        return store.filled(name, made_of, load, rebuild, data=None if rebuild else "stream", rows="rows").drop("batch")
    if first is not None and batch_days:
        return store.filled(name, made_of, lambda path: progressive_features(df, build, path, (first, last), batch_days, progress), rebuild)
    return store.table(name, made_of, lambda: build(df), rebuild)


def teacher_run(train: DataFrame, val: DataFrame, folder: str, boosting: Boosting = Boosting(), rich: bool = False, rebuild: bool = False, stop_early: bool = True, batch_days: int | None = None, source: str | None = None, batch_files: int = 64, progress=None) -> tuple[Fitted, DataFrame]:
    """Lookup tables and encoders of the training window, offline features, teachers; features, models and soft labels are stored.

    Everything lies under an address of all it was made of (manifest.Store):
    features of either window follow from that window, its columns and the
    tables and encoders of the training window; models from the features of
    both windows and their settings.  Features are built once and read again
    by every later step.  Returns what was fitted and the (model, metric,
    value) report on the validation window.
    """
    spark = train.sparkSession
    store = manifest.Store(spark, folder)
    seen = {"window": manifest.window_of(train)}
    tables = stats.lookup_tables(train)
    encoders = encoding.fit_encoders(train, features.CATEGORICAL)
    fitted_on = seen | {"tables": manifest.digest(manifest.all_of(tables, "table")), "encoders": manifest.digest(encoders), "rich": rich}
    store.table("lookups", fitted_on, lambda: manifest.all_of(tables, "table"), rebuild)
    store.table("encoders", fitted_on, lambda: encoders, rebuild)
    build = lambda df: _with_targets(features.offline(df, tables, encoders, rich=rich)[0], df)
    made_of = {n: {"of": manifest.window_of(df), "fitted_on": fitted_on} for n, df in (("train", train), ("val", val))}
    own, check = (_features(store, "features", df, build, made_of[n], rebuild, batch_days, source, batch_files, progress) for n, df in (("train", train), ("val", val)))
    names = _numeric(own)
    settings = made_of | {"boosting": asdict(boosting), "names": names, "stop_early": stop_early}
    fit = lambda: model.fit_teachers(own, names, boosting, check if stop_early else None)
    teachers = store.model("teachers", settings, fit, lambda path: model.load(path, names), rebuild)
    for n, df in (("train", own), ("val", check)):
        store.table("soft_labels", settings | {"of": n}, lambda df=df: model.soft_labels(teachers, df).select(*stores.SOFT_LABELS), rebuild)
    store.record("teachers", lookups=store.address("lookups", fitted_on), encoders=store.address("encoders", fitted_on), soft_labels={n: store.address("soft_labels", settings | {"of": n}) for n in made_of}, made_of=settings)
    return Fitted(tables, encoders, names, teachers), report(teachers, check, "teacher")


def _recorded(store: manifest.Store) -> tuple[dict, dict[str, DataFrame], DataFrame]:
    """The last teacher run's record, lookup tables and encoders."""
    run = store.recorded("teachers")
    tables = settled_by(store.read(run["lookups"]), "table", list(stores.LOOKUPS))
    return run, tables, settled(store.read(run["encoders"]))


def report(models: model.TwoStage, df: DataFrame, name: str) -> DataFrame:
    """(model, metric, value): classifier and ranking metrics of the probability, regression metrics of the gated and soft revenue."""
    scored = models.score(stats.with_targets(df))
    ranks = [("rank", rank(scored, "buyer_d7", "p_buyer")) for rank in (evaluate.auc_roc, evaluate.average_precision)]
    parts = [("cls", evaluate.classifier_report(scored, "buyer_d7", "p_buyer")), *ranks, *((c, evaluate.regressor_report(scored, "iap_revenue_d7", c)) for c in ("gated", "soft"))]
    long = evaluate.compared(parts)
    return long.select(F.lit(name).alias("model"), F.concat_ws("_", "model", "metric").alias("metric"), "value")


def student_run(train: DataFrame, val: DataFrame, folder: str, boosting: Boosting = Boosting(10, 4), alpha: float = 0.8, rebuild: bool = False) -> tuple[model.TwoStage, list[str], DataFrame]:
    """Small models of the online features on blended labels, with tables, encoders and soft labels of the folder's last teacher run.

    Boosting stops where the validation window's blended labels are no longer
    met better.  The students lie under an address of the teachers and settings.
    """
    store = manifest.Store(train.sparkSession, folder)
    run, tables, encoders = _recorded(store)
    own, check = (features.online(df, tables, encoders, fit=False)[0] for df in (train, val))
    names = _numeric(own)
    soft = {n: store.read(address) for n, address in run["soft_labels"].items()}
    made_of = {"teachers": run["made_of"], "train": manifest.window_of(train), "val": manifest.window_of(val), "boosting": asdict(boosting), "alpha": alpha, "names": names}
    fit = lambda: model.fit_students(own, soft["train"], names, boosting, alpha, (check, soft["val"]))
    students = store.model("students", made_of, fit, lambda path: model.load(path, names, probability=False), rebuild)
    store.record("students", students=store.address("students", made_of), names=names, teachers=run)
    return students, names, report(students, _with_targets(check, val), "student")


def simple_run(train: DataFrame, val: DataFrame, boosting: Boosting = Boosting(10, 4), test: DataFrame | None = None) -> tuple[model.TwoStage, DataFrame]:
    """The variant without nested columns: numeric and label-encoded features that both windows have; `test` is reported on too."""
    cats = features.SIMPLE_CATEGORICAL
    encoders = encoding.fit_encoders(train, cats)
    build = lambda df: encoding.apply_encoders(df.select("row_id", *TARGETS, *(c for c in _numeric(df)), *(c for c in cats if c in df.columns)), encoders, cats)
    own, check = build(train), build(val)
    names = sorted(set(_numeric(own)) & set(_numeric(check)))
    teachers = model.fit_teachers(own, names, boosting, check)
    out = report(teachers, check, "simple")
    return teachers, out if test is None else out.unionByName(report(teachers, build(test), "simple_test"))


RESEARCH_CATEGORICAL = ["advertiser_category", "country", "dev_os"]


def research_features(train: DataFrame, others: list[DataFrame], weight: float = 1.0) -> tuple[DataFrame, list[DataFrame]]:
    """Research features of the training rows and of other rows, categories as ordered target statistics.

    Each category becomes two numbers, the share of buyers (`_ts`) and the mean
    log revenue (`_rev_ts`).  A training row's come from rows before it in a
    random order, so its own target is in none; other rows' from all of them.
    """
    cats = RESEARCH_CATEGORICAL
    known = stats.with_targets(stats.filled(train, dict.fromkeys(cats, "UNK")))
    prior = known.agg(F.avg("buyer_d7").alias("buyer_d7"), F.avg("log_rev_d7").alias("log_rev_d7")).first().asDict()
    own, rest = stats.with_targets(features.research(train, train)), [stats.with_targets(features.research(df, train)) for df in others]
    for target, suffix in (("buyer_d7", "_ts"), ("log_rev_d7", "_rev_ts")):
        start = prior[target] or 0.0
        table = encoding.target_statistics(known, cats, target, start, weight)
        own = encoding.ordered_statistics(own, cats, target, "row_id", start, weight, suffix=suffix)
        rest = [encoding.apply_statistics(df, table, cats, start, suffix) for df in rest]
    return own, rest


def _numbers(names: list[str], df: DataFrame) -> list[str]:
    """A feature list with the categories' statistics in their place, as far as the table has them as numbers."""
    wide = [x for c in dict.fromkeys(names) for x in ([f"{c}_ts", f"{c}_rev_ts"] if c in RESEARCH_CATEGORICAL else [c])]
    numeric = set(stats.numeric_columns(df)) - LEAKS
    return [c for c in wide if c in numeric]


def research_run(train: DataFrame, val: DataFrame, boosting: Boosting = Boosting(10, 4), students: Boosting = Boosting(8, 3), alpha: float = 0.8, test: DataFrame | None = None) -> tuple[model.TwoStage, model.TwoStage, DataFrame]:
    """Teachers and students on the research feature lists, categories by ordered target statistics, all stopped by the validation window; `test` is reported on too."""
    own, rest = research_features(train, [val, *([test] if test is not None else [])])
    own, check, *more = (once(df.drop(*stats.nested_columns(df))) for df in (own, *rest))
    names = _numbers(features.RESEARCH_TEACHER + features.RESEARCH_REGRESSOR, own)
    teachers = model.fit_teachers(own, names, boosting, check)
    small = _numbers(features.RESEARCH_STUDENT, own)
    soft = [once(model.soft_labels(teachers, df)) for df in (own, check)]
    fitted = model.fit_students(own, soft[0], small, students, alpha, (check, soft[1]))
    reports = [report(m, df, f"{n}{where}") for df, where in ((check, ""), *((df, "_test") for df in more)) for n, m in (("research", teachers), ("research_student", fitted))]
    return teachers, fitted, stats.union_all(*reports)


def score_run(test: DataFrame, fitted: Fitted, path: str, combine: str = "gated") -> dict[str, int]:
    """Scan, features, models, gate and submission, streaming through partitions; returns the checked counts."""
    built = features.offline(test, fitted.tables, fitted.encoders)[0]
    scored = fitted.teachers.compiled().score(built)
    return stores.write_submission(scored.select("row_id", F.col(combine).alias("iap_revenue_d7")), path)


def student_submission(test: DataFrame, folder: str, path: str, combine: str = "gated") -> dict[str, int]:
    """The submission of the folder's last students, from online features by the tables and encoders of their teachers' run."""
    store = manifest.Store(test.sparkSession, folder)
    run = store.recorded("students")
    _, tables, encoders = _recorded(store)
    address = run["students"]
    students = model.load(f"{folder}/{address}/{store.manifest(address)['data']}", run["names"], probability=False)
    built = features.online(test, tables, encoders, fit=False)[0]
    scored = students.compiled().score(built)
    return stores.write_submission(scored.select("row_id", F.col(combine).alias("iap_revenue_d7")), path)


class Predictor:
    """Scores tables or files with fitted models, compiled once to column expressions."""

    def __init__(self, fitted: Fitted):
        self.fitted, self.scorer = fitted, fitted.teachers.compiled()

    def predict(self, df: DataFrame) -> DataFrame:
        return self.scorer.score(features.offline(df, self.fitted.tables, self.fitted.encoders)[0]).select("row_id", "p_buyer", "log_rev", "gated", "soft")

    def predict_file(self, spark: SparkSession, path: str) -> DataFrame:
        return self.predict(spark.read.parquet(path))


def split(df: DataFrame, train: tuple[str, str], val: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    scan.Windows(*train, *val)  # the windows must be apart
    return scan.window(df, *train), scan.window(df, *val)
