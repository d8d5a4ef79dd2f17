"""Exact metrics, the two-stage combinations, and distillation labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.nested import col
from sparkloom.operators.ranks import running


def gate(p: str | Column, log_revenue: str | Column, threshold: float = 0.5, strict: bool = False) -> Column:
    """Hard gate: revenue where the probability reaches (or, strictly, passes) the threshold, else 0."""
    open_ = col(p) > threshold if strict else col(p) >= threshold
    return F.when(open_, F.greatest(F.expm1(col(log_revenue)), F.lit(0.0))).otherwise(0.0)


def product(p: str | Column, log_revenue: str | Column) -> Column:
    """Soft combination: probability times revenue, not below 0."""
    return F.greatest(col(p) * F.expm1(col(log_revenue)), F.lit(0.0))


def stack(d1: str, d7: str, d14: str, p: str, weights: tuple[float, float, float] = (0.2, 0.6, 0.2)) -> list[Column]:
    """Weighted revenue of three horizons, and its product with the buyer probability."""
    revenue = sum((w * F.col(c) for w, c in zip(weights, (d1, d7, d14))), F.lit(0.0))
    return [revenue.alias("meta_revenue"), (F.col(p) * revenue).alias("buyer_x_revenue")]


def blend(teacher: str | Column, truth: str | Column, alpha: float = 0.8) -> Column:
    return alpha * col(teacher) + (1 - alpha) * col(truth)


def squared_log_error(y: str, p: str) -> Column:
    return F.pow(F.log1p(F.col(y)) - F.log1p(F.greatest(F.col(p), F.lit(0.0))), F.lit(2.0))


def regression_aggregates(y: str, p: str) -> dict[str, Column]:
    yy, pp = F.col(y), F.greatest(F.col(p), F.lit(0.0))
    return {
        "msle": F.avg(squared_log_error(y, p)),
        "rmsle": F.sqrt(F.avg(squared_log_error(y, p))),
        "rmse": F.sqrt(F.avg(F.pow(yy - F.col(p), F.lit(2.0)))),
        "rmse_log": F.sqrt(F.avg(squared_log_error(y, p))),
        "mae": F.avg(F.abs(yy - F.col(p))),
        "mae_log": F.avg(F.abs(F.log1p(yy) - F.log1p(pp))),
        "mean_true": F.avg(yy),
        "mean_pred": F.avg(pp),
        "zero_rate_true": F.avg((yy == 0).cast("int")),
        "zero_rate_pred": F.avg((pp == 0).cast("int")),
    }


def regressor_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row of metrics in one aggregate."""
    return df.agg(*(c.alias(n) for n, c in regression_aggregates(y, p).items()))


def confusion(y: str, p: str, threshold: float = 0.5) -> dict[str, Column]:
    said, true = F.col(p) >= threshold, F.col(y) == 1
    return {"tp": F.count_if(said & true), "fp": F.count_if(said & ~true), "fn": F.count_if(~said & true), "tn": F.count_if(~said & ~true)}


def rates() -> dict[str, Column]:
    """The counts tp, fp, fn and tn, and what follows from them."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn), "accuracy": F.try_divide(tp + tn, n), "pos_rate_true": F.try_divide(tp + fn, n), "pos_rate_pred": F.try_divide(tp + fp, n)}


def classifier_report(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """precision, recall, f1 (0 where undefined), accuracy and positive rates in one aggregate."""
    counts = df.agg(*(c.alias(n) for n, c in confusion(y, p, threshold).items()))
    return counts.select(*(c.alias(n) for n, c in rates().items()))


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    """Positives and rows of each distinct score, and of all scores from it upwards.

    Distinct scores are summed within drawn ranges, so no window holds all of
    them however they crowd.  Rows without a score or label are left out; NaN
    is above every number.
    """
    own = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).cast("double").alias("_s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    found = running(own, ["_s"], ["pos", "n"])
    return found.select("_s", "pos", "n", (F.col("pos_total") - F.col("pos_before")).alias("cum_pos"), (F.col("n_total") - F.col("n_before")).alias("cum_n"))


def auc_roc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Exact area under the ROC curve; equal scores count half; null without both classes."""
    s = _by_score(df, y, score)
    neg = F.col("n") - F.col("pos")
    # Each negative is below the positives of higher scores, and level with those of its own.
    wins = F.sum(neg.cast("double") * (F.col("cum_pos") - F.col("pos")) + neg * F.col("pos") * 0.5)
    return s.agg(wins.alias("w"), F.sum("pos").cast("double").alias("p"), F.sum(neg).cast("double").alias("q")).select(F.try_divide("w", F.col("p") * F.col("q")).alias("auc_roc"))


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    """Sum of precision times the step of recall over distinct scores; null without positives."""
    s = _by_score(df, y, score)
    area = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    return s.agg(area.alias("a"), F.sum("pos").alias("p")).select(F.try_divide("a", "p").alias("average_precision"))


def two_stage_report(df: DataFrame, buyer: str, p: str, revenue: str, log_revenue: str) -> DataFrame:
    """cls_ metrics of the probability, reg_ of the revenue alone, final_ of their product."""
    scored = df.withColumns({"_final": product(p, log_revenue), "_reg": F.greatest(F.expm1(F.col(log_revenue)), F.lit(0.0))})
    prefixed = lambda report, prefix: report.select(*(F.col(c).alias(f"{prefix}{c}") for c in report.columns))
    final, alone = ({f"{prefix}{n}": c for n, c in regression_aggregates(revenue, p).items()} for prefix, p in (("final_", "_final"), ("reg_", "_reg")))
    counts = scored.agg(*(c.alias(n) for n, c in (confusion(buyer, p) | final | alone).items()))
    return counts.select(*(c.alias(f"cls_{n}") for n, c in rates().items()), *final, *alone)


def compared(reports: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """(model, metric, value) of named one-row reports, as for a teacher and its student."""
    out = None
    for name, report in reports:
        long = report.select(F.lit(name).alias("model"), F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in report.columns))).alias("e")).select("model", "e.*")
        out = long if out is None else out.unionByName(long)
    return out


def lines_of(metrics: dict[str, float]) -> Iterable[str]:
    """Metrics as text, grouped by what stands before the first underscore."""
    group = None
    for name in sorted(metrics):
        head = name.split("_", 1)[0]
        if head != group:
            group = head
            yield f"[{head}]"
        yield f"  {name}: {metrics[name]:.6f}"
