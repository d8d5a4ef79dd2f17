"""Two-stage models: buyer probability and log revenue, teachers and distilled students."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import compiled, evaluate, sampling, stats


@dataclass
class TwoStage:
    """Fitted buyer and revenue models over the same features."""

    buyer: PipelineModel
    revenue: PipelineModel
    features: list[str]
    probability: bool = True  # the buyer model is a classifier (else it predicts p itself)

    def score(self, df: DataFrame) -> DataFrame:
        """`df` with p_buyer, log_rev, the gated and the soft prediction; a projection, row by row."""
        out = self.buyer.transform(df.na.fill(0.0, subset=self.features))
        p = vector_to_array("probability")[1] if self.probability else F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))
        out = self.revenue.transform(out.withColumn("p_buyer", p).drop("_features", "rawPrediction", "probability", "prediction"))
        out = out.withColumn("log_rev", F.greatest("prediction", F.lit(0.0))).drop("_features", "prediction")
        return out.withColumns({"gated": evaluate.gate("p_buyer", "log_rev"), "soft": evaluate.product("p_buyer", "log_rev")})

    def compiled(self) -> compiled.Scorer:
        """The same models as column expressions."""
        buyer = compiled.ensemble(self.buyer.stages[-1], self.features, self.probability)
        return compiled.Scorer(buyer, compiled.ensemble(self.revenue.stages[-1], self.features))

    def save(self, path: str) -> None:
        self.buyer.write().overwrite().save(f"{path}/buyer")
        self.revenue.write().overwrite().save(f"{path}/revenue")

    def importances(self) -> list[tuple[str, float]]:
        """Features of the revenue model by importance."""
        values = self.revenue.stages[-1].featureImportances.toArray().tolist()
        return sorted(zip(self.features, values), key=lambda x: (-x[1], x[0]))


def load(path: str, features: list[str], probability: bool = True) -> TwoStage:
    return TwoStage(PipelineModel.load(f"{path}/buyer"), PipelineModel.load(f"{path}/revenue"), features, probability)


@dataclass(frozen=True)
class Boosting:
    """How trees are boosted: their number and depth, the learning rate, the share of rows of each, and whether validation rows stop it."""

    trees: int = 20
    depth: int = 5
    rate: float = 0.1
    subsample: float = 1.0
    tolerance: float = 0.01
    seed: int = 42

    def of(self, learner, **columns):
        return learner(maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, subsamplingRate=self.subsample, validationTol=self.tolerance, seed=self.seed, featuresCol="_features", **columns)


def _fitted(df: DataFrame, features: list[str], learner, boosting: Boosting, validation: DataFrame | None = None, **columns) -> PipelineModel:
    """Model of the rows of `df`; rows of `validation` only tell when to stop."""
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")
    if validation is not None:
        df = df.withColumn("_stop", F.lit(False)).unionByName(validation.withColumn("_stop", F.lit(True)), allowMissingColumns=True)
        columns["validationIndicatorCol"] = "_stop"
    return PipelineModel([assembler, boosting.of(learner, **columns).fit(assembler.transform(df))])


def fit_teachers(df: DataFrame, features: list[str], boosting: Boosting = Boosting(), validation: DataFrame | None = None, key: str = "row_id", bins: list[float] = sampling.BINS, weights: list[float] = sampling.WEIGHTS) -> TwoStage:
    """Class-weighted classifier, and a regressor of log revenue on the bin-weighted sample.

    With validation rows, boosting stops where they no longer gain.
    """
    base = stats.with_targets(df).na.fill(0.0, subset=features)
    check = stats.with_targets(validation).na.fill(0.0, subset=features) if validation is not None else None
    counts = {r[0]: r[1] for r in base.groupBy("buyer_d7").count().collect()}
    total = sum(counts.values())
    weight = F.element_at(F.create_map(*(x for c, n in counts.items() for x in (F.lit(c), F.lit(total / (2.0 * n))))), F.col("buyer_d7"))
    weighted = lambda x: x.withColumn("_weight", F.coalesce(weight, F.lit(1.0)))
    buyer = _fitted(weighted(base), features, GBTClassifier, boosting, weighted(check) if check is not None else None, labelCol="buyer_d7", weightCol="_weight")
    drawn = sampling.bin_sample(base, key, "iap_revenue_d7", bins, weights, boosting.seed)
    revenue = _fitted(drawn, features, GBTRegressor, boosting, check, labelCol="log_rev_d7")
    return TwoStage(buyer, revenue, features)


def soft_labels(teachers: TwoStage, df: DataFrame) -> DataFrame:
    scored = teachers.score(stats.with_targets(df))
    return scored.select("row_id", "p_buyer", "log_rev", F.col("buyer_d7").cast("double").alias("y_buyer"), F.col("log_rev_d7").alias("y_log_rev"))


def fit_students(df: DataFrame, labels: DataFrame, features: list[str], boosting: Boosting = Boosting(10, 4), alpha: float = 0.8, validation: tuple[DataFrame, DataFrame] | None = None) -> TwoStage:
    """Two small regressors of the blend of teacher outputs and truth, joined by row_id.

    With validation rows and their soft labels, boosting stops where the blend
    of those is no longer met better.
    """

    def blended(rows: DataFrame, own: DataFrame) -> DataFrame:
        out = rows.drop(*(c for c in own.columns if c != "row_id")).join(own, "row_id").na.fill(0.0, subset=features)
        return out.withColumns({"_p": evaluate.blend("p_buyer", "y_buyer", alpha), "_r": evaluate.blend("log_rev", "y_log_rev", alpha)}).select(*features, "_p", "_r")

    own = blended(df, labels)
    check = blended(*validation) if validation is not None else None
    buyer, revenue = (_fitted(own, features, GBTRegressor, boosting, check, labelCol=label) for label in ("_p", "_r"))
    return TwoStage(buyer, revenue, features, probability=False)


def kept_model(folder: str, key: str, features: list[str], fit, rebuild: bool = False, probability: bool = True) -> TwoStage:
    """The models stored under `key`, which names windows, features and settings; fitted and stored if they are not there."""
    path = f"{folder}/{key}"
    if not rebuild and _exists(f"{path}/revenue/metadata"):
        return load(path, features, probability)
    models = fit()
    models.save(path)
    return models


def _exists(path: str) -> bool:
    """Whether a path of any store that Spark reads is there."""
    try:
        SparkSession.active().read.text(path)
        return True
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
