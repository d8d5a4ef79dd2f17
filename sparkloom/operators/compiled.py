"""Fitted trees as column expressions and as SQL text: scoring without vectors, inside the projection that needs it."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import evaluate

#: What a fitted tree says of its nodes.
_TEST = re.compile(r"If \(feature (\d+) (<=|in) (.+)\)$")
_LEAF = re.compile(r"Predict: (.+)$")


@dataclass(frozen=True)
class Node:
    """A leaf with a value, or a test of one feature: up to the threshold (or, of codes, in the list) goes left, all else right.

    Missing values and NaN go right, as they do in the fitted model.
    """

    value: float | None = None
    feature: str | None = None
    threshold: float | None = None
    codes: list[float] | None = None
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> int:
        return 1 if self.feature is None else self.left.leaves() + self.right.leaves()


@dataclass(frozen=True)
class Ensemble:
    """Trees and their weights; the score is the weighted sum, or the probability that follows from it."""

    trees: list[Node]
    weights: list[float]
    probability: bool = False

    def column(self) -> Column:
        total = reduce(lambda a, b: a + b, (F.lit(float(w)) * _column(t) for w, t in zip(self.weights, self.trees)), F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-2.0 * total)) if self.probability else total

    def sql(self, quote: str = '"') -> str:
        total = " + ".join(["0e0", *(f"{_double(w)} * {_sql(t, quote)}" for w, t in zip(self.weights, self.trees))])
        return f"(1e0 / (1e0 + exp(-2e0 * ({total}))))" if self.probability else f"({total})"

    def features(self) -> list[str]:
        """Features that a test looks at: what a scan has to read."""
        return sorted(set().union(*map(_used, self.trees))) if self.trees else []

    def text(self) -> str:
        """The ensemble as JSON, which of() reads."""
        return json.dumps(asdict(self, dict_factory=lambda items: {k: v for k, v in items if v is not None}))

    @classmethod
    def of(cls, text: str) -> Ensemble:
        found = json.loads(text)
        return cls([_node(t) for t in found["trees"]], found["weights"], found["probability"])


def _node(x: dict) -> Node:
    return Node(**{k: _node(v) if k in ("left", "right") else v for k, v in x.items()})


def _used(tree: Node) -> set[str]:
    return set() if tree.feature is None else {tree.feature} | _used(tree.left) | _used(tree.right)


def _column(tree: Node) -> Column:
    if tree.feature is None:
        return F.lit(float(tree.value))
    x = F.col(f"`{tree.feature}`").cast("double")
    test = x <= F.lit(tree.threshold) if tree.codes is None else x.isin(tree.codes)
    return F.when(test, _column(tree.left)).otherwise(_column(tree.right))


def _double(x: float) -> str:
    """A number that both Spark and other engines read as a double."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def _sql(tree: Node, quote: str) -> str:
    if tree.feature is None:
        return _double(tree.value)
    name = f"{quote}{tree.feature.replace(quote, quote * 2)}{quote}"
    test = f"<= {_double(tree.threshold)}" if tree.codes is None else f"IN ({', '.join(map(_double, tree.codes))})"
    return f"CASE WHEN CAST({name} AS DOUBLE) {test} THEN {_sql(tree.left, quote)} ELSE {_sql(tree.right, quote)} END"


def _parsed(description: str, features: list[str]) -> Node:
    """The tree of a fitted model's description, whose lines are tests and leaves in depth-first order."""
    lines = (x.strip() for x in description.splitlines()[1:])

    def read() -> Node:
        line = next(lines)
        if leaf := _LEAF.match(line):
            return Node(value=float(leaf[1]))
        feature, kind, rest = _TEST.match(line).groups()
        left = read()
        next(lines)  # Else (...)
        right = read()
        test = {"threshold": float(rest)} if kind == "<=" else {"codes": sorted(float(x) for x in rest.strip("{}").split(","))}
        return Node(feature=features[int(feature)], left=left, right=right, **test)

    return read()


@dataclass(frozen=True)
class Scorer:
    """Two-stage models as expressions: buyer probability, log revenue, and the gated and the soft revenue.

    What `TwoStage.score` gives, without vectors and without the fitted models:
    a scan that scores reads the features that a tree looks at, and no others.
    """

    buyer: Ensemble
    revenue: Ensemble

    def features(self) -> list[str]:
        return sorted({*self.buyer.features(), *self.revenue.features()})

    def score(self, df: DataFrame) -> DataFrame:
        """`df` (missing features 0) with p_buyer, log_rev, gated and soft; a projection, row by row."""
        known = self.features()
        p = self.buyer.column() if self.buyer.probability else F.least(F.greatest(self.buyer.column(), F.lit(0.0)), F.lit(1.0))
        out = (df.na.fill(0.0, subset=known) if known else df).withColumn("p_buyer", p).withColumn("log_rev", F.greatest(self.revenue.column(), F.lit(0.0)))
        return out.withColumns({"gated": evaluate.gate("p_buyer", "log_rev"), "soft": evaluate.product("p_buyer", "log_rev")})

    def sql(self, table: str, key: str = "row_id", threshold: float = 0.5) -> str:
        """The same as a SELECT of the key and the four numbers, in SQL that other engines read too."""
        known = ", ".join(f'coalesce("{f}", 0) AS "{f}"' for f in self.features())
        p = self.buyer.sql() if self.buyer.probability else f"least(greatest({self.buyer.sql()}, 0e0), 1e0)"
        back = "greatest(exp(log_rev) - 1, 0e0)"
        return (
            f"WITH known AS (SELECT {key}{', ' + known if known else ''} FROM {table}), scored AS (SELECT {key}, {p} AS p_buyer, greatest({self.revenue.sql()}, 0e0) AS log_rev FROM known) "
            f"SELECT {key}, p_buyer, log_rev, CASE WHEN p_buyer >= {_double(threshold)} THEN {back} ELSE 0e0 END AS gated, p_buyer * {back} AS soft FROM scored"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of text, in any store that Spark writes."""
        spark.createDataFrame([(json.dumps([self.buyer.text(), self.revenue.text()]),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scorer:
        return cls.of(spark.read.text(path, wholetext=True).first()[0])

    @classmethod
    def of(cls, text: str) -> Scorer:
        return cls(*map(Ensemble.of, json.loads(text)))


def ensemble(model, features: list[str], probability: bool = False) -> Ensemble:
    """Of a fitted gradient-boosted model (or one tree) whose vector has the `features` in this order."""
    trees = getattr(model, "trees", None) or [model]
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    return Ensemble([_parsed(t.toDebugString, features) for t in trees], [float(w) for w in weights], probability)
