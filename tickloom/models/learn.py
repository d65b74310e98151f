"""Models on feature tables with MLlib; probabilities keep the order sell, hold, buy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import corr

CLASSES = (-1, 0, 1)
KEYS = ("symbol", "us", "seq")


def with_class(rows: DataFrame, label: str = "label") -> DataFrame:
    """Labels -1/0/+1 as the class index MLlib wants (0/1/2)."""
    return rows.filter(F.col(label).isNotNull()).withColumn("cls", (F.col(label) + 1).cast("double"))


def _front(features: Sequence[str]) -> list:
    return [
        VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="skip"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
    ]


def fit_logistic(rows: DataFrame, features: Sequence[str], penalty: float = 1e-3) -> PipelineModel:
    """Multinomial logistic on standardised features."""
    model = LogisticRegression(labelCol="cls", family="multinomial", regParam=penalty, maxIter=50)
    return Pipeline(stages=[*_front(features), model]).fit(with_class(rows))


def fit_forest(
    rows: DataFrame, features: Sequence[str], trees: int = 50, depth: int = 6, seed: int = 7, subset: str = "sqrt"
) -> PipelineModel:
    """Random forest; extra trees use the same learner with one feature a split (``subset='1'``)."""
    model = RandomForestClassifier(
        labelCol="cls", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy=subset
    )
    return Pipeline(stages=[*_front(features), model]).fit(with_class(rows))


def fit_ridge(rows: DataFrame, features: Sequence[str], target: str, penalty: float = 1.0) -> PipelineModel:
    model = LinearRegression(labelCol=target, regParam=penalty, elasticNetParam=0.0)
    return Pipeline(stages=[*_front(features), model]).fit(rows.filter(F.col(target).isNotNull()))


def fit_boosted(rows: DataFrame, features: Sequence[str], target: str, rounds: int = 20, depth: int = 3, seed: int = 7) -> PipelineModel:
    model = GBTRegressor(labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*_front(features), model]).fit(rows.filter(F.col(target).isNotNull()))


@dataclass
class BoostedClasses:
    """One boosted classifier per class, probabilities scaled to sum to one."""

    models: list[PipelineModel] = field(default_factory=list)

    @classmethod
    def fit(cls, rows: DataFrame, features: Sequence[str], rounds: int = 10, depth: int = 3, seed: int = 7) -> BoostedClasses:
        labelled = with_class(rows)
        models = []
        for k in range(len(CLASSES)):
            one = labelled.withColumn("hit", (F.col("cls") == k).cast("double"))
            stage = GBTClassifier(labelCol="hit", maxIter=rounds, maxDepth=depth, seed=seed)
            models.append(Pipeline(stages=[*_front(features), stage]).fit(one))
        return cls(models)

    def predict(self, rows: DataFrame) -> DataFrame:
        out = rows
        for k, m in enumerate(self.models):
            hit = vector_to_array("probability")[1].alias(f"_h{k}")
            out = m.transform(out).select(*out.columns, hit)
        total = F.col("_h0") + F.col("_h1") + F.col("_h2")
        names = ("p_sell", "p_hold", "p_buy")
        return out.select(
            *rows.columns, *[(F.col(f"_h{k}") / total).alias(n) for k, n in enumerate(names)]
        )


def predict_classes(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Class probabilities beside the rows."""
    p = vector_to_array("probability")
    return model.transform(rows).select(
        *rows.columns, p[0].alias("p_sell"), p[1].alias("p_hold"), p[2].alias("p_buy")
    )


def predict_value(model: PipelineModel, rows: DataFrame, name: str = "mu") -> DataFrame:
    return model.transform(rows).select(*rows.columns, F.col("prediction").alias(name))


def class_prior(rows: DataFrame, label: str = "label") -> DataFrame:
    """One row: share of each class, what a model must beat."""
    known = rows.filter(F.col(label).isNotNull())
    return known.agg(
        *[F.avg((F.col(label) == c).cast("double")).alias(n) for c, n in zip(CLASSES, ("p_sell", "p_hold", "p_buy"), strict=True)]
    )


def always_hold(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.lit(0.0).alias("p_sell"), F.lit(1.0).alias("p_hold"), F.lit(0.0).alias("p_buy"))


def edge_to_probabilities(edge: Column, scale: Column | float) -> list[Column]:
    """A signed edge as (sell, hold, buy): a third plus what the size adds, at most 0.9."""
    third = 1.0 / 3.0
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    sure = F.lit(third) + F.tanh(F.abs(edge) / s) * (0.9 - third)
    rest = (F.lit(1.0) - sure) / 2
    return [
        F.when(edge < 0, sure).otherwise(rest),
        rest,
        F.when(edge >= 0, sure).otherwise(rest),
    ]


def meta_rows(rows: DataFrame, target: str, confidence: float) -> DataFrame:
    """Rows the primary would act on, with whether acting won; a target of 0 is a loss."""
    side = F.when(F.col("p_buy") >= F.col("p_sell"), 1).otherwise(-1)
    sure = F.greatest("p_buy", "p_sell")
    kept = rows.filter(F.col(target).isNotNull() & (sure >= confidence))
    won = (F.signum(F.col(target)) == side).cast("double")
    return kept.withColumn("side", side).withColumn("won", won)


def fit_meta(rows: DataFrame, features: Sequence[str]) -> PipelineModel:
    """Secondary model: will acting on the primary's side win?"""
    model = LogisticRegression(labelCol="won", regParam=1e-3, maxIter=50)
    return Pipeline(stages=[*_front(features), model]).fit(rows)


def fit_bagged(rows: DataFrame, features: Sequence[str], bags: int) -> list[PipelineModel]:
    """One logistic per contiguous stretch of days."""
    placed = stretches(rows, bags)
    return [fit_logistic(placed.filter(F.col("stretch") == k), features) for k in range(bags)]


def stretches(rows: DataFrame, bags: int) -> DataFrame:
    """Rows with the index of their contiguous stretch of the calendar."""
    day = F.floor(F.col("us") / F.lit(86_400_000_000))
    span = rows.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    joined = rows.join(F.broadcast(span))  # one row
    k = F.floor((day - F.col("_a")) * bags / (F.col("_b") - F.col("_a") + 1)).cast("int")
    return joined.withColumn("stretch", k).drop("_a", "_b")


def average_predictions(models: Sequence[PipelineModel], rows: DataFrame) -> DataFrame:
    """Mean class probabilities of several models."""
    out = rows
    names = ("p_sell", "p_hold", "p_buy")
    for i, m in enumerate(models):
        part = predict_classes(m, out)
        out = part.select(*out.columns, *[F.col(n).alias(f"_{n}{i}") for n in names])
    mean = [sum((F.col(f"_{n}{i}") for i in range(len(models))), F.lit(0.0)) / len(models) for n in names]
    return out.select(*rows.columns, *[c.alias(n) for c, n in zip(mean, names, strict=True)])


def stacked_rows(rows: DataFrame, features: Sequence[str], folds: int) -> DataFrame:
    """Out-of-sample probabilities from forward-chained fits, for a second model to learn from."""
    placed = stretches(rows, folds + 1)
    out: DataFrame | None = None
    for k in range(1, folds + 1):
        model = fit_logistic(placed.filter(F.col("stretch") < k), features)
        part = predict_classes(model, placed.filter(F.col("stretch") == k))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def fit_mean_and_spread(
    rows: DataFrame, features: Sequence[str], target: str, tail: int = 4
) -> tuple[PipelineModel, PipelineModel]:
    """A mean model and a model of its squared error.

    The error is learned on the last of ``tail`` stretches with a mean fitted before it; the mean
    is then fitted again on everything.
    """
    placed = stretches(rows.filter(F.col(target).isNotNull()), tail)
    front = placed.filter(F.col("stretch") < tail - 1)
    back = placed.filter(F.col("stretch") == tail - 1)
    first = fit_ridge(front, features, target)
    squared = predict_value(first, back, "_m").withColumn("_sq", F.pow(F.col(target) - F.col("_m"), 2))
    error = fit_ridge(squared, features, "_sq")
    return fit_ridge(placed, features, target), error


def calibrate(rows: DataFrame, name: str, cls: int, label: str = "label"):
    """Isotonic map of one class probability onto observed frequency."""
    data = rows.select(F.col(name).alias("p"), (F.col(label) == cls).cast("double").alias("hit"))
    return IsotonicRegression(featuresCol="p", labelCol="hit").fit(data.filter("hit IS NOT NULL"))


def linear_ceiling(rows: DataFrame, features: Sequence[str], target: str, penalty: float = 1.0) -> DataFrame:
    """One row: correlation of a ridge's own fit with its target, the most a line can reach."""
    model = fit_ridge(rows, features, target, penalty)
    fitted = predict_value(model, rows.filter(F.col(target).isNotNull()))
    return fitted.agg(corr("mu", target).alias("ceiling"), F.count(F.lit(1)).alias("rows"))


def source_audit(rows: DataFrame, sources: dict[str, Sequence[str]], target: str) -> DataFrame:
    """Greedy audit: which source of features adds most to what the ones before explain."""
    left, used = dict(sources), []
    spark = rows.sparkSession
    found: list[tuple[int, str, float]] = []
    while left:
        scored = []
        for name, columns in left.items():
            value = linear_ceiling(rows, [*used, *columns], target).first()["ceiling"] or 0.0
            scored.append((-value, name))
        worst, name = min(scored)
        used += left.pop(name)
        found.append((len(found), name, -worst))
    return spark.createDataFrame(found, "step int, source string, ceiling double")


def bias_variance(rows: DataFrame, features: Sequence[str], target: str, refits: int) -> DataFrame:
    """One row: squared bias, variance and noise of refits on contiguous stretches, on shared rows."""
    placed = stretches(rows.filter(F.col(target).isNotNull()), refits + 1)
    held = placed.filter(F.col("stretch") == refits)
    out = held
    for k in range(refits):
        model = fit_ridge(placed.filter(F.col("stretch") == k), features, target)
        out = predict_value(model, out, f"_f{k}")
    fits = [F.col(f"_f{k}") for k in range(refits)]
    mean = sum(fits, F.lit(0.0)) / refits
    spread = sum(((f - F.col("_mean")) * (f - F.col("_mean")) for f in fits), F.lit(0.0)) / refits
    staged = out.withColumn("_mean", mean).withColumn("_var", spread)
    error = F.col(target) - F.col("_mean")
    return staged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(error * error).alias("squared_error_of_mean"),
        F.avg("_var").alias("variance"),
    )

