"""Models fitted and applied with MLlib on the feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import labels
from tickloom.functions.book import build_features
from tickloom.models import learn
from tickloom.plans.fixtures import Fixtures
from tickloom.plans.queries_labels import FWD, LABEL
from tickloom.plans.registry import query
from tickloom.session import materialised

FEATURES = ["queue_imbalance", "spread_bp", "log_depth_ratio", "ofi_1", "mid_return_1_bp"]
CUT = 1_705_276_800_000_000


def rows(fx: Fixtures) -> DataFrame:
    """Features, forward move and label, written once: a fit reads them many times."""
    made = build_features(fx.book, FEATURES, spine=fx.spine, dropna=True)
    moves = labels.forward_return(fx.book, 10, spine=fx.spine)
    joined = made.join(moves, ["symbol", "us", "seq"])
    label = labels.three_class(F.col("forward_bp"), 50)
    return materialised(joined.withColumn("label", label))


def parts(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    every = rows(fx)
    return every.filter(F.col("us") < CUT), every.filter(F.col("us") >= CUT)


def summary(predicted: DataFrame) -> DataFrame:
    """Mean probabilities and accuracy per instrument."""
    top = F.when(
        (F.col("p_buy") >= F.col("p_hold")) & (F.col("p_buy") >= F.col("p_sell")), 1
    ).when(F.col("p_sell") >= F.col("p_hold"), -1).otherwise(0)
    return predicted.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("p_sell").alias("p_sell"),
        F.avg("p_buy").alias("p_buy"),
        F.avg((top == F.col("label")).cast("double")).alias("accuracy"),
    )


@query(
    "m1_class_prior",
    f"""
    WITH {FWD}, l AS (SELECT {LABEL} AS label FROM f) SELECT avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0
      END) AS p_sell, avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS p_hold, avg(CASE WHEN label = 1
      THEN 1.0 ELSE 0.0 END) AS p_buy FROM l WHERE label IS NOT NULL""",
    d="p_sell p_hold p_buy",
)
def m1(fx: Fixtures) -> DataFrame:
    moves = labels.forward_return(fx.book, 10, spine=fx.spine)
    return learn.class_prior(moves.withColumn("label", labels.three_class(F.col("forward_bp"), 50)))


@query(
    "m1_always_hold",
    f"""
    WITH {FWD}, l AS (SELECT symbol, {LABEL} AS label FROM f) SELECT symbol, count(*) AS rows,
      avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS right, 0.0 AS p_sell, 0.0 AS p_buy
    FROM l WHERE label IS NOT NULL GROUP BY symbol""",
    d="right p_sell p_buy",
)
def m1b(fx: Fixtures) -> DataFrame:
    """How often the model that never trades is right, per instrument."""
    moves = labels.forward_return(fx.book, 10, spine=fx.spine)
    rows = moves.withColumn("label", labels.three_class(F.col("forward_bp"), 50)).where("label IS NOT NULL")
    right = F.avg(((F.col("label") == 0) & (F.col("p_hold") > 0.5)).cast("double"))
    return learn.always_hold(rows).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), right.alias("right"), F.max("p_sell").alias("p_sell"), F.max("p_buy").alias("p_buy")
    )


@query("m2_multinomial_logistic", None)
def m2(fx: Fixtures) -> DataFrame:
    train, test = parts(fx)
    return summary(learn.predict_classes(learn.fit_logistic(train, FEATURES), test))


@query("m3_ridge", None)
def m3(fx: Fixtures) -> DataFrame:
    train, test = parts(fx)
    model = learn.fit_ridge(train, FEATURES, "forward_bp")
    return learn.predict_value(model, test).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("mu").alias("mean_mu"), F.stddev_pop("mu").alias("sd_mu")
    )


@query("m4_forests", None)
def m4(fx: Fixtures) -> DataFrame:
    train, test = parts(fx)
    return summary(learn.predict_classes(learn.fit_forest(train, FEATURES, trees=20, depth=4), test))


@query("m5_boosting", None)
def m5(fx: Fixtures) -> DataFrame:
    train, test = parts(fx)
    return summary(learn.BoostedClasses.fit(train, FEATURES, rounds=3, depth=2).predict(test))


@query(
    "m6_edge_to_probabilities",
    """
    WITH s AS (SELECT symbol, us, seq, imb * 60 AS e, 1.0 / 3 + (0.9 - 1.0 / 3) * tanh(abs(imb * 60) / 20)
      AS sure FROM fx_decisions)
    SELECT symbol, us, seq, CASE WHEN e < 0 THEN sure ELSE (1 - sure) / 2 END AS p_sell, (1 - sure) / 2
      AS p_hold, CASE WHEN e >= 0 THEN sure ELSE (1 - sure) / 2 END AS p_buy FROM s""",
    d="p_sell p_hold p_buy",
)
def m6(fx: Fixtures) -> DataFrame:
    p = learn.edge_to_probabilities(F.col("imb") * 60, 20.0)
    return fx.decisions.select(
        "symbol", "us", "seq", p[0].alias("p_sell"), p[1].alias("p_hold"), p[2].alias("p_buy")
    )


@query("m7_meta_labelling", None)
def m7(fx: Fixtures) -> DataFrame:
    train, test = parts(fx)
    primary = learn.fit_logistic(train, FEATURES)
    acted = learn.meta_rows(learn.predict_classes(primary, train), "forward_bp", 0.3)
    second = learn.fit_meta(acted, [*FEATURES, "p_buy", "p_sell"])
    judged = learn.meta_rows(learn.predict_classes(primary, test), "forward_bp", 0.3)
    from pyspark.ml.functions import vector_to_array

    scored = second.transform(judged).select(
        "symbol", "won", vector_to_array("probability")[1].alias("p_win")
    )
    return scored.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("won").alias("won"), F.avg("p_win").alias("p_win")
    )


@query("m8_bagged_and_stacked", None)
def m8(fx: Fixtures) -> DataFrame:
    train, test = parts(fx)
    bagged = learn.average_predictions(learn.fit_bagged(train, FEATURES, 2), test)
    level = learn.stacked_rows(train, FEATURES, 2).drop("stretch")
    second = learn.fit_logistic(level, ["p_sell", "p_buy"])
    base = learn.predict_classes(learn.fit_logistic(train, FEATURES), test)
    stacked = second.transform(base).drop("raw", "features", "rawPrediction", "prediction")
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    rows_ = stacked.select("symbol", "label", p[0].alias("p_sell"), p[1].alias("p_hold"), p[2].alias("p_buy"))
    return summary(bagged).withColumn("kind", F.lit("bagged")).unionByName(
        summary(rows_).withColumn("kind", F.lit("stacked"))
    )


@query("m9_mean_and_variance", None)
def m9(fx: Fixtures) -> DataFrame:
    train, test = parts(fx)
    mean, error = learn.fit_mean_and_spread(train, FEATURES, "forward_bp")
    both = learn.predict_value(error, learn.predict_value(mean, test, "mu"), "sq")
    return both.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("mu").alias("mu"),
        F.avg(F.sqrt(F.greatest("sq", F.lit(0.0)))).alias("sigma"),
    )


@query("m10_calibrated", None)
def m10(fx: Fixtures) -> DataFrame:
    train, test = parts(fx)
    model = learn.fit_logistic(train, FEATURES)
    mapping = learn.calibrate(learn.predict_classes(model, train), "p_buy", 1)
    scored = mapping.transform(learn.predict_classes(model, test).withColumn("p", F.col("p_buy")))
    return scored.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("prediction").alias("calibrated"), F.avg("p").alias("raw")
    )


@query("m11_predict_period", None)
def m11(fx: Fixtures) -> DataFrame:
    train, test = parts(fx)
    out = learn.predict_classes(learn.fit_logistic(train, FEATURES), test)
    return out.select("symbol", "us", "seq", "p_sell", "p_hold", "p_buy")


@query("e17_source_audit", None)
def e17(fx: Fixtures) -> DataFrame:
    every = rows(fx)
    sources = {
        "queue": ["queue_imbalance", "log_depth_ratio"],
        "flow": ["ofi_1"],
        "move": ["mid_return_1_bp", "spread_bp"],
    }
    return learn.source_audit(every, sources, "forward_bp")


@query("e18_bias_variance", None)
def e18(fx: Fixtures) -> DataFrame:
    return learn.bias_variance(rows(fx), FEATURES, "forward_bp", 3)
