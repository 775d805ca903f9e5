"""Closed-form baseline models cross-validated in one pass (M6/M7 'dummy'
and one-feature least squares).

Per-fold sufficient statistics (n, sums, cross products) come from one
``groupBy(fold)`` aggregate; the training statistics of fold f are the
totals minus fold f, so k models are fitted from k rows.  Predictions are a
join with that k-row table (broadcast, bounded by k) and all metrics come
from one ``groupBy(model, fold)`` aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.core import c
from tabsmith.ml.metrics import regression_metrics


def fold_fits(df: DataFrame, target: str, feature: str, fold_col: str = "fold") -> DataFrame:
    """Per fold: training mean of y, least-squares slope and intercept."""
    y, x = c(target).cast("double"), c(feature).cast("double")
    ok = y.isNotNull() & x.isNotNull()
    per = df.groupBy(c(fold_col).alias("fold")).agg(
        F.count(F.when(y.isNotNull(), 1)).alias("ny"), F.sum(y).alias("sy"),
        F.count(F.when(ok, 1)).alias("n"), F.sum(F.when(ok, x)).alias("sx"), F.sum(F.when(ok, y)).alias("sxy_y"),
        F.sum(F.when(ok, x * y)).alias("sxy"), F.sum(F.when(ok, x * x)).alias("sxx"))
    tot = per.agg(*[F.sum(k).alias(f"t_{k}") for k in ("ny", "sy", "n", "sx", "sxy_y", "sxy", "sxx")])
    j = per.crossJoin(tot)  # one-row side; k rows
    tr = {k: F.col(f"t_{k}") - F.col(k) for k in ("ny", "sy", "n", "sx", "sxy_y", "sxy", "sxx")}
    slope = (tr["n"] * tr["sxy"] - tr["sx"] * tr["sxy_y"]) / (tr["n"] * tr["sxx"] - tr["sx"] * tr["sx"])
    return j.select("fold", (tr["sy"] / tr["ny"]).alias("train_mean"), slope.alias("slope"),
                    ((tr["sxy_y"] - slope * tr["sx"]) / tr["n"]).alias("intercept"))


def baseline_predictions(df: DataFrame, target: str, feature: str, fold_col: str = "fold") -> DataFrame:
    """(model, fold, label, prediction) for the dummy mean and the OLS line."""
    fits = fold_fits(df, target, feature, fold_col)
    j = df.select(c(fold_col).alias("fold"), c(target).cast("double").alias("label"),
                  c(feature).cast("double").alias("x")).join(F.broadcast(fits), "fold")  # k rows
    # both models from one pass over the rows (explode of two predictions, not a union of two scans)
    both = F.array(F.struct(F.lit("dummy").alias("model"), F.col("train_mean").alias("prediction")),
                   F.struct(F.lit("ols").alias("model"),
                            (F.col("intercept") + F.col("slope") * F.col("x")).alias("prediction")))
    return j.select("fold", "label", F.explode(both).alias("p")) \
            .select(F.col("p.model").alias("model"), "fold", "label", F.col("p.prediction").alias("prediction"))


def baseline_leaderboard(df: DataFrame, target: str, feature: str, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    per = regression_metrics(baseline_predictions(df, target, feature, fold_col), "label", "prediction",
                             by=["model", "fold"])
    names = ["MAE", "MSE", "RMSE", "R2", "RMSLE", "MAPE"]
    board = per.groupBy("model").agg(*[F.avg(x).alias(x) for x in names])
    return board, per
