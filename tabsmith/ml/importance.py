"""Permutation importance (M10) without ``rand()`` and without a single task.

The rows get positions in key order; a feature is shuffled by a bijection of
the positions, ``p -> (a p + b) mod n`` with a prime to n, whose a and b come
from a hash of the feature and the repeat.  So a row's new value is found by
one join on the position, any partitioning gives the same shuffle, and every
feature and repeat is scored in one transform.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.core import c
from tabsmith.ml.metrics import classification_metrics, regression_metrics
from tabsmith.ml.models import Prepared, model_input
from tabsmith.operators.rows import with_position
from tabsmith.session import cut_lineage

_MOST = 1 << 20  # of a and b, so that a * p + b fits a long up to 8 * 10^12 rows


def bijection(n: int, feature: str, repeat: int, seed: int = 42) -> tuple[int, int]:
    """(a, b) of the shuffle of a feature's n positions."""
    h = hashlib.md5(f"{feature}|{repeat}|{seed}".encode()).hexdigest()
    a, b = int(h[:8], 16) % _MOST + 2, int(h[8:16], 16) % _MOST
    while math.gcd(a, n) != 1:
        a += 1
    return a, b


def shuffled(rows: DataFrame, features: Sequence[str], n: int, repeats: int, seed: int, position: str = "__pos") -> DataFrame:
    """``rows`` once per feature and repeat, with columns ``__feature``, ``__repeat`` and that feature's values shuffled."""
    turns = [(x, r, *bijection(n, x, r, seed)) for x in features for r in range(repeats)]
    plan = F.array(*[F.struct(F.lit(x).alias("__feature"), F.lit(r).alias("__repeat"),
                              F.pmod(F.col(position) * F.lit(a).cast("long") + F.lit(b).cast("long"), F.lit(n).cast("long")).alias("__from"))
                     for x, r, a, b in turns])
    values = rows.select(F.col(position).alias("__from"), F.inline(F.array(*[
        F.struct(F.lit(x).alias("__feature"), F.struct(*[(c(x) if x == y else F.lit(None).cast(rows.schema[y].dataType)).alias(f"v{j}")
                                                         for j, y in enumerate(features)]).alias("__value")) for x in features])))
    out = rows.select("*", F.inline(plan)).join(values, ["__from", "__feature"])
    new: dict[str, Column] = {x: F.when(F.col("__feature") == x, F.col("__value")[f"v{j}"]).otherwise(c(x)) for j, x in enumerate(features)}
    return out.withColumns(new).drop("__value", "__from")


def permutation_importance(model: PipelineModel, prep: Prepared, df: DataFrame, target: str, key_cols: Sequence[str],
                           features: Sequence[str] | None = None, repeats: int = 1, seed: int = 42) -> DataFrame:
    """(feature, importance, std, score): how much R2 (regression) or Accuracy (classification) falls when a feature
    is shuffled, mean and population std over the repeats, and the score without shuffling."""
    feats = list(features or prep.features)
    metric = "R2" if prep.task == "regression" else "Accuracy"
    rows = cut_lineage(with_position(df.select(*dict.fromkeys([*key_cols, *prep.features, target])), [c(k) for k in key_cols], "__pos")
                       .withColumn("__pos", F.col("__pos") - 1))
    n = rows.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], "feature string, importance double, std double, score double")

    def scores(data: DataFrame, by: list) -> DataFrame:
        pred = model.transform(model_input(data, prep, target))
        found = regression_metrics(pred, "label", "prediction", by) if metric == "R2" else \
            classification_metrics(pred, "label", "prediction", by=by, average="weighted")
        return found.select(*by, F.col(metric).alias("s"))
    whole = scores(rows, []).withColumnRenamed("s", "score")
    each = scores(shuffled(rows, feats, n, repeats, seed), ["__feature", "__repeat"])
    drop = each.crossJoin(whole).withColumn("d", F.col("score") - F.col("s"))  # one row
    return drop.groupBy(F.col("__feature").alias("feature")).agg(
        F.avg("d").alias("importance"), F.stddev_pop("d").alias("std"), F.first("score").alias("score"))
