"""Prediction behind a drift gate.

A model's folder keeps the distributions of its training features, bounded
whatever the table's size: ``BINS`` equal-width bins between the extremes of a
numeric feature (and one below, one above, one for missing), the ``TOP`` most
frequent values of a text feature (and one bin for the others, one for
missing).  A batch is binned the same way in one scan; the Jensen-Shannon
distance of a feature's two distributions is its drift score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.core import c, is_numeric
from tabsmith.ml.models import Prepared, predict
from tabsmith.operators.clean import present
from tabsmith.operators.frequent import top_values

BINS, TOP = 32, 50
SCHEMA = "feature string, kind string, bin int, value string, lo double, hi double, n long"


class DriftDetected(RuntimeError):
    """A batch that differs from the training data, when the caller asked to stop."""

    def __init__(self, scores: dict[str, float]):
        super().__init__(f"the batch drifts from the training data: {scores}")
        self.scores = scores


def _numeric_bin(name: str, lo: float | None, hi: float | None) -> Column:
    """0 .. BINS-1 inside [lo, hi], -1 below, BINS above, -2 missing."""
    v = present(name)
    if lo is None:
        return F.when(v.isNull(), -2).otherwise(0)
    width = (hi - lo) / BINS or 1.0
    inside = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(BINS - 1))
    return F.when(v.isNull(), -2).when(v < lo, -1).when(v > hi, BINS).otherwise(inside).cast("int")


def _text_bin(name: str, values: Sequence[str]) -> Column:
    """The value's number among ``values``, their count for others, -2 for missing."""
    v = c(name).cast("string")
    at = F.array_position(F.array(*[F.lit(x) for x in values]), v) if values else F.lit(0)
    return F.when(v.isNull(), -2).when(at > 0, at - 1).otherwise(len(values)).cast("int")


def _binned(df: DataFrame, bins: dict[str, Column]) -> DataFrame:
    """(feature, bin, n) of all features in one scan, counted before the shuffle."""
    cells = F.array(*[F.struct(F.lit(x).alias("feature"), b.alias("bin")) for x, b in bins.items()])
    return df.select(F.inline(cells)).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def reference_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Bounded distributions of the features, one row per bin that has rows."""
    num = [x for x in features if is_numeric(df.schema[x].dataType)]
    cat = [x for x in features if x not in num]
    ends = df.agg(F.count(F.lit(1)), *[f(present(x)) for x in num for f in (F.min, F.max)]).first()
    at = {x: (ends[1 + 2 * i], ends[2 + 2 * i]) for i, x in enumerate(num)}
    tops: dict[str, list] = {x: [] for x in cat}
    if cat:
        for r in sorted(top_values(df, cat, TOP).collect(), key=lambda r: r["rank"]):
            tops[r["column_name"]].append(r["value"])
    bins = {x: _numeric_bin(x, *at[x]) for x in num} | {x: _text_bin(x, tops[x]) for x in cat}
    rows = [(r["feature"], "num" if r["feature"] in at else "cat", r["bin"],
             tops[r["feature"]][r["bin"]] if r["feature"] in tops and 0 <= r["bin"] < len(tops[r["feature"]]) else None,
             *at.get(r["feature"], (None, None)), r["n"]) for r in _binned(df, bins).collect()]  # bounded: bins of each feature
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def load_reference(spark: SparkSession, path: str) -> DataFrame:
    """The distributions in a model's folder."""
    return spark.read.parquet(f"{path}/reference")


def drift_scores(reference: DataFrame, batch: DataFrame) -> DataFrame:
    """(feature, drift_score): Jensen-Shannon distance (base 2) of the binned distributions; one scan of the batch."""
    known: dict[str, dict] = {}
    for r in reference.collect():  # bounded: at most BINS or TOP bins a feature
        f = known.setdefault(r["feature"], {"kind": r["kind"], "lo": r["lo"], "hi": r["hi"], "values": {}})
        if r["value"] is not None:
            f["values"][r["bin"]] = r["value"]
    missing = [x for x in known if x not in batch.columns]
    if missing:
        raise ValueError(f"the batch lacks the features {missing}")
    bins = {x: _numeric_bin(x, f["lo"], f["hi"]) if f["kind"] == "num" else _text_bin(x, [f["values"][k] for k in sorted(f["values"])])
            for x, f in known.items()}
    new = _binned(batch, bins).withColumnRenamed("n", "m")
    both = reference.select("feature", "bin", "n").join(new, ["feature", "bin"], "full_outer").fillna(0, ["n", "m"])
    tot = both.groupBy("feature").agg(F.sum("n").alias("n_all"), F.sum("m").alias("m_all"))
    both = both.join(tot, "feature")
    p, q = F.try_divide(F.col("n"), F.col("n_all")), F.try_divide(F.col("m"), F.col("m_all"))
    mid = (p + q) / 2

    def kl(a: Column) -> Column:
        return F.sum(F.when(a > 0, a * F.log2(a / mid)).otherwise(0.0))
    return both.groupBy("feature").agg(F.sqrt(F.greatest(F.lit(0.0), 0.5 * kl(p) + 0.5 * kl(q))).alias("drift_score"))


def predict_gated(model: PipelineModel, prep: Prepared, reference: DataFrame, batch: DataFrame, target: str | None = None,
                  on_drift: str = "flag", threshold: float = 0.1, share: float = 0.5, narrow: bool = False,
                  label_name: str = "prediction_label", score_name: str = "prediction_score") -> DataFrame:
    """Predictions with ``drift_detected`` and ``drift_share`` (features whose score reaches ``threshold``).

    The batch drifts when at least ``share`` of the features do; ``on_drift``
    "stop" then raises ``DriftDetected`` before anything is scored, "ignore"
    doesn't look.  ``narrow`` stores the batch's columns in narrower types."""
    if on_drift not in ("flag", "stop", "ignore"):
        raise ValueError(f"on_drift must be flag, stop or ignore, not {on_drift!r}")
    scores = {} if on_drift == "ignore" else {r["feature"]: r["drift_score"] for r in drift_scores(reference, batch).collect()}
    drifting = [x for x, v in scores.items() if v is not None and v >= threshold]
    part = len(drifting) / len(scores) if scores else 0.0
    found = bool(scores) and part >= share
    if found and on_drift == "stop":
        raise DriftDetected(scores)
    if narrow:
        from tabsmith.operators.schema import apply_narrowing, narrow_types_plan
        batch = apply_narrowing(batch, narrow_types_plan(batch))
    out = predict(model, prep, batch, target, label_name, score_name)
    return out.withColumn("drift_detected", F.lit(found)).withColumn("drift_share", F.lit(part))
