"""Model search, tuning, evaluation, persistence, prediction and explanation
on Spark ML (M4-M10, M14-M17).

Folds are a column (``fold``), never copies of the table.  Every fit is a
distributed Spark ML job; the predictions of all (model, fold) pairs are
unioned and scored by one ``groupBy(model, fold)`` aggregate.
"""

from __future__ import annotations

import json
import statistics
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import (
    Imputer, ImputerModel, OneHotEncoder, OneHotEncoderModel, StandardScaler, StandardScalerModel, StringIndexer, StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import c, hash_bucket, is_numeric
from tabsmith.ml.metrics import classification_metrics, regression_metrics

# Metric columns of the leaderboards and which direction is better.
REGRESSION_METRICS = ("MAE", "MSE", "RMSE", "R2", "RMSLE", "MAPE")
CLASSIFICATION_METRICS = ("Accuracy", "AUC", "Recall", "Precision", "F1", "Kappa", "MCC")
HIGHER_IS_BETTER = {"Accuracy", "AUC", "Recall", "Precision", "F1", "Kappa", "MCC", "R2"}
DEFAULT_MODELS = ("lr", "ridge", "lightgbm", "rf", "et")
MODEL_NAMES = {"lr": "Linear / Logistic Regression", "ridge": "Ridge", "rf": "Random Forest",
               "et": "Extra Trees (no bootstrap)", "lightgbm": "Gradient Boosted Trees", "dt": "Decision Tree",
               "dummy": "Dummy"}


@dataclass
class Prepared:
    pipeline: Pipeline
    features: list[str]
    numeric: list[str]
    categorical: list[str]
    task: str
    label_col: str


def build_preprocess(df: DataFrame, target: str, task: str, features: Sequence[str] | None = None,
                     scale: bool | None = None) -> Prepared:
    """M4: mean imputation of numeric features, mode-like handling of text
    features (index with an 'unknown' bucket, one-hot), assembler, and
    z-scaling for regression - one Spark ML pipeline.

    Spark's scaler divides by the sample deviation; against the population
    deviation that is one constant factor, which the models here don't see
    (linear ones standardise by themselves, trees only order values)."""
    feats = [x for x in (features or df.columns) if x != target]
    num = [x for x in feats if is_numeric(df.schema[x].dataType)]
    cat = [x for x in feats if isinstance(df.schema[x].dataType, (T.StringType, T.BooleanType))]
    stages = []
    if num:
        stages.append(Imputer(inputCols=[f"__d_{x}" for x in num], outputCols=[f"__i_{x}" for x in num], strategy="mean"))
    if cat:
        stages.append(StringIndexer(inputCols=[f"__s_{x}" for x in cat], outputCols=[f"__x_{x}" for x in cat],
                                    handleInvalid="keep", stringOrderType="frequencyDesc"))
        stages.append(OneHotEncoder(inputCols=[f"__x_{x}" for x in cat], outputCols=[f"__o_{x}" for x in cat],
                                    handleInvalid="keep", dropLast=True))
    stages.append(VectorAssembler(inputCols=[f"__i_{x}" for x in num] + [f"__o_{x}" for x in cat],
                                  outputCol="__raw_features", handleInvalid="keep"))
    if scale if scale is not None else task == "regression":
        stages.append(StandardScaler(inputCol="__raw_features", outputCol="features", withMean=True, withStd=True))
    else:
        from pyspark.ml.feature import SQLTransformer
        stages.append(SQLTransformer(statement="SELECT *, __raw_features AS features FROM __THIS__"))
    label_col = "label"
    if task == "classification" and not is_numeric(df.schema[target].dataType):
        stages.insert(0, StringIndexer(inputCol=f"__y_{target}", outputCol="label", handleInvalid="error"))
    return Prepared(Pipeline(stages=stages), feats, num, cat, task, label_col)


def model_input(df: DataFrame, prep: Prepared, target: str | None) -> DataFrame:
    """Typed input columns the preprocessing pipeline reads."""
    cols = {f"__d_{x}": c(x).cast("double") for x in prep.numeric}
    cols.update({f"__s_{x}": c(x).cast("string") for x in prep.categorical})
    if target is not None and target in df.columns:
        if prep.task == "classification" and not is_numeric(df.schema[target].dataType):
            cols[f"__y_{target}"] = c(target).cast("string")
        else:
            cols["label"] = c(target).cast("double")
    return df.withColumns(cols)


def stored_input(df: DataFrame, prep: Prepared, target: str, fold_col: str) -> DataFrame:
    """``model_input`` of a table that is read by many fits: only its typed columns and the fold,
    written once, so that no fit computes the fold of a row (a hash of its key) or reads other columns again."""
    from tabsmith.session import cut_lineage
    base = model_input(df, prep, target)
    keep = [x for x in base.columns if x == "label" or x.startswith(("__d_", "__s_", "__y_"))]
    return cut_lineage(base.select(*[c(x) for x in keep], c(fold_col)))


def fit_preparation(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """``pipeline.fit``; the fill values are stored, as Spark's imputer is lazy: each transform that is called would
    compute the means of ``train`` again."""
    import uuid

    from tabsmith.session import scratch_path
    stages = list(pipeline.getStages())
    for i, stage in enumerate(stages):
        if isinstance(stage, Imputer):
            path = scratch_path(train.sparkSession, f"imputer-{uuid.uuid4().hex}")
            stage.fit(train).write().save(path)
            stages[i] = ImputerModel.load(path)
    return Pipeline(stages=stages).fit(train)


def make_estimator(model_id: str, task: str, params: dict | None = None, n_classes: int = 2, seed: int = 42):
    """M5: candidate model ids -> Spark ML estimators."""
    p = dict(params or {})
    common = {"featuresCol": "features", "labelCol": "label"}
    if task == "regression":
        if model_id == "lr":
            return LinearRegression(**common, **p)
        if model_id == "ridge":
            return LinearRegression(**common, elasticNetParam=0.0, regParam=p.pop("regParam", 1.0), **p)
        if model_id == "rf":
            return RandomForestRegressor(**common, seed=seed, **{"numTrees": 20, **p})
        if model_id == "et":
            return RandomForestRegressor(**common, seed=seed, bootstrap=False, **{"numTrees": 20, **p})
        if model_id == "lightgbm":
            return GBTRegressor(**common, seed=seed, **{"maxIter": 20, **p})
        if model_id == "dt":
            return DecisionTreeRegressor(**common, seed=seed, **p)
    else:
        if model_id in ("lr", "ridge"):
            reg = p.pop("regParam", 1.0 if model_id == "ridge" else 0.0)
            return LogisticRegression(**common, regParam=reg, elasticNetParam=0.0, **{"maxIter": 100, **p})
        if model_id == "rf":
            return RandomForestClassifier(**common, seed=seed, **{"numTrees": 20, **p})
        if model_id == "et":
            return RandomForestClassifier(**common, seed=seed, bootstrap=False, **{"numTrees": 20, **p})
        if model_id == "lightgbm":
            gbt = GBTClassifier(**common, seed=seed, **{"maxIter": 20, **p})
            return gbt if n_classes <= 2 else OneVsRest(classifier=gbt, **common)
        if model_id == "dt":
            return DecisionTreeClassifier(**common, seed=seed, **p)
    raise ValueError(f"unknown model id {model_id} for {task}")


# Regression trees that draw neither rows nor features: a row counts only by its bins.  Parameters that mean the same for cells as for rows.
CELL_MODELS = ("dt", "lightgbm")
CELL_PARAMS = {"maxDepth", "maxIter", "stepSize", "minInfoGain"}
BINS = 32         # of Spark's trees (maxBins)
POINTS = 255      # quantiles of a fold's column


def numeric_summaries(base: DataFrame, prep: Prepared, fold_col: str) -> dict:
    """Per fold, from one scan: ``rows``, and per numeric feature ``known`` (rows with a value), ``values`` (all values,
    if there are at most ``BINS``) and ``points`` (quantiles), by fixed-size sketches of all rows."""
    at = [i / (POINTS + 1) for i in range(1, POINTS + 1)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, x in enumerate(prep.numeric):
        v = F.nanvl(c(f"__d_{x}"), F.lit(None).cast("double"))
        aggs += [F.count(v).alias(f"n{i}"), F.percentile_approx(v, at, 10_000).alias(f"q{i}"),
                 F.call_function("approx_top_k", v, F.lit(BINS + 2), F.lit(256)).alias(f"t{i}")]  # null is an item, too
    out = {}
    for r in base.groupBy(fold_col).agg(*aggs).collect():
        out[r[fold_col]] = {"rows": r["rows"]}
        for i, x in enumerate(prep.numeric):
            values = {t["item"]: t["count"] for t in r[f"t{i}"] if t["item"] is not None}
            whole = len(values) <= BINS and sum(values.values()) == r[f"n{i}"]
            out[r[fold_col]][x] = {"known": r[f"n{i}"], "values": set(values) if whole else None, "points": r[f"q{i}"] or []}
    return out


def thresholds(parts: Sequence[dict], x: str, filled: float) -> list[float]:
    """Where trees may split feature ``x`` of the rows that ``parts`` summarise (gaps hold ``filled``), as Spark's trees
    choose: between all values if there are at most ``BINS``, else at quantiles."""
    gaps = sum(p["rows"] - p[x]["known"] for p in parts)
    if all(p[x]["values"] is not None for p in parts):
        values = sorted(set().union(*[p[x]["values"] for p in parts]) | ({filled} if gaps else set()))
        if len(values) <= BINS:
            return [(a + b) / 2 for a, b in zip(values, values[1:])]
    points = [(v, p[x]["known"] / len(p[x]["points"])) for p in parts for v in p[x]["points"]] + ([(filled, gaps)] if gaps else [])
    points.sort()
    total, done, out = sum(w for _, w in points), 0.0, []
    for v, w in points:
        done += w
        if done >= total * (len(out) + 1) / BINS:
            out.append(v)
            while done >= total * (len(out) + 1) / BINS:
                out.append(v)
    return sorted(set(out[:BINS - 1]))


def _bin(value: Column, cuts: Sequence[float], lo: int = 0) -> Column:
    """How many of the ascending ``cuts`` are below ``value``, by halving."""
    if not cuts:
        return F.lit(float(lo))
    mid = len(cuts) // 2
    return F.when(value <= F.lit(float(cuts[mid])), _bin(value, cuts[:mid], lo)).otherwise(_bin(value, cuts[mid + 1:], lo + mid + 1))


def cells_of(train: DataFrame, prep: Prepared, pm: PipelineModel, summaries: dict):
    """The rows of a fold's training set by cell (bin of every numeric feature, every text feature's category): mean
    label, ``__rows`` and ``__cell_features``; and the function that gives prepared rows their ``__cell_features``.

    Spark's trees see a numeric feature by its bin only and choose splits by sums of the rows of a bin, so a tree of squared
    errors is the same for rows and for their means with weights, boosted ones too (rows of a cell have one
    prediction); only between splits that are equally good the rounding of sums may decide otherwise.  There are at most ``BINS`` to the power of the numeric features times the categories, whatever the values."""
    from tabsmith.session import cut_lineage
    early = PipelineModel([st for st in pm.stages if isinstance(st, (ImputerModel, StringIndexerModel))])
    encoder = PipelineModel([st for st in pm.stages if isinstance(st, OneHotEncoderModel)])
    fill = {}
    for st in early.stages:
        if isinstance(st, ImputerModel):
            row = st.surrogateDF.first()
            fill = {x: row[f"__d_{x}"] for x in prep.numeric}
    bins = {f"__b_{x}": _bin(c(f"__i_{x}"), thresholds(list(summaries.values()), x, fill[x])) for x in prep.numeric}
    assembler = VectorAssembler(inputCols=[*bins, *[f"__o_{x}" for x in prep.categorical]], outputCol="__cell_features")
    cats = [f"__x_{x}" for x in prep.categorical]
    found = early.transform(train).withColumns(bins).groupBy(*[c(x) for x in [*bins, *cats]]).agg(
        F.avg("label").alias("label"), F.count("label").cast("double").alias("__rows"))
    return assembler.transform(encoder.transform(cut_lineage(found.where(F.col("__rows") > 0)))), \
        lambda rows: assembler.transform(rows.withColumns(bins))


# Parameters with which Spark's linear regression sees its rows by their moments only (solver "auto", squared error).
MOMENT_MODELS = ("lr", "ridge")
MOMENT_PARAMS = {"regParam", "elasticNetParam", "fitIntercept", "standardization", "maxIter", "tol"}
MOMENT_FEATURES = 64  # more features are fitted to the rows
NO_VARIANCE = 1e-10   # of the largest along an axis of standardised features: what sums may be off


def moments_of(train: DataFrame, prep: Prepared, pm: PipelineModel) -> DataFrame | None:
    """A few weighted rows (``features``, ``label``, ``__rows``) whose count, means and covariances are those of the
    prepared rows of ``train``: m + sqrt(p) s and m - sqrt(p) s for means m and each of the p columns s of the
    covariances' root.  Least squares, penalised or not, depend on nothing else, so their fit is the same.
    From one scan, by sums of centred values; None with more than ``MOMENT_FEATURES`` features or other preparations."""
    import numpy as np
    from pyspark.ml.linalg import Vectors
    early = PipelineModel([st for st in pm.stages if isinstance(st, (ImputerModel, StringIndexerModel))])
    scaler, labels, centre = None, [], []
    for st in pm.stages:
        if isinstance(st, ImputerModel):
            centre = [st.surrogateDF.first()[f"__d_{x}"] for x in prep.numeric]
        elif isinstance(st, StringIndexerModel):
            labels = [len(x) + 1 for x in st.labelsArray]  # the last is an unknown category's
        elif isinstance(st, StandardScalerModel):
            scaler = st
    size = len(prep.numeric) + sum(labels)
    if scaler is None or not 0 < size <= MOMENT_FEATURES or scaler.std.size != size:
        return None
    middle = train.agg(F.avg("label")).first()[0]
    if middle is None:
        return None
    values = [c(f"__i_{x}") - F.lit(float(m)) for x, m in zip(prep.numeric, centre)]
    values += [F.when(c(f"__x_{x}") == i, 1.0).otherwise(0.0) for x, n in zip(prep.categorical, labels) for i in range(n)]
    values.append(F.col("label") - F.lit(float(middle)))
    wide = early.transform(train).select(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    n = len(values)
    r = wide.agg(F.count(F.lit(1)).alias("n"), F.count(F.col(f"v{n - 1}")).alias("known"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(n)],
                 *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    if r["known"] < r["n"]:
        return None  # Spark refuses rows without a label
    mean = np.array([r[f"s{i}"] for i in range(n)]) / r["n"]
    cov = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) / r["n"] - np.outer(mean, mean)
    # to the scaler's features: its means are those of the rows
    std, at = np.append(scaler.std.toArray(), 1.0), np.append(scaler.mean.toArray(), 0.0)
    by = np.divide(1.0, std, out=np.zeros(n), where=std > 0)
    mean = (mean + np.array([*centre, *[0.0] * sum(labels), middle]) - at) * by
    cov = cov * np.outer(by, by)
    if not np.isfinite(cov).all():
        return None  # infinite values
    # features that vary, along the axes of their covariances; along an axis without variance (as the columns of a
    # text's categories have, which add up to 1) a little of it, apart from the label, keeps the equations solvable
    live = np.flatnonzero(by[:-1])
    level, axes = np.linalg.eigh(cov[np.ix_(live, live)])
    known = level > NO_VARIANCE * level.max(initial=0.0)
    level = np.where(known, level, 10 * NO_VARIANCE)
    with_label = np.where(known, axes.T @ cov[live, -1], 0.0) / np.sqrt(level)
    roots = np.zeros((n, n))
    roots[:len(live), live] = (axes * np.sqrt(level)).T
    roots[:len(live), -1] = with_label
    roots[-1, -1] = np.sqrt(max(0.0, cov[-1, -1] - (with_label ** 2).sum()))
    roots *= np.sqrt(n)
    rows = [(Vectors.dense(v[:-1]), float(v[-1]), r["n"] / (2.0 * n)) for v in np.concatenate([mean + roots, mean - roots])]
    return train.sparkSession.createDataFrame(rows, ["features", "label", "__rows"]).coalesce(1)


def _dummy_predict(train: DataFrame, test: DataFrame, task: str) -> DataFrame:
    """Dummy model: training mean (regression) or most frequent class."""
    if task == "regression":
        m = train.agg(F.avg("label")).first()[0]
        return test.withColumn("prediction", F.lit(m).cast("double"))
    top = train.groupBy("label").count().orderBy(F.col("count").desc(), F.col("label")).first()[0]
    return test.withColumn("prediction", F.lit(top).cast("double")) \
               .withColumn("probability", F.array(F.lit(1.0))) \
               .withColumn("__score", F.lit(0.5))


def _score_col(pred: DataFrame) -> DataFrame:
    """``__score``, the positive class's probability, and ``__probs``, those of all classes (null when absent)."""
    if "probability" in pred.columns and not isinstance(pred.schema["probability"].dataType, T.ArrayType):
        pred = pred.withColumn("__probs", vector_to_array("probability"))
    else:
        pred = pred.withColumn("__probs", F.lit(None).cast("array<double>"))
    if "probability" in pred.columns and "__score" not in pred.columns:
        arr = vector_to_array("probability")
        return pred.withColumn("__score", F.when(F.size(arr) > 1, arr[1]).otherwise(F.lit(None).cast("double")))
    if "__score" not in pred.columns:
        return pred.withColumn("__score", F.lit(None).cast("double"))
    return pred


def fit_predict_folds(df: DataFrame, target: str, task: str, models: Sequence[str], fold_col: str = "fold",
                      k: int | None = None, params: dict | None = None, parallelism: int = 4,
                      features: Sequence[str] | None = None, stored: bool = True) -> tuple[DataFrame, dict]:
    """Fit every (model, fold) on the other folds; return the held-out
    predictions of all pairs as one DataFrame (model, fold, label,
    prediction, __score) and the fit seconds per pair.  ``stored=False`` leaves
    the predictions to be made when they are read, for a reader of one scan.

    All rows are learnt from; regression trees are fitted to a fold's cells (``cells_of``), linear regressions to a few
    rows with its moments (``moments_of``)."""
    prep = build_preprocess(df, target, task, features)
    base = stored_input(df, prep, target, fold_col)
    folds = list(range(k)) if k is not None else sorted(r[0] for r in base.select(fold_col).distinct().collect())
    n_classes = 2
    if task == "classification":
        n_classes = df.select(target).distinct().count()

    def prepare(f):
        t0 = time.time()
        return fit_preparation(prep.pipeline, base.where(F.col(fold_col) != f)), time.time() - t0

    def gather(f):
        t0 = time.time()
        return cells_of(base.where(F.col(fold_col) != f), prep, fitted[f][0], {g: seen[g] for g in seen if g is not None and g != f}), time.time() - t0

    def add_up(f):
        t0 = time.time()
        return moments_of(base.where(F.col(fold_col) != f), prep, fitted[f][0]), time.time() - t0

    def fit(pair):
        m, f = pair
        pm, prepared = fitted[f]
        given = (params or {}).get(m)
        t0 = time.time()
        if m == "dummy":
            model = None
        elif f in cells and by_cells(m):
            (table, _), gathered = cells[f]
            prepared += gathered
            model = make_estimator(m, task, given, n_classes).setFeaturesCol("__cell_features").setWeightCol("__rows").fit(table)
        elif by_moments(m) and moments[f][0] is not None:
            table, summed = moments[f]
            prepared += summed
            model = make_estimator(m, task, given, n_classes).setWeightCol("__rows").fit(table)
        else:
            model = make_estimator(m, task, given, n_classes).fit(pm.transform(base.where(F.col(fold_col) != f)))
        return model, prepared + time.time() - t0

    def held_out(m, f):
        train, test = base.where(F.col(fold_col) != f), base.where(F.col(fold_col) == f)
        tr, te = fitted[f][0].transform(train), fitted[f][0].transform(test)
        pred = _score_col(_dummy_predict(tr, te, task) if m == "dummy" else models_of[m, f][0].transform(te))
        return pred.select(F.lit(m).alias("model"), F.lit(f).cast("int").alias("fold"), F.col("label").cast("double").alias("label"),
                           F.col("prediction").cast("double").alias("prediction"), "__score", "__probs")

    def held_out_by_all(f):
        """Regression: a held-out row is prepared once and meets all models."""
        out = fitted[f][0].transform(base.where(F.col(fold_col) == f))
        if f in cells:
            out = cells[f][0][1](out)
        found = []
        for m in models:
            if m == "dummy":
                mean = F.lit(base.where(F.col(fold_col) != f).agg(F.avg("label")).first()[0]).cast("double")
            else:
                out = models_of[m, f][0].setPredictionCol(f"__p_{m}").transform(out)
                mean = F.col(f"__p_{m}").cast("double")
            found.append(F.struct(F.lit(m).alias("model"), mean.alias("prediction")))
        out = out.select(F.col("label").cast("double").alias("label"), F.inline(F.array(*found)))
        return out.select("model", F.lit(f).cast("int").alias("fold"), "label", "prediction", F.lit(None).cast("double").alias("__score"),
                          F.lit(None).cast("array<double>").alias("__probs"))

    def by_cells(m):
        return task == "regression" and m in CELL_MODELS and set((params or {}).get(m) or ()) <= CELL_PARAMS

    def by_moments(m):
        return task == "regression" and m in MOMENT_MODELS and set((params or {}).get(m) or ()) <= MOMENT_PARAMS

    pairs = [(m, f) for m in models for f in folds]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        # imputation, encoding and scaling of a fold are the same for all models
        fitted = dict(zip(folds, ex.map(prepare, folds)))
        cells = {}
        if any(by_cells(m) for m in models):
            seen = numeric_summaries(base, prep, fold_col)
            cells = dict(zip(folds, ex.map(gather, folds)))
        moments = dict(zip(folds, ex.map(add_up, folds))) if any(by_moments(m) for m in models) else {}
        models_of = dict(zip(pairs, ex.map(fit, pairs)))
        parts = list(ex.map(held_out_by_all, folds)) if task == "regression" else [held_out(m, f) for m, f in pairs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    secs = {pair: s for pair, (_, s) in models_of.items()}
    if not stored:
        return out, secs
    # held-out predictions are small (one row per input row and pair); writing
    # them once keeps every metric job a plain scan instead of re-running all
    # fitted pipelines, and survives executor loss
    from tabsmith.session import cut_lineage
    return cut_lineage(out), secs


def fold_metrics(preds: DataFrame, task: str) -> DataFrame:
    """All metrics for all (model, fold) pairs."""
    if task == "regression":
        return regression_metrics(preds, "label", "prediction", by=["model", "fold"])
    # all (model, fold) pairs in the same grouped jobs; models without class
    # probabilities get AUC 0 (as the reference reports for such models)
    # more than two classes: averages over the classes, weighted by their rows
    many = preds.select("label").distinct().count() > 2
    met = classification_metrics(preds, "label", "prediction", "__score", positive=1.0, by=["model", "fold"],
                                 average="weighted" if many else "binary", probs="__probs" if many else None, stored=True)
    return met.withColumn("AUC", F.coalesce(F.col("AUC"), F.lit(0.0))) \
              .select("model", "fold", *[F.col(x) for x in CLASSIFICATION_METRICS])


def cv_leaderboard(df: DataFrame, target: str, task: str, models: Sequence[str] = DEFAULT_MODELS,
                   k: int = 3, key_cols: Sequence[str] | None = None, sort: str | None = None,
                   seed: int = 42, parallelism: int = 4, features: Sequence[str] | None = None,
                   stratified: bool = True) -> tuple[DataFrame, DataFrame]:
    """M6: one row per model with the fold-mean of every metric and the mean
    fit seconds ``TT (Sec)``, sorted by ``sort`` (AUC / R2 high, errors low).
    Returns (leaderboard, per-fold metrics)."""
    from tabsmith.ml.prep import kfold, stratified_kfold
    keys = list(key_cols or df.columns)
    if "fold" not in df.columns:
        df = (stratified_kfold(df, target, keys, k, seed) if task == "classification" and stratified
              else kfold(df, keys, k, seed))
    # the metrics of a regression are one aggregate, whose few rows are kept; those of classes read the predictions often
    preds, secs = fit_predict_folds(df, target, task, models, "fold", k, parallelism=parallelism, features=features,
                                    stored=task != "regression")
    per = fold_metrics(preds, task)
    if task == "regression":
        from tabsmith.session import cut_lineage
        per = cut_lineage(per, len(models) * k)
    names = REGRESSION_METRICS if task == "regression" else CLASSIFICATION_METRICS
    spark = df.sparkSession
    tt = spark.createDataFrame([(m, f, float(s)) for (m, f), s in secs.items()], "model string, fold int, tt double")
    per = per.join(tt, ["model", "fold"])
    board = per.groupBy("model").agg(*[F.avg(x).alias(x) for x in names], F.avg("tt").alias("TT (Sec)"))
    board = board.withColumn("Model", F.col("model"))
    metric = sort or ("R2" if task == "regression" else "Accuracy")
    return leaderboard_sort(board, metric), per


def leaderboard_sort(board: DataFrame, metric: str, models: Sequence[str] | None = None, top: int | None = None) -> DataFrame:
    """Sort by a metric in its better direction; optional subset and top-N."""
    out = board.where(F.col("model").isin(list(models))) if models else board
    key = F.col(metric).desc_nulls_last() if metric in HIGHER_IS_BETTER else F.col(metric).asc_nulls_last()
    out = out.orderBy(key, F.col("model"))
    return out.limit(top) if top else out


def best_by_composite(board: DataFrame) -> DataFrame:
    """Model minimising RMSE - R2."""
    return board.agg(F.min_by("model", F.col("RMSE") - F.col("R2")).alias("best_model"),
                     F.min(F.col("RMSE") - F.col("R2")).alias("score"))


def fold_table(per_fold: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """M7: fold rows plus 'Mean' and 'Std' (population) rows per model."""
    rows = per_fold.select("model", F.col("fold").cast("string").alias("Fold"), *[F.col(x) for x in metrics])
    mean = per_fold.groupBy("model").agg(*[F.avg(x).alias(x) for x in metrics]).withColumn("Fold", F.lit("Mean"))
    std = per_fold.groupBy("model").agg(*[F.stddev_pop(x).alias(x) for x in metrics]).withColumn("Fold", F.lit("Std"))
    return rows.unionByName(mean).unionByName(std)


def _evaluator(task: str, metric: str | None):
    """Spark ML evaluator for a metric by its leaderboard name or its Spark name."""
    from pyspark.ml.evaluation import (
        BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator,
    )
    if task == "regression":
        return RegressionEvaluator(metricName=(metric or "rmse").lower(), labelCol="label", predictionCol="prediction")
    name = {"AUC": "areaUnderROC", "Accuracy": "accuracy", "F1": "f1", "Recall": "weightedRecall",
            "Precision": "weightedPrecision"}.get(metric or "AUC", metric)
    if name in ("areaUnderROC", "areaUnderPR"):
        return BinaryClassificationEvaluator(metricName=name, labelCol="label", rawPredictionCol="rawPrediction")
    return MulticlassClassificationEvaluator(metricName=name, labelCol="label", predictionCol="prediction")


def tune(df: DataFrame, target: str, task: str, model_id: str, grid: dict[str, list], k: int = 3,
         metric: str | None = None, key_cols: Sequence[str] | None = None, seed: int = 42,
         n_iter: int | None = None, parallelism: int = 4,
         features: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
    """M8: grid (or seeded random subset of the grid) search with k folds
    given as a column (0 to k - 1); imputation, encoding and scaling are fitted
    inside each fold, once for all candidates.  ``metric``: RMSE, MAE, MSE, R2 /
    AUC, Accuracy, F1, Recall, Precision (or Spark's names).  Returns one row
    per candidate (params as JSON, mean and std of the metric) and the best params."""
    import itertools
    import random

    from tabsmith.ml.prep import kfold
    keys = list(key_cols or df.columns)
    data = kfold(df, keys, k, seed) if "fold" not in df.columns else df
    prep = build_preprocess(df, target, task, features or [x for x in df.columns if x != "fold"])
    base = stored_input(data, prep, target, "fold")
    # folds are numbered 0 to k - 1, none is empty
    sizes = {r["fold"]: r["count"] for r in base.groupBy("fold").count().limit(k + 1).collect()}
    if set(sizes) != set(range(k)) or k < 2:
        raise ValueError(f"fold must hold each of 0 to {k - 1}, found {sorted(sizes, key=str)}")
    stages = prep.pipeline.getStages()
    if isinstance(stages[0], StringIndexer) and stages[0].getOutputCol() == "label":
        # class numbers are the same in all folds
        base, stages = stages[0].fit(base).transform(base), stages[1:]
    est = make_estimator(model_id, task, n_classes=df.select(target).distinct().count() if task == "classification" else 2)
    names = sorted(grid)
    combos = list(itertools.product(*[grid[n] for n in names]))
    if n_iter is not None and n_iter < len(combos):
        combos = random.Random(seed).sample(combos, n_iter)
    maps = [{est.getParam(n): v for n, v in zip(names, combo)} for combo in combos]
    ev = _evaluator(task, metric)
    inputs = Pipeline(stages=stages)

    def prepare(f):
        train, test = base.where(F.col("fold") != f), base.where(F.col("fold") == f)
        fitted = inputs.fit(train)
        return fitted.transform(train), fitted.transform(test)

    def one(pair):
        f, i = pair
        train, test = folds[f]
        return ev.evaluate(est.fit(train, maps[i]).transform(test))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        # what a fold's rows are prepared by is the same for all candidates
        folds = list(ex.map(prepare, range(k)))
        found = list(ex.map(one, itertools.product(range(k), range(len(maps)))))
    scores = [found[i::len(maps)] for i in range(len(maps))]
    rows = []
    for combo, each in zip(combos, scores):
        rows.append((json.dumps(dict(zip(names, combo)), sort_keys=True), statistics.fmean(each), statistics.pstdev(each)))
    out = df.sparkSession.createDataFrame(rows, "params string, mean_metric double, std_metric double")
    best = max(rows, key=lambda r: r[1]) if ev.isLargerBetter() else min(rows, key=lambda r: r[1])
    return out.withColumn("metric", F.lit(metric or ev.getMetricName())), json.loads(best[0])


def fit_final(df: DataFrame, target: str, task: str, model_id: str, params: dict | None = None,
              features: Sequence[str] | None = None) -> tuple[PipelineModel, Prepared]:
    """Refit preprocessing + model on all rows as one PipelineModel."""
    prep = build_preprocess(df, target, task, features)
    base = model_input(df, prep, target)
    n_classes = df.select(target).distinct().count() if task == "classification" else 2
    pipe = Pipeline(stages=prep.pipeline.getStages() + [make_estimator(model_id, task, params, n_classes)])
    return pipe.fit(base), prep


def holdout_metrics(df: DataFrame, target: str, task: str, model_id: str, key_cols: Sequence[str],
                    test_fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """M9: fit on the hash-selected train rows, score the test rows."""
    from tabsmith.ml.prep import split_train_test
    s = split_train_test(df, key_cols, test_fraction, seed)
    model, prep = fit_final(s.where(F.col("split") == "train").drop("split"), target, task, model_id)
    pred = _score_col(model.transform(model_input(s.where(F.col("split") == "test").drop("split"), prep, target)))
    if task == "regression":
        return regression_metrics(pred, "label", "prediction")
    many = df.select(target).distinct().count() > 2
    return classification_metrics(pred, "label", "prediction", "__score", positive=1.0,
                                  average="weighted" if many else "binary", probs="__probs" if many else None)


def feature_importance(model: PipelineModel, sample: DataFrame) -> DataFrame:
    """Tree importances or |coefficients| of linear models, named after
    the assembled features (one-hot slots as ``col=value``)."""
    est = model.stages[-1]
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray().tolist()
    elif hasattr(est, "coefficients"):
        vals = [abs(v) for v in est.coefficients.toArray().tolist()]
    elif hasattr(est, "coefficientMatrix"):
        m = est.coefficientMatrix.toArray()
        vals = [float(abs(m[:, j]).mean()) for j in range(m.shape[1])]
    else:
        raise ValueError("model has no importances")
    feats = model.transform(sample.limit(1)).schema["features"].metadata
    names = [f"f{i}" for i in range(len(vals))]
    attrs = feats.get("ml_attr", {}).get("attrs", {})
    for group in attrs.values():
        for a in group:
            if a["idx"] < len(names):
                names[a["idx"]] = a["name"].replace("__i_", "").replace("__o_", "")
    rows = sorted(zip(names, vals), key=lambda r: -r[1])
    return sample.sparkSession.createDataFrame([(n, float(v)) for n, v in rows], "feature string, importance double")


def save_model(model: PipelineModel, path: str, meta: dict, reference: DataFrame | None = None) -> None:
    """Model directory plus a one-row metadata table next to it, and the
    features' bounded distributions (``gate.reference_profile``), if given."""
    from pyspark.sql import SparkSession
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta, sort_keys=True), time.time())], "meta string, saved_at double") \
        .write.mode("overwrite").parquet(f"{path}/meta")
    if reference is not None:
        reference.write.mode("overwrite").parquet(f"{path}/reference")


def load_model(spark, path: str) -> tuple[PipelineModel, dict]:
    model = PipelineModel.load(f"{path}/model")
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    return model, meta


def predict(model: PipelineModel, prep: Prepared, df: DataFrame, target: str | None = None,
            label_name: str = "prediction_label", score_name: str = "prediction_score") -> DataFrame:
    """Original columns (target dropped) plus the predicted label and,
    for classifiers, the probability of the predicted class."""
    data = df.drop(target) if target and target in df.columns else df
    out = model.transform(model_input(data, prep, None))
    keep = [c(x) for x in data.columns]
    extra = [F.col("prediction").alias(label_name)]
    if "probability" in out.columns:
        extra.append(F.array_max(vector_to_array("probability")).alias(score_name))
    return out.select(*keep, *extra)


def explain_linear(df: DataFrame, coef: dict[str, float], intercept: float, means: dict[str, float]) -> DataFrame:
    """M17 (linear models): exact per-row contributions coef * (x - mean) for
    every row, base value = prediction at the means."""
    base = intercept + sum(coef[k] * means[k] for k in coef)
    out = df.withColumn("base_value", F.lit(base))
    for k, b in coef.items():
        out = out.withColumn(f"contrib_{k}", F.lit(b) * (c(k).cast("double") - F.lit(means[k])))
    return out


def _explained(scored: DataFrame, cls: str) -> Column:
    """What an explanation adds up to: the probability of class ``cls`` where
    the model gives probabilities, else the predicted value."""
    if "probability" not in scored.columns:
        return F.col("prediction").cast("double")
    return F.element_at(vector_to_array("probability"), F.col(cls).cast("int") + 1)


def explain_sampled(model: PipelineModel, prep: Prepared, df: DataFrame, key_cols: Sequence[str],
                    n_perm: int = 8, seed: int = 42) -> DataFrame:
    """M17 (any model): sampled Shapley values for numeric features.

    Explained is the predicted value, or for classifiers the probability of the
    row's predicted class (``predicted_class``).  Each row gets ``n_perm``
    seeded feature orders; walking an order, the features switch from the
    background mean to the row's value one by one.  All walk steps are rows of
    one DataFrame (explode), scored in one ``model.transform``; a feature's
    contribution is the sum of the values just after its switch less those just
    before it, so one aggregate per row gives all of them, and they sum to
    ``prediction - base_value``.  ``key_cols`` identify a row."""
    feats = list(prep.numeric)
    p = len(feats)
    means = df.agg(*[F.avg(c(x).cast("double")).alias(x) for x in feats]).first().asDict()
    keyed = df.withColumn("__rid", F.to_json(F.struct(*[c(x) for x in key_cols]), {"ignoreNullFields": "false"}))
    base = model.transform(model_input(keyed, prep, None)).select(
        *[c(x) for x in df.columns], "__rid", F.col("prediction").alias("__cls"))
    order = F.array_sort(F.array(*[F.struct(
        hash_bucket([F.col("__rid"), F.col("__perm").cast("string"), F.lit(x)], seed).alias("h"),
        F.lit(i).alias("i")) for i, x in enumerate(feats)]))
    steps = (base.withColumn("__perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
             .withColumn("__order", F.transform(order, lambda s: s["i"]))
             .withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(p)))))
    # feature i uses the row's value when its rank in the order is below the step
    steps = steps.withColumns({x: F.when(F.array_position(F.col("__order"), F.lit(i)) <= F.col("__step"), c(x).cast("double"))
                               .otherwise(F.lit(means[x])) for i, x in enumerate(feats)})
    scored = model.transform(model_input(steps, prep, None))
    scored = scored.select("__rid", "__step", "__order", _explained(scored, "__cls").alias("__y"))
    after, before = F.get("__order", F.col("__step") - 1), F.get("__order", F.col("__step"))
    y = F.col("__y")
    found = scored.groupBy("__rid").agg(
        *[((F.sum(F.when(after == i, y)) - F.sum(F.when(before == i, y))) / n_perm).alias(f"contrib_{x}")
          for i, x in enumerate(feats)],
        F.avg(F.when(F.col("__step") == 0, y)).alias("base_value"),
        F.avg(F.when(F.col("__step") == p, y)).alias("prediction"))
    out = base.join(found, "__rid").drop("__rid")
    return out.withColumnRenamed("__cls", "predicted_class") if prep.task == "classification" else out.drop("__cls")
