"""Evaluation metrics and tables as aggregates.

Order-dependent statistics (AUC, ROC/PR curves, KS) need running sums over
the distinct scores.  ``cumulative_sums`` computes them without a
single-partition window: approximate quantiles cut the score axis into
buckets, bucket totals are prefixed over the (few) buckets, and the exact
running sum inside a bucket is a window partitioned by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.core import c, safe_div
from tabsmith.operators.quantiles import exact_quantiles


def cumulative_sums(df: DataFrame, order_col: str, value_cols: Sequence[str], buckets: int = 256,
                    descending: bool = False, prefix: str = "cum_", keys: Sequence[str] = (),
                    next_col: str | None = None) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ``order_col`` order, per
    ``keys`` group (one row per distinct (keys, order value) is expected).

    Exact; the buckets only spread the work: approximate quantile edges of
    the order value (a fixed-size sketch per group, computed in-plan) cut each
    group into ``buckets`` ranges, bucket totals are prefixed with a window
    over the bucket table (``buckets`` rows per group), and the running sum
    inside a bucket is a window partitioned by (group, bucket).  NaN is the
    largest order value, as in DuckDB."""
    o = c(order_col).cast("double")
    key = F.when(F.isnan(o), float("-inf")).otherwise(-o) if descending else o
    order = ["__number", "__key"] if descending else ["__key"]  # in falling order NaN comes before the infinite
    ks = list(keys)
    fr = [i / buckets for i in range(1, buckets)]
    t = df.withColumns({"__key": key, "__number": ~F.isnan(o)})
    g = t.groupBy(*[c(k) for k in ks]) if ks else t.groupBy()
    # sketches can't order NaN
    edges = g.agg(F.array_sort(F.array_distinct(F.percentile_approx(F.when(~F.isnan("__key"), F.col("__key")), fr, 10 * buckets))).alias("__e"))
    # one row per group, and groups are few (models x folds, or one): broadcast, as a shuffle by group would gather
    # the whole table in as many tasks as there are groups
    t = t.join(F.broadcast(edges), ks) if ks else t.crossJoin(F.broadcast(edges))
    t = t.withColumn("__bk", _edges_below(F.col("__e"), F.col("__key"), buckets)).drop("__e")
    tot = t.groupBy(*[c(k) for k in ks], "__bk").agg(*[F.sum(c(v)).alias(f"__t_{v}") for v in value_cols],
                                                     F.min("__key").alias("__first"))
    wspec = Window.partitionBy(*[c(k) for k in ks]) if ks else Window
    wb = wspec.orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)  # over buckets only
    extra = []
    if next_col:  # first order value of the next non-empty bucket (growing frame in reverse order)
        wn = wspec.orderBy(F.col("__bk").desc()).rowsBetween(Window.unboundedPreceding, -1)
        extra.append(F.last("__first", ignorenulls=True).over(wn).alias("__nf"))
    off = tot.select(*[c(k) for k in ks], "__bk",
                     *[F.coalesce(F.sum(f"__t_{v}").over(wb), F.lit(0)).alias(f"__o_{v}") for v in value_cols],
                     *extra)
    wi = Window.partitionBy(*[c(k) for k in ks], "__bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = t.join(off, ks + ["__bk"])  # buckets x groups rows
    out = out.withColumns({f"{prefix}{v}": F.sum(c(v)).over(wi) + F.col(f"__o_{v}") for v in value_cols})
    if next_col:
        wl = Window.partitionBy(*[c(k) for k in ks], "__bk").orderBy(*order)
        nxt = F.coalesce(F.lead("__key").over(wl), F.col("__nf"))
        out = out.withColumn(next_col, -nxt if descending else nxt).drop("__nf")
    return out.drop("__bk", "__key", "__number", *[f"__o_{v}" for v in value_cols])


def _edges_below(edges: Column, key: Column, buckets: int) -> Column:
    """How many of the ascending ``edges`` (fewer than ``buckets``) are at most ``key``, by halving: 8 comparisons for
    256 buckets where a filter of the array needs 255."""
    steps = [1 << k for k in range(max(1, (buckets - 1).bit_length()) - 1, -1, -1)]
    found = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda lo, step:
                        F.when(F.get(edges, lo + step - 1) <= key, lo + step).otherwise(lo))
    return F.when(edges.isNotNull(), found).otherwise(F.when(F.isnan(key), 0))  # no edges: every value is NaN, or null


# ---------------------------------------------------------------------------
# regression
# ---------------------------------------------------------------------------

def regression_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE, R2, RMSLE (on absolute values), MAPE (rows with y = 0
    skipped) - one aggregate, optionally per group (e.g. model, fold)."""
    y, p = c(label).cast("double"), c(pred).cast("double")
    e = y - p
    g = df.groupBy(*[c(x) for x in by]) if by else df.groupBy()
    a = g.agg(F.avg(F.abs(e)).alias("MAE"), F.avg(e * e).alias("MSE"),
              F.sum(e * e).alias("_sse"), F.var_pop(y).alias("_vy"), F.count(y).alias("_n"),
              F.avg(F.pow(F.log1p(F.abs(p)) - F.log1p(F.abs(y)), 2)).alias("_msle"),
              F.avg(F.when(y != 0, F.abs(e / y))).alias("MAPE"))
    return a.select(*[c(x) for x in by], "MAE", "MSE", F.sqrt("MSE").alias("RMSE"),
                    (F.lit(1.0) - safe_div(F.col("_sse"), F.col("_vy") * F.col("_n"))).alias("R2"),
                    F.sqrt("_msle").alias("RMSLE"), "MAPE")


# ---------------------------------------------------------------------------
# classification
# ---------------------------------------------------------------------------

def confusion_matrix(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*[c(x) for x in by], c(label).alias("actual"), c(pred).alias("predicted")) \
             .agg(F.count(F.lit(1)).alias("count"))


def auc(df: DataFrame, label: str, score: str, positive=1, buckets: int = 256, by: Sequence[str] = ()) -> DataFrame:
    """Binary ROC AUC by the rank-sum formula with ties counted half (per ``by`` group); null with one class only."""
    pos = (c(label) == F.lit(positive)).cast("long")
    g = df.where(c(score).isNotNull()).groupBy(*[c(x) for x in by], c(score).cast("double").alias("s")).agg(
        F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    cs = cumulative_sums(g, "s", ["n"], buckets, keys=by)
    gg = cs.groupBy(*[c(x) for x in by]) if by else cs.groupBy()
    return gg.agg(safe_div(F.sum(F.col("p") * (F.col("cum_n") - F.col("n") + 0.5 * F.col("n"))),
                           F.sum("p").cast("double") * F.sum("n")).alias("AUC"))


def auc_one_vs_rest(df: DataFrame, label: str, probs: str, by: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """AUC of each class against the rest, averaged by the classes' rows (per ``by`` group).

    ``label`` numbers the classes from 0, ``probs`` is the array of their
    probabilities.  All classes share one bucketed running sum over (class,
    score); rows are counted per distinct score before the shuffle.  Classes
    without rows, or without other rows, have no AUC."""
    keys = [*by, "__class"]
    cells = df.where(c(probs).isNotNull()).select(*[c(x) for x in by], c(label).cast("int").alias("__y"),
                                                  F.posexplode(c(probs)).alias("__class", "__s"))
    pos = (F.col("__y") == F.col("__class")).cast("long")
    g = cells.groupBy(*[c(x) for x in keys], "__s").agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    cs = cumulative_sums(g, "__s", ["n"], buckets, keys=keys)
    per = cs.groupBy(*[c(x) for x in keys]).agg(
        F.sum("p").alias("P"), F.try_divide(F.sum(F.col("p") * (F.col("cum_n") - 0.5 * F.col("n"))),
                                            (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))
    per = per.where(F.col("auc").isNotNull())
    g = per.groupBy(*[c(x) for x in by]) if by else per.groupBy()
    return g.agg(F.try_divide(F.sum(F.col("auc") * F.col("P")), F.sum("P").cast("double")).alias("AUC"))


def classification_metrics(df: DataFrame, label: str, pred: str, score: str | None = None,
                           positive=1, by: Sequence[str] = (), average: str = "binary", probs: str | None = None,
                           stored: bool = False) -> DataFrame:
    """Accuracy, AUC (binary, when a score is given; one against the rest,
    when the array of class probabilities ``probs`` is), Recall, Precision, F1,
    Cohen's Kappa and MCC from the confusion counts - optionally for many
    (e.g. model, fold) groups in the same jobs.  The confusion counts and the AUC read the
    rows six times: their few columns are written once, unless ``df`` is a ``stored`` table.

    ``average="binary"``: Recall, Precision and F1 of the positive class;
    ``"weighted"``: their means over all classes, weighted by the classes' rows."""
    if average not in ("binary", "weighted"):
        raise ValueError(f"average must be binary or weighted, not {average!r}")
    by = list(by)
    if not stored:
        from tabsmith.session import cut_lineage
        df = cut_lineage(df.select(*[c(x) for x in dict.fromkeys([*by, label, pred, score, probs]) if x is not None]))
    cm = confusion_matrix(df, label, pred, by)
    n = F.sum("count")
    diag = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0))
    rows = cm.groupBy(*[c(x) for x in by], "actual").agg(
        F.sum("count").alias("r"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count"))).alias("tp"))
    cols = cm.groupBy(*[c(x) for x in by], F.col("predicted").alias("actual")).agg(F.sum("count").alias("cc"))
    rc = rows.join(cols, by + ["actual"], "full_outer").fillna(0, ["r", "cc", "tp"])
    cmg = cm.groupBy(*[c(x) for x in by]) if by else cm.groupBy()
    tot = cmg.agg(n.cast("double").alias("N"), diag.cast("double").alias("D"),
                 F.sum(F.when((F.col("actual") == positive) & (F.col("predicted") == positive), F.col("count")).otherwise(0))
                 .cast("double").alias("TP"),
                 F.sum(F.when((F.col("actual") != positive) & (F.col("predicted") == positive), F.col("count")).otherwise(0))
                 .cast("double").alias("FP"),
                 F.sum(F.when((F.col("actual") == positive) & (F.col("predicted") != positive), F.col("count")).otherwise(0))
                 .cast("double").alias("FN"))
    rcg = rc.groupBy(*[c(x) for x in by]) if by else rc.groupBy()
    hits = F.col("r") * F.col("tp").cast("double")
    marg = rcg.agg((F.sum("tp") / F.sum("r")).alias("WR"),
                   (F.sum(F.coalesce(safe_div(hits, F.col("cc")), F.lit(0.0))) / F.sum("r")).alias("WP"),
                   (F.sum(2 * hits / (F.col("r") + F.col("cc"))) / F.sum("r")).alias("WF"),
                   F.sum(F.col("r").cast("double") * F.col("cc")).alias("RC"),
                   F.sum(F.col("r").cast("double") * F.col("r")).alias("RR"),
                   F.sum(F.col("cc").cast("double") * F.col("cc")).alias("CC"))
    m = tot.join(marg, by) if by else tot.crossJoin(marg)  # one row per group
    prec = safe_div(F.col("TP"), F.col("TP") + F.col("FP"))
    rec = safe_div(F.col("TP"), F.col("TP") + F.col("FN"))
    f1 = safe_div(2 * prec * rec, prec + rec)
    if average == "weighted":
        prec, rec, f1 = F.col("WP"), F.col("WR"), F.col("WF")
    out = m.select(*[c(x) for x in by],
        (F.col("D") / F.col("N")).alias("Accuracy"),
        F.coalesce(rec, F.lit(0.0)).alias("Recall"), F.coalesce(prec, F.lit(0.0)).alias("Precision"),
        F.coalesce(f1, F.lit(0.0)).alias("F1"),
        F.coalesce(safe_div(F.col("N") * F.col("D") - F.col("RC"), F.col("N") * F.col("N") - F.col("RC")),
                   F.lit(0.0)).alias("Kappa"),
        F.coalesce(safe_div(F.col("N") * F.col("D") - F.col("RC"),
                            F.sqrt((F.col("N") * F.col("N") - F.col("CC")) * (F.col("N") * F.col("N") - F.col("RR")))),
                   F.lit(0.0)).alias("MCC"))
    if probs is not None or score is not None:
        a = auc(df, label, score, positive, by=by) if probs is None else auc_one_vs_rest(df, label, probs, by)
        out = out.join(a, by, "left") if by else out.crossJoin(a)  # one row per group
    return out


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per class precision, recall, F1 and support."""
    cm = confusion_matrix(df, label, pred)
    tp = cm.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("count").alias("tp"))
    sup = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("count").alias("support"))
    prd = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("count").alias("predicted"))
    j = sup.join(prd, "cls", "full_outer").join(tp, "cls", "left").fillna(0, ["tp", "support", "predicted"])
    p = safe_div(F.col("tp"), F.col("predicted"))
    r = safe_div(F.col("tp"), F.col("support"))
    return j.select(F.col("cls").alias("class_value"), F.coalesce(p, F.lit(0.0)).alias("precision"),
                    F.coalesce(r, F.lit(0.0)).alias("recall"),
                    F.coalesce(safe_div(2 * p * r, p + r), F.lit(0.0)).alias("f1"),
                    F.col("support").cast("bigint").alias("support"))


def roc_curve(df: DataFrame, label: str, score: str, positive=1, buckets: int = 256) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, thresholds descending:
    a row predicts positive when score >= threshold."""
    pos = (c(label) == F.lit(positive)).cast("long")
    g = df.groupBy(c(score).cast("double").alias("threshold")).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    cs = cumulative_sums(g, "threshold", ["p", "n"], buckets, descending=True)
    tot = g.agg(F.sum("p").alias("tot_p"), F.sum("n").alias("tot_n"))
    j = cs.crossJoin(tot)  # one-row side
    return j.select("threshold", safe_div(F.col("cum_n"), F.col("tot_n")).alias("fpr"),
                    safe_div(F.col("cum_p"), F.col("tot_p")).alias("tpr"))


def pr_curve(df: DataFrame, label: str, score: str, positive=1, buckets: int = 256) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    pos = (c(label) == F.lit(positive)).cast("long")
    g = df.groupBy(c(score).cast("double").alias("threshold")).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    cs = cumulative_sums(g, "threshold", ["p", "n"], buckets, descending=True)
    tot = g.agg(F.sum("p").alias("tot_p"))
    j = cs.crossJoin(tot)  # one-row side
    return j.select("threshold", safe_div(F.col("cum_p"), F.col("cum_p") + F.col("cum_n")).alias("precision"),
                    safe_div(F.col("cum_p"), F.col("tot_p")).alias("recall"))


def residual_summary(df: DataFrame, label: str, pred: str, exact: bool = False) -> DataFrame:
    """Residual (y - prediction) distribution: mean, std, min, quartiles, max
    and the prediction-error correlation between y and prediction.  Quartiles
    from a bounded sketch, or ``exact`` by distributed selection."""
    y, p = c(label).cast("double"), c(pred).cast("double")
    e = y - p
    aggs = [F.count(e).alias("n"), F.avg(e).alias("mean_residual"), F.stddev_samp(e).alias("std_residual"),
            F.min(e).alias("min_residual"), F.max(e).alias("max_residual"),
            F.coalesce(F.try_divide(F.covar_pop(y, p), F.nullif(F.stddev_pop(y) * F.stddev_pop(p), F.lit(0.0))),
                       F.lit(0.0)).alias("pred_actual_corr")]
    if exact:
        found = exact_quantiles(df.select(e.alias("e")), ["e"], [0.25, 0.5, 0.75]).select(F.col("q0").alias("_q"))
        out = df.agg(*aggs).crossJoin(found)  # one row
    else:
        out = df.agg(*aggs, F.percentile_approx(e, [0.25, 0.5, 0.75], 10000).cast("array<double>").alias("_q"))
    return out.select("n", "mean_residual", "std_residual", "min_residual", F.col("_q")[0].alias("q1_residual"),
                      F.col("_q")[1].alias("median_residual"), F.col("_q")[2].alias("q3_residual"), "max_residual",
                      "pred_actual_corr")


def cooks_distance(df: DataFrame, features: Sequence[str], label: str, pred: str) -> DataFrame:
    """Cook's distance of every row for a linear model with intercept:
    leverage from the p x p normal matrix (one aggregate, inverted on the
    driver, p small), residuals from ``pred``."""
    xs = [F.lit(1.0)] + [c(f).cast("double") for f in features]
    p = len(xs)
    aggs = [F.sum(xs[i] * xs[j]).alias(f"x{i}_{j}") for i in range(p) for j in range(i, p)]
    y, yh = c(label).cast("double"), c(pred).cast("double")
    aggs += [F.sum((y - yh) * (y - yh)).alias("_sse"), F.count(F.lit(1)).alias("_n")]
    r = df.agg(*aggs).first()
    xtx = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            xtx[i, j] = xtx[j, i] = r[f"x{i}_{j}"]
    inv = np.linalg.pinv(xtx)
    mse = r["_sse"] / max(r["_n"] - p, 1)
    h: Column = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            if inv[i, j] != 0.0:
                h = h + xs[i] * xs[j] * F.lit(float(inv[i, j]))
    e = y - yh
    return df.withColumn("leverage", h).withColumn(
        "cooks_distance", (e * e) / F.lit(p * mse) * F.col("leverage") / F.pow(F.lit(1.0) - F.col("leverage"), 2))
