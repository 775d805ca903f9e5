"""Modelling queries (M1-M19) with DuckDB oracles where SQL can express them;
Spark ML fits are registered without an oracle (rows-only check)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions.core import ieee_div, round_doubles
from tabsmith.ml import baselines as BL
from tabsmith.ml import drift as DR
from tabsmith.ml import metrics as MT
from tabsmith.ml import models as MD
from tabsmith.ml import prep as PR
from tabsmith.plans.q_rows import LINEITEM_HASH_KEYS, duck_bucket
from tabsmith.plans.registry import register
from tabsmith.sources.tables import duckdb_view_cte, load

LF = duckdb_view_cte("label_features")
CUT = "TIMESTAMP '2024-01-16 00:00:00'"


def _halves(spark, sf):
    ev = load(spark, sf, "events")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)


# ---------------------------------------------------------------------------
# M1-M3
# ---------------------------------------------------------------------------

@register("detect_task_type", """
SELECT 'quality' AS target, CASE WHEN bool_and(CAST(quality AS DOUBLE) IN (0.0, 1.0)) OR count(DISTINCT quality) < 10
  THEN 'classification' ELSE 'regression' END AS task_type,
  CASE WHEN bool_and(CAST(quality AS DOUBLE) IN (0.0, 1.0)) THEN 'binary_01' WHEN count(DISTINCT quality) < 10
  THEN 'few_integer_values' ELSE 'many_integer_values' END AS reason, count(DISTINCT quality) AS n_distinct FROM labels""")
def q_detect_task_type(spark, sf):
    return PR.detect_task_type(load(spark, sf, "labels"), "quality")


@register("detect_task_type_regression", """
SELECT 'l_extendedprice' AS target, CASE WHEN count(DISTINCT l_extendedprice) <= 5 THEN 'classification'
  ELSE 'regression' END AS task_type, CASE WHEN count(DISTINCT l_extendedprice) <= 5 THEN 'float_few_values'
  ELSE 'float_many_values' END AS reason, count(DISTINCT l_extendedprice) AS n_distinct FROM lineitem""")
def q_detect_task_type_regression(spark, sf):
    return PR.detect_task_type(load(spark, sf, "lineitem"), "l_extendedprice")


@register("split_train_test", f"""
SELECT *, CASE WHEN {duck_bucket(['o_orderkey'])} < {int(0.3 * 2**32)} THEN 'test' ELSE 'train' END AS split FROM orders""")
def q_split_train_test(spark, sf):
    return PR.split_train_test(load(spark, sf, "orders"), ["o_orderkey"], 0.3)


@register("kfold", f"SELECT *, CAST({duck_bucket(['doc_id'])} % 3 AS INTEGER) AS fold FROM labels")
def q_kfold(spark, sf):
    return PR.kfold(load(spark, sf, "labels"), ["doc_id"], 3)


STRAT_SQL = f"""
SELECT doc_id, quality, toxic, CAST((row_number() OVER (PARTITION BY quality ORDER BY {duck_bucket(['doc_id'])}, doc_id) - 1) % 3
  AS INTEGER) AS fold FROM labels"""


@register("stratified_kfold", STRAT_SQL)
def q_stratified_kfold(spark, sf):
    return PR.stratified_kfold(load(spark, sf, "labels"), "quality", ["doc_id"], 3)


# ---------------------------------------------------------------------------
# M12 / M11 with deterministic scorers
# ---------------------------------------------------------------------------

OLS_CTE = """WITH st AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
d AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice AS y, a + b * l_quantity AS p FROM lineitem, st)"""


def _ols(spark, sf):
    li = load(spark, sf, "lineitem")
    st = li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"),
                F.regr_intercept("l_extendedprice", "l_quantity").alias("a"))
    return li.crossJoin(st).withColumn("p", F.col("a") + F.col("b") * F.col("l_quantity"))  # one-row side


@register("regression_metrics", OLS_CTE + """
SELECT round(avg(abs(y - p)), 6) AS MAE, round(avg((y - p) * (y - p)), 2) AS MSE, round(sqrt(avg((y - p) * (y - p))), 6) AS RMSE,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS R2,
  round(sqrt(avg(pow(ln(1 + abs(p)) - ln(1 + abs(y)), 2))), 6) AS RMSLE,
  round(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END), 6) AS MAPE FROM d""")
def q_regression_metrics(spark, sf):
    out = MT.regression_metrics(_ols(spark, sf), "l_extendedprice", "p")
    return round_doubles(out.withColumn("MSE", F.round("MSE", 2)))


SCORED = LF + """, d AS (SELECT doc_id, quality AS y, f_spaces / f_chars AS s,
  CASE WHEN f_spaces / f_chars >= 0.15 THEN 1 ELSE 0 END AS p FROM label_features)"""


def _scored(spark, sf):
    lf = load(spark, sf, "label_features")
    s = ieee_div(F.col("f_spaces"), F.col("f_chars"))
    return lf.select("doc_id", F.col("quality").alias("y"), s.alias("s"), F.when(s >= 0.15, 1).otherwise(0).alias("p"))


@register("classification_metrics", SCORED + """,
cm AS (SELECT y, p, count(*) AS n FROM d GROUP BY 1, 2),
t AS (SELECT CAST(sum(n) AS DOUBLE) AS N, CAST(coalesce(sum(n) FILTER (WHERE y = p), 0) AS DOUBLE) AS D,
  CAST(coalesce(sum(n) FILTER (WHERE y = 1 AND p = 1), 0) AS DOUBLE) AS TP,
  CAST(coalesce(sum(n) FILTER (WHERE y <> 1 AND p = 1), 0) AS DOUBLE) AS FP,
  CAST(coalesce(sum(n) FILTER (WHERE y = 1 AND p <> 1), 0) AS DOUBLE) AS FN FROM cm),
r AS (SELECT y AS k, sum(n) AS r FROM cm GROUP BY 1), cc AS (SELECT p AS k, sum(n) AS c FROM cm GROUP BY 1),
rc AS (SELECT coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM r FULL OUTER JOIN cc ON r.k = cc.k),
m AS (SELECT CAST(sum(r * c) AS DOUBLE) AS RC, CAST(sum(r * r) AS DOUBLE) AS RR, CAST(sum(c * c) AS DOUBLE) AS CC FROM rc),
g AS (SELECT s, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pp, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS nn FROM d GROUP BY s),
w AS (SELECT pp, nn, sum(nn) OVER (ORDER BY s) - nn AS cn FROM g),
a AS (SELECT sum(pp * (cn + 0.5 * nn)) / (sum(pp) * sum(nn)) AS AUC FROM w),
pr AS (SELECT *, TP / NULLIF(TP + FP, 0) AS P_, TP / NULLIF(TP + FN, 0) AS R_ FROM t)
SELECT round(D / N, 6) AS Accuracy, round(coalesce(R_, 0.0), 6) AS Recall, round(coalesce(P_, 0.0), 6) AS Precision,
  round(coalesce(2 * P_ * R_ / NULLIF(P_ + R_, 0), 0.0), 6) AS F1,
  round(coalesce((N * D - RC) / NULLIF(N * N - RC, 0), 0.0), 6) AS Kappa,
  round(coalesce((N * D - RC) / NULLIF(sqrt((N * N - CC) * (N * N - RR)), 0), 0.0), 6) AS MCC,
  round(AUC, 6) AS AUC FROM pr, m, a""")
def q_classification_metrics(spark, sf):
    return round_doubles(MT.classification_metrics(_scored(spark, sf), "y", "p", "s", positive=1))


@register("confusion_matrix", SCORED + " SELECT y AS actual, p AS predicted, count(*) AS count FROM d GROUP BY 1, 2")
def q_confusion_matrix(spark, sf):
    return MT.confusion_matrix(_scored(spark, sf), "y", "p")


@register("roc_curve", SCORED + """,
g AS (SELECT CAST(s AS DOUBLE) AS threshold, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pp, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS nn FROM d GROUP BY 1)
SELECT round(threshold, 6) AS threshold, round(CAST(sum(nn) OVER (ORDER BY threshold DESC) AS DOUBLE) / sum(nn) OVER (), 6) AS fpr,
  round(CAST(sum(pp) OVER (ORDER BY threshold DESC) AS DOUBLE) / sum(pp) OVER (), 6) AS tpr FROM g""")
def q_roc_curve(spark, sf):
    return round_doubles(MT.roc_curve(_scored(spark, sf), "y", "s"))


@register("pr_curve", SCORED + """,
g AS (SELECT CAST(s AS DOUBLE) AS threshold, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pp, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS nn FROM d GROUP BY 1),
c AS (SELECT threshold, sum(pp) OVER (ORDER BY threshold DESC) AS cp, sum(nn) OVER (ORDER BY threshold DESC) AS cn,
  sum(pp) OVER () AS P FROM g)
SELECT round(threshold, 6) AS threshold, round(CAST(cp AS DOUBLE) / (cp + cn), 6) AS precision, round(CAST(cp AS DOUBLE) / P, 6) AS recall FROM c""")
def q_pr_curve(spark, sf):
    return round_doubles(MT.pr_curve(_scored(spark, sf), "y", "s"))


@register("class_report", SCORED + """,
cm AS (SELECT y, p, count(*) AS n FROM d GROUP BY 1, 2),
k AS (SELECT y AS k FROM cm UNION SELECT p FROM cm),
s AS (SELECT k, coalesce((SELECT sum(n) FROM cm WHERE y = k), 0) AS support, coalesce((SELECT sum(n) FROM cm WHERE p = k), 0) AS predicted,
  coalesce((SELECT sum(n) FROM cm WHERE y = k AND p = k), 0) AS tp FROM k)
SELECT k AS class_value, round(coalesce(CAST(tp AS DOUBLE) / NULLIF(predicted, 0), 0.0), 6) AS precision,
  round(coalesce(CAST(tp AS DOUBLE) / NULLIF(support, 0), 0.0), 6) AS recall,
  round(coalesce(2 * (CAST(tp AS DOUBLE) / NULLIF(predicted, 0)) * (CAST(tp AS DOUBLE) / NULLIF(support, 0)) /
    NULLIF(CAST(tp AS DOUBLE) / NULLIF(predicted, 0) + CAST(tp AS DOUBLE) / NULLIF(support, 0), 0), 0.0), 6) AS f1,
  CAST(support AS BIGINT) AS support FROM s""")
def q_class_report(spark, sf):
    return round_doubles(MT.class_report(_scored(spark, sf), "y", "p"))


@register("residual_summary", OLS_CTE + """
SELECT count(y - p) AS n, round(avg(y - p), 4) + 0.0 AS mean_residual, round(stddev_samp(y - p), 4) AS std_residual,
  round(min(y - p), 4) AS min_residual, round(quantile_cont(y - p, 0.25), 4) AS q1_residual,
  round(quantile_cont(y - p, 0.5), 4) AS median_residual, round(quantile_cont(y - p, 0.75), 4) AS q3_residual,
  round(max(y - p), 4) AS max_residual, round(corr(y, p), 6) AS pred_actual_corr FROM d""")
def q_residual_summary(spark, sf):
    out = MT.residual_summary(_ols(spark, sf), "l_extendedprice", "p", exact=True)
    return out.select("n", *[F.round(x, 4).alias(x) for x in out.columns if x.endswith("_residual")],
                      F.round("pred_actual_corr", 6).alias("pred_actual_corr"))


@register("cooks_distance", OLS_CTE + """,
s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, sum((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) *
  (l_quantity - (SELECT avg(l_quantity) FROM lineitem))) AS sxx, sum((y - p) * (y - p)) AS sse FROM d),
h AS (SELECT d.*, 1.0 / n + (l_quantity - mx) * (l_quantity - mx) / sxx AS leverage, sse / (n - 2) AS mse FROM d, s)
SELECT l_orderkey, l_linenumber, round(leverage * 1e6, 4) AS leverage_e6,
  round((y - p) * (y - p) / (2 * mse) * leverage / ((1 - leverage) * (1 - leverage)) * 1e6, 4) AS cooks_distance_e6 FROM h""")
def q_cooks_distance(spark, sf):
    out = MT.cooks_distance(_ols(spark, sf), ["l_quantity"], "l_extendedprice", "p")
    return out.select("l_orderkey", "l_linenumber", F.round(F.col("leverage") * 1e6, 4).alias("leverage_e6"),
                      F.round(F.col("cooks_distance") * 1e6, 4).alias("cooks_distance_e6"))


# ---------------------------------------------------------------------------
# M18 / M19 drift between the first and second half of events
# ---------------------------------------------------------------------------

def _ecdf_sql(col: str) -> str:
    return f"""d AS (SELECT CAST({col} AS DOUBLE) AS x, 1 AS a FROM events WHERE ts < {CUT} AND {col} IS NOT NULL
  UNION ALL SELECT CAST({col} AS DOUBLE), 0 FROM events WHERE ts >= {CUT} AND {col} IS NOT NULL),
g AS (SELECT x, sum(a) AS p, sum(1 - a) AS n FROM d GROUP BY x),
w AS (SELECT x, CAST(sum(p) OVER (ORDER BY x) AS DOUBLE) / sum(p) OVER () AS f,
             CAST(sum(n) OVER (ORDER BY x) AS DOUBLE) / sum(n) OVER () AS h, lead(x) OVER (ORDER BY x) AS xn,
             sum(p) OVER () AS P, sum(n) OVER () AS N FROM g)"""


@register("drift_ks", "WITH " + _ecdf_sql("value") + """
SELECT round(max(abs(f - h)), 6) AS statistic, CAST(max(P) AS BIGINT) AS n_reference, CAST(max(N) AS BIGINT) AS n_current FROM w""")
def q_drift_ks(spark, sf):
    a, b = _halves(spark, sf)
    out = DR.ks_statistic(a, b, "value")
    return out.select(F.round("statistic", 6).alias("statistic"), F.col("n_reference").cast("bigint").alias("n_reference"),
                      F.col("n_current").cast("bigint").alias("n_current"))


def _wass_sql(col: str) -> str:
    return "WITH " + _ecdf_sql(col) + f"""
SELECT round(sum(abs(f - h) * (xn - x)), 6) AS wasserstein,
  round(sum(abs(f - h) * (xn - x)) / (SELECT stddev_pop(CAST({col} AS DOUBLE)) FROM events WHERE ts < {CUT}), 6) AS statistic
FROM w WHERE xn IS NOT NULL"""


@register("drift_wasserstein", _wass_sql("value"))
def q_drift_wasserstein(spark, sf):
    a, b = _halves(spark, sf)
    return round_doubles(DR.wasserstein_normed(a, b, "value"))


def _cat_sql(col: str) -> str:
    return f"""a AS (SELECT CAST({col} AS VARCHAR) AS k, count(*) AS rc FROM events WHERE ts < {CUT} GROUP BY 1),
b AS (SELECT CAST({col} AS VARCHAR) AS k, count(*) AS cc FROM events WHERE ts >= {CUT} GROUP BY 1),
t AS (SELECT coalesce(a.k, b.k) AS k, coalesce(rc, 0) AS rc, coalesce(cc, 0) AS cc FROM a FULL OUTER JOIN b ON a.k IS NOT DISTINCT FROM b.k),
s AS (SELECT k, rc, cc, CAST(rc AS DOUBLE) / (SELECT sum(rc) FROM t) AS ps, CAST(cc AS DOUBLE) / (SELECT sum(cc) FROM t) AS qs,
  (SELECT sum(cc) FROM t) AS C FROM t)"""


@register("drift_chi2", "WITH " + _cat_sql("event_type") + """
SELECT round(sum((cc - ps * C) * (cc - ps * C) / (ps * C)), 6) AS statistic, count(*) - 1 AS dof FROM s WHERE rc > 0""")
def q_drift_chi2(spark, sf):
    a, b = _halves(spark, sf)
    return round_doubles(DR.chi_square(a, b, "event_type"))


def _js_expr() -> str:
    return ("sqrt(greatest(0.0, 0.5 * sum(CASE WHEN ps > 0 THEN ps * log2(ps / ((ps + qs) / 2)) ELSE 0 END) + "
            "0.5 * sum(CASE WHEN qs > 0 THEN qs * log2(qs / ((ps + qs) / 2)) ELSE 0 END)))")


@register("drift_js", "WITH " + _cat_sql("event_type") + f" SELECT round({_js_expr()}, 6) AS statistic FROM s")
def q_drift_js(spark, sf):
    a, b = _halves(spark, sf)
    return round_doubles(DR.jensen_shannon(a, b, "event_type"))


def _drift_report_sql() -> str:
    parts = []
    for col in ("value", "user_id"):
        w = _wass_sql(col).replace("WITH ", "", 1)
        body = w[:w.rindex("\nSELECT")]
        parts.append(f"(WITH {body} SELECT '{col}' AS \"column\", 'num' AS type, 'Wasserstein distance (normed)' AS test, "
                     f"sum(abs(f - h) * (xn - x)) / (SELECT stddev_pop(CAST({col} AS DOUBLE)) FROM events WHERE ts < {CUT}) "
                     f"AS drift_score FROM w WHERE xn IS NOT NULL)")
    parts.append(f"(WITH {_cat_sql('event_type')} SELECT 'event_type', 'cat', 'Jensen-Shannon distance', {_js_expr()} FROM s)")
    parts = [f"SELECT * FROM {p}" for p in parts]
    return f"""WITH r AS ({' UNION ALL '.join(parts)}),
r2 AS (SELECT *, drift_score >= 0.1 AS drift_detected FROM r)
SELECT "column", type, test, round(drift_score, 6) AS drift_score, drift_detected,
  (SELECT CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*) FROM r2) >= 0.5 AS dataset_drift,
  round((SELECT CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*) FROM r2), 6) AS drift_share FROM r2"""


@register("drift_report", _drift_report_sql())
def q_drift_report(spark, sf):
    a, b = _halves(spark, sf)
    return round_doubles(DR.drift_report(a, b, ["value", "user_id", "event_type"]))


@register("drift_distribution", f"""
WITH d AS (SELECT value AS x, 1 AS a FROM events WHERE ts < {CUT} AND value IS NOT NULL
  UNION ALL SELECT value, 0 FROM events WHERE ts >= {CUT} AND value IS NOT NULL),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
i0 AS (SELECT x, a, lo, hi, least(greatest(CAST(floor((x - lo) * (10.0 / (hi - lo))) AS INTEGER), 0), 9) AS i FROM d, r),
i1 AS (SELECT x, a, lo, hi, CASE WHEN x < (CASE WHEN i >= 10 THEN hi ELSE lo + CAST(i AS DOUBLE) * ((hi - lo) / 10.0) END) THEN i - 1 ELSE i END AS i FROM i0),
i2 AS (SELECT a, CASE WHEN i < 9 AND x >= (CASE WHEN i + 1 >= 10 THEN hi ELSE lo + CAST(i + 1 AS DOUBLE) * ((hi - lo) / 10.0) END)
  THEN i + 1 ELSE i END AS bin FROM i1),
g AS (SELECT bin, sum(a) AS rc, sum(1 - a) AS cc FROM i2 GROUP BY bin)
SELECT CAST(b.range AS INTEGER) AS bin, CAST(coalesce(rc, 0) AS BIGINT) AS reference_count, CAST(coalesce(cc, 0) AS BIGINT) AS current_count
FROM range(0, 10) b LEFT JOIN g ON g.bin = b.range""")
def q_drift_distribution(spark, sf):
    a, b = _halves(spark, sf)
    return DR.drift_distribution(a, b, "value", 10)


@register("drift_over_time", f"""
WITH ref AS (SELECT value AS x FROM events WHERE ts < {CUT} AND value IS NOT NULL),
cur AS (SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS period, value AS x FROM events WHERE ts >= {CUT} AND value IS NOT NULL),
rg AS (SELECT x, count(*) AS p FROM ref GROUP BY x),
cg AS (SELECT period, x, count(*) AS n FROM cur GROUP BY 1, 2),
u AS (SELECT x, sum(p) AS p FROM (SELECT x, p FROM rg UNION ALL SELECT x, 0 FROM cg) GROUP BY x),
e AS (SELECT x, CAST(sum(p) OVER (ORDER BY x) AS DOUBLE) / (SELECT sum(p) FROM rg) AS f_le,
  CAST(sum(p) OVER (ORDER BY x) - p AS DOUBLE) / (SELECT sum(p) FROM rg) AS f_lt FROM u),
t AS (SELECT cg.period, cg.n, e.f_le, e.f_lt, sum(n) OVER (PARTITION BY period ORDER BY cg.x) AS cn,
  sum(n) OVER (PARTITION BY period) AS nn FROM cg JOIN e ON cg.x = e.x)
SELECT period, round(max(greatest(abs(f_le - CAST(cn AS DOUBLE) / nn), abs(f_lt - CAST(cn - n AS DOUBLE) / nn))), 6) AS ks_statistic,
  CAST(sum(n) AS BIGINT) AS n_current FROM t GROUP BY period""")
def q_drift_over_time(spark, sf):
    a, b = _halves(spark, sf)
    return round_doubles(DR.drift_over_time(a, b, "value", "ts", "week"))


# ---------------------------------------------------------------------------
# M6 / M7 / L11 closed-form baselines, M16 / M17 on least squares
# ---------------------------------------------------------------------------

def _baseline_sql(outer: str) -> str:
    return f"""WITH f AS (SELECT CAST({duck_bucket(LINEITEM_HASH_KEYS)} % 3 AS INTEGER) AS fold, l_extendedprice AS y, l_quantity AS x FROM lineitem),
per AS (SELECT fold, count(y) AS ny, sum(y) AS sy, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n,
  sum(x) AS sx, sum(y) AS sxy_y, sum(x * y) AS sxy, sum(x * x) AS sxx FROM f GROUP BY fold),
tot AS (SELECT sum(ny) AS t_ny, sum(sy) AS t_sy, sum(n) AS t_n, sum(sx) AS t_sx, sum(sxy_y) AS t_sxy_y, sum(sxy) AS t_sxy, sum(sxx) AS t_sxx FROM per),
tr AS (SELECT fold, t_ny - ny AS ny, t_sy - sy AS sy, t_n - n AS n, t_sx - sx AS sx, t_sxy_y - sxy_y AS sxy_y, t_sxy - sxy AS sxy, t_sxx - sxx AS sxx FROM per, tot),
fits AS (SELECT fold, sy / ny AS train_mean, (n * sxy - sx * sxy_y) / (n * sxx - sx * sx) AS slope, sxy_y, sx, n FROM tr),
fits2 AS (SELECT fold, train_mean, slope, (sxy_y - slope * sx) / n AS intercept FROM fits),
pred AS (SELECT 'dummy' AS model, f.fold, y AS label, train_mean AS prediction FROM f JOIN fits2 USING (fold)
  UNION ALL SELECT 'ols', f.fold, y, intercept + slope * x FROM f JOIN fits2 USING (fold)),
per_fold AS (SELECT model, fold, avg(abs(label - prediction)) AS MAE, avg((label - prediction) * (label - prediction)) AS MSE,
  sqrt(avg((label - prediction) * (label - prediction))) AS RMSE,
  1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(label)) AS R2,
  sqrt(avg(pow(ln(1 + abs(prediction)) - ln(1 + abs(label)), 2))) AS RMSLE,
  avg(CASE WHEN label <> 0 THEN abs((label - prediction) / label) END) AS MAPE FROM pred GROUP BY model, fold)
{outer}"""


_M = ["MAE", "MSE", "RMSE", "R2", "RMSLE", "MAPE"]


def _lineitem_folds(spark, sf):
    return PR.kfold(load(spark, sf, "lineitem"), LINEITEM_HASH_KEYS, 3)


@register("cv_leaderboard_dummy", _baseline_sql(
    "SELECT model, " + ", ".join(f"round(avg({m}), {2 if m == 'MSE' else 6}) AS {m}" for m in _M)
    + " FROM per_fold GROUP BY model"))
def q_cv_leaderboard_dummy(spark, sf):
    board, _ = BL.baseline_leaderboard(_lineitem_folds(spark, sf), "l_extendedprice", "l_quantity")
    return round_doubles(board.withColumn("MSE", F.round("MSE", 2)))


@register("cv_fold_table", _baseline_sql(
    "SELECT model, CAST(fold AS VARCHAR) AS Fold, " + ", ".join(f"round({m}, {2 if m == 'MSE' else 6}) AS {m}" for m in _M)
    + " FROM per_fold UNION ALL SELECT model, 'Mean', " + ", ".join(f"round(avg({m}), {2 if m == 'MSE' else 6})" for m in _M)
    + " FROM per_fold GROUP BY model UNION ALL SELECT model, 'Std', "
    + ", ".join(f"round(stddev_pop({m}), {2 if m == 'MSE' else 6})" for m in _M) + " FROM per_fold GROUP BY model"))
def q_cv_fold_table(spark, sf):
    _, per = BL.baseline_leaderboard(_lineitem_folds(spark, sf), "l_extendedprice", "l_quantity")
    out = MD.fold_table(per, _M)
    return round_doubles(out.withColumn("MSE", F.round("MSE", 2)))


@register("best_by_composite", _baseline_sql(
    "SELECT arg_min(model, RMSE - R2) AS best_model, round(min(RMSE - R2), 6) AS score FROM "
    "(SELECT model, avg(RMSE) AS RMSE, avg(R2) AS R2 FROM per_fold GROUP BY model)"))
def q_best_by_composite(spark, sf):
    board, _ = BL.baseline_leaderboard(_lineitem_folds(spark, sf), "l_extendedprice", "l_quantity")
    return round_doubles(MD.best_by_composite(board))


@register("predict_ols", f"""
WITH s AS (SELECT *, CASE WHEN {duck_bucket(LINEITEM_HASH_KEYS)} < {int(0.3 * 2**32)} THEN 'test' ELSE 'train' END AS split FROM lineitem),
t AS (SELECT count(*) AS n, sum(l_quantity) AS sx, sum(l_extendedprice) AS sy, sum(l_quantity * l_extendedprice) AS sxy,
  sum(l_quantity * l_quantity) AS sxx FROM s WHERE split = 'train'),
fit AS (SELECT (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, sy, sx, n FROM t)
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
  round((sy - b * sx) / n + b * l_quantity, 6) AS prediction_label FROM s, fit WHERE split = 'test'""")
def q_predict_ols(spark, sf):
    s = PR.split_train_test(load(spark, sf, "lineitem"), LINEITEM_HASH_KEYS, 0.3)
    fits = BL.fold_fits(s, "l_extendedprice", "l_quantity", fold_col="split").where(F.col("fold") == "test")
    test = s.where(F.col("split") == "test").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = test.crossJoin(fits)  # one-row side
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                      F.round(F.col("intercept") + F.col("slope") * F.col("l_quantity"), 6).alias("prediction_label"))


@register("explain_linear", """
WITH t AS (SELECT count(*) AS n, sum(l_quantity) AS sx, sum(l_extendedprice) AS sy, sum(l_quantity * l_extendedprice) AS sxy,
  sum(l_quantity * l_quantity) AS sxx FROM lineitem),
fit AS (SELECT (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, sy, sx, n FROM t),
fit2 AS (SELECT b, (sy - b * sx) / n AS a, sx / n AS mx FROM fit)
SELECT l_orderkey, l_linenumber, l_quantity, round(a + b * mx, 6) AS base_value, round(b * (l_quantity - mx), 6) AS contrib_l_quantity
FROM lineitem, fit2""")
def q_explain_linear(spark, sf):
    li = load(spark, sf, "lineitem")
    r = li.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sx"), F.sum("l_extendedprice").alias("sy"),
               F.sum(F.col("l_quantity") * F.col("l_extendedprice")).alias("sxy"),
               F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("sxx")).first()
    b = (r["n"] * r["sxy"] - r["sx"] * r["sy"]) / (r["n"] * r["sxx"] - r["sx"] * r["sx"])
    a = (r["sy"] - b * r["sx"]) / r["n"]
    out = MD.explain_linear(li.select("l_orderkey", "l_linenumber", "l_quantity"), {"l_quantity": b}, a,
                            {"l_quantity": r["sx"] / r["n"]})
    return round_doubles(out)


# ---------------------------------------------------------------------------
# Spark ML estimators (rows-only: no SQL equivalent of the fitted models)
# ---------------------------------------------------------------------------

LF_FEATURES = ["f_chars", "f_spaces"]


@register("cv_leaderboard")
def q_cv_leaderboard(spark, sf):
    df = load(spark, sf, "label_features")
    board, _ = MD.cv_leaderboard(df, "quality", "classification", ["lr", "ridge", "rf", "et", "lightgbm", "dt", "dummy"],
                                 k=3, key_cols=["doc_id"], features=LF_FEATURES, sort="AUC")
    return round_doubles(board.drop("TT (Sec)"))


@register("cv_leaderboard_regression")
def q_cv_leaderboard_regression(spark, sf):
    li = load(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                                            "l_extendedprice", *[x for x in LINEITEM_HASH_KEYS if x not in
                                                                 ("l_returnflag", "l_linestatus")])
    feats = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    board, _ = MD.cv_leaderboard(li, "l_extendedprice", "regression", ["lr", "ridge", "dt", "lightgbm", "dummy"], k=3,
                                 key_cols=LINEITEM_HASH_KEYS, features=feats, sort="R2")
    return round_doubles(board.drop("TT (Sec)"))


@register("tune_ridge")
def q_tune_ridge(spark, sf):
    li = load(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice",
                                            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
                                            "l_returnflag", "l_linestatus")
    out, _best = MD.tune(li.select("l_quantity", "l_discount", "l_tax", "l_extendedprice", *LINEITEM_HASH_KEYS),
                         "l_extendedprice", "regression", "ridge",
                         {"regParam": [0.01, 0.1, 1.0, 10.0]}, k=3, key_cols=LINEITEM_HASH_KEYS)
    return out


@register("holdout_metrics")
def q_holdout_metrics(spark, sf):
    df = load(spark, sf, "label_features")
    return round_doubles(MD.holdout_metrics(df, "quality", "classification", "lr", ["doc_id"]))


@register("feature_importance")
def q_feature_importance(spark, sf):
    li = load(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")
    model, prep = MD.fit_final(li, "l_extendedprice", "regression", "rf", {"numTrees": 10, "maxDepth": 5})
    return MD.feature_importance(model, MD.model_input(li, prep, "l_extendedprice"))


@register("predict_batch")
def q_predict_batch(spark, sf):
    df = load(spark, sf, "label_features")
    model, prep = MD.fit_final(df, "quality", "classification", "lr", features=LF_FEATURES)
    return MD.predict(model, prep, df, target="quality")


@register("explain_sampled")
def q_explain_sampled(spark, sf):
    df = load(spark, sf, "label_features")
    model, prep = MD.fit_final(df.drop("doc_id"), "quality", "classification", "rf", {"numTrees": 10},
                               features=LF_FEATURES)
    return MD.explain_sampled(model, prep, df, ["doc_id"], n_perm=4)


# ---------------------------------------------------------------------------
# M10, M12, M16 through the fitted models: least squares has a closed form
# ---------------------------------------------------------------------------

_OLS2 = """st AS (SELECT covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22, covar_pop(x1, x2) AS s12,
  covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM train),
fit AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM st),
co AS (SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM fit)"""


def _permutation_sql() -> str:
    from tabsmith.ml.importance import bijection  # fixed by feature, repeat and seed; a is raised until it is prime to n
    parts = []
    for x, col in (("o_shippriority", "x1"), ("o_custkey", "x2")):
        a0, b0 = bijection(1, x, 0)
        parts.append(f"SELECT '{x}' AS feature, (SELECT min(a) FROM range({a0}, {a0} + 200) t(a) WHERE gcd(a, (SELECT count(*) FROM r)) = 1) AS a, {b0} AS b")
    return f"""WITH train AS (SELECT o_orderkey % 13 AS x1, o_custkey AS x2, o_totalprice + 5000 * (o_orderkey % 13) + 20 * o_custkey AS y, o_orderkey FROM orders),
{_OLS2},
r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, (SELECT count(*) FROM train) AS n FROM train),
t AS ({' UNION ALL '.join(parts)}),
v AS (SELECT t.feature, r.y, CASE WHEN t.feature = 'o_shippriority' THEN o.x1 ELSE r.x1 END AS x1,
        CASE WHEN t.feature = 'o_custkey' THEN o.x2 ELSE r.x2 END AS x2
      FROM r CROSS JOIN t JOIN r o ON o.pos = (r.pos * t.a + t.b) % r.n),
w AS (SELECT 1 - sum((y - b0 - b1 * x1 - b2 * x2) ** 2) / (var_pop(y) * count(y)) AS score FROM train, co),
s AS (SELECT feature, 1 - sum((y - b0 - b1 * x1 - b2 * x2) ** 2) / (var_pop(y) * count(y)) AS s FROM v, co GROUP BY 1)
SELECT feature, round(score - s, 6) AS importance, 0.0::DOUBLE AS std, round(score, 6) AS score FROM s, w"""


def _priced(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", (F.col("o_orderkey") % 13).alias("o_shippriority"), "o_custkey",
                    (F.col("o_totalprice") + 5000 * (F.col("o_orderkey") % 13) + 20 * F.col("o_custkey")).alias("price"))


@register("feature_importance_permutation", _permutation_sql())
def q_feature_importance_permutation(spark, sf):
    from tabsmith.ml.importance import permutation_importance
    df, feats = _priced(spark, sf), ["o_shippriority", "o_custkey"]
    model, prep = MD.fit_final(df, "price", "regression", "lr", features=feats)
    return round_doubles(permutation_importance(model, prep, df, "price", ["o_orderkey"], feats))


def _gated_sql() -> str:
    def bin_(k: int) -> str:
        return (f"CASE WHEN x{k} IS NULL THEN -2 WHEN x{k} < lo{k} THEN -1 WHEN x{k} > hi{k} THEN 32 "
                f"ELSE CAST(least(floor((x{k} - lo{k}) / ((hi{k} - lo{k}) / 32)), 31) AS INTEGER) END")
    js = ("sqrt(greatest(0, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + "
          "0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)))")
    return f"""WITH o AS (SELECT o_orderkey, o_orderkey % 13 AS x1, o_custkey AS x2,
        o_totalprice + 5000 * (o_orderkey % 13) + 20 * o_custkey AS y FROM orders),
train AS (SELECT * FROM o WHERE o_orderkey % 5 <> 0), {_OLS2},
batch AS (SELECT 'same' AS batch, o_orderkey, x1, CAST(x2 AS DOUBLE) AS x2 FROM o WHERE o_orderkey % 5 = 0
          UNION ALL SELECT 'moved', o_orderkey, x1, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE x2 * 1.5 + 400 END FROM o WHERE o_orderkey % 5 = 0),
e AS (SELECT min(x1) AS lo1, max(x1) AS hi1, min(x2) AS lo2, max(x2) AS hi2, avg(x2) AS fill FROM train),
c AS (SELECT 'train' AS side, 'x1' AS f, {bin_(1)} AS bin FROM train, e
      UNION ALL SELECT 'train', 'x2', {bin_(2)} FROM train, e
      UNION ALL SELECT batch, 'x1', {bin_(1)} FROM batch, e
      UNION ALL SELECT batch, 'x2', {bin_(2)} FROM batch, e),
h AS (SELECT side, f, bin, count(*) AS n, sum(count(*)) OVER (PARTITION BY side, f) AS m FROM c GROUP BY 1, 2, 3),
k AS (SELECT b.batch, f.f, g.bin FROM (SELECT DISTINCT batch FROM batch) b, (SELECT DISTINCT f FROM h) f, (SELECT DISTINCT f, bin FROM h) g WHERE f.f = g.f),
j AS (SELECT k.batch, k.f, coalesce(t.n / t.m, 0) AS p, coalesce(u.n / u.m, 0) AS q FROM k
      LEFT JOIN h t ON t.side = 'train' AND t.f = k.f AND t.bin = k.bin LEFT JOIN h u ON u.side = k.batch AND u.f = k.f AND u.bin = k.bin),
s AS (SELECT batch, f, {js} AS score FROM j GROUP BY 1, 2),
d AS (SELECT batch, avg(CASE WHEN score >= 0.2 THEN 1.0 ELSE 0.0 END)::DOUBLE AS drift_share FROM s GROUP BY 1)
SELECT batch.batch, o_orderkey, round(b0 + b1 * x1 + b2 * coalesce(x2, fill), 2) AS price_predicted, drift_share >= 0.5 AS drift_detected, drift_share
FROM batch JOIN d USING (batch), co, e"""


@register("predict_gated", _gated_sql())
def q_predict_gated(spark, sf):
    """Saved model with its features' distributions; a batch like the training rows, and one that has moved."""
    import uuid

    from tabsmith.ml import gate
    from tabsmith.session import scratch_path
    df, feats = _priced(spark, sf), ["o_shippriority", "o_custkey"]
    train, rest = df.where(F.col("o_orderkey") % 5 != 0), df.where(F.col("o_orderkey") % 5 == 0)
    model, prep = MD.fit_final(train, "price", "regression", "lr", features=feats)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    MD.save_model(model, path, {"task": "regression"}, gate.reference_profile(train, feats))
    model, _ = MD.load_model(spark, path)
    moved = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey") * 1.5 + 400)
    batches = {"same": rest.withColumn("o_custkey", F.col("o_custkey").cast("double")), "moved": rest.withColumn("o_custkey", moved)}
    out = None
    for name, batch in batches.items():
        one = gate.predict_gated(model, prep, gate.load_reference(spark, path), batch, target="price", threshold=0.2,
                                 label_name="price_predicted").withColumn("batch", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("batch", "o_orderkey", F.round("price_predicted", 2).alias("price_predicted"), "drift_detected", "drift_share")


_MULTI = """WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y,
  (o_totalprice % 97) / 97 + CASE WHEN o_orderstatus = 'F' THEN 0.3 ELSE 0 END AS a, (o_orderkey % 89) / 89 AS b, (o_custkey % 83) / 83 AS c FROM orders),
d AS (SELECT y, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2,
  CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS p FROM r WHERE a + b + c > 0)"""


@register("classification_metrics_multi", _MULTI + """,
cell AS (SELECT 0 AS k, p0 AS s, y FROM d UNION ALL SELECT 1, p1, y FROM d UNION ALL SELECT 2, p2, y FROM d),
g AS (SELECT k, s, sum((y = k)::INT) AS pp, sum((y <> k)::INT) AS nn FROM cell GROUP BY 1, 2),
w AS (SELECT k, pp, nn, sum(nn) OVER (PARTITION BY k ORDER BY s) - nn AS cn FROM g),
au AS (SELECT k, sum(pp) AS P, sum(pp * (cn + 0.5 * nn)) / (sum(pp) * sum(nn)) AS auc FROM w GROUP BY 1),
cm AS (SELECT y, p, count(*) AS n FROM d GROUP BY 1, 2),
per AS (SELECT k, (SELECT sum(n) FROM cm WHERE y = k) AS r, coalesce((SELECT sum(n) FROM cm WHERE p = k), 0) AS c,
          coalesce((SELECT sum(n) FROM cm WHERE y = k AND p = k), 0) AS tp FROM (SELECT unnest([0, 1, 2]) AS k)),
t AS (SELECT sum(r) AS n, sum(tp) AS tp, sum(tp) / sum(r) AS wr, sum(r * coalesce(tp / nullif(c, 0), 0)) / sum(r) AS wp,
        sum(r * 2 * tp / (r + c)) / sum(r) AS wf, sum(r * c) AS rc, sum(r * r) AS rr, sum(c * c) AS cc FROM per)
SELECT round(tp / n, 6) AS Accuracy, round(wr, 6) AS Recall, round(wp, 6) AS Precision, round(wf, 6) AS F1,
  round((n * tp - rc) / (n * n - rc), 6) AS Kappa, round((n * tp - rc) / sqrt((n * n - cc)::DOUBLE * (n * n - rr)), 6) AS MCC,
  round((SELECT sum(auc * P) / sum(P) FROM au), 6) AS AUC FROM t""")
def q_classification_metrics_multi(spark, sf):
    """Three classes: averages by class, and AUC of each class against the rest."""
    o = load(spark, sf, "orders")
    y = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    a = (F.col("o_totalprice") % 97) / 97 + F.when(F.col("o_orderstatus") == "F", 0.3).otherwise(0.0)
    d = o.select(y.alias("y"), a.alias("a"), (F.col("o_orderkey") % 89 / 89).alias("b"), (F.col("o_custkey") % 83 / 83).alias("c"))
    total = F.col("a") + F.col("b") + F.col("c")
    p = F.when((F.col("a") >= F.col("b")) & (F.col("a") >= F.col("c")), 0).when(F.col("b") >= F.col("c"), 1).otherwise(2)
    d = d.where(total > 0).select("y", F.array(*[F.col(x) / total for x in "abc"]).alias("probs"), p.alias("p"))
    return round_doubles(MT.classification_metrics(d, "y", "p", average="weighted", probs="probs"))


def _shapley_sql() -> str:
    """All six orders of three features, by the function that the tree has learned."""
    import itertools
    f = lambda a, b, c: f"(10 * {a} + 5 * {b} + 7 * {a} * {b} - 3 * {b} * {c} + {c})"
    terms = {x: [] for x in "abc"}
    for order in itertools.permutations("abc"):
        at = {x: f"{x}0" for x in "abc"}
        for x in order:
            before = f(*[at[k] for k in "abc"])
            at[x] = x
            terms[x].append(f"{f(*[at[k] for k in 'abc'])} - {before}")
    sums = ", ".join(f"round(({' + '.join(t)}) / 6.0, 6) + 0.0 AS contrib_{x}" for x, t in terms.items())
    return f"""WITH d AS (SELECT o_orderkey, (o_orderkey % 3 = 0)::INT AS a, (o_custkey % 4 = 0)::INT AS b, (o_orderkey % 5 <> 0)::INT AS c FROM orders),
m AS (SELECT 0 AS a0, 0 AS b0, 1 AS c0)
SELECT o_orderkey, {sums}, round({f('a0', 'b0', 'c0')}, 6)::DOUBLE AS base_value, round({f('a', 'b', 'c')}, 6)::DOUBLE AS prediction FROM d, m"""


@register("explain_trees", _shapley_sql())
def q_explain_trees(spark, sf):
    """Exact contributions of a tree, equal to walking all orders of its three features."""
    from tabsmith.ml.explain_trees import explain_trees
    d = load(spark, sf, "orders").select("o_orderkey", *[e.cast("int").alias(x) for x, e in (
        ("a", F.col("o_orderkey") % 3 == 0), ("b", F.col("o_custkey") % 4 == 0), ("c", F.col("o_orderkey") % 5 != 0))])
    a, b, c = (F.col(x) for x in "abc")
    d = d.withColumn("y", 10 * a + 5 * b + 7 * a * b - 3 * b * c + c)
    model, prep = MD.fit_final(d, "y", "regression", "dt", {"maxDepth": 4}, features=["a", "b", "c"])
    # the row to compare with: the most frequent values
    common = spark.createDataFrame([(0, 0, 1)], "a int, b int, c int")
    out = explain_trees(model, prep, d.select("o_orderkey", "a", "b", "c"), common)
    return round_doubles(out.drop("a", "b", "c"))
