"""Whole tables decide: no size switches or prefixes; null groups, repeated rows and odd values are kept."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tabsmith.ml import drift, prep
from tabsmith.operators import charts, clean, rows, schema, smote, sqlapi
from tabsmith.sources import files


def test_user_sql_refuses_commands(spark, tmp_path):
    t = spark.createDataFrame([(1, "orders"), (2, "x")], "id int, kind string")
    out = str(tmp_path / "out")
    for sql in (f"WITH t AS (SELECT 1 AS a) INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT * FROM t",
                f"FROM orders INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT id",
                "SELECT 1; DROP TABLE x", "CREATE TABLE x AS SELECT 1", "SET a=b"):
        with pytest.raises(sqlapi.NotAQuery):
            sqlapi.run_sql(spark, sql, {"orders": t})
    assert not os.path.exists(out)


def test_user_sql_leaves_the_text_alone(spark):
    t = spark.createDataFrame([(1, "orders"), (2, "2024")], "id int, kind string")
    tables = {"orders": t}
    assert sqlapi.run_sql(spark, "SELECT id FROM orders WHERE kind = 'orders'", tables).collect()[0][0] == 1
    assert sqlapi.run_sql(spark, "SELECT count(*) AS orders FROM orders", tables).columns == ["orders"]
    assert sqlapi.run_sql(spark, "SELECT id FROM orders WHERE kind RLIKE '[0-9]{4}'", tables).collect()[0][0] == 2
    assert sqlapi.run_sql(spark, "SELECT ';' AS s", {}).collect()[0][0] == ";"
    t.limit(1).createOrReplaceTempView("orders")  # a view of that name survives
    assert sqlapi.run_sql(spark, "SELECT * FROM orders", tables).count() == 2
    assert spark.table("orders").count() == 1
    spark.catalog.dropTempView("orders")


def test_repeated_turns_are_kept(spark):
    t = spark.createDataFrame([(1, 0, "a"), (1, 0, "a"), (1, 1, "b")] + [(2, k, "x") for k in range(40)], "conv_id int, turn int, text string")
    out = rows.truncate_history(t, "conv_id", "turn", max_turns=3, keep_head=2)
    assert out.filter("conv_id = 1").count() == 3
    assert sorted(r["turn"] for r in out.filter("conv_id = 2").collect()) == [0, 1] + list(range(34, 40))


def test_null_groups_are_kept(spark):
    t = spark.createDataFrame([(1.0, "a"), (2.0, None), (3.0, None)], "v double, g string")
    h = charts.histogram(t, "v", 2, ["g"]).agg(F.sum("count")).first()[0]
    assert h == 3
    assert charts.boxplot(t, "v", "g").count() == 2


def test_drift_test_is_the_callers_choice(spark):
    small = spark.range(50).select(F.col("id").cast("double").alias("x"))
    big = spark.range(3000).select((F.col("id") % 50).cast("double").alias("x"))
    for name, label in (("distance", "Wasserstein distance (normed)"), ("p_value", "K-S p_value")):
        assert {drift.drift_report(a, small, test=name).first()["test"] for a in (small, big)} == {label}


def test_sample_fraction_is_the_callers_choice(spark):
    t = spark.range(2000)
    out, fraction = rows.sample_policy(t, ["id"], fraction=0.5)
    assert fraction == 0.5 and 800 < out.count() < 1200
    assert rows.sample_policy(t, ["id"], "tune")[1] == 0.3


def test_types_come_from_all_values(spark):
    t = spark.createDataFrame([("2024-01-01",)] * 5 + [(f"w{k}",) for k in range(268)], "s string")
    assert schema.simplified_types(t).first()[1] == "categorical"
    wide = spark.createDataFrame([(1e20,), (2.0,)], "x double")
    plan = schema.narrow_types_plan(wide)
    assert schema.apply_narrowing(wide, plan).count() == 2 and plan.first()[2] == "double"
    days = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),)], "d date")
    assert prep.detect_task_type(days, "d").first()["task_type"] == "classification"


def test_smote_with_equal_rows(spark):
    data = [(float(i), float(i % 7), "big") for i in range(60)] + [(float(i // 2), 0.5, "small") for i in range(16)]
    t = spark.createDataFrame(data, "a double, b double, y string")
    out = smote.smote(t, "y", ["a", "b"])
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {"big": 60, "small": 60}


def test_balancing_needs_a_target(spark):
    t = spark.createDataFrame([(1.0, "a")], "a double, y string")
    with pytest.raises(ValueError):
        clean.clean(t, clean.CleaningConfig(handle_imbalanced_data=True))


def test_csv_missing_tokens_and_line_breaks(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write('id,v,s,d\n1,1,"two\nlines",2024-01-01\n2,NA,n/a,2024-01-02\n3,3,x,\n')
    out = files.read_csv(spark, path, multiline=True).orderBy("id")
    assert dict(out.dtypes) == {"id": "int", "v": "int", "s": "string", "d": "date"}
    assert [r["v"] for r in out.collect()] == [1, None, 3] and [r["s"] for r in out.collect()] == ["two\nlines", None, "x"]


def test_focus_filter_lets_real_failures_through(spark):
    t = spark.range(3)
    assert rows.focus_filter(t, "id +")[1] is False and rows.focus_filter(t, "missing > 1")[1] is False
    assert rows.focus_filter(t, "id > 1")[1] is True


def test_nan_counts_as_missing(spark):
    from tabsmith.operators import profile as P
    t = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, 3.0), (4, None)], "id int, x double")
    report = {r.feature_name: r for r in P.dataset_report(t, exact=True).collect()}
    assert report["x"].missing_percentage == 50.0 and report["id"].missing_percentage == 0.0
    row = P.describe_numeric(t, ["x"], exact=True).first()
    assert (row["count"], row["mean"], row["max"]) == (2, 2.0, 3.0)
    assert [r.missing_count for r in P.missing_counts(t).collect()] == [2]


def test_weighted_metrics_of_three_classes(spark):
    from tabsmith.ml.metrics import classification_metrics
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 2)] + [(2, 2)] * 4 + [(2, 0)] * 3
    t = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "label double, prediction double")
    got = classification_metrics(t, "label", "prediction", average="weighted").first()
    prec = rec = f1 = 0.0
    for k in (0, 1, 2):
        tp = sum(a == b == k for a, b in pairs)
        n, m = sum(a == k for a, _ in pairs), sum(b == k for _, b in pairs)
        prec, rec, f1 = prec + n * tp / m, rec + tp, f1 + n * 2 * tp / (n + m)
    n = len(pairs)
    assert (got.Precision, got.Recall, got.F1) == pytest.approx((prec / n, rec / n, f1 / n))


def test_tuning_prepares_inside_the_folds_and_takes_metric_names(spark):
    from tabsmith.ml import models as MD
    rows = [(i, float(i % 7), "ab"[i % 2], "yes" if i % 7 + i % 2 > 4 else "no") for i in range(60)]
    t = spark.createDataFrame(rows, "id int, x double, g string, y string")
    out, best = MD.tune(t, "y", "classification", "lr", {"regParam": [0.0, 5.0]}, k=2, metric="Accuracy", key_cols=["id"],
                        features=["x", "g"])
    found = {r.params: r.mean_metric for r in out.collect()}
    assert len(found) == 2 and all(0.0 <= v <= 1.0 for v in found.values()) and out.first().metric == "Accuracy"
    assert best == {"regParam": 0.0}


def test_explanations_add_up_to_the_probability_of_the_predicted_class(spark):
    from tabsmith.ml import models as MD
    t = spark.createDataFrame([(i, float(i % 5), float(i % 3), int(i % 5 > 2)) for i in range(40)],
                              "id int, a double, b double, y int")
    model, prep = MD.fit_final(t, "y", "classification", "lr", {"regParam": 0.1}, features=["a", "b"])
    scores = {r.id: r for r in MD.predict(model, prep, t, "y").collect()}
    rows = MD.explain_sampled(model, prep, t, ["id"], n_perm=2).collect()
    assert len(rows) == 40
    for r in rows:
        assert r.predicted_class == scores[r.id].prediction_label
        assert r.prediction == pytest.approx(scores[r.id].prediction_score)
        assert r.contrib_a + r.contrib_b == pytest.approx(r.prediction - r.base_value, abs=1e-9)
    assert any(0.01 < abs(r.contrib_a) < 0.99 for r in rows)


def test_leaderboard_prepares_each_fold_once(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from tabsmith.ml import models as MD
    fits, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df, *a: fits.append(df) or fit(self, df, *a))
    t = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2], float(3 * (i % 7) + i % 2)) for i in range(60)], "id int, x double, g string, y double")
    board, per = MD.cv_leaderboard(t, "y", "regression", ["lr", "dt", "dummy"], k=2, key_cols=["id"], features=["x", "g"])
    assert board.first()["Model"] == "lr" and per.count() == 6
    # folds are read from the stored columns, not made from keys again by each fit
    assert len(fits) == 2 and all("md5" not in str(df._jdf.queryExecution().optimizedPlan()) for df in fits)


def test_tuning_prepares_each_fold_once(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from tabsmith.ml import models as MD
    fits, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df, *a: fits.append(df) or fit(self, df, *a))
    t = spark.createDataFrame([(i, float(i % 7), float(3 * (i % 7) + i % 2)) for i in range(60)], "id int, x double, y double")
    out, best = MD.tune(t, "y", "regression", "ridge", {"regParam": [0.1, 10.0]}, k=2, key_cols=["id"], features=["x"])
    assert best == {"regParam": 0.1} and len(fits) == 2
    folds, want = prep.kfold(t, ["id"], 2), []
    for f in (0, 1):
        model, p = MD.fit_final(folds.where(F.col("fold") != f), "y", "regression", "ridge", {"regParam": 0.1}, features=["x"])
        want.append(RegressionEvaluator().evaluate(model.transform(MD.model_input(folds.where(F.col("fold") == f), p, "y"))))
    row = out.where("params like '%0.1%'").first()
    assert (row.mean_metric, row.std_metric) == pytest.approx((sum(want) / 2, abs(want[0] - want[1]) / 2))


def test_exact_distinct_counts_keep_no_other_buffers(spark):
    from tabsmith.operators import profile as P
    t = spark.createDataFrame([(0.0, "a", dt.date(2024, 1, 1), [1, 2], True), (-0.0, "", None, [1, 2], False), (float("nan"), None, None, [2], True)],
                              "x double, s string, d date, l array<int>, b boolean")
    for report in (P.profile_table, P.variable_cards):
        out = report(t, exact=True)
        name = "distinct_count" if report is P.profile_table else "distinct"
        assert {r["column_name"]: r[name] for r in out.collect()} == {"x": 1, "s": 2, "d": 1, "l": 2, "b": 2}
        assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["feature_name"]: r["unique_percentage"] for r in P.dataset_report(t, exact=True).collect()}["s"] == 66.67
    empty = P.profile_table(t.limit(0), exact=True).collect()
    assert [(r["total_rows"], r["distinct_count"]) for r in empty] == [(0, 0)] * 5


def test_knn_by_blocks_of_odd_rows(spark, monkeypatch):
    from tabsmith.operators import neighbors as N
    monkeypatch.setattr(N, "BLOCK", 7)
    rows = [(f"r{i}", "a" if i % 3 else "b", [float(i % 11), float(i // 20)]) for i in range(120)]
    odd = [("n", "a", None), ("m", "a", [1.0, None]), ("f", "a", [float("nan"), 1.0]), ("i", "b", [float("inf"), 1.0]), ("g", None, [1.0, 1.0]),
           ("s", "a", [1.0])]
    t = spark.createDataFrame(rows, "id string, y string, v array<double>")
    both = t.unionByName(spark.createDataFrame(odd, "id string, y string, v array<double>"))
    got = N.knn_join(both, "id", "v", 4, "y", cell_rows=10)
    want = N.knn_brute_force(t, "id", "v", 4, "y")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    # pairs are made in blocks, not as rows of a join
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_csv_files_with_line_breaks_are_bounded(spark, tmp_path):
    path = str(tmp_path / "t")
    t = spark.range(1000).select("id", F.concat_ws("\n", F.lit("a"), F.col("id").cast("string")).alias("s"),
                                 F.when(F.col("id") < 999, F.col("id").cast("string")).otherwise("x").alias("v"))
    files.write_csv(t.repartition(1), path, rows_per_file=100)
    assert len([x for x in os.listdir(path) if x.endswith(".csv")]) == 10
    out = files.read_csv(spark, path, multiline=True)
    assert dict(out.dtypes) == {"id": "int", "s": "string", "v": "string"} and out.rdd.getNumPartitions() > 1
    assert sorted(r["s"] for r in out.collect()) == sorted(f"a\n{i}" for i in range(1000))


def test_scores_of_empty_documents_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    con, path = duckdb.connect(), str(tmp_path)
    texts = ["a b c d e", "abc", "", "x y", "", "a  b", "pqrs t", "ab cd"]
    docs = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)] + [(8, "a b", "en", "web", 0)]
    labels = [(i, int(i % 3 == 0 or i == 4), 0) for i in range(9)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    for key in ("classification_metrics", "confusion_matrix", "class_report", "roc_curve", "pr_curve"):
        got = entry.queries()[key](spark, path)
        want = con.sql(entry.oracle_sql()[key])
        rows = [tuple(str(r[x]) for x in want.columns) for r in got.collect()]
        assert sorted(rows) == sorted(tuple(str(v) for v in r) for r in want.fetchall()), key


def test_auc_of_one_class_is_null(spark):
    from tabsmith.ml.metrics import auc
    t = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert auc(t, "y", "s").first()["AUC"] is None


def test_texts_are_counted_before_the_join(spark, sf):
    from tabsmith.sources.tables import load
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = load(spark, sf, "label_features")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "text" not in plan[plan.index("Join"):plan.index("Project", plan.index("Join"))]
    assert plan.index("replace(") > plan.index("Join")


def test_knn_of_values_whose_squares_are_too_large(spark):
    from tabsmith.operators import neighbors as N
    t = spark.createDataFrame([(i, [x, 0.0]) for i, x in enumerate([0.0, 1.0, 3.0, 1e200, -1e200])], "id int, v array<double>")
    assert sorted(N.knn_join(t, "id", "v", 2).collect()) == sorted(N.knn_brute_force(t, "id", "v", 2).collect())


def test_knn_in_many_cells_and_blocks(spark, monkeypatch):
    import time

    import numpy as np

    from tabsmith.operators import neighbors as N
    monkeypatch.setattr(N, "BLOCK", 40)
    monkeypatch.setattr(N, "SLAB", 3)
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, [float(x) for x in rng.integers(0, 60, 2)]) for i in range(1500)]
    t = spark.createDataFrame(rows, "id int, y int, v array<double>")
    want = sorted(N.knn_brute_force(t, "id", "v", 5, "y").collect())
    began = time.time()
    assert sorted(N.knn_join(t, "id", "v", 5, "y", cell_rows=8).collect()) == want
    # what a block needs is found once for each block, not from all cells for each row and cell: 64 cells took minutes
    assert time.time() - began < 60


def test_knn_meets_few_blocks_of_points_on_a_line(spark):
    import numpy as np

    from tabsmith.operators import neighbors as N
    x = np.arange(1000.0)[:, None]
    pivots = np.array([[100.0], [600.0]])
    d = N.distances(x, pivots)
    cell = d.argmin(axis=1)
    order = np.lexsort((d.min(axis=1), cell))
    block = np.empty(1000, int)
    block[order] = np.arange(1000) // 50
    pieces = [(int(j), b, d.min(axis=1)[(block == b) & (cell == j)]) for b in range(20) for j in np.unique(cell[block == b])]
    rings = {"cell": np.array([p[0] for p in pieces]), "block": np.array([p[1] for p in pieces]), "lo": np.array([p[2].min() for p in pieces]),
             "hi": np.array([p[2].max() for p in pieces]), "rows": np.array([len(p[2]) for p in pieces])}
    near, met = np.abs(x - x.T), []
    for b in range(20):
        rows = block == b
        bound = np.sort(near[np.ix_(rows, rows)], axis=1)[:, 5]
        got = N.needed_blocks(d[rows], bound, rings, 5)
        nearest = np.argsort(near[rows], axis=1, kind="stable")[:, :6]
        assert set(block[nearest].ravel().tolist()) <= set(got.tolist())
        met.append(len(got))
    assert np.median(met) <= 4


def test_balanced_cleaning_reads_the_documents_once(spark, sf, monkeypatch):
    from tabsmith.plans import q_clean
    seen, clean = [], q_clean.C.clean
    monkeypatch.setattr(q_clean.C, "clean", lambda df, *a, **k: (seen.append(df.inputFiles()), clean(df, *a, **k))[1])
    q_clean.q_clean_full_balanced(spark, sf)
    assert seen[0] and all("/cut-" in f for f in seen[0])


def _regression_rows(spark):
    """Each fold holds all values beside all others, and no two cells are alike: between splits that are equally good
    only the rounding of sums decides."""
    import numpy as np
    rng = np.random.default_rng(3)
    effect, noise, rows = rng.normal(0, 5, (5, 4, 3)), rng.normal(0, 1, 1080), []
    for i in range(1080):
        x, z, g = i % 5, i // 5 % 4, i // 20 % 3
        y = effect[x, z, g] + noise[i]
        rows.append((i, float(x), [None, float("nan"), 3.0, 7.5][z], [None, "a", "b"][g], float(y), i // 60 % 3))
    return spark.createDataFrame(rows, "id int, x double, z double, g string, y double, fold int")


def test_fits_to_cells_and_moments_are_those_of_the_rows(spark):
    from tabsmith.ml import models as MD
    t = _regression_rows(spark)
    names = ["lr", "ridge", "dt", "lightgbm"]
    preds, _ = MD.fit_predict_folds(t, "y", "regression", names, "fold", 3, features=["x", "z", "g"])
    got = {(r.model, r.fold): (r.R2, r.MAE) for r in MD.regression_metrics(preds, "label", "prediction", ["model", "fold"]).collect()}
    p = MD.build_preprocess(t, "y", "regression", ["x", "z", "g"])
    base = MD.model_input(t, p, "y").coalesce(1)
    for f in (0, 1, 2):
        pm = p.pipeline.fit(base.where(F.col("fold") != f))
        for m in names:
            model = MD.make_estimator(m, "regression").fit(pm.transform(base.where(F.col("fold") != f)))
            want = MD.regression_metrics(model.transform(pm.transform(base.where(F.col("fold") == f))), "label", "prediction").first()
            assert got[m, f] == pytest.approx((want.R2, want.MAE), rel=1e-6), (m, f)


def test_trees_of_a_leaderboard_are_fitted_to_cells(spark, monkeypatch):
    from pyspark.ml import Estimator
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
    from tabsmith.ml import models as MD
    seen = {}
    for kind in (DecisionTreeRegressor, GBTRegressor, LinearRegression):
        monkeypatch.setattr(kind, "fit", lambda self, df, *a, k=kind.__name__: seen.setdefault(k, []).append(df.count()) or Estimator.fit(self, df, *a))
    # 3,000 different values of two features: 32 bins each, however many values there are
    t = spark.range(3000).selectExpr("id", "id * 1.5D AS a", "CAST((id * 7919) % 3001 AS DOUBLE) AS b", "CAST(id % 50 AS DOUBLE) AS y")
    board, per = MD.cv_leaderboard(t, "y", "regression", ["lr", "dt", "lightgbm", "dummy"], k=2, key_cols=["id"], features=["a", "b"])
    assert board.count() == 4 and per.count() == 8
    assert max(seen["DecisionTreeRegressor"] + seen["GBTRegressor"]) <= 32 ** 2 and max(seen["LinearRegression"]) == 6


def test_bins_are_between_values_or_at_quantiles(spark):
    from tabsmith.ml import models as MD
    t = spark.range(4000).selectExpr("CAST(id % 5 AS DOUBLE) AS few", "CAST(id AS DOUBLE) AS many", "CAST(id % 2 AS INT) AS fold", "1.0D AS y")
    prep_ = MD.build_preprocess(t, "y", "regression", ["few", "many"])
    seen = MD.numeric_summaries(MD.model_input(t, prep_, "y"), prep_, "fold")
    assert MD.thresholds(list(seen.values()), "few", 2.0) == [0.5, 1.5, 2.5, 3.5]
    cuts = MD.thresholds(list(seen.values()), "many", 2000.0)
    sizes = [r["count"] for r in t.groupBy(MD._bin(F.col("many"), cuts).alias("b")).count().collect()]
    assert len(cuts) == 31 and len(sizes) == 32 and max(sizes) < 2 * 4000 / 32
