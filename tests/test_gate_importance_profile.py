"""Drift gate, permutation importance, one-vs-rest AUC and stored profiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.ml import gate, importance
from tabsmith.ml import metrics as MT
from tabsmith.ml import models as MD
from tabsmith.operators import stored_profile as S


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.range(600).select("id", (F.col("id") % 17).cast("double").alias("x"), F.concat(F.lit("k"), F.col("id") % 3).alias("kind"),
                                 ((F.col("id") % 17) * 3 + F.col("id") % 3).cast("double").alias("y"))
    return df, *MD.fit_final(df.drop("id"), "y", "regression", "lr", features=["x", "kind"])


def test_gate(spark, fitted):
    df, model, prep = fitted
    ref = gate.reference_profile(df, ["x", "kind"])
    assert ref.count() <= 2 * (gate.TOP + 2)
    same = gate.predict_gated(model, prep, ref, df.where("id % 2 = 0"), target="y")
    assert same.columns == ["id", "x", "kind", "prediction_label", "drift_detected", "drift_share"]
    assert not same.first()["drift_detected"] and abs(same.agg(F.avg(F.abs(F.col("prediction_label") - F.col("x") * 3 - F.col("id") % 3))).first()[0]) < 1e-6
    moved = df.withColumns({"x": F.col("x") + 30, "kind": F.when(F.col("id") % 2 == 0, "new").otherwise(F.lit(None))})
    out = gate.predict_gated(model, prep, ref, moved, on_drift="ignore")
    assert not out.first()["drift_detected"]
    scores = {r["feature"]: r["drift_score"] for r in gate.drift_scores(ref, moved).collect()}
    assert scores["kind"] == pytest.approx(1.0) and scores["x"] == pytest.approx(1.0)
    with pytest.raises(gate.DriftDetected) as stop:
        gate.predict_gated(model, prep, ref, moved, on_drift="stop")
    assert set(stop.value.scores) == {"x", "kind"}
    narrow = gate.predict_gated(model, prep, ref, df, target="y", narrow=True, label_name="out")
    assert dict(narrow.dtypes)["x"] == "tinyint" and "out" in narrow.columns
    with pytest.raises(ValueError):
        gate.predict_gated(model, prep, ref, df.drop("x"))


def test_shuffle_is_a_bijection(spark, fitted):
    df, model, prep = fitted
    for n in (1, 2, 6, 97, 600, 1024):
        for x in ("a", "b"):
            a, b = importance.bijection(n, x, 0)
            assert sorted((a * p + b) % n for p in range(n)) == list(range(n))
    out = importance.permutation_importance(model, prep, df, "y", ["id"], repeats=3).collect()
    got = {r["feature"]: r for r in out}
    assert got["x"]["importance"] > 1 > got["kind"]["importance"] > 0 and got["x"]["score"] == pytest.approx(1.0)
    again = importance.permutation_importance(model, prep, df.repartition(13), "y", ["id"], repeats=3).collect()
    assert {r["feature"]: round(r["importance"], 9) for r in again} == {x: round(r["importance"], 9) for x, r in got.items()}
    rows = df.withColumn("__pos", F.col("id")).select("id", "x", "kind", "__pos")
    mixed = importance.shuffled(rows, ["x", "kind"], 600, 1, 42)
    assert mixed.count() == 1200
    one = mixed.where("__feature = 'x'")
    assert one.agg(F.sum("x")).first()[0] == df.agg(F.sum("x")).first()[0] and one.where(F.col("kind") != F.concat(F.lit("k"), F.col("id") % 3)).count() == 0
    assert importance.permutation_importance(model, prep, df.limit(0), "y", ["id"]).count() == 0


def test_one_vs_rest_auc(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in ("a", "b"):
        for _ in range(400):
            y = int(rng.integers(0, 3))
            p = np.round(rng.dirichlet([1, 1, 1]) + np.eye(3)[y] * 0.3, 2)
            rows.append((g, y, [float(v) for v in p]))
    df = spark.createDataFrame(rows, "g string, y int, p array<double>")
    for r in MT.auc_one_vs_rest(df, "y", "p", ["g"], buckets=16).collect():
        own = [(y, p) for g, y, p in rows if g == r["g"]]
        total = 0.0
        for k in range(3):
            pos, neg = [p[k] for y, p in own if y == k], [p[k] for y, p in own if y != k]
            wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
            total += wins / len(neg)
        assert r["AUC"] == pytest.approx(total / len(own))
    assert MT.auc_one_vs_rest(df.limit(0), "y", "p").first()["AUC"] is None


def test_buckets_of_running_sums_are_found_by_halving(spark):
    rows = []
    for n in (0, 1, 2, 3, 7, 8, 254, 255):
        edges = sorted({round(0.5 * k, 1) for k in range(n)})
        rows += [(edges, x) for x in [-1.0, 0.0, 0.25, 0.5, 3.0, 63.5, 127.0, 500.0, float("nan"), None]]
    df = spark.createDataFrame(rows + [(None, 1.0)], "e array<double>, x double")
    out = df.select("e", "x", MT._edges_below(F.col("e"), F.col("x"), 256).alias("got")).collect()
    for r in out:
        want = None if r["e"] is None else 0 if r["x"] is None else sum(e <= r["x"] or r["x"] != r["x"] for e in r["e"])
        assert r["got"] == want
    # a row takes 8 comparisons (a filter of all edges: 255), and the few groups aren't what rows are shuffled by
    scores = spark.range(50).select((F.col("id") % 3).alias("k"), F.col("id").alias("s"), F.lit(1).alias("n"))
    plan = MT.cumulative_sums(scores, "s", ["n"], keys=["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(__e" not in plan and "strategy=broadcast" in plan


def test_leaderboard_of_three_classes(spark, sf):
    from tabsmith.sources.tables import load
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 3).alias("y"), (F.col("o_orderkey") % 3 * 2.0).alias("x"))
    board, per = MD.cv_leaderboard(o, "y", "classification", ["lr", "dummy"], k=2, key_cols=["o_orderkey"], features=["x", "o_totalprice"], sort="AUC")
    got = {r["Model"]: r for r in board.collect()}
    assert got["lr"]["AUC"] > 0.99 and got["dummy"]["AUC"] == 0 and per.count() == 4


def test_merged_profiles(spark):
    rows = [(k // 100, None if k % 7 == 0 else float("nan") if k % 11 == 0 else float(k * k % 1009), "ab" * (k % 5), None) for k in range(1000)]
    df = spark.createDataFrame(rows, "part int, v double, t string, none long")
    merged = {r["column_name"]: r for r in S.merged_profile(S.profile_parts(df, F.col("part"), ["v", "t", "none"])).collect()}
    v = np.array([r[1] for r in rows if r[1] is not None and r[1] == r[1]])
    m = merged["v"]
    assert (m["total_rows"], m["null_count"], m["min"], m["max"]) == (1000, 1000 - len(v), v.min(), v.max())
    assert m["mean"] == pytest.approx(v.mean()) and m["stddev"] == pytest.approx(v.std())
    assert abs(m["distinct_count"] - len(set(v))) <= 0.05 * len(set(v))
    for f, x in zip((0.25, 0.5, 0.75), m["q"]):
        assert abs((v <= x).mean() - f) < 0.02
    assert merged["t"]["avg_length"] == pytest.approx(np.mean([len(r[2]) for r in rows])) and merged["t"]["distinct_count"] == 5
    assert merged["none"]["null_count"] == 1000 and merged["none"]["q"] is None and merged["none"]["mean"] is None
