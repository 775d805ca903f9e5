"""Exact contributions of tree models against walking all orders of the features."""

import itertools

import pytest
from pyspark.sql import functions as F

from tabsmith.ml import models as MD
from tabsmith.ml.explain_trees import explain_trees


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(400).select("id", (F.col("id") % 13).cast("double").alias("u"), (F.col("id") * F.col("id") * 7 % 10).cast("double").alias("v"),
                                   (F.col("id") * F.col("id") * 3 % 11).cast("double").alias("w"), F.concat(F.lit("k"), F.col("id") % 3).alias("kind")) \
                .withColumn("y", F.col("u") * F.col("v") - F.col("w") * F.col("w") + F.when(F.col("u") > 6, F.col("w") * 5).otherwise(0)) \
                .withColumn("z", (F.col("y") + F.when(F.col("kind") == "k1", 20).otherwise(0) > 20).cast("int"))


def _scores(model, prep, rows, cls):
    out = model.transform(MD.model_input(rows, prep, None))
    if cls:
        from pyspark.ml.functions import vector_to_array
        out = out.withColumn("prediction", F.element_at(vector_to_array("probability"), F.col("cls") + 1))
    return {(r["id"], r["s"]): r["prediction"] for r in out.select("id", "s", "prediction").collect()}


@pytest.mark.parametrize("task,target,model_id", [("regression", "y", "rf"), ("regression", "y", "lightgbm"), ("regression", "y", "dt"),
                                                  ("classification", "z", "rf")])
def test_all_orders(table, task, target, model_id):
    feats, few = ["u", "v", "w"], table.where("id % 40 = 3")
    params = {"rf": {"numTrees": 4, "maxDepth": 4}, "dt": {"maxDepth": 5}, "lightgbm": {"maxIter": 4, "maxDepth": 3}}[model_id]
    model, prep = MD.fit_final(table, target, task, model_id, params, features=feats)
    every = explain_trees(model, prep, table.select("id", *feats))  # the background is the whole table's
    got = {r["id"]: r for r in every.where("id % 40 = 3").collect()}
    means = table.agg(*[F.avg(x).alias(x) for x in feats]).first()
    rows = few.select("id", *feats)
    if task == "classification":
        cls = model.transform(MD.model_input(rows, prep, None)).select("id", F.col("prediction").cast("int").alias("cls"))
        rows = rows.join(cls, "id")
    mixed = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(7))))
    mixed = mixed.withColumns({x: F.when(F.col("s").bitwiseAND(1 << k) > 0, F.col(x)).otherwise(F.lit(means[x])) for k, x in enumerate(feats)})
    score = _scores(model, prep, mixed, task == "classification")
    assert len(got) == 10
    for i, r in got.items():
        want = dict.fromkeys(feats, 0.0)
        for order in itertools.permutations(range(3)):
            s = 0
            for k in order:
                want[feats[k]] += (score[i, s | 1 << k] - score[i, s]) / 6
                s |= 1 << k
        for x in feats:
            assert r[f"contrib_{x}"] == pytest.approx(want[x], abs=1e-9)
        assert r["base_value"] == pytest.approx(score[i, 0]) and r["prediction"] == pytest.approx(score[i, 7])


@pytest.mark.parametrize("task,target,model_id", [("regression", "y", "rf"), ("classification", "z", "et")])
def test_text_features_and_sums(table, task, target, model_id):
    model, prep = MD.fit_final(table, target, task, model_id, {"numTrees": 5, "maxDepth": 5}, features=["u", "v", "kind"])
    out = explain_trees(model, prep, table)
    assert {"contrib_u", "contrib_v", "contrib_kind", "base_value", "prediction"} <= set(out.columns) and out.count() == 400
    gap = F.abs(F.col("contrib_u") + F.col("contrib_v") + F.col("contrib_kind") + F.col("base_value") - F.col("prediction"))
    assert out.agg(F.max(gap)).first()[0] < 1e-9
    scored = _scores(model, prep, table.withColumn("s", F.lit(0)), False)
    for r in out.collect():
        if task == "regression":
            assert r["prediction"] == pytest.approx(scored[r["id"], 0])
        else:
            assert r["predicted_class"] == scored[r["id"], 0] and 0.4 < r["prediction"] <= 1
    assert out.agg(F.max(F.abs("contrib_kind"))).first()[0] > 0
    assert explain_trees(model, prep, table.limit(0)).count() == 0
