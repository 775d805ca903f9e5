"""Exact quantiles by selection against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators.quantiles import exact_quantiles

FRACTIONS = [0.0, 0.25, 0.5, 0.9, 1.0]


def _frame(spark, n=6000):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(n):
        g = None if k % 3 == 0 else int(rng.integers(0, 3))
        rows.append((g, float(rng.normal() * 10.0 ** rng.integers(-3, 6)), float(rng.integers(0, 4)) if k % 2 else 7.0,
                     None if k % 5 == 0 else float("nan") if k % 7 == 0 else float(k), None, int(k % 11)))
    return rows, spark.createDataFrame(rows, "g long, wild double, few double, gaps double, none double, whole int")


def _want(values):
    v = [x for x in values if x is not None and x == x]
    return [None] * len(FRACTIONS) if not v else np.quantile(v, FRACTIONS).tolist()


@pytest.mark.parametrize("accuracy,most", [(4000, 20_000), (40, 25), (20, 300)])
def test_against_numpy(spark, accuracy, most):
    rows, df = _frame(spark)
    cols = ["wild", "few", "gaps", "none", "whole"]
    got = exact_quantiles(df, cols, FRACTIONS, accuracy=accuracy, most=most).collect()
    assert len(got) == 1
    for i, x in enumerate(cols):
        want = _want([r[i + 1] for r in rows])
        assert got[0][f"q{i}"] == want or np.allclose(got[0][f"q{i}"], want, rtol=1e-12)
    if most != 25:
        return
    grouped = {r["g"]: r for r in exact_quantiles(df, ["wild", "few", "none"], FRACTIONS, by=["g"], accuracy=accuracy, most=most).collect()}
    assert set(grouped) == {None, 0, 1, 2}
    for g, r in grouped.items():
        for i, k in enumerate((1, 2, 4)):
            want = _want([x[k] for x in rows if x[0] == g])
            assert r[f"q{i}"] == want or np.allclose(r[f"q{i}"], want, rtol=1e-12)


def test_small_groups(spark):
    """Few rows: both ends of an interval are one value, and the upper neighbour lies beyond it."""
    rng = np.random.default_rng(7)
    rows = [(n, float(x)) for n in range(1, 60) for x in rng.integers(0, 4 * n, n)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r["g"]: r["q0"] for r in exact_quantiles(df, ["x"], FRACTIONS, by=["g"]).collect()}
    assert len(got) == 59
    for n, q in got.items():
        assert np.allclose(q, np.quantile([x for g, x in rows if g == n], FRACTIONS), rtol=1e-12)


def test_wrong_proposals_are_mended(spark, monkeypatch):
    _, df = _frame(spark, 900)
    from tabsmith.operators import quantiles

    def off(df, keys, cols, fractions, accuracy, real=quantiles._intervals):
        e = real(df, keys, cols, fractions, accuracy)
        return e.withColumn("lo", F.col("lo") + 3).withColumn("hi", F.col("lo") + 1)
    want = exact_quantiles(df, ["wild", "whole"], [0.1, 0.5]).first()
    monkeypatch.setattr(quantiles, "_intervals", off)
    assert exact_quantiles(df, ["wild", "whole"], [0.1, 0.5]).first() == want


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert exact_quantiles(df, ["x"], [0.5]).collect()[0]["q0"] == [None]
    assert exact_quantiles(df, ["x"], [0.5], by=["g"]).count() == 0
    one = spark.createDataFrame([("a", 3.0), ("a", None)], "g string, x double")
    assert exact_quantiles(one, ["x"], [0.0, 0.3], by=["g"]).first()["q0"] == [3.0, 3.0]
