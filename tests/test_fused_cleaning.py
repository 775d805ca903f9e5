"""The cleaning job fits its steps together: same values as step by step, in few scans."""

import math

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import clean as C


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, None if k % 10 == 3 else float("nan") if k % 10 == 4 else float(k % 37) * (50 if k % 211 == 0 else 1), k % 5,
             None if k % 8 == 1 else "abcdefg"[k * k % 7], 4.0, "same", None) for k in range(3000)]
    return spark.createDataFrame(rows, "id long, value double, small long, kind string, const double, same string, none string")


def _counting(df, counter):
    def run(batches):
        for b in batches:
            counter.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema)


CONFIGS = [dict(handle_missing_values=True, handle_outliers=True, feature_scaling=True, reduce_cardinality=True, max_unique_categories=3,
                encode_categorical_values=True),
           dict(handle_missing_values=True, numeric_missing_strategy="median", handle_outliers=True, feature_scaling=True),
           dict(handle_outliers=True, outlier_z=50.0, feature_scaling=True, reduce_cardinality=True, max_unique_categories=2),
           dict(feature_scaling=True), dict(handle_missing_values=True)]


@pytest.mark.parametrize("n", range(len(CONFIGS)))
def test_same_as_step_by_step(table, n):
    cfg = C.CleaningConfig(**CONFIGS[n], id_col="id")
    got = C.clean(table, cfg)
    assert got.report["dropped_constant"] == ["const", "same", "none"]
    out, num, cat = table.drop("const", "same", "none"), ["value", "small"], ["kind"]
    want = {}
    if cfg.handle_missing_values:
        want["impute_numeric"] = C.fit_impute_numeric(out, num, cfg.numeric_missing_strategy)
        out = C.impute_numeric(out, want["impute_numeric"])
    if cfg.handle_outliers:
        want["cap"] = C.fit_cap(out, num, cfg.outlier_z)
        out = C.cap(out, want["cap"])
    if cfg.feature_scaling:
        want["scale"] = C.fit_scale(out, num)
    if cfg.handle_missing_values:
        want["impute_categorical"] = C.fit_mode(out, cat)
        out = C.impute_categorical(out, want["impute_categorical"])
    if cfg.reduce_cardinality:
        want["reduce"] = C.fit_reduce_cardinality(out, cat, cfg.max_unique_categories)
        out = C.reduce_cardinality(out, want["reduce"])
    if cfg.encode_categorical_values:
        want["one_hot"] = C.fit_one_hot(out, cat)
    assert set(got.fitted) == set(want)
    for step, values in want.items():
        for x, v in values.items():
            mine = got.fitted[step][x]
            if step in ("cap", "scale"):
                assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(mine, v))
            elif step == "impute_numeric":
                assert math.isclose(mine, v, rel_tol=1e-12)
            else:
                assert mine == v


def test_scans_are_few(spark, table):
    counter = spark.sparkContext.accumulator(0)
    C.clean(_counting(table, counter), C.CleaningConfig(**CONFIGS[0], id_col="id"))
    assert counter.value == 3 * 3000  # all statistics; columns that the cap changes; the proposed categories
    counter = spark.sparkContext.accumulator(0)
    C.clean(_counting(table, counter), C.CleaningConfig(handle_missing_values=True, handle_outliers=True, outlier_z=500.0, feature_scaling=True,
                                                       id_col="id"))
    assert counter.value == 2 * 3000


def test_empty_and_target(spark, table):
    cfg = C.CleaningConfig(**CONFIGS[0])
    assert C.clean(table.limit(0), cfg).df.count() == 0
    out = C.clean(table.withColumn("y", (F.col("id") % 4 == 0).cast("int")), C.CleaningConfig(
        **{**CONFIGS[0], "remainder": "drop"}, id_col="id", handle_imbalanced_data=True), target="y").df
    n = {r["y"]: r["n"] for r in out.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {0: 2250, 1: 2250} and out.where("is_synthetic").where("id IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        C.clean(table, C.CleaningConfig(handle_imbalanced_data=True))
