"""Frequent values against full counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import frequent


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcde"), str(k), None if k % 3 == 0 else rng.choice(["x", "y"]), int(rng.paretovariate(0.7)), None, k % 2 == 0)
            for k in range(12_000)]
    schema = "few string, key string, gaps string, tail long, none string, flag boolean"
    return rows, schema.replace(",", "").split()[::2], spark.createDataFrame(rows, schema)


def _text(v):
    return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("null", [False, True])
def test_top_values(table, null):
    rows, names, df = table
    got = {}
    for r in frequent.top_values(df, names, 7, include_null=null).collect():
        got.setdefault(r["column_name"], {})[r["rank"]] = (r["value"], r["count"])
    for i, x in enumerate(names):
        n = Counter(_text(r[i]) for r in rows)
        if not null:
            n.pop(None, None)
        want = sorted(n.items(), key=lambda v: (-v[1], v[0] is not None, v[0] or ""))[:7]
        assert [got.get(x, {}).get(k + 1) for k in range(len(want))] == want and len(got.get(x, {})) == len(want)


def test_values_that_the_sketch_may_lose(spark, monkeypatch):
    monkeypatch.setattr(frequent, "TRACKED", 16)
    monkeypatch.setattr(frequent, "CANDIDATES", 10)
    monkeypatch.setattr(frequent, "_MISSED", 7 / 16)
    # one value above the bound, then many that differ by little: only the first may be trusted
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 997).cast("string")).alias("v"))
    n = Counter("hot" if k % 2 == 0 else str(k % 997) for k in range(20_000))
    for k in (1, 5):
        want = sorted(n.items(), key=lambda v: (-v[1], v[0]))[:k]
        assert [(r["value"], r["count"]) for r in frequent.top_values(df, ["v"], k).orderBy("rank").collect()] == want


def test_small_counts(table, spark):
    rows, names, df = table
    got = {(r["column_name"], r["value"]): (r["count"], r["n_unique"]) for r in frequent.small_value_counts(df, names, 5).collect()}
    want = {}
    for i, x in enumerate(names):
        n = Counter(_text(r[i]) for r in rows)
        distinct = len(set(n) - {None})
        if 0 < distinct <= 5:
            want.update({(x, v): (k, distinct) for v, k in n.items()})
    assert got == want and ("gaps", None) in got
    empty = spark.createDataFrame([], "a string")
    assert frequent.top_values(empty, ["a"], 3).count() == 0 and frequent.small_value_counts(empty, ["a"], 3).count() == 0


def test_the_shuffle_holds_candidates(spark):
    df = spark.range(200_000).select((F.col("id") % 50_000).cast("string").alias("v"))
    named, sizes, _ = frequent.candidates(df, ["v"])
    assert sizes == {"v": (200_000, 200_000)} and named.count() <= frequent.CANDIDATES
