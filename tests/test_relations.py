"""Foreign keys from the inverted value index."""

from pyspark.sql import functions as F

from tabsmith.operators import relate as J


def _edges(out):
    return sorted((r["child_table"], r["child_column"], r["parent_table"], r["parent_column"], r["child_distinct"]) for r in out.collect())


def test_many_columns_kinds_and_nulls(spark):
    wide = spark.range(50).select(*[(F.col("id") + k).alias(f"w{k}_key") for k in range(70)])  # more than one mask word
    parent = spark.createDataFrame([(1, "a", "x" * 100), (2, "b", "y" * 100), (3, "c", "z" * 100)], "p int, code string, long string")
    child = spark.createDataFrame([(1, "a", "x" * 100, None), (1, None, "y" * 100, 7), (3, "c", None, 7), (None, "c", None, 2)],
                                  "p_key long, code_key string, long_key string, other_key int")
    out = _edges(J.inclusion_dependencies({"wide": wide, "parent": parent, "child": child}))
    assert ("child", "p_key", "parent", "p", 2) in out and ("child", "code_key", "parent", "code", 2) in out
    assert ("child", "long_key", "parent", "long", 2) in out
    assert not any(e[1] == "other_key" and e[2] == "parent" for e in out)
    assert ("child", "other_key", "wide", "w0_key", 2) in out and ("child", "other_key", "wide", "w3_key", 2) not in out
    assert ("child", "p_key", "wide", "w1_key", 2) in out and ("child", "p_key", "wide", "w65_key", 2) not in out
    # a column with repeated or missing values is nobody's parent, equal text of another kind doesn't count
    assert not any(e[2] == "child" for e in out)
    text = spark.createDataFrame([("1",), ("3",)], "t_key string")
    assert _edges(J.inclusion_dependencies({"parent": parent.select("p"), "text": text})) == []


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "a_key long")
    some = spark.createDataFrame([(1,)], "b_key long")
    assert _edges(J.inclusion_dependencies({"empty": empty, "some": some})) == []
    assert _edges(J.inclusion_dependencies({"none": spark.createDataFrame([(1.5,)], "v double")})) == []


def test_one_scan_per_table_and_no_join(spark, sf):
    from tabsmith.sources.tables import load
    tables = {t: load(spark, sf, t) for t in ("orders", "customer", "nation")}
    index = J.value_index(tables, [("orders", "o_custkey"), ("customer", "c_custkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey")])
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3 and "Join" not in plan
