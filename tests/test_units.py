"""Layers 2-4: edge frames, properties and plan checks."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions import text as TX
from tabsmith.functions.core import nan_to_null, round_doubles
from tabsmith.ml import drift as DR
from tabsmith.ml import metrics as MT
from tabsmith.ml import prep as PR
from tabsmith.operators import charts as CH
from tabsmith.operators import clean as C
from tabsmith.operators import profile as P
from tabsmith.operators import rows as R
from tabsmith.operators.neighbors import knn_brute_force, knn_join
from tabsmith.operators.smote import smote
from tabsmith.operators.sqlapi import NotAQuery, explain_sql, is_select, run_sql
from tabsmith.operators.windows import fill_bfill_ffill, trailing_mean
from tabsmith.sources.tables import load

# ---------------------------------------------------------------------------
# edge frames
# ---------------------------------------------------------------------------


def test_report_on_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    rows = P.dataset_report(df, exact=True).collect()
    assert len(rows) == 2
    assert all(r.total_records == 0 and r.data_quality_score == 0.0 for r in rows)


def test_report_all_null_and_constant(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, 1, "x"), (None, 1, "x")], "a int, b int, c string")
    rep = {r.feature_name: r for r in P.dataset_report(df, exact=True).collect()}
    assert rep["a"].missing_percentage == 100.0 and rep["a"].unique_percentage == 0.0
    assert rep["b"].unique_percentage == round(100 / 3, 2)
    const = {r.column_name: r.is_constant for r in R.constant_columns(df).collect()}
    assert const == {"a": True, "b": True, "c": True}


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y")], ["a.b", "sp ace", "tick`s"])
    rep = P.dataset_report(df, exact=True).collect()
    assert {r.feature_name for r in rep} == {"a.b", "sp ace", "tick`s"}
    assert P.describe_numeric(df).count() == 2
    assert P.missing_counts(df).collect()[0].column_name == "sp ace"


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),)], "x double")
    out = nan_to_null(df).collect()
    assert out[0].x is None and out[1].x == 1.0 and math.isinf(out[2].x)
    cards = P.variable_cards(nan_to_null(df)).collect()[0]
    assert cards.missing == 1 and cards.infinite == 1


def test_corr_constant_and_nulls(spark):
    import statistics
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 6.0), (4.0, 5.0, 7.0)], "a double, b double, c double")
    m = {(r.col_a, r.col_b): r.corr for r in P.corr_matrix(df).collect()}
    assert m[("a", "b")] == 0.0 and m[("b", "b")] == 0.0
    assert m[("a", "a")] == pytest.approx(1.0)
    # pairwise complete: the row with c null is dropped for (a, c)
    assert m[("a", "c")] == pytest.approx(statistics.correlation([1.0, 3.0, 4.0], [2.0, 6.0, 7.0]))
    assert all(-1.0 <= v <= 1.0 for v in m.values())


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    h = CH.histogram(df, "x", 10).orderBy("bin").collect()
    assert len(h) == 10 and sum(r["count"] for r in h) == 4
    assert h[0].bin_start == 2.5 and h[-1].bin_end == 3.5


def test_histogram_counts_sum(spark, sf):
    ev = load(spark, sf, "events")
    h = CH.histogram(ev, "value", 7).collect()
    assert sum(r["count"] for r in h) == ev.where("value IS NOT NULL").count()


def test_reduce_cardinality_20_and_21(spark):
    rows20 = [(f"v{i:02d}",) for i in range(20) for _ in range(i + 1)]
    df20 = spark.createDataFrame(rows20, "c string")
    out = C.reduce_cardinality(df20, C.fit_reduce_cardinality(df20, ["c"], 20))
    assert out.where("c = 'Other'").count() == 0
    df21 = spark.createDataFrame(rows20 + [("zz",)], "c string")
    out = C.reduce_cardinality(df21, C.fit_reduce_cardinality(df21, ["c"], 20))
    assert [r.c for r in out.where("c = 'Other'").collect()] == ["Other"]


def test_code_blocks(spark):
    df = spark.createDataFrame([("no code",), ("x ```python\nprint(1)\n``` y",),
                                ("```Python a=1``` mid ```python b=2```",)], "t string")
    out = df.select(TX.extract_python_code("t").alias("code"), TX.strip_python_code("t").alias("rest")).collect()
    assert out[0].code is None and out[0].rest == "no code"
    assert out[1].code == "print(1)" and out[1].rest == "x  y"
    assert out[2].code == "a=1" and out[2].rest == "mid"


def test_html_and_images_and_lines(spark):
    df = spark.createDataFrame([("```html <p>a</p> ``` and ```html <b>b</b>```", "see `plots/a.png` now",
                                 "- one\n\n* two\n  + three\n")], "h string, i string, l string")
    r = df.select(TX.extract_html_blocks("h").alias("h"), TX.extract_image_ref("i").alias("i"),
                  TX.clean_list_lines("l", 2).alias("l"), TX.sanitize_name(F.lit("my file.v2 (final)!")).alias("s")).first()
    assert r.h == ["<p>a</p>", "<b>b</b>"] and r.i == "plots/a.png" and r.l == ["one", "two"]
    assert r.s == "my_file_v2_final"


def test_focus_filter_fallback(spark, sf):
    df = load(spark, sf, "orders")
    out, ok = R.focus_filter(df, "o_totalprice >")
    assert not ok and out.count() == df.count()


def test_sql_guard(spark, sf):
    assert is_select("  -- c\n WITH a AS (SELECT 1) SELECT * FROM a")
    for bad in ("DROP TABLE orders", "INSERT INTO x VALUES (1)", "SELECT 1; DROP TABLE x", "CREATE VIEW v AS SELECT 1"):
        with pytest.raises(NotAQuery):
            run_sql(spark, bad, {})
    plan = explain_sql(spark, "SELECT o_orderkey FROM orders WHERE o_totalprice > 5", {"orders": load(spark, sf, "orders")})
    text = "\n".join(r.plan for r in plan.collect())
    assert "PushedFilters" in text


# ---------------------------------------------------------------------------
# properties
# ---------------------------------------------------------------------------


def test_partition_invariance(spark, sf):
    ev = load(spark, sf, "events")
    a = round_doubles(C.smooth(ev.repartition(1), ["value"], ["ts", "event_id"], ["user_id"])).collect()
    b = round_doubles(C.smooth(ev.repartition(13), ["value"], ["ts", "event_id"], ["user_id"])).collect()
    assert sorted(a) == sorted(b)
    s1 = R.sample_n(ev.repartition(1), 50, ["event_id"]).collect()
    s2 = R.sample_n(ev.repartition(7), 50, ["event_id"]).collect()
    assert sorted(s1) == sorted(s2)


def test_hot_key_chunks_equal_plain(spark, sf):
    ev = load(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 4 == 0, None).otherwise(F.col("value")))
    plain = round_doubles(trailing_mean(ev, ["value"], ["user_id"], ["ts", "event_id"], 3)).collect()
    hot = round_doubles(trailing_mean(ev, ["value"], ["user_id"], ["ts", "event_id"], 3, rows_per_chunk=3)).collect()
    glob = round_doubles(trailing_mean(ev, ["value"], [], ["ts", "event_id"], 3)).collect()
    glob_hot = round_doubles(trailing_mean(ev, ["value"], [], ["ts", "event_id"], 3, rows_per_chunk=50)).collect()
    assert sorted(plain) == sorted(hot) and sorted(glob) == sorted(glob_hot)
    f1 = fill_bfill_ffill(ev, ["value"], ["user_id"], ["ts", "event_id"]).collect()
    f2 = fill_bfill_ffill(ev, ["value"], ["user_id"], ["ts", "event_id"], rows_per_chunk=2).collect()
    assert sorted(f1) == sorted(f2)


def test_idempotent_cleaning(spark, sf):
    de = load(spark, sf, "dirty_events")
    d1 = C.drop_duplicates(de)
    assert d1.count() == C.drop_duplicates(d1).count()
    imp = C.impute_numeric(de, C.fit_impute_numeric(de, ["value"]))
    again = C.impute_numeric(imp, C.fit_impute_numeric(imp, ["value"]))
    assert sorted(imp.select("value").collect()) == sorted(again.select("value").collect())
    capped = C.cap(de, C.fit_cap(de, ["value"]))
    b = C.fit_cap(de, ["value"])["value"]
    mx = capped.agg(F.max("value"), F.min("value")).first()
    assert mx[0] <= b[1] + 1e-9 and mx[1] >= b[0] - 1e-9


def test_scaling_moments(spark, sf):
    li = load(spark, sf, "lineitem")
    s = C.scale(li, C.fit_scale(li, ["l_quantity", "l_extendedprice"]))
    st = s.agg(F.avg("l_quantity"), F.stddev_pop("l_quantity")).first()
    assert abs(st[0]) < 1e-9 and st[1] == pytest.approx(1.0)


def test_one_hot_rows_sum(spark, sf):
    o = load(spark, sf, "orders")
    enc = C.one_hot(o, C.fit_one_hot(o, ["o_orderstatus"]))
    cols = [x for x in enc.columns if x.startswith("o_orderstatus_")]
    sums = {r[0] for r in enc.select(sum((F.col(x) for x in cols), F.lit(0.0))).collect()}
    assert sums <= {0.0, 1.0}


def test_splits_and_folds(spark, sf):
    lab = load(spark, sf, "labels")
    f = PR.kfold(lab, ["doc_id"], 3)
    assert f.count() == lab.count() and set(r.fold for r in f.select("fold").distinct().collect()) <= {0, 1, 2}
    s = PR.stratified_kfold(lab, "quality", ["doc_id"], 3)
    w = PR.stratified_kfold_window(lab, "quality", ["doc_id"], 3)
    assert sorted(s.collect()) == sorted(w.collect())
    per = s.groupBy("quality", "fold").count().collect()
    for q in {r.quality for r in per}:
        counts = [r["count"] for r in per if r.quality == q]
        assert max(counts) - min(counts) <= 1
    t = PR.split_train_test(load(spark, sf, "orders"), ["o_orderkey"], 0.3)
    assert t.where("split = 'test'").count() + t.where("split = 'train'").count() == t.count()


def test_ks_symmetric_bounded(spark, sf):
    ev = load(spark, sf, "events")
    a, b = ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1")
    d1 = DR.ks_statistic(a, b, "value").first().statistic
    d2 = DR.ks_statistic(b, a, "value").first().statistic
    assert d1 == pytest.approx(d2) and 0 <= d1 <= 1
    assert DR.chi2_sf(0.0, 3) == 1.0 and DR.chi2_sf(7.814727903251178, 3) == pytest.approx(0.05, abs=1e-6)
    assert DR.ks_pvalue(0.0, 100, 100) == 1.0


def test_auc_matches_pairwise(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.5), (0, 0.5), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = MT.auc(df, "y", "s").first().AUC
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(want)


def test_knn_equals_brute_force(spark, sf):
    emb = load(spark, sf, "embeddings")
    a = round_doubles(knn_join(emb, "vec_id", "embedding", 4, "label", cell_rows=3)).collect()
    b = round_doubles(knn_brute_force(emb, "vec_id", "embedding", 4, "label")).collect()
    assert sorted(a) == sorted(b)


def test_smote_balances_on_segments(spark):
    rows = [Row(id=i, y=0, a=float(i), b=float(2 * i)) for i in range(30)] + \
           [Row(id=100 + i, y=1, a=float(i % 7), b=float(2 * (i % 7)) + 0.5 * (i % 2)) for i in range(9)]
    df = spark.createDataFrame(rows)
    out = smote(df, "y", ["a", "b"], id_col="id", k=5)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 30
    syn = out.where("is_synthetic").collect()
    assert len(syn) == 21 and all(0 <= r.a <= 6 for r in syn)
    # a class with <= k rows is left alone
    small = spark.createDataFrame(rows[:30] + rows[30:33])
    assert smote(small, "y", ["a", "b"], id_col="id", k=5).where("is_synthetic").count() == 0


def test_position_in_group(spark, sf):
    o = load(spark, sf, "orders")
    p = R.position_in_group(o, ["o_orderstatus"], [F.col("o_orderkey")], "pos")
    from pyspark.sql import Window
    w = o.withColumn("pos", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderkey")).cast("bigint"))
    assert sorted(p.collect()) == sorted(w.collect())


def test_model_roundtrip_and_explanations(spark, sf, tmp_path):
    from tabsmith.ml import models as MD
    lf = load(spark, sf, "label_features")
    model, prep = MD.fit_final(lf, "quality", "classification", "lr", features=["f_chars", "f_spaces"])
    MD.save_model(model, str(tmp_path / "m"), {"task": "classification"})
    m2, meta = MD.load_model(spark, str(tmp_path / "m"))
    assert meta == {"task": "classification"}
    p1 = MD.predict(model, prep, lf, "quality").select("doc_id", "prediction_label").collect()
    p2 = MD.predict(m2, prep, lf, "quality").select("doc_id", "prediction_label").collect()
    assert sorted(p1) == sorted(p2)
    rf, prep2 = MD.fit_final(lf.drop("doc_id"), "quality", "classification", "rf", {"numTrees": 5},
                             features=["f_chars", "f_spaces"])
    ex = MD.explain_sampled(rf, prep2, lf, ["doc_id"], n_perm=3).collect()
    for r in ex[:20]:
        assert r.contrib_f_chars + r.contrib_f_spaces == pytest.approx(r.prediction - r.base_value, abs=1e-9)


# ---------------------------------------------------------------------------
# plan checks
# ---------------------------------------------------------------------------


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_single_scan_and_pruning(spark, sf):
    plan = _plan(P.dataset_report(load(spark, sf, "lineitem")))
    assert plan.count("FileScan parquet") == 1
    sel = load(spark, sf, "lineitem").select("l_quantity").where("l_quantity > 10")
    p = _plan(sel)
    assert "ReadSchema: struct<l_quantity:double>" in p and "PushedFilters" in p


def test_latest_k_uses_group_limit(spark, sf):
    plan = _plan(R.latest_k_per_group(load(spark, sf, "events"), "user_id", "ts", "event_id", 5))
    assert "WindowGroupLimit" in plan


def test_approx_distinct_error(spark, sf):
    li = load(spark, sf, "lineitem")
    ex = {r.feature_name: r.unique_percentage for r in P.dataset_report(li, exact=True).collect()}
    ap = {r.feature_name: r.unique_percentage for r in P.dataset_report(li, exact=False).collect()}
    for k, v in ex.items():
        assert abs(ap[k] - v) <= max(0.05 * v, 0.02)


def test_truncate_history_keeps_head_and_tail(spark):
    rows = [(1, t) for t in range(1, 31)] + [(2, t) for t in range(1, 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long")
    out = R.truncate_history(df, "conv_id", "turn", max_turns=3, keep_head=2)
    got = sorted((r.conv_id, r.turn) for r in out.collect())
    assert got == [(1, 1), (1, 2)] + [(1, t) for t in range(25, 31)] + [(2, t) for t in range(1, 6)]


def test_sources_and_schema_helpers(spark, sf, tmp_path):
    from tabsmith.operators.schema import match_columns
    from tabsmith.sources import files as IO
    nation = load(spark, sf, "nation")
    p = str(tmp_path / "n.csv")
    IO.write_csv(nation, p)
    back = IO.read_csv(spark, p)
    assert sorted(back.collect()) == sorted(nation.collect())
    # Materialise once, later calls keep the stored copy
    first = IO.materialize_once(nation, str(tmp_path / "clean"))
    again = IO.materialize_once(nation.limit(1), str(tmp_path / "clean"))
    assert first.count() == again.count() == nation.count()
    # records
    recs = IO.from_records(spark, [{"a": 1, "b": "x"}, {"a": 2, "b": None}], "a long, b string")
    assert recs.count() == 2
    # Loose name matching
    m = {r.requested: r.column_name for r in match_columns(load(spark, sf, "orders"), ["O_Order Key", "o total price", "nope"]).collect()}
    assert m == {"O_Order Key": "o_orderkey", "o total price": "o_totalprice", "nope": None}
    # Schema alignment
    d = {r.column_name: r.side for r in R.schema_diff(load(spark, sf, "orders"), load(spark, sf, "text_orders")).collect()}
    assert d["o_orderkey"] == "both" and d["price_txt"] == "right_only" and d["o_totalprice"] == "left_only"


def test_wide_one_hot_matches_dense(spark):
    from pyspark.ml.functions import vector_to_array
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "a")], "id int, s string")
    dense = C.one_hot(df, C.fit_one_hot(df, ["s"], max_dense=10)).orderBy("id").collect()
    wide = C.one_hot(df, C.fit_one_hot(df, ["s"], max_dense=1)).select("id", vector_to_array("s_vec").alias("v")) \
            .orderBy("id").collect()
    assert [[r.s_a, r.s_b, r.s_c] for r in dense] == [list(r.v) for r in wide]


def test_one_hot_form_is_the_callers_choice(spark):
    df = spark.range(1001).select(F.col("id").cast("string").alias("s"))
    assert [len(v) for v in C.fit_one_hot(df, ["s"]).values()] == [1001]
    few = df.limit(2)
    assert C.one_hot(few, C.fit_one_hot(few, ["s"], encoding="sparse")).columns == ["s_vec"]
    with pytest.raises(ValueError):
        C.fit_one_hot(few, ["s"], encoding="auto")


@pytest.mark.parametrize("sql", [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT k FROM t WHERE k = java_method('java.lang.Math', 'abs', -1)",
    "SELECT * FROM text.`/etc/hostname`", "WITH a AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM a",
    "SELECT (SELECT max(value) FROM text.`/etc/hostname`) FROM t", "SELECT k FROM t WHERE k IN (SELECT try_reflect('java.lang.Math', 'abs', -1))",
    "SELECT * FROM other", "SELECT * FROM t JOIN parquet.`/tmp/x` USING (k)"])
def test_user_sql_reads_the_given_tables_only(spark, sql):
    with pytest.raises(NotAQuery):
        run_sql(spark, sql, {"t": spark.range(3).withColumnRenamed("id", "k")})


def test_user_sql_ctes_and_subqueries(spark):
    t = {"t": spark.range(5).withColumnRenamed("id", "k")}
    assert run_sql(spark, "WITH a AS (SELECT k FROM T WHERE k > 1), b AS (SELECT * FROM a) SELECT count(*) AS n FROM b WHERE k < (SELECT max(k) FROM t)", t).first()["n"] == 2
    assert run_sql(spark, "SELECT * FROM range(3)").count() == 3


def test_candidate_keys_by_sketch_and_exact(spark):
    df = spark.range(5000).select("id", (F.col("id") % 4999).alias("nearly"), (F.col("id") % 7).alias("few"), F.when(F.col("id") > 0, F.col("id")).alias("gap"))
    for exact in (False, True):
        got = {r.column_name: r for r in P.candidate_keys(df, exact=exact).collect()}
        assert {x for x, r in got.items() if r.is_candidate_key} == {"id"} and got["nearly"].distinct_count == 4999
    assert P.candidate_keys(df.limit(0)).count() == 4


def test_entry_without_a_module_of_the_subpackage():
    import os
    import subprocess
    import sys
    code = ("import sys; sys.modules['xxhash'] = None; import __spark_entry__ as E; q = E.queries(); "
            "assert 'dataset_report' in q and not any(k.startswith('op1_') for k in q) and set(E.oracle_sql()) <= set(q)")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0
