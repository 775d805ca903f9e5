"""Cleaning queries (C1-C16, W1/W2) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions.core import round_doubles
from tabsmith.operators import clean as C
from tabsmith.operators.windows import fill_bfill_ffill
from tabsmith.plans.registry import register
from tabsmith.sources.tables import duckdb_view_cte, load, nan_as_null_cte

DE = duckdb_view_cte("dirty_events")
DE_NUM = ["event_id", "user_id", "value", "segment", "const_num"]


def _r(e: str) -> str:
    return f"round({e}, 6)"


@register("clean_dedup", DE + "SELECT DISTINCT * FROM dirty_events")
def q_clean_dedup(spark, sf):
    return C.drop_duplicates(load(spark, sf, "dirty_events"))


def _impute_sql(agg: str) -> str:
    sel = ", ".join(f"{agg.format(x=f'CAST({x} AS DOUBLE)')} AS a_{x}" for x in DE_NUM)
    out = {x: _r(f"coalesce(CAST({x} AS DOUBLE), a_{x})") + f" AS {x}" for x in DE_NUM}
    cols = ["event_id", "ts", "user_id", "event_type", "value", "segment", "const_num", "const_cat"]
    return DE + f", m AS (SELECT {sel} FROM dirty_events) SELECT " + ", ".join(
        out.get(x, x) for x in cols) + " FROM dirty_events, m"


@register("clean_impute_mean", _impute_sql("avg({x})"))
def q_clean_impute_mean(spark, sf):
    df = load(spark, sf, "dirty_events")
    return round_doubles(C.impute_numeric(df, C.fit_impute_numeric(df, DE_NUM, "mean")))


@register("clean_impute_median", _impute_sql("quantile_cont({x}, 0.5)"))
def q_clean_impute_median(spark, sf):
    df = load(spark, sf, "dirty_events")
    return round_doubles(C.impute_numeric(df, C.fit_impute_numeric(df, DE_NUM, "median")))


_PLAIN = nan_as_null_cte("nan_events", ("value", "segment"))


def _impute_nan_sql(agg: str) -> str:
    return _PLAIN + f""", m AS (SELECT {agg.format(x='value')} AS a, {agg.format(x='segment')} AS b FROM plain)
SELECT event_id, event_type, round(coalesce(value, a), 6) AS value, round(coalesce(segment, b), 6) AS segment, user_num FROM plain, m"""


@register("clean_impute_mean_nan", _impute_nan_sql("avg({x})"))
def q_clean_impute_mean_nan(spark, sf):
    """NaN is missing: it doesn't enter the mean, and gets it."""
    df = load(spark, sf, "nan_events")
    return round_doubles(C.impute_numeric(df, C.fit_impute_numeric(df, ["value", "segment"], "mean")))


@register("clean_impute_median_nan", _impute_nan_sql("quantile_cont({x}, 0.5)"))
def q_clean_impute_median_nan(spark, sf):
    df = load(spark, sf, "nan_events")
    return round_doubles(C.impute_numeric(df, C.fit_impute_numeric(df, ["value", "segment"], "median")))


@register("clean_cap_scale_nan", _PLAIN + """,
s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM plain),
k AS (SELECT * REPLACE (least(greatest(value, m - 2.0 * sd), m + 2.0 * sd) AS value) FROM plain, s WHERE value IS NOT NULL
      UNION ALL SELECT * FROM plain, s WHERE value IS NULL),
z AS (SELECT avg(value) AS zm, stddev_pop(value) AS zs FROM k)
SELECT event_id, event_type, round((value - zm) / zs, 6) AS value, segment, user_num FROM k, z""")
def q_clean_cap_scale_nan(spark, sf):
    """Bounds and scale from the present values; NaN stays missing."""
    df = load(spark, sf, "nan_events").withColumn("segment", C.present("segment"))
    df = C.cap(df, C.fit_cap(df, ["value"], 2.0))
    return round_doubles(C.scale(df, C.fit_scale(df, ["value"])))


@register("clean_impute_mode", DE + """,
m1 AS (SELECT event_type AS v FROM dirty_events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1),
m2 AS (SELECT const_cat AS v FROM dirty_events WHERE const_cat IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)
SELECT event_id, ts, user_id, coalesce(event_type, (SELECT v FROM m1)) AS event_type, value, segment, const_num,
       coalesce(const_cat, (SELECT v FROM m2)) AS const_cat FROM dirty_events""")
def q_clean_impute_mode(spark, sf):
    df = load(spark, sf, "dirty_events")
    return C.impute_categorical(df, C.fit_mode(df, ["event_type", "const_cat"]))


def _smooth_sql(part: str) -> str:
    p = f"PARTITION BY {part} " if part else ""
    return DE + f""",
s AS (SELECT *, avg(value) OVER ({p}ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS sv FROM dirty_events)
SELECT event_id, ts, user_id, event_type,
  round(coalesce(sv, first_value(sv IGNORE NULLS) OVER ({p}ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                 last_value(sv IGNORE NULLS) OVER ({p}ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS value,
  segment, const_num, const_cat FROM s"""


@register("clean_smooth", _smooth_sql("user_id"))
def q_clean_smooth(spark, sf):
    return round_doubles(C.smooth(load(spark, sf, "dirty_events"), ["value"], ["ts", "event_id"], ["user_id"], 3))


@register("clean_smooth_hot_keys", _smooth_sql("user_id"))
def q_clean_smooth_hot_keys(spark, sf):
    """Same result with every user treated as a hot key split into chunks."""
    return round_doubles(C.smooth(load(spark, sf, "dirty_events"), ["value"], ["ts", "event_id"], ["user_id"], 3,
                                  rows_per_chunk=16))


@register("clean_smooth_global", _smooth_sql(""))
def q_clean_smooth_global(spark, sf):
    """Global row order (no key): range chunks + carry rows, never one task."""
    return round_doubles(C.smooth(load(spark, sf, "dirty_events"), ["value"], ["ts", "event_id"], [], 3,
                                  rows_per_chunk=1000))


FILL_SQL = DE + """
SELECT event_id, ts, user_id, event_type,
  coalesce(value, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
           last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value,
  segment, const_num, const_cat FROM dirty_events"""


@register("fill_bfill_ffill", FILL_SQL)
def q_fill_bfill_ffill(spark, sf):
    return fill_bfill_ffill(load(spark, sf, "dirty_events"), ["value"], ["user_id"], ["ts", "event_id"])


@register("fill_bfill_ffill_hot_keys", FILL_SQL)
def q_fill_bfill_ffill_hot_keys(spark, sf):
    return fill_bfill_ffill(load(spark, sf, "dirty_events"), ["value"], ["user_id"], ["ts", "event_id"],
                            rows_per_chunk=16)


# A third of the rows has no key, the order is text with ties and nulls, and rows repeat.
_HOT_NULL = DE + """,
h AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 4 END AS grp, CAST(event_id % 100 AS VARCHAR) AS tie,
        CAST(event_id AS VARCHAR) AS id_txt FROM dirty_events)"""
_HOT_ORDER = "PARTITION BY grp ORDER BY event_type NULLS FIRST, tie NULLS FIRST, id_txt NULLS FIRST"


def _hot_null(spark, sf):
    df = load(spark, sf, "dirty_events")
    return df.withColumns({"grp": F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 4),
                           "tie": (F.col("event_id") % 100).cast("string"), "id_txt": F.col("event_id").cast("string")})


@register("clean_smooth_hot_null_key", _HOT_NULL + f""",
s AS (SELECT *, avg(value) OVER ({_HOT_ORDER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS sv FROM h)
SELECT event_id, grp, event_type, tie, id_txt,
  round(coalesce(sv, first_value(sv IGNORE NULLS) OVER ({_HOT_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                 last_value(sv IGNORE NULLS) OVER ({_HOT_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS value FROM s""")
def q_clean_smooth_hot_null_key(spark, sf):
    """Hot NULL key, text order column with ties and nulls: cut by rank like any other."""
    df = _hot_null(spark, sf).select("event_id", "grp", "event_type", "tie", "id_txt", "value")
    return round_doubles(C.smooth(df, ["value"], ["event_type", "tie", "id_txt"], ["grp"], 3, rows_per_chunk=300))


@register("fill_bfill_ffill_hot_null_key", _HOT_NULL + f"""
SELECT event_id, grp, event_type, tie, id_txt,
  coalesce(value, first_value(value IGNORE NULLS) OVER ({_HOT_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
           last_value(value IGNORE NULLS) OVER ({_HOT_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value FROM h""")
def q_fill_hot_null_key(spark, sf):
    df = _hot_null(spark, sf).select("event_id", "grp", "event_type", "tie", "id_txt", "value")
    return fill_bfill_ffill(df, ["value"], ["grp"], ["event_type", "tie", "id_txt"], rows_per_chunk=300)


@register("clean_cap_outliers", """
WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events)
SELECT event_id, ts, user_id, event_type,
  round(CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value, m - 3.0 * sd), m + 3.0 * sd) END, 6) AS value, props
FROM events, s""")
def q_clean_cap_outliers(spark, sf):
    df = load(spark, sf, "events")
    return round_doubles(C.cap(df, C.fit_cap(df, ["value"], 3.0)))


LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("clean_scale", "WITH s AS (SELECT " + ", ".join(
    f"avg(CAST({x} AS DOUBLE)) AS m_{x}, coalesce(nullif(stddev_pop(CAST({x} AS DOUBLE)), 0), 1.0) AS s_{x}"
    for x in LI_NUM) + " FROM lineitem) SELECT " + ", ".join(
    _r(f"(CAST({x} AS DOUBLE) - m_{x}) / s_{x}") + f" AS {x}" for x in LI_NUM)
    + ", l_returnflag, l_linestatus, l_shipdate FROM lineitem, s")
def q_clean_scale(spark, sf):
    df = load(spark, sf, "lineitem")
    return round_doubles(C.scale(df, C.fit_scale(df, LI_NUM)))


@register("clean_reduce_cardinality", """
WITH t AS (SELECT p_brand AS v FROM part GROUP BY 1 ORDER BY count(*) DESC, v NULLS FIRST LIMIT 20)
SELECT p_partkey, p_name, CASE WHEN p_brand IS NULL THEN NULL WHEN p_brand IN (SELECT v FROM t) THEN p_brand ELSE 'Other' END AS p_brand,
  p_type, p_size, p_retailprice FROM part""")
def q_clean_reduce_cardinality(spark, sf):
    df = load(spark, sf, "part")
    return C.reduce_cardinality(df, C.fit_reduce_cardinality(df, ["p_brand"], 20))


@register("clean_one_hot", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority,
  coalesce(CAST(o_orderstatus = 'F' AS DOUBLE), 0.0) AS o_orderstatus_F,
  coalesce(CAST(o_orderstatus = 'O' AS DOUBLE), 0.0) AS o_orderstatus_O,
  coalesce(CAST(o_orderstatus = 'P' AS DOUBLE), 0.0) AS o_orderstatus_P FROM orders""")
def q_clean_one_hot(spark, sf):
    df = load(spark, sf, "orders")
    return C.one_hot(df, C.fit_one_hot(df, ["o_orderstatus"]))


@register("clean_one_hot_wide", """
WITH v AS (SELECT o_custkey, row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS i, count(*) OVER () AS n
           FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL))
SELECT o_orderkey, coalesce(v.n, (SELECT max(n) FROM v))::INTEGER AS size, v.i::INTEGER AS category, CASE WHEN v.i IS NOT NULL THEN 1.0::DOUBLE END AS value
FROM orders LEFT JOIN v ON orders.o_custkey = v.o_custkey""")
def q_clean_one_hot_wide(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    out = C.one_hot(df, C.fit_one_hot(df, ["o_custkey"], encoding="sparse")).withColumn("v", F.unwrap_udt("o_custkey_vec"))
    return out.select("o_orderkey", F.col("v.size").alias("size"), F.get("v.indices", F.lit(0)).alias("category"),
                      F.get("v.values", F.lit(0)).alias("value"))


@register("balance_check", """
WITH g AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1),
s AS (SELECT count(*) AS n_classes, min(n) AS minority_count, max(n) AS majority_count FROM g)
SELECT *, CASE WHEN n_classes < 2 THEN 'skip_single_class' WHEN minority_count < 6 THEN 'skip_minority_too_small'
  WHEN n_classes > 2 THEN 'warn_multiclass' ELSE 'ok' END AS verdict FROM s""")
def q_balance_check(spark, sf):
    return C.balance_check(load(spark, sf, "labels"), "quality", ["toxic"])


@register("high_cardinality", """
SELECT * FROM (SELECT 'c_name' AS column_name, count(DISTINCT c_name) AS n_unique FROM customer
  UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer) WHERE n_unique > 100""")
def q_high_cardinality(spark, sf):
    return C.high_cardinality(load(spark, sf, "customer"), ["c_name", "c_mktsegment"], 100, exact=True)


_NUM4 = ["event_id", "user_id", "value", "segment"]


def _pipeline_sql(smooth: bool, scale: bool, reduce: bool, drop: bool) -> str:
    """Staged fits exactly as the Spark run: dedup -> drop constants -> impute ->
    [smooth] -> cap -> [scale]; categorical: mode -> [top-20 + Other]."""
    q = [DE + ", d AS (SELECT DISTINCT * FROM dirty_events)",
         "m AS (SELECT " + ", ".join(f"avg(CAST({x} AS DOUBLE)) AS a_{x}" for x in _NUM4) + " FROM d)",
         "i AS (SELECT " + ", ".join(f"coalesce(CAST({x} AS DOUBLE), a_{x}) AS {x}" for x in _NUM4)
         + ", ts, event_type FROM d, m)"]
    cur = "i"
    if smooth:
        q.append("sm AS (SELECT ts, event_type, " + ", ".join(
            f"avg({x}) OVER (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS {x}" for x in _NUM4)
            + " FROM i)")
        cur = "sm"
    q.append(f"cs AS (SELECT " + ", ".join(f"avg({x}) AS m_{x}, coalesce(stddev_pop({x}), 0.0) AS s_{x}" for x in _NUM4)
             + f" FROM {cur})")
    q.append("c AS (SELECT ts, event_type, " + ", ".join(
        f"CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, m_{x} - 3.0 * s_{x}), m_{x} + 3.0 * s_{x}) END AS {x}"
        for x in _NUM4) + f" FROM {cur}, cs)")
    cur = "c"
    if scale:
        q.append("ss AS (SELECT " + ", ".join(
            f"avg({x}) AS m_{x}, coalesce(nullif(stddev_pop({x}), 0), 1.0) AS s_{x}" for x in _NUM4) + " FROM c)")
        q.append("sc AS (SELECT ts, event_type, " + ", ".join(f"({x} - m_{x}) / s_{x} AS {x}" for x in _NUM4)
                 + " FROM c, ss)")
        cur = "sc"
    q.append(f"mo AS (SELECT event_type AS v FROM {cur} WHERE event_type IS NOT NULL GROUP BY 1 "
             "ORDER BY count(*) DESC, v LIMIT 1)")
    q.append(f"ci AS (SELECT *, coalesce(event_type, (SELECT v FROM mo)) AS et FROM {cur})")
    et = "et"
    if reduce:
        q.append("tp AS (SELECT et AS v FROM ci GROUP BY 1 ORDER BY count(*) DESC, v NULLS FIRST LIMIT 20)")
        et = "CASE WHEN et IS NULL THEN NULL WHEN et IN (SELECT v FROM tp) THEN et ELSE 'Other' END"
    sel = [_r(x) + f" AS {x}" for x in _NUM4] + [f"{et} AS event_type"]
    if not drop:
        sel.insert(1, "ts")
    return ",\n".join(q) + "\nSELECT " + ", ".join(sel) + " FROM ci"


@register("clean_pipeline_default", _pipeline_sql(False, False, False, False))
def q_clean_pipeline_default(spark, sf):
    cfg = C.CleaningConfig(remove_duplicates=True, handle_missing_values=True, handle_outliers=True)
    return round_doubles(C.clean(load(spark, sf, "dirty_events"), cfg).df)


@register("clean_full", _pipeline_sql(True, True, True, True))
def q_clean_full(spark, sf):
    cfg = C.CleaningConfig(remove_duplicates=True, handle_missing_values=True, smooth_noisy_data=True,
                           handle_outliers=True, feature_scaling=True, reduce_cardinality=True,
                           order_by=("ts", "event_id"), remainder="drop")
    return round_doubles(C.clean(load(spark, sf, "dirty_events"), cfg).df)


@register("clean_preview", DE + """,
s AS (SELECT """ + ", ".join(f"avg(CAST({x} AS DOUBLE)) AS m_{x}, stddev_samp(CAST({x} AS DOUBLE)) AS s_{x}" for x in DE_NUM)
          + """ FROM dirty_events),
a AS (SELECT CAST(sum(""" + " + ".join(f"CASE WHEN {x} IS NULL THEN 1 ELSE 0 END" for x in
                                     ["event_id", "ts", "user_id", "event_type", "value", "segment", "const_num",
                                      "const_cat"]) + """) AS BIGINT) AS missing_cells,
  CAST(sum(""" + " + ".join(f"CASE WHEN abs(CAST({x} AS DOUBLE) - m_{x}) > 3 * s_{x} THEN 1 ELSE 0 END" for x in DE_NUM)
          + """) AS BIGINT) AS outlier_cells FROM dirty_events, s),
dup AS (SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM dirty_events
  GROUP BY event_id, ts, user_id, event_type, value, segment, const_num, const_cat))
SELECT * FROM a, dup""")
def q_clean_preview(spark, sf):
    return C.clean_preview(load(spark, sf, "dirty_events"))


@register("clean_report", DE + """
SELECT (SELECT count(*) FROM dirty_events) AS original_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_events)) AS cleaned_rows,
  (SELECT count(*) FROM dirty_events) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_events)) AS rows_removed""")
def q_clean_report(spark, sf):
    df = load(spark, sf, "dirty_events")
    return C.clean_report(df, C.drop_duplicates(df))


# ---------------------------------------------------------------------------
# C9 SMOTE and J5 kNN
# ---------------------------------------------------------------------------

def _bucket(*parts: str) -> str:
    return ("CAST(('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ", '42')), 1, 8)) AS BIGINT)")


SMOTE_SQL = duckdb_view_cte("label_features") + f""",
cnt AS (SELECT quality, count(*) AS n FROM label_features GROUP BY 1),
mx AS (SELECT max(n) AS M FROM cnt),
mi AS (SELECT lf.*, n, M FROM label_features lf JOIN cnt USING (quality) CROSS JOIN mx WHERE n < M AND n > 5),
knn AS (SELECT a.doc_id, b.doc_id AS nb, row_number() OVER (PARTITION BY a.doc_id ORDER BY
          sqrt((a.f_chars - b.f_chars) * (a.f_chars - b.f_chars) + (a.f_spaces - b.f_spaces) * (a.f_spaces - b.f_spaces)),
          b.doc_id) AS rk FROM mi a JOIN mi b ON a.quality = b.quality AND a.doc_id <> b.doc_id),
pos AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_bucket('CAST(doc_id AS VARCHAR)')}, doc_id) AS p FROM mi),
rep AS (SELECT *, (M - n) // n + CASE WHEN p <= (M - n) % n THEN 1 ELSE 0 END AS q FROM pos),
ex AS (SELECT rep.*, unnest(range(0, q)) AS j FROM rep WHERE q > 0),
ex2 AS (SELECT *, CAST({_bucket('CAST(doc_id AS VARCHAR)', 'CAST(j AS VARCHAR)', "'nn'")} % 5 + 1 AS INTEGER) AS rk2,
          CAST({_bucket('CAST(doc_id AS VARCHAR)', 'CAST(j AS VARCHAR)', "'step'")} AS DOUBLE) / 4294967296.0 AS step FROM ex),
syn AS (SELECT e.quality, e.f_chars + step * (o.f_chars - e.f_chars) AS f_chars, e.f_spaces + step * (o.f_spaces - e.f_spaces) AS f_spaces
        FROM ex2 e JOIN knn ON knn.doc_id = e.doc_id AND knn.rk = e.rk2 JOIN label_features o ON o.doc_id = knn.nb)
SELECT doc_id, quality, round(f_chars, 6) AS f_chars, round(f_spaces, 6) AS f_spaces, false AS is_synthetic FROM label_features
UNION ALL SELECT NULL, quality, round(f_chars, 6), round(f_spaces, 6), true FROM syn"""


@register("clean_smote", SMOTE_SQL)
def q_clean_smote(spark, sf):
    from tabsmith.operators.smote import smote
    out = smote(load(spark, sf, "label_features"), "quality", ["f_chars", "f_spaces"], id_col="doc_id", k=5)
    return round_doubles(out)


def _job_sql() -> str:
    """Impute, cap, scale, mode, top 2 + Other, one-hot, then SMOTE on the result, in the same order."""
    return duckdb_view_cte("label_features") + f""",
src AS (SELECT lf.doc_id, lf.quality, CASE WHEN lf.doc_id % 9 = 4 THEN NULL ELSE f_chars END AS f_chars, f_spaces,
          CASE WHEN lf.doc_id % 7 = 2 THEN NULL ELSE lang END AS lang FROM label_features lf JOIN documents d USING (doc_id)),
m AS (SELECT avg(f_chars) AS a, avg(f_spaces) AS b FROM src),
i AS (SELECT doc_id, quality, coalesce(f_chars, a) AS f_chars, coalesce(f_spaces, b) AS f_spaces, lang FROM src, m),
cs AS (SELECT avg(f_chars) AS ma, stddev_pop(f_chars) AS sa, avg(f_spaces) AS mb, stddev_pop(f_spaces) AS sb FROM i),
k AS (SELECT doc_id, quality, least(greatest(f_chars, ma - 2 * sa), ma + 2 * sa) AS f_chars,
        least(greatest(f_spaces, mb - 2 * sb), mb + 2 * sb) AS f_spaces, lang FROM i, cs),
ss AS (SELECT avg(f_chars) AS ma, stddev_pop(f_chars) AS sa, avg(f_spaces) AS mb, stddev_pop(f_spaces) AS sb FROM k),
mo AS (SELECT lang AS v FROM src WHERE lang IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1),
z AS (SELECT doc_id, quality, (f_chars - ma) / sa AS f_chars, (f_spaces - mb) / sb AS f_spaces, coalesce(lang, (SELECT v FROM mo)) AS lang FROM k, ss),
tp AS (SELECT lang AS v FROM z GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 2),
w AS (SELECT doc_id, quality, f_chars, f_spaces, CASE WHEN lang IN (SELECT v FROM tp) THEN lang ELSE 'Other' END AS lang FROM z),
names AS (SELECT list(DISTINCT lang ORDER BY lang) AS l FROM w),
f AS (SELECT doc_id, quality, list_concat([f_chars, f_spaces], list_transform(l, lambda x: (lang = x)::DOUBLE)) AS v FROM w, names),
cnt AS (SELECT quality, count(*) AS n FROM f GROUP BY 1),
mx AS (SELECT max(n) AS M FROM cnt),
mi AS (SELECT f.*, n, M FROM f JOIN cnt USING (quality) CROSS JOIN mx WHERE n < M AND n > 5),
knn AS (SELECT a.doc_id, b.doc_id AS nb, row_number() OVER (PARTITION BY a.doc_id ORDER BY
          round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))), 12), b.doc_id) AS rk
        FROM mi a JOIN mi b ON a.quality = b.quality AND a.doc_id <> b.doc_id),
pos AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_bucket('CAST(doc_id AS VARCHAR)')}, doc_id) AS p FROM mi),
rep AS (SELECT *, (M - n) // n + CASE WHEN p <= (M - n) % n THEN 1 ELSE 0 END AS q FROM pos),
ex AS (SELECT rep.*, unnest(range(0, q)) AS j FROM rep WHERE q > 0),
ex2 AS (SELECT *, CAST({_bucket('CAST(doc_id AS VARCHAR)', 'CAST(j AS VARCHAR)', "'nn'")} % 5 + 1 AS INTEGER) AS rk2,
          CAST({_bucket('CAST(doc_id AS VARCHAR)', 'CAST(j AS VARCHAR)', "'step'")} AS DOUBLE) / 4294967296.0 AS step FROM ex),
syn AS (SELECT NULL AS doc_id, e.quality, list_transform(list_zip(e.v, o.v), lambda t: t[1] + e.step * (t[2] - t[1])) AS v, true AS is_synthetic
        FROM ex2 e JOIN knn ON knn.doc_id = e.doc_id AND knn.rk = e.rk2 JOIN f o ON o.doc_id = knn.nb)
SELECT doc_id, quality, list_transform(v, lambda x: round(x, 6) + 0.0) AS features, is_synthetic
FROM (SELECT doc_id, quality, v, false AS is_synthetic FROM f UNION ALL SELECT * FROM syn)"""


@register("clean_full_balanced", _job_sql())
def q_clean_full_balanced(spark, sf):
    """The whole cleaning job with a target: imputation, cap, scale, categories, one-hot columns and balanced classes."""
    from tabsmith.session import cut_lineage
    lf = load(spark, sf, "label_features").join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    src = lf.select("doc_id", "quality", F.when(F.col("doc_id") % 9 != 4, F.col("f_chars")).alias("f_chars"), "f_spaces",
                    F.when(F.col("doc_id") % 7 != 2, F.col("lang")).alias("lang"))
    src = cut_lineage(src)  # five columns that the job's steps scan several times; documents are read once
    cfg = C.CleaningConfig(handle_missing_values=True, handle_outliers=True, outlier_z=2.0, feature_scaling=True, reduce_cardinality=True,
                           max_unique_categories=2, encode_categorical_values=True, handle_imbalanced_data=True, id_col="doc_id",
                           remainder="drop")
    out = C.clean(src, cfg, target="quality").df
    feats = [x for x in out.columns if x not in ("doc_id", "quality", "is_synthetic")]
    return out.select("doc_id", "quality", F.array(*[F.round(x, 6) + F.lit(0.0) for x in feats]).alias("features"), "is_synthetic")


@register("knn_join", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.label, a.vec_id, b.vec_id AS neighbor_id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS d
      FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rk FROM p)
SELECT label, vec_id, neighbor_id, CAST(rk AS INTEGER) AS rank, round(d, 6) AS distance FROM r WHERE rk <= 5""")
def q_knn_join(spark, sf):
    from tabsmith.operators.neighbors import knn_join
    out = knn_join(load(spark, sf, "embeddings"), "vec_id", "embedding", k=5, group_col="label", cell_rows=8)
    return round_doubles(out)
