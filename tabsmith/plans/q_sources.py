"""Sources, sinks and text helpers on data that meets their cases."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabsmith.functions import text as TX
from tabsmith.functions.core import round_doubles
from tabsmith.ml import baselines as BL
from tabsmith.ml import models as MD
from tabsmith.operators import charts as CH
from tabsmith.operators import profile as P
from tabsmith.operators.sqlapi import run_sql
from tabsmith.plans.q_ml import _baseline_sql, _lineitem_folds
from tabsmith.plans.registry import register
from tabsmith.session import scratch_path
from tabsmith.sources import files as IO
from tabsmith.sources.tables import duckdb_view_cte, load, spark_view


def _path(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("scan_csv_missing_and_breaks", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'a "quoted", text' || chr(10) || 'of two lines'
  ELSE o_orderpriority END AS note, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey AS INTEGER) END AS num,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price, CAST(o_orderdate AS DATE) AS day FROM orders""")
def q_scan_csv_missing_and_breaks(spark, sf):
    """A folder of CSV files with missing-value tokens, quotes and quoted line breaks; types inferred."""
    o, k = load(spark, sf, "orders"), F.col("o_orderkey")
    broken = F.lit('a "quoted", text\nof two lines')
    df = o.select("o_orderkey", F.when(k % 5 == 0, "N/A").when(k % 5 == 1, broken).otherwise(F.col("o_orderpriority")).alias("note"),
                  F.when(k % 7 == 0, "nan").otherwise(F.col("o_custkey").cast("string")).alias("num"),
                  F.when(k % 3 == 0, "NULL").otherwise(F.col("o_totalprice").cast("string")).alias(" price "),
                  F.col("o_orderdate").cast("date").alias("day"))
    path = _path(spark, "csv")
    IO.write_csv(df.repartition(4), path, rows_per_file=100_000)
    return IO.read_csv(spark, path, multiline=True).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@register("scan_json_records", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def q_scan_json_records(spark, sf):
    """Records as JSON lines with a declared schema."""
    path = _path(spark, "json")
    load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.json(path)
    return IO.from_json_lines(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@register("materialize_once", "SELECT DISTINCT event_type, user_id FROM events")
def q_materialize_once(spark, sf):
    """The stored version stays, whatever a second call would write."""
    path = _path(spark, "version")
    df = load(spark, sf, "events").select("event_type", "user_id").distinct()
    IO.materialize_once(df, path)
    return IO.materialize_once(df.limit(1), path)


@register("export_predictions", """
WITH fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, l_returnflag, round(a + b * l_quantity, 2) AS prediction_label FROM lineitem, fit""")
def q_export_predictions(spark, sf):
    """Predictions as CSV without an index, read back with their schema."""
    li = load(spark, sf, "lineitem")
    fit = li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"), F.regr_intercept("l_extendedprice", "l_quantity").alias("a"))
    out = li.crossJoin(fit).select("l_orderkey", "l_linenumber", "l_returnflag",  # one-row side
                                   F.round(F.col("a") + F.col("b") * F.col("l_quantity"), 2).alias("prediction_label"))
    path = _path(spark, "predictions")
    IO.write_csv(out, path)
    return IO.read_csv(spark, path, schema=out.schema)


@register("chart_pie_other", """
WITH g AS (SELECT p_brand AS category, sum(p_retailprice) AS value FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, category) AS r FROM g)
SELECT CASE WHEN r < 6 THEN category ELSE 'Other' END AS category, round(sum(value), 2) AS value,
  round(sum(value) / (SELECT sum(value) FROM g) * 100, 6) AS percentage, true AS ok FROM r GROUP BY 1""")
def q_chart_pie_other(spark, sf):
    out = CH.pie(load(spark, sf, "part"), "p_brand", "p_retailprice", max_slices=6, fold_other=True)
    return round_doubles(out.withColumn("value", F.round("value", 2)))


@register("leaderboard_top", _baseline_sql(
    "SELECT model, round(avg(RMSE), 6) AS RMSE, round(avg(R2), 6) AS R2 FROM per_fold WHERE model IN ('ols', 'dummy') "
    "GROUP BY model ORDER BY avg(RMSE) LIMIT 1"))
def q_leaderboard_top(spark, sf):
    """Some of the models, best first by an error (smaller is better), the first one only."""
    board, _ = BL.baseline_leaderboard(_lineitem_folds(spark, sf), "l_extendedprice", "l_quantity")
    return round_doubles(MD.leaderboard_sort(board, "RMSE", ["ols", "dummy", "absent"], top=1).select("model", "RMSE", "R2"))


_CONTEXT_COLS = [("event_id", "n"), ("ts", "n"), ("user_id", "n"), ("event_type", "c"), ("value", "n"), ("segment", "n"), ("const_num", "n"),
                 ("const_cat", "c")]


def _context_sql() -> str:
    info = [f"SELECT 'info' AS piece, '{x}' AS column_name, NULL AS item, count({x}) AS n FROM dirty_events" for x, _ in _CONTEXT_COLS]
    miss = [f"SELECT 'missing', '{x}', NULL, count(*) - count({x}) FROM dirty_events HAVING count(*) > count({x})" for x, _ in _CONTEXT_COLS]
    cats = [x for x, k in _CONTEXT_COLS if k == "c"]
    vals = [f"SELECT 'value_counts', '{x}', {x}, count(*) FROM dirty_events WHERE (SELECT count(DISTINCT {x}) FROM dirty_events) <= 20 GROUP BY {x}"
            for x in cats]
    desc = [f"SELECT 'categorical', '{x}', (SELECT {x} FROM dirty_events WHERE {x} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "
            f"count(DISTINCT {x}) FROM dirty_events" for x in cats]
    nums = [f"SELECT 'numeric', '{x}', NULL, count({x}) FROM dirty_events" for x, k in _CONTEXT_COLS if k == "n" and x != "ts"]
    return duckdb_view_cte("dirty_events") + " UNION ALL ".join([*info, *miss, *vals, *desc, *nums])


@register("data_context", _context_sql())
def q_data_context(spark, sf):
    """Every piece of the table's context over the whole table, as (piece, column, item, n)."""
    ctx = P.data_context(load(spark, sf, "dirty_events"), order_by=["event_id"])
    none = F.lit(None).cast("string").alias("item")
    parts = [ctx["info"].select(F.lit("info").alias("piece"), "column_name", none, F.col("non_null_count").alias("n")),
             ctx["missing"].select(F.lit("missing").alias("piece"), "column_name", none, F.col("missing_count").alias("n")),
             ctx["value_counts"].select(F.lit("value_counts").alias("piece"), "column_name", F.col("value").alias("item"), F.col("count").alias("n")),
             ctx["categorical"].select(F.lit("categorical").alias("piece"), "column_name", F.col("top").alias("item"), F.col("unique").alias("n")),
             ctx["numeric"].select(F.lit("numeric").alias("piece"), "column_name", none, F.col("count").alias("n"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Turns with fenced blocks, image paths and lists, made from the conversations; the same text in both engines.
MARKED_SQL = """
SELECT conv_id, turn, CASE turn % 4
  WHEN 0 THEN text || chr(10) || '```Python' || chr(10) || '  x = ' || CAST(turn AS STRING) || chr(10) || '``` and ```python y```'
  WHEN 1 THEN 'See ```html <b>' || CAST(conv_id AS STRING) || '</b>' || chr(10) || '``` then ```html' || chr(10) || '<i/> ``` ' || text
  WHEN 2 THEN 'Chart at `plots/' || CAST(conv_id AS STRING) || '.png`, not `x.txt` or `y.gif`. ' || text
  ELSE '- first' || chr(10) || '  * second item  ' || chr(10) || chr(10) || '+third' || chr(10) || text END AS text FROM {conversations}"""
_MARKED = "WITH m AS (" + MARKED_SQL.format(conversations="conversations") + ")"


def _marked(spark, sf):
    return spark_view(spark, sf, MARKED_SQL, ("conversations",))


@register("extract_code_blocks_marked", _MARKED + r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?is)```python\s*(.*?)\s*```')
       THEN regexp_replace(regexp_extract(text, '(?is)```python\s*(.*?)\s*```', 1), '^\s+|\s+$', '', 'g') END AS code,
  regexp_replace(regexp_replace(text, '(?is)```python\s*(.*?)\s*```', '', 'g'), '^\s+|\s+$', '', 'g') AS remaining_text FROM m""")
def q_extract_code_blocks_marked(spark, sf):
    return _marked(spark, sf).select("conv_id", "turn", TX.extract_python_code("text").alias("code"), TX.strip_python_code("text").alias("remaining_text"))


@register("extract_html_blocks_marked", _MARKED + r"""
SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '```html\s*([\s\S]*?)\s*```', 1)) > 0
  THEN regexp_extract_all(text, '```html\s*([\s\S]*?)\s*```', 1) ELSE [text] END AS html_blocks FROM m""")
def q_extract_html_blocks_marked(spark, sf):
    return _marked(spark, sf).select("conv_id", "turn", TX.extract_html_blocks("text").alias("html_blocks"))


@register("extract_image_refs_marked", _MARKED + r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '`([^`]+\.(?:png|jpg|jpeg|gif|webp))`')
  THEN regexp_extract(text, '`([^`]+\.(?:png|jpg|jpeg|gif|webp))`', 1) END AS image_ref FROM m""")
def q_extract_image_refs_marked(spark, sf):
    return _marked(spark, sf).select("conv_id", "turn", TX.extract_image_ref("text").alias("image_ref"))


@register("clean_list_lines_marked", _MARKED + r"""
SELECT conv_id, turn, list_transform(list_filter(string_split(text, chr(10)),
    lambda s: length(regexp_replace(s, '^\s+|\s+$', '', 'g')) > 0),
    lambda s: regexp_replace(regexp_replace(s, '^\s*[-*+]?\s*', ''), '^\s+|\s+$', '', 'g')) AS lines FROM m""")
def q_clean_list_lines_marked(spark, sf):
    return _marked(spark, sf).select("conv_id", "turn", TX.clean_list_lines("text").alias("lines"))


_ANTI = """SELECT p.p_partkey, p.p_brand FROM part p {anti} (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) l ON p.p_partkey = l.l_partkey"""


@register("sql_join_anti_rows", _ANTI.format(anti="ANTI JOIN"))
def q_sql_join_anti_rows(spark, sf):
    """Parts that no large order line names."""
    return run_sql(spark, _ANTI.format(anti="LEFT ANTI JOIN"), {t: load(spark, sf, t) for t in ("part", "lineitem")})
