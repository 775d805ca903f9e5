"""Row, window, sampling and scalar-function queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions import text as TX
from tabsmith.functions.core import round_doubles
from tabsmith.operators import rows as R
from tabsmith.plans.registry import register
from tabsmith.plans.schemas import cols
from tabsmith.sources.tables import duckdb_view_cte, load

HASH_DUCK = "CAST(('0x' || substr(md5(concat_ws('|', {keys}, '{seed}')), 1, 8)) AS BIGINT)"


def duck_bucket(keys: list[str], seed: int = 42) -> str:
    return HASH_DUCK.format(keys=", ".join(f"CAST({k} AS VARCHAR)" for k in keys), seed=seed)


LINEITEM_HASH_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
                      "l_linestatus", "l_shipdate"]

# ---------------------------------------------------------------------------
# P2-P4, P8, P9, P12
# ---------------------------------------------------------------------------

FOCUS = "o_totalprice > 100000 AND o_orderstatus = 'F'"


@register("focus_filter", f"SELECT *, true AS focus_applied FROM orders WHERE {FOCUS}")
def q_focus_filter(spark, sf):
    df, applied = R.focus_filter(load(spark, sf, "orders"), FOCUS)
    return df.withColumn("focus_applied", F.lit(applied))


@register("focus_filter_invalid", "SELECT *, false AS focus_applied FROM orders")
def q_focus_filter_invalid(spark, sf):
    df, applied = R.focus_filter(load(spark, sf, "orders"), "no_such_column > 3")
    return df.withColumn("focus_applied", F.lit(applied))


@register("focus_impact", """
SELECT count(*) AS rows_before, count(*) FILTER (WHERE o_orderstatus = 'O') AS rows_after,
  round(sum(o_totalprice), 2) AS sum_before, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS sum_after,
  round(avg(o_totalprice), 6) AS mean_before, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 6) AS mean_after,
  count(*) - count(*) FILTER (WHERE o_orderstatus = 'O') AS rows_removed FROM orders""")
def q_focus_impact(spark, sf):
    out = R.focus_impact(load(spark, sf, "orders"), "o_orderstatus = 'O'", "o_totalprice")
    return out.select("rows_before", "rows_after", F.round("sum_before", 2).alias("sum_before"),
                      F.round("sum_after", 2).alias("sum_after"), F.round("mean_before", 6).alias("mean_before"),
                      F.round("mean_after", 6).alias("mean_after"), "rows_removed")


@register("what_if", """
WITH b AS (SELECT sum(l_extendedprice * (1 - l_discount)) AS before,
                  sum(l_extendedprice * (1 - (l_discount + 0.05))) AS after FROM lineitem)
SELECT round(before, 2) AS before, round(after, 2) AS after, round(after - before, 2) AS delta,
       round((after - before) / abs(before) * 100, 6) AS delta_pct FROM b""")
def q_what_if(spark, sf):
    out = R.what_if(load(spark, sf, "lineitem"), {"l_discount": "l_discount + 0.05"},
                    "sum(l_extendedprice * (1 - l_discount))")
    return out.select(F.round("before", 2).alias("before"), F.round("after", 2).alias("after"),
                      F.round("delta", 2).alias("delta"), F.round("delta_pct", 6).alias("delta_pct"))


@register("text_search", """
SELECT * FROM part WHERE coalesce(contains(lower(p_name), 'red'), false)
   OR coalesce(contains(lower(p_type), 'red'), false) OR coalesce(contains(lower(p_brand), 'red'), false)""")
def q_text_search(spark, sf):
    return R.text_search(load(spark, sf, "part"), "RED", ["p_name", "p_type", "p_brand"])


@register("filter_page", "SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 50 OFFSET 20")
def q_filter_page(spark, sf):
    return R.filter_page(load(spark, sf, "orders"), {"o_orderstatus": "O"}, ["o_orderkey"], skip=20, limit=50)


@register("preview_iso", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, user_id, event_type, value, props FROM events""")
def q_preview_iso(spark, sf):
    return R.preview_iso(load(spark, sf, "events"))


# ---------------------------------------------------------------------------
# L1-L9
# ---------------------------------------------------------------------------

@register("preview", """
SELECT *, (SELECT count(*) FROM orders) AS total_rows, 6 AS total_columns
FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)""")
def q_preview(spark, sf):
    return R.preview(load(spark, sf, "orders"), ["o_orderkey"], 100)


@register("mini_preview", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 4")
def q_mini_preview(spark, sf):
    return R.mini_preview(load(spark, sf, "customer"), ["c_custkey"])


@register("sort_latest", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def q_sort_latest(spark, sf):
    return R.sort_latest(load(spark, sf, "orders"), "o_orderdate", "o_orderkey")


@register("sort_table", duckdb_view_cte("dirty_events") + """
SELECT *, row_number() OVER (ORDER BY coalesce(event_type, '') ASC, event_id ASC) AS row_position FROM dirty_events""")
def q_sort_table(spark, sf):
    return R.sort_table(load(spark, sf, "dirty_events"), "event_type", True, ["event_id"])


@register("top_n", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q_top_n(spark, sf):
    return R.top_n(load(spark, sf, "part"), "p_brand", 10)


@register("sample_rows", "SELECT * FROM part ORDER BY p_partkey LIMIT 10")
def q_sample_rows(spark, sf):
    return R.sample_rows(load(spark, sf, "part"), ["p_partkey"], 10)


@register("sample_fraction", f"SELECT * FROM orders WHERE {duck_bucket(['o_orderkey'])} < {int(0.1 * 2**32)}")
def q_sample_fraction(spark, sf):
    return R.sample_fraction(load(spark, sf, "orders"), 0.1, ["o_orderkey"])


@register("sample_n", f"SELECT * FROM orders ORDER BY {duck_bucket(['o_orderkey'])}, o_orderkey LIMIT 1000")
def q_sample_n(spark, sf):
    return R.sample_n(load(spark, sf, "orders"), 1000, ["o_orderkey"])


@register("sample_policy", f"""
SELECT *, CAST(0.1 AS DOUBLE) AS applied_fraction FROM lineitem
WHERE {duck_bucket(LINEITEM_HASH_KEYS)} < {int(0.1 * 2**32)}""")
def q_sample_policy(spark, sf):
    out, frac = R.sample_policy(load(spark, sf, "lineitem"), LINEITEM_HASH_KEYS, "compare")
    return out.withColumn("applied_fraction", F.lit(float(frac)))


@register("plot_sample", f"""
SELECT * FROM lineitem ORDER BY {duck_bucket(LINEITEM_HASH_KEYS)}, {', '.join(cols('lineitem'))} LIMIT 10000""")
def q_plot_sample(spark, sf):
    df = load(spark, sf, "lineitem")
    b = R.hash_bucket(LINEITEM_HASH_KEYS, 42)
    return df.withColumn("_b", b).orderBy("_b", *df.columns).limit(10000).drop("_b")


# ---------------------------------------------------------------------------
# W2-W7
# ---------------------------------------------------------------------------

@register("latest_k_per_group", """
SELECT event_id, ts, user_id, event_type, value, props,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 10""")
def q_latest_k_per_group(spark, sf):
    return R.latest_k_per_group(load(spark, sf, "events"), "user_id", "ts", "event_id", 10)


@register("latest_per_group", """
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1""")
def q_latest_per_group(spark, sf):
    return R.latest_per_group(load(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@register("truncate_history", """
SELECT conv_id, turn, role, text FROM
(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS up,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS dn FROM conversations)
WHERE up <= 2 OR dn <= 20""")
def q_truncate_history(spark, sf):
    return R.truncate_history(load(spark, sf, "conversations"), "conv_id", "turn", 10, 2)


@register("assemble_qa_pairs", """
WITH i AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM conversations)
SELECT conv_id, CAST(q AS BIGINT) AS pair_index,
  min(turn) FILTER (WHERE role = 'user') AS question_turn,
  arg_max(text, turn) FILTER (WHERE role = 'user') AS question,
  coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS answer,
  count(*) FILTER (WHERE role = 'assistant') AS n_answer_parts
FROM i WHERE q > 0 GROUP BY conv_id, q""")
def q_assemble_qa_pairs(spark, sf):
    return R.assemble_qa_pairs(load(spark, sf, "conversations"))


@register("constant_columns", duckdb_view_cte("dirty_events") + " " + " UNION ALL ".join(
    [f"SELECT '{x}' AS column_name, true AS is_numeric, round(coalesce(var_samp(CAST({x} AS DOUBLE)), 0.0), 6) AS variance, "
     f"coalesce(var_samp(CAST({x} AS DOUBLE)), 0.0) = 0 AS is_constant FROM dirty_events"
     for x in ["event_id", "user_id", "value", "segment", "const_num"]]
    + [f"SELECT '{x}', false, CAST(NULL AS DOUBLE), count({x}) = 0 OR (count(*) FILTER (WHERE {x} IS NULL) = 0 "
       f"AND min({x}) = max({x})) FROM dirty_events" for x in ["ts", "event_type", "const_cat"]]))
def q_constant_columns(spark, sf):
    return round_doubles(R.constant_columns(load(spark, sf, "dirty_events")))


# ---------------------------------------------------------------------------
# F1-F5, F9, F10 scalar functions over whole columns / texts
# ---------------------------------------------------------------------------

@register("sanitize_names", r"""
SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^\w\-. ]', '', 'g'), '[ .]+', '_', 'g') AS safe_name FROM part""")
def q_sanitize_names(spark, sf):
    return load(spark, sf, "part").select("p_partkey", TX.sanitize_name("p_name").alias("safe_name"))


STRIP_DUCK = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@register("extract_code_blocks", r"""
SELECT conv_id, turn,
  CASE WHEN regexp_matches(text, '(?is)```python\s*(.*?)\s*```')
       THEN regexp_replace(regexp_extract(text, '(?is)```python\s*(.*?)\s*```', 1), '^\s+|\s+$', '', 'g') END AS code,
  regexp_replace(regexp_replace(text, '(?is)```python\s*(.*?)\s*```', '', 'g'), '^\s+|\s+$', '', 'g') AS remaining_text
FROM conversations""")
def q_extract_code_blocks(spark, sf):
    df = load(spark, sf, "conversations")
    return df.select("conv_id", "turn", TX.extract_python_code("text").alias("code"),
                     TX.strip_python_code("text").alias("remaining_text"))


@register("extract_html_blocks", r"""
SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '```html\s*([\s\S]*?)\s*```', 1)) > 0
  THEN regexp_extract_all(text, '```html\s*([\s\S]*?)\s*```', 1) ELSE [text] END AS html_blocks FROM documents""")
def q_extract_html_blocks(spark, sf):
    return load(spark, sf, "documents").select("doc_id", TX.extract_html_blocks("text").alias("html_blocks"))


@register("extract_image_refs", r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '`([^`]+\.(?:png|jpg|jpeg|gif|webp))`')
  THEN regexp_extract(text, '`([^`]+\.(?:png|jpg|jpeg|gif|webp))`', 1) END AS image_ref FROM conversations""")
def q_extract_image_refs(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", TX.extract_image_ref("text").alias("image_ref"))


@register("clean_list_lines", r"""
SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)),
    lambda s: length(regexp_replace(s, '^\s+|\s+$', '', 'g')) > 0),
    lambda s: regexp_replace(regexp_replace(s, '^\s*[-*+]?\s*', ''), '^\s+|\s+$', '', 'g')) AS lines FROM documents""")
def q_clean_list_lines(spark, sf):
    return load(spark, sf, "documents").select("doc_id", TX.clean_list_lines("text").alias("lines"))


@register("json_payload", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CAST(to_json({'event_id': event_id, 'event_type': event_type}) AS VARCHAR) AS row_json FROM events""")
def q_json_payload(spark, sf):
    df = load(spark, sf, "events")
    return df.select("event_id", TX.json_field("props", "$.k").cast("bigint").alias("k"),
                     TX.row_to_json(["event_id", "event_type"]).alias("row_json"))


@register("stats_as_list", """
WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, list(o_orderpriority ORDER BY o_orderpriority) AS priorities,
       list(n ORDER BY o_orderpriority) AS counts FROM g GROUP BY 1""")
def q_stats_as_list(spark, sf):
    """Chart-style nested result: per status, the per-priority counts as
    aligned lists (groups are bounded by the number of priorities)."""
    g = load(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    pairs = g.groupBy("o_orderstatus").agg(F.sort_array(F.collect_list(F.struct("o_orderpriority", "n"))).alias("p"))
    return pairs.select("o_orderstatus", F.col("p.o_orderpriority").alias("priorities"), F.col("p.n").alias("counts"))


@register("assemble_qa_pairs_hot", """
WITH i AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM conversations)
SELECT conv_id, CAST(q AS BIGINT) AS pair_index,
  min(turn) FILTER (WHERE role = 'user') AS question_turn,
  arg_max(text, turn) FILTER (WHERE role = 'user') AS question,
  coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS answer,
  count(*) FILTER (WHERE role = 'assistant') AS n_answer_parts
FROM i WHERE q > 0 GROUP BY conv_id, q""")
def q_assemble_qa_pairs_hot(spark, sf):
    """Same result with every conversation treated as a hot key (chunked running count)."""
    return R.assemble_qa_pairs(load(spark, sf, "conversations"), rows_per_chunk=2)


@register("assemble_qa_pairs_null_conv", """
WITH n AS (SELECT CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id END AS conv_id,
             lpad(CAST(conv_id AS VARCHAR), 12, '0') || '/' || lpad(CAST(turn AS VARCHAR), 6, '0') AS place, role, text FROM conversations),
i AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY place
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM n)
SELECT conv_id, CAST(q AS BIGINT) AS pair_index,
  min(place) FILTER (WHERE role = 'user') AS question_turn,
  arg_max(text, place) FILTER (WHERE role = 'user') AS question,
  coalesce(string_agg(text, chr(10) ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS answer,
  count(*) FILTER (WHERE role = 'assistant') AS n_answer_parts
FROM i WHERE q > 0 GROUP BY conv_id, q""")
def q_assemble_qa_pairs_null_conv(spark, sf):
    """A third of the turns belongs to one conversation without an id; turns are ordered by text."""
    place = F.concat(F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit("/"), F.lpad(F.col("turn").cast("string"), 6, "0"))
    df = load(spark, sf, "conversations").select(F.when(F.col("conv_id") % 3 != 0, F.col("conv_id")).alias("conv_id"),
                                                 place.alias("place"), "role", "text")
    out = R.assemble_qa_pairs(df, turn="place", rows_per_chunk=100)
    return out
