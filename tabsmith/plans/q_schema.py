"""Schema / typing queries (T1-T11) and sources (S1, S9, S10) with oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabsmith.operators import schema as S
from tabsmith.plans.registry import register
from tabsmith.session import scratch_path
from tabsmith.sources import files as IO
from tabsmith.sources.tables import TABLES, duckdb_view_cte, load

TXT = duckdb_view_cte("text_orders")


def _vote_sql() -> str:
    per =" UNION ALL ".join(
        f"SELECT '{x}' AS column_name, {j} AS j, '{sp}' AS sp, '{py}' AS py, "
        f"coalesce(CAST(count(try_strptime({x}, '{py}')) AS DOUBLE) / NULLIF(count({x}), 0), 0.0) AS ratio FROM text_orders"
        for x in ("price_txt", "date_txt", "o_orderstatus")
        for j, (sp, py) in enumerate(zip(S.DATE_FORMATS_SPARK, S.DATE_FORMATS_STRPTIME)))
    return TXT + f""",
r AS ({per}),
b AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY ratio DESC, j) AS rn FROM r)
SELECT column_name, ratio AS best_ratio, CASE WHEN ratio > 0.7 THEN sp END AS spark_format,
  CASE WHEN ratio > 0.7 THEN py END AS strptime_format FROM b WHERE rn = 1"""


@register("datetime_format_vote", _vote_sql())
def q_datetime_format_vote(spark, sf):
    return S.datetime_format_vote(load(spark, sf, "text_orders"))


@register("infer_logical_types", """
WITH s AS (SELECT * FROM orders)
SELECT * FROM (VALUES ('o_orderkey', 'number', 'bigint'), ('o_custkey', 'number', 'bigint'),
  ('o_totalprice', 'number', 'double'), ('o_orderdate', 'datetime', 'timestamp_ntz')) AS t(column_name, logical_type, spark_type),
  (SELECT NULL::VARCHAR AS date_format)
UNION ALL SELECT 'o_orderstatus', CASE WHEN count(*) > 100 AND CAST(count(DISTINCT o_orderstatus) AS DOUBLE) / count(*) < 0.5
  THEN 'category' ELSE 'string' END, 'string', NULL FROM s
UNION ALL SELECT 'o_orderpriority', CASE WHEN count(*) > 100 AND CAST(count(DISTINCT o_orderpriority) AS DOUBLE) / count(*) < 0.5
  THEN 'category' ELSE 'string' END, 'string', NULL FROM s""")
def q_infer_logical_types(spark, sf):
    return S.infer_logical_types(load(spark, sf, "orders"))


@register("coerce_dates_by_rule", TXT + """
SELECT o_orderkey, price_txt, CAST(try_strptime(date_txt, '%Y-%m-%d') AS TIMESTAMP) AS date_txt, o_orderstatus FROM text_orders""")
def q_coerce_dates_by_rule(spark, sf):
    out, _ = S.coerce_dates_by_rule(load(spark, sf, "text_orders"))
    return out


def _narrow_sql(table: str, cols: list[tuple[str, str]]) -> str:
    parts = ["SELECT NULL::VARCHAR AS column_name, NULL::VARCHAR AS current_type, NULL::VARCHAR AS suggested_type "
             "WHERE false"]
    for x, t in cols:
        if t == "string":
            parts.append(f"SELECT '{x}' AS column_name, 'string' AS current_type, CASE WHEN count(*) > 0 AND "
                         f"CAST(count(DISTINCT {x}) AS DOUBLE) / count(*) < 0.5 THEN 'category' ELSE 'string' END "
                         f"AS suggested_type FROM {table}")
        elif t in ("bigint", "int"):
            parts.append(f"SELECT '{x}', '{t}', CASE WHEN min({x}) >= -128 AND max({x}) <= 127 THEN 'tinyint' "
                         f"WHEN min({x}) >= -32768 AND max({x}) <= 32767 THEN 'smallint' "
                         f"WHEN min({x}) >= -2147483648 AND max({x}) <= 2147483647 THEN 'int' ELSE 'bigint' END FROM {table}")
        elif t == "double":
            parts.append(f"SELECT '{x}', 'double', CASE WHEN bool_and(coalesce(abs({x}) % 1 = 0, false)) THEN "
                         f"CASE WHEN min({x}) >= -128 AND max({x}) <= 127 THEN 'tinyint' "
                         f"WHEN min({x}) >= -32768 AND max({x}) <= 32767 THEN 'smallint' "
                         f"WHEN min({x}) >= -2147483648 AND max({x}) <= 2147483647 THEN 'int' ELSE 'bigint' END "
                         f"ELSE 'double' END FROM {table}")
        else:
            parts.append(f"SELECT '{x}', '{t}', '{t}' FROM (SELECT count(*) FROM {table})")
    return "\nUNION ALL\n".join(parts)


@register("narrow_types_plan", _narrow_sql("lineitem", [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]))
def q_narrow_types_plan(spark, sf):
    return S.narrow_types_plan(load(spark, sf, "lineitem"))


@register("conform_to_schema", TXT + """
SELECT coalesce(TRY_CAST(o_orderkey AS DOUBLE), 0.0) AS o_orderkey, coalesce(TRY_CAST(price_txt AS DOUBLE), 0.0) AS price_txt,
  CAST(date_txt AS VARCHAR) AS date_txt, CAST(o_orderstatus AS VARCHAR) AS o_orderstatus FROM text_orders""")
def q_conform_to_schema(spark, sf):
    return S.conform_to_schema(load(spark, sf, "text_orders"), {
        "o_orderkey": "numeric", "price_txt": "numeric", "date_txt": "categorical", "o_orderstatus": "categorical"})


@register("feature_schema", """
WITH v AS (SELECT 'o_orderstatus' AS feature, o_orderstatus AS v FROM orders UNION ALL
           SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL
           SELECT 'o_orderdate', CAST(o_orderdate AS VARCHAR) FROM orders),
d AS (SELECT DISTINCT feature, v FROM v WHERE v IS NOT NULL)
SELECT feature, 'categorical' AS kind, count(*) AS n_distinct,
  CASE WHEN count(*) <= 20 THEN list(v ORDER BY v) END AS values FROM d GROUP BY feature
UNION ALL SELECT * FROM (VALUES ('o_orderkey', 'numeric', NULL::BIGINT, NULL::VARCHAR[]), ('o_custkey', 'numeric', NULL, NULL),
  ('o_totalprice', 'numeric', NULL, NULL)) WHERE (SELECT count(*) FROM orders) >= 0""")
def q_feature_schema(spark, sf):
    return S.feature_schema(load(spark, sf, "orders"))


@register("chart_columns", """
WITH lt AS (SELECT * FROM (VALUES ('o_orderkey', 'number'), ('o_custkey', 'number'), ('o_totalprice', 'number'),
  ('o_orderdate', 'datetime'), ('o_orderstatus', 'category'), ('o_orderpriority', 'category')) AS t(column_name, logical_type)
  WHERE (SELECT count(*) FROM orders) >= 0),
r AS (SELECT * FROM (VALUES ('bar', 'x', 'string'), ('bar', 'x', 'datetime'), ('bar', 'x', 'category'), ('bar', 'y', 'number'),
  ('line', 'x', 'number'), ('line', 'x', 'datetime'), ('line', 'y', 'number'), ('scatter', 'x', 'number'),
  ('scatter', 'x', 'datetime'), ('scatter', 'y', 'number'), ('histogram', 'x', 'number')) AS t(chart_type, axis, logical_type))
SELECT chart_type, axis, column_name, logical_type FROM r JOIN lt USING (logical_type)""")
def q_chart_columns(spark, sf):
    return S.chart_columns(S.infer_logical_types(load(spark, sf, "orders")))


@register("simplified_types", """
WITH smp AS (SELECT 'l_returnflag' AS column_name, l_returnflag AS v FROM lineitem WHERE l_returnflag IS NOT NULL
        UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem WHERE l_linestatus IS NOT NULL),
chk AS (SELECT column_name, count(*) AS n, count(TRY_CAST(v AS TIMESTAMP)) AS ok FROM smp GROUP BY 1)
SELECT * FROM (VALUES ('l_orderkey', 'integer'), ('l_partkey', 'integer'), ('l_suppkey', 'integer'),
  ('l_linenumber', 'integer'), ('l_quantity', 'float'), ('l_extendedprice', 'float'), ('l_discount', 'float'),
  ('l_tax', 'float'), ('l_shipdate', 'datetime')) AS t(column_name, simplified_type)
UNION ALL SELECT column_name, CASE WHEN n > 0 AND ok = n THEN 'datetime' ELSE 'categorical' END FROM chk""")
def q_simplified_types(spark, sf):
    return S.simplified_types(load(spark, sf, "lineitem"))


# ---------------------------------------------------------------------------
# sources
# ---------------------------------------------------------------------------

@register("scan_csv_roundtrip", "SELECT * FROM nation")
def q_scan_csv_roundtrip(spark, sf):
    """Write a table as CSV into the shared scratch folder, read it back
    with header and type inference, and compare with the original."""
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    IO.write_csv(load(spark, sf, "nation"), path)
    return IO.read_csv(spark, path)


@register("list_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {n} AS column_count, count(*) AS row_count FROM {t}"
    for t, n in [("region", 2), ("nation", 3), ("customer", 5), ("supplier", 4), ("part", 6), ("orders", 6),
                 ("lineitem", 11), ("events", 6), ("documents", 5), ("embeddings", 3), ("pages", 3),
                 ("benchmark", 2), ("labels", 3), ("conversations", 4)]))
def q_list_tables(spark, sf):
    return IO.list_tables(spark, {t: load(spark, sf, t) for t in TABLES})


@register("table_schema", " UNION ALL ".join(
    f"SELECT 'customer' AS table_name, {i} AS position, '{x}' AS column_name, '{t}' AS type, "
    f"count(*) - count({x}) AS null_count, count(DISTINCT {x}) = count(*) AND count({x}) = count(*) AS is_candidate_key "
    f"FROM customer" for i, (x, t) in enumerate([("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                                                   ("c_acctbal", "double"), ("c_mktsegment", "string")])))
def q_table_schema(spark, sf):
    from tabsmith.operators.profile import candidate_keys
    df = load(spark, sf, "customer")
    keys = candidate_keys(df, exact=True)
    meta = spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
                                 "position int, column_name string, type string")
    return meta.join(keys, "column_name").select(
        F.lit("customer").alias("table_name"), "position", "column_name", "type", "null_count", "is_candidate_key")

