"""Join queries (J1-J4, J6) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import relate as J
from tabsmith.plans.registry import register
from tabsmith.sources.tables import load


@register("feature_label_join", """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_feature_label_join(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return J.feature_label_join(d, load(spark, sf, "labels"), "doc_id")


@register("join_inner", """
SELECT * FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""")
def q_join_inner(spark, sf):
    o = load(spark, sf, "orders")
    return J.parents_with_children(load(spark, sf, "customer"), o, [("c_custkey", "o_custkey")],
                                   F.col("o_orderstatus") == "F")


@register("join_nested", """
SELECT c.*, o.o_orderkey, o.o_orderdate, o.o_totalprice,
  CASE WHEN o.o_custkey IS NOT NULL THEN row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderdate, o.o_orderkey) END AS child_position
FROM customer c LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders) o ON c.c_custkey = o.o_custkey""")
def q_join_nested(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    out = J.children_in_order(load(spark, sf, "customer"), o, "c_custkey", "o_custkey", ["o_orderdate", "o_orderkey"])
    return out.drop("o_custkey")


_REL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
_INTS = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"],
         "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"],
         "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"],
         "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]}


def _related_sql() -> str:
    cols = [(t, x) for t in _REL for x in _INTS[t]]
    stats = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{x}' AS x, count(DISTINCT {x}) AS d, count({x}) AS n, count(*) AS rows FROM {t}"
        for t, x in cols)
    pairs = []
    for ct, cc in cols:
        if not cc.endswith("key"):
            continue
        for pt, pc in cols:
            if pt == ct:
                continue
            pairs.append(
                f"SELECT '{ct}' AS child_table, '{cc}' AS child_column, '{pt}' AS parent_table, '{pc}' AS parent_column, "
                f"(SELECT count(DISTINCT {cc}) FROM {ct}) AS child_distinct, "
                f"(SELECT count(DISTINCT {cc}) FROM {ct} WHERE CAST({cc} AS BIGINT) IN (SELECT CAST({pc} AS BIGINT) FROM {pt})) AS matched")
    return f"""WITH st AS ({stats}),
pk AS (SELECT t, x FROM st WHERE d = rows AND n = rows AND rows > 0),
pr AS ({' UNION ALL '.join(pairs)})
SELECT pr.*, CAST(matched AS DOUBLE) / child_distinct AS coverage FROM pr JOIN pk ON pr.parent_table = pk.t AND pr.parent_column = pk.x
WHERE child_distinct > 0 AND matched = child_distinct"""


@register("related_tables", _related_sql())
def q_related_tables(spark, sf):
    return J.inclusion_dependencies({t: load(spark, sf, t) for t in _REL})


def _keyed(spark, sf):
    """Tables keyed by text and by date: customers by a code, a calendar, and orders that refer to both."""
    o = load(spark, sf, "orders")
    code = lambda x: F.concat(F.lit("C-"), F.col(x).cast("string"))
    return {"clients": load(spark, sf, "customer").select(code("c_custkey").alias("client_key"), F.col("c_name").alias("client_name_key")),
            "days": o.select(F.col("o_orderdate").cast("date").alias("day_key")).distinct(),
            "sales": o.select(code("o_custkey").alias("buyer_key"), F.col("o_orderdate").cast("date").alias("sold_key"),
                              F.when(F.col("o_orderkey") % 3 != 0, code("o_custkey")).alias("agent_key"),
                              F.concat(code("o_custkey"), F.lit("?")).alias("other_key"), F.col("o_orderkey").alias("sale_key"))}


_KEYED_COLS = {"clients": ["client_key", "client_name_key"], "days": ["day_key"],
               "sales": ["buyer_key", "sold_key", "agent_key", "other_key", "sale_key"]}


def _keyed_sql() -> str:
    cols = [(t, x) for t, xs in _KEYED_COLS.items() for x in xs]
    cells = " UNION ALL ".join(f"SELECT '{t}' AS t, '{x}' AS x, typeof({x}) AS k, CAST({x} AS VARCHAR) AS v FROM {t}" for t, x in cols)
    return f"""WITH clients AS (SELECT 'C-' || c_custkey AS client_key, c_name AS client_name_key FROM customer),
days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day_key FROM orders),
sales AS (SELECT 'C-' || o_custkey AS buyer_key, CAST(o_orderdate AS DATE) AS sold_key,
            CASE WHEN o_orderkey % 3 <> 0 THEN 'C-' || o_custkey END AS agent_key, 'C-' || o_custkey || '?' AS other_key,
            o_orderkey AS sale_key FROM orders),
cells AS ({cells}),
st AS (SELECT t, x, any_value(k) AS k, count(DISTINCT v) AS d, count(v) AS n, count(*) AS rows FROM cells GROUP BY t, x),
vals AS (SELECT DISTINCT t, x, k, v FROM cells WHERE v IS NOT NULL),
m AS (SELECT a.t AS child_table, a.x AS child_column, b.t AS parent_table, b.x AS parent_column, count(*) AS matched
      FROM vals a JOIN vals b ON a.k = b.k AND a.v = b.v AND a.t <> b.t GROUP BY 1, 2, 3, 4)
SELECT child_table, child_column, parent_table, parent_column, c.d AS child_distinct, matched, CAST(matched AS DOUBLE) / c.d AS coverage
FROM m JOIN st c ON child_table = c.t AND child_column = c.x JOIN st p ON parent_table = p.t AND parent_column = p.x
WHERE matched = c.d AND p.d = p.rows AND p.n = p.rows"""


@register("related_tables_text_date", _keyed_sql())
def q_related_tables_text_date(spark, sf):
    return J.inclusion_dependencies(_keyed(spark, sf))


@register("drift_category_table", """
WITH a AS (SELECT CAST(event_type AS VARCHAR) AS category, count(*) AS ref_count FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
b AS (SELECT CAST(event_type AS VARCHAR) AS category, count(*) AS cur_count FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT coalesce(a.category, b.category) AS category, coalesce(ref_count, 0) AS ref_count, coalesce(cur_count, 0) AS cur_count
FROM a FULL OUTER JOIN b ON a.category IS NOT DISTINCT FROM b.category""")
def q_drift_category_table(spark, sf):
    ev = load(spark, sf, "events")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return J.category_alignment(ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut), "event_type")
