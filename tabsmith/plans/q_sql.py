"""User SQL surface (Q1, Q3, J7): the same query text runs in Spark (through
``run_sql``) and in DuckDB (the oracle)."""

from __future__ import annotations

import pandas as pd

from tabsmith.operators.sqlapi import apply_pandas_step, run_sql
from tabsmith.plans.registry import register
from tabsmith.sources.tables import load

SQL_SELECT = """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus"""

SQL_ROLLUP = """
SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g_status,
  CAST(grouping(o_orderpriority) AS INT) AS g_priority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"""

SQL_RANK = """
SELECT o_orderkey, o_custkey,
  CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rnk,
  CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS drnk,
  CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS quartile,
  lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_price,
  lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total
FROM orders"""

SQL_SET_OPS = """
SELECT c_custkey AS k, 'intersect' AS op FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL
SELECT c_custkey, 'except' FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)"""

SQL_SEMI = """
SELECT c_custkey, c_name, c_mktsegment FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)"""

SQL_ANTI = """
SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)"""

SQL_JOIN3 = """
SELECT n.n_name, r.r_name, count(*) AS n_customers, round(sum(c.c_acctbal), 2) AS acctbal
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY n.n_name, r.r_name"""


def _q(sql: str, names: list[str]):
    def run(spark, sf):
        return run_sql(spark, sql, {n: load(spark, sf, n) for n in names})
    return run


register("sql_select", SQL_SELECT)(_q(SQL_SELECT, ["lineitem"]))
register("sql_rollup", SQL_ROLLUP)(_q(SQL_ROLLUP, ["orders"]))
register("sql_rank", SQL_RANK)(_q(SQL_RANK, ["orders"]))
register("sql_set_ops", SQL_SET_OPS)(_q(SQL_SET_OPS, ["customer", "orders"]))
register("sql_join_semi", SQL_SEMI)(_q(SQL_SEMI, ["customer", "orders"]))
register("sql_join_anti", SQL_ANTI)(_q(SQL_ANTI, ["customer", "orders"]))
register("sql_join_3way", SQL_JOIN3)(_q(SQL_JOIN3, ["customer", "nation", "region"]))


@register("sql_params", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 150000")
def q_sql_params(spark, sf):
    return run_sql(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :st AND o_totalprice > :p",
                   {"orders": load(spark, sf, "orders")}, args={"st": "P", "p": 150000})


def _net_price(pdf: pd.DataFrame) -> pd.DataFrame:
    """A user step written in pandas (runs per Arrow batch inside the tasks)."""
    out = pd.DataFrame({"l_orderkey": pdf["l_orderkey"], "l_linenumber": pdf["l_linenumber"]})
    out["net"] = pdf["l_extendedprice"] * (1.0 - pdf["l_discount"]) * (1.0 + pdf["l_tax"])
    return out


@register("user_step_pandas", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0 - l_discount) * (1.0 + l_tax) AS net FROM lineitem""")
def q_user_step_pandas(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return apply_pandas_step(li, _net_price, "l_orderkey bigint, l_linenumber int, net double")
