"""Column lists of the test tables and derived views (Spark type names), used
only to generate oracle SQL text without a Spark session."""

from __future__ import annotations

SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
    "dirty_events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
                     ("event_type", "string"), ("value", "double"), ("segment", "bigint"),
                     ("const_num", "double"), ("const_cat", "string")],
    "text_orders": [("o_orderkey", "bigint"), ("price_txt", "string"), ("date_txt", "string"),
                    ("o_orderstatus", "string")],
    "label_features": [("doc_id", "bigint"), ("quality", "int"), ("f_chars", "double"),
                       ("f_spaces", "double")],
}

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def cols(table: str) -> list[str]:
    return [n for n, _ in SCHEMAS[table]]


def numeric_cols(table: str) -> list[str]:
    return [n for n, t in SCHEMAS[table] if t in NUMERIC]


def string_cols(table: str) -> list[str]:
    return [n for n, t in SCHEMAS[table] if t in ("string", "boolean")]


def dq(name: str) -> str:
    """DuckDB identifier quoting."""
    return '"' + name.replace('"', '""') + '"'


def sq(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"
