"""Readers for the Parquet tables and the derived 'dirty' views.

The derived views inject nulls, rare values, duplicates and text-typed values
with the same SQL text in Spark and DuckDB, so cleaning and typing operators
have something to do while staying oracle-checkable.  They are Spark
projections over the given tables: their size grows with the tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(table_path(sf_dir, name))


# ---------------------------------------------------------------------------
# Derived views.  Same SQL text for both engines ({src} is the input relation).
# ---------------------------------------------------------------------------

_DIRTY_EVENTS_BODY = """
SELECT event_id, ts, user_id,
  CASE WHEN event_id % 17 = 5 THEN NULL
       WHEN event_id % 401 = 0 THEN 'rare_' || CAST(event_id AS STRING)
       ELSE event_type END AS event_type,
  CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 23 = 7 THEN NULL ELSE user_id % 7 END AS segment,
  CAST(5.0 AS DOUBLE) AS const_num, 'x' AS const_cat
FROM {events}"""

DIRTY_EVENTS_SQL = (_DIRTY_EVENTS_BODY + "\nUNION ALL" + _DIRTY_EVENTS_BODY
                    + " WHERE event_id % 50 = 0")

TEXT_ORDERS_SQL = """
SELECT o_orderkey, CAST(o_totalprice AS STRING) AS price_txt,
  CASE WHEN o_orderkey % 20 = 1 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_txt,
  o_orderstatus FROM {orders}"""

LABEL_FEATURES_SQL = """
SELECT d.doc_id, l.quality, CAST(d.n_chars AS DOUBLE) AS f_chars,
  CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) AS f_spaces
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""

NAN_EVENTS_SQL = """
SELECT event_id, event_type,
  CASE WHEN event_id % 10 = 3 THEN NULL WHEN event_id % 10 = 6 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value,
  CASE WHEN event_id % 8 = 2 THEN CAST('NaN' AS DOUBLE) ELSE CAST(user_id % 7 AS DOUBLE) END AS segment,
  CAST(user_id AS DOUBLE) AS user_num FROM {events}"""

VIEW_SQL = {
    "nan_events": (NAN_EVENTS_SQL, ("events",)),
    "dirty_events": (DIRTY_EVENTS_SQL, ("events",)),
    "text_orders": (TEXT_ORDERS_SQL, ("orders",)),
    "label_features": (LABEL_FEATURES_SQL, ("documents", "labels")),
}


def spark_view(spark: SparkSession, sf_dir: str, sql: str, deps: tuple[str, ...]) -> DataFrame:
    """A projection over given tables by the SQL text that the oracle uses, too."""
    return spark.sql(sql, **{d: read_table(spark, sf_dir, d) for d in deps})


def read_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "label_features":
        return label_features(spark, sf_dir)
    return spark_view(spark, sf_dir, *VIEW_SQL[name])


def label_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``LABEL_FEATURES_SQL``.  A document's text is counted where it is read: as planned from the SQL,
    the join would shuffle and sort all texts."""
    text = F.col("text")
    counted = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("f_chars"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("double").alias("f_spaces"))
    found = counted.join(read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return found.select("doc_id", "quality", "f_chars", "f_spaces")


def duckdb_view_cte(*names: str) -> str:
    """``WITH`` clause defining the derived views for the DuckDB oracle."""
    parts = []
    for n in names:
        sql, deps = VIEW_SQL[n]
        parts.append(f"{n} AS ({sql.format(**{d: d for d in deps})})")
    return "WITH " + ",\n".join(parts) + "\n"


def nan_as_null_cte(view: str, columns: tuple[str, ...], name: str = "plain") -> str:
    """The CTE of a derived view, and ``name``: the same with NaN as NULL in these columns (for oracles)."""
    mended = ", ".join(f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END AS {x}" for x in columns)
    return duckdb_view_cte(view) + f", {name} AS (SELECT * REPLACE ({mended}) FROM {view})"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table or derived view by name."""
    if name in VIEW_SQL:
        return read_view(spark, sf_dir, name)
    return read_table(spark, sf_dir, name)
