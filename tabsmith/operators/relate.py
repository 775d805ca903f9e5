"""Join and relationship operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import INTEGRAL_TYPES, TEMPORAL_TYPES, c


def join_dimension(fact: DataFrame, dim: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """Fact-to-dimension equi-join.

    No hint: Spark broadcasts ``dim`` only when its estimated size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and AQE re-checks the real size
    after the shuffle map stage; otherwise it stays a sort-merge join (with
    AQE splitting skewed partitions).  That is the size check - a dimension
    that grows with the data is never forced into every executor's memory.
    """
    return fact.join(dim, on, how)


def feature_label_join(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Attach the target to the features by a row key (inner)."""
    return join_dimension(features, labels, key, "inner")


def parents_with_children(parent: DataFrame, child: DataFrame, on: Sequence[tuple[str, str]],
                          child_filter: Column | None = None) -> DataFrame:
    """Distinct parents having at least one (filtered) child - a left
    semi join, so a parent never repeats and no child column is carried."""
    ch = child.where(child_filter) if child_filter is not None else child
    cond = None
    for p, k in on:
        e = parent[p] == ch[k]
        cond = e if cond is None else (cond & e)
    return parent.join(ch, cond, "left_semi")


def children_in_order(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str,
                      order_by: Sequence[str]) -> DataFrame:
    """One-to-many load ordered by time - every parent (left join) with its
    children flat and numbered in order.  Flat rows instead of one nested
    array per parent: a parent with a huge number of children never becomes
    one giant value.  Positions come from ``position_in_group`` (a global
    range-partitioned sort), so a parent with a third of all children is
    spread over many tasks instead of one window partition."""
    from tabsmith.operators.rows import position_in_group
    j = parent.join(child, parent[parent_key] == child[child_key], "left")
    j = position_in_group(j, [parent_key], [c(o) for o in order_by], "__pos")
    return j.withColumn("child_position", F.when(c(child_key).isNotNull(), F.col("__pos")).cast("bigint")).drop("__pos")


# Kinds of columns that can be keys, and the text under which their values meet.
_KEY_KINDS = (("int", INTEGRAL_TYPES), ("text", (T.StringType,)), ("time", TEMPORAL_TYPES))
_LONG_TEXT = 64


def _key_kind(dt: T.DataType) -> str | None:
    return next((kind for kind, types in _KEY_KINDS if isinstance(dt, types)), None)


def _key_text(name: str, dt: T.DataType) -> Column:
    """Value of a key column as text; a long text by its SHA-256, so that an index entry has a bounded size."""
    if isinstance(dt, T.DateType):
        return c(name).cast("timestamp_ntz").cast("string")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return c(name).cast("timestamp_ntz").cast("string")
    if isinstance(dt, T.StringType):
        return F.when(F.octet_length(c(name)) > _LONG_TEXT, F.concat(F.lit("sha256:"), F.sha2(c(name), 256))).otherwise(c(name))
    return c(name).cast("bigint").cast("string")


def value_index(tables: Mapping[str, DataFrame], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Inverted index (kind, value, holders): which of the columns hold a value, and in how many rows.

    One scan per table unpivots its columns to (column, value) and counts the
    rows of each pair before the shuffle, so a value that fills a third of a
    table is one entry per task.  ``holders`` has one entry per column that
    holds the value: its size is bounded by the schema."""
    parts = []
    for t, df in tables.items():
        own = [(i, x, df.schema[x].dataType) for i, (tt, x) in enumerate(columns) if tt == t]
        if own:
            cells = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(_key_kind(dt)).alias("kind"), _key_text(x, dt).alias("value"))
                              for i, x, dt in own])
            parts.append(df.select(F.inline(cells)))
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    counts = cells.groupBy("kind", "value", "col").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("kind", "value").agg(F.collect_list(F.struct("col", "n")).alias("holders"))


_EDGES = ("child_table string, child_column string, parent_table string, parent_column string, "
          "child_distinct bigint, matched bigint, coverage double")


def inclusion_dependencies(tables: Mapping[str, DataFrame], key_suffix: str = "key") -> DataFrame:
    """J4 (re-aimed): discover foreign keys as inclusion dependencies, for
    integer, text and date or time keys.

    Parents: columns whose values are unique and non-null.  Children: columns
    named ``*{key_suffix}`` in other tables.  A pair is kept when every
    distinct child value exists in the parent column.

    All pairs come from one inverted index: for each column the sets of columns
    that hold its values are intersected (a bit mask, 62 columns a word), so
    there is one scan per table and no join per pair.  One row per column
    reaches the driver."""
    spark = next(iter(tables.values())).sparkSession
    # a kind without a child column can't give a pair: its columns aren't read
    kinds = {_key_kind(f.dataType) for df in tables.values() for f in df.schema.fields if f.name.lower().endswith(key_suffix)} - {None}
    columns = [(t, f.name) for t, df in tables.items() for f in df.schema.fields if _key_kind(f.dataType) in kinds]
    if not columns:
        return spark.createDataFrame([], _EDGES)
    index = value_index(tables, columns)
    words = range(0, len(columns), 62)

    def mask(first: int) -> Column:
        bits = F.filter("holders", lambda h: (h["col"] >= first) & (h["col"] < first + 62))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda m, h: m.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), h["col"] - first)))
    seen = index.select("value", *[mask(w).alias(f"m{w}") for w in words], F.inline("holders"))
    known = F.col("value").isNotNull()
    stats = seen.groupBy("col").agg(
        F.count("value").alias("distinct"), F.sum(F.when(known, F.col("n"))).alias("filled"),
        F.sum(F.when(~known, F.col("n"))).alias("nulls"), *[F.bit_and(F.when(known, F.col(f"m{w}"))).alias(f"m{w}") for w in words])
    rows = {r["col"]: r for r in stats.collect()}
    out = []
    for i, (ct, cc) in enumerate(columns):
        child = rows.get(i)
        if not cc.lower().endswith(key_suffix) or child is None or not child["distinct"]:
            continue
        for j, (pt, pc) in enumerate(columns):
            parent = rows.get(j)
            if parent is None or pt == ct or not child[f"m{j - j % 62}"] >> (j % 62) & 1:
                continue
            if parent["distinct"] == parent["filled"] and not parent["nulls"]:
                out.append((ct, cc, pt, pc, child["distinct"], child["distinct"], 1.0))
    return spark.createDataFrame(out, _EDGES)


def related_tables(edges: DataFrame, table: str) -> DataFrame:
    """Outgoing (table is child) and incoming (table is parent) edges of a table."""
    out = edges.where(F.col("child_table") == table).withColumn("direction", F.lit("outgoing"))
    inc = edges.where(F.col("parent_table") == table).withColumn("direction", F.lit("incoming"))
    return out.unionByName(inc)


def category_alignment(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Full outer alignment of the category counts of two tables."""
    a = reference.groupBy(c(column).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("ref_count"))
    b = current.groupBy(c(column).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("cur_count"))
    j = a.join(b, a["category"].eqNullSafe(b["category"]), "full_outer")
    return j.select(F.coalesce(a["category"], b["category"]).alias("category"),
                    F.coalesce(F.col("ref_count"), F.lit(0)).alias("ref_count"),
                    F.coalesce(F.col("cur_count"), F.lit(0)).alias("cur_count"))
