"""User SQL and user-supplied steps (Q1-Q3)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

_QUERY_START = re.compile(r"^\s*(\(\s*)*(SELECT|WITH|VALUES|TABLE|FROM)\b", re.IGNORECASE)
_COMMENTS = re.compile(r"--[^\n]*|/\*.*?\*/", re.DOTALL)


class NotAQuery(ValueError):
    """Raised for statements that would change state (DDL/DML/commands)."""


def is_select(sql: str) -> bool:
    """Queries only: commands run eagerly inside ``spark.sql``, so they are
    refused before Spark sees them."""
    return bool(_QUERY_START.match(_COMMENTS.sub(" ", sql).strip()))


# Functions that call into the JVM by name.
_CALLS_JAVA = frozenset(("reflect", "try_reflect", "java_method"))


def check_query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None) -> None:
    """Refuse a statement unless its parsed plan is a query through and through
    (``WITH ... INSERT`` and ``FROM ... INSERT`` start like one), calls no Java
    by name, and reads nothing but the given tables and its own CTEs (without
    ``tables``: tables and views of the catalog, so no files)."""
    if not is_select(sql):
        raise NotAQuery("only SELECT / WITH / VALUES queries are accepted")
    catalyst = "org.apache.spark.sql.catalyst."

    def cls(name: str):
        return spark._jvm.java.lang.Class.forName(catalyst + name)
    commands = [cls("plans.logical." + k) for k in ("Command", "ParsedStatement", "InsertIntoDir")]
    relation, function, with_, subquery = cls("analysis.UnresolvedRelation"), cls("analysis.UnresolvedFunction"), \
        cls("plans.logical.UnresolvedWith"), cls("expressions.SubqueryExpression")

    def items(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]
    try:
        todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    except ParseException as e:
        raise NotAQuery(f"not one query: {e}") from e
    read, own = [], set()
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in commands):
            raise NotAQuery(f"only queries are accepted, not {node.nodeName()}")
        if relation.isInstance(node):
            read.append(items(node.multipartIdentifier()))
        if with_.isInstance(node):
            own |= {items(pair.productIterator().toSeq())[0].lower() for pair in items(node.cteRelations())}
        todo += items(node.children()) + items(node.innerChildren())
        expressions = items(node.expressions())
        while expressions:
            e = expressions.pop()
            if function.isInstance(e) and items(e.nameParts())[-1].lower() in _CALLS_JAVA:
                raise NotAQuery(f"{items(e.nameParts())[-1]} is refused")
            if subquery.isInstance(e):
                todo.append(e.plan())
            expressions += items(e.children())
    known = own | {t.lower() for t in tables or ()}
    for parts in read:
        if len(parts) == 1 and parts[0].lower() in known:
            continue
        if tables is not None or not spark.catalog.tableExists(".".join("`" + x.replace("`", "``") + "`" for x in parts)):
            raise NotAQuery(f"{'.'.join(parts)} is not among the given tables")


@contextmanager
def named_views(spark: SparkSession, tables: Mapping[str, DataFrame]):
    """Temp views by the given names while a text is analysed; views that had these names come back after it."""
    temporary = {r["viewName"].lower() for r in spark.sql("SHOW VIEWS").collect() if r["isTemporary"]}
    before = {name: spark.table(name) for name in tables if name.lower() in temporary}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        yield
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None,
            args: Mapping[str, object] | None = None) -> DataFrame:
    """Q1: run a read-only query over named DataFrames.  The text is left as it
    is: tables are temp views while it is analysed; named parameter markers
    (``:x``) bind ``args`` safely."""
    check_query(spark, sql, tables)
    with named_views(spark, tables or {}):
        return spark.sql(sql, args=dict(args)) if args else spark.sql(sql)


def explain_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None,
                mode: str = "formatted") -> DataFrame:
    """Q2: the plan as rows (one row per line).  Spark plans without running,
    unlike EXPLAIN ANALYZE."""
    from pyspark.sql import functions as F
    check_query(spark, sql, tables)
    with named_views(spark, tables or {}):
        plan = spark.sql(f"EXPLAIN {mode.upper()} {sql}")
    return plan.select(F.posexplode(F.split("plan", "\n")).alias("line_no", "plan"))


def apply_step(df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Q3: a trusted user step written with the DataFrame API."""
    return df.transform(step)


def apply_pandas_step(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Q3: a trusted per-batch pandas step (Arrow batches via ``mapInPandas``);
    rows stay in their partitions, nothing passes through the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)
    return df.mapInPandas(run, schema)
