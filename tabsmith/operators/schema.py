"""Schema and type inference jobs.

Each inference is one aggregate over the table (or over an explicitly
ordered sample of it) that returns one row per column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import INTEGRAL_TYPES, TEMPORAL_TYPES, c, is_numeric, q

# The seven date formats of the reference vote, in its order
# (strptime spelling), and the equivalent Spark patterns.  One-letter Spark
# fields accept 1- or 2-digit days and months as strptime does.
DATE_FORMATS_STRPTIME = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d",
                         "%d-%m-%Y", "%m-%d-%Y")
DATE_FORMATS_SPARK = ("yyyy-M-d H:m:s", "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d",
                      "d-M-yyyy", "M-d-yyyy")
ISO_DATE_PREFIX = r"^\d{4}-\d{2}-\d{2}"
# Text shape of each format above (same order): a format is only tried on
# text of its shape, so most failing parses (exception-driven, slow) never run.
DATE_SHAPES = (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", r"^\d{4}-\d{1,2}-\d{1,2}$",
               r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{4}/\d{1,2}/\d{1,2}$",
               r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$")


def _sample(df: DataFrame, rows: int | None, order_by: Sequence[str] | None) -> DataFrame:
    """First ``rows`` rows in an explicit order, or the whole table."""
    if rows is None or not order_by:
        return df
    return df.orderBy(*[c(x) for x in order_by]).limit(rows)


def datetime_format_vote(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.7,
                         sample_rows: int | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """Share of non-null values each format parses; best format (first on
    ties) wins when its share exceeds ``threshold``.  One aggregate."""
    s = _sample(df, sample_rows, order_by)
    cols = list(columns) if columns is not None else [f.name for f in s.schema.fields
                                                       if isinstance(f.dataType, T.StringType)]
    aggs = []
    for i, x in enumerate(cols):
        v = c(x).cast("string")
        aggs.append(F.count(v).alias(f"n{i}"))
        for j, fmt in enumerate(DATE_FORMATS_SPARK):
            aggs.append(F.count(F.when(v.rlike(DATE_SHAPES[j]), F.try_to_timestamp(v, F.lit(fmt))))
                        .alias(f"p{i}_{j}"))
    st = s.agg(*aggs).first()  # one row: 8 counts per column
    rows = []
    for i, x in enumerate(cols):
        n = st[f"n{i}"]
        ratios = [(st[f"p{i}_{j}"] / n) if n else 0.0 for j in range(len(DATE_FORMATS_SPARK))]
        best = max(range(len(ratios)), key=lambda j: (ratios[j], -j))  # earliest format on ties
        ok = ratios[best] > threshold
        rows.append((x, float(ratios[best]), DATE_FORMATS_SPARK[best] if ok else None,
                     DATE_FORMATS_STRPTIME[best] if ok else None))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, best_ratio double, spark_format string, strptime_format string")


def apply_datetime_formats(df: DataFrame, formats: Mapping[str, str]) -> DataFrame:
    """Convert columns with the voted format, invalid text -> NULL."""
    return df.withColumns({x: F.try_to_timestamp(c(x).cast("string"), F.lit(f)).cast("timestamp_ntz")
                           for x, f in formats.items()})


def infer_logical_types(df: DataFrame, sample_rows: int | None = None, order_by: Sequence[str] | None = None,
                        category_ratio: float = 0.5, min_rows_for_category: int = 100) -> DataFrame:
    """Datetime -> number -> boolean -> category -> string per column.

    Text columns: date vote first; otherwise category when
    distinct / rows < ``category_ratio`` and rows > ``min_rows_for_category``.
    The whole table decides unless the caller asks for its first
    ``sample_rows`` rows by ``order_by``."""
    s = _sample(df, sample_rows, order_by)
    fields = s.schema.fields
    strings = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    vote = {}
    if strings:
        vote = {r["column_name"]: r["spark_format"] for r in datetime_format_vote(s, strings).collect()}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_distinct(c(f.name)).alias(f"d{i}"))
    st = s.agg(*aggs).first()
    rows = []
    for i, f in enumerate(fields):
        dt = f.dataType
        if isinstance(dt, TEMPORAL_TYPES) or (f.name in vote and vote[f.name]):
            lt = "datetime"
        elif isinstance(dt, T.BooleanType):
            lt = "boolean"
        elif is_numeric(dt):
            lt = "number"
        elif st["_rows"] > min_rows_for_category and st[f"d{i}"] / st["_rows"] < category_ratio:
            lt = "category"
        else:
            lt = "string"
        rows.append((f.name, lt, dt.simpleString(), vote.get(f.name)))
    return df.sparkSession.createDataFrame(rows, "column_name string, logical_type string, "
                                                 "spark_type string, date_format string")


def simplified_types(df: DataFrame) -> DataFrame:
    """Integer / float / datetime / boolean / categorical; a text column is
    datetime when it has values and all of them parse as timestamps.  One
    aggregate over the whole table."""
    fields = df.schema.fields
    out = []
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    parsed: dict[str, bool] = {}
    if texts:
        r = df.agg(*[F.count(c(x)).alias(f"n{i}") for i, x in enumerate(texts)],
                   *[F.count(F.try_to_timestamp(c(x))).alias(f"ok{i}") for i, x in enumerate(texts)]).first()
        parsed = {x: r[f"n{i}"] > 0 and r[f"ok{i}"] == r[f"n{i}"] for i, x in enumerate(texts)}
    for f in fields:
        dt = f.dataType
        if isinstance(dt, INTEGRAL_TYPES):
            t = "integer"
        elif isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
            t = "float"
        elif isinstance(dt, TEMPORAL_TYPES):
            t = "datetime"
        elif isinstance(dt, T.BooleanType):
            t = "boolean"
        elif isinstance(dt, T.StringType):
            t = "datetime" if parsed.get(f.name) else "categorical"
        else:
            t = dt.simpleString()
        out.append((f.name, t))
    return df.sparkSession.createDataFrame(out, "column_name string, simplified_type string")


def coerce_dates_by_rule(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """T4: text columns named like a date/time, or whose every value starts
    with ``dddd-dd-dd``, become timestamps (invalid -> NULL) unless the
    conversion leaves nothing.  One aggregate decides for all columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df, []
    aggs = []
    for i, x in enumerate(texts):
        v = c(x)
        aggs += [F.bool_and(F.coalesce(v.rlike(ISO_DATE_PREFIX), F.lit(False))).alias(f"m{i}"),
                 F.count(v).alias(f"n{i}"), F.count(F.try_to_timestamp(v)).alias(f"t{i}")]
    st = df.agg(*aggs).first()
    conv = []
    for i, x in enumerate(texts):
        named = "date" in x.lower() or "time" in x.lower()
        if (named or (st[f"m{i}"] and st[f"n{i}"] > 0)) and st[f"t{i}"] > 0:
            conv.append(x)
    return df.withColumns({x: F.try_to_timestamp(c(x)).cast("timestamp_ntz") for x in conv}), conv


def narrow_types_plan(df: DataFrame, allow_float32: bool = False, category_ratio: float = 0.5) -> DataFrame:
    """T5: smallest integer type holding [min, max]; integer-valued floats
    (without nulls) -> integers; float32 only on request (lossy); text with
    distinct/rows < ratio flagged as category.  One aggregate."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        x = c(f.name)
        if is_numeric(f.dataType):
            aggs += [F.min(x.cast("double")).alias(f"lo{i}"), F.max(x.cast("double")).alias(f"hi{i}"),
                     F.bool_and(F.coalesce(F.abs(x.cast("double")) % 1 == 0, F.lit(False))).alias(f"int{i}")]
        elif isinstance(f.dataType, T.StringType):
            aggs.append(F.count_distinct(x).alias(f"d{i}"))
    st = df.agg(*aggs).first()
    ranges = (("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2**31, 2**31 - 1))
    out = []
    for i, f in enumerate(fields):
        cur = f.dataType.simpleString()
        sug = cur
        if is_numeric(f.dataType) and st[f"lo{i}"] is not None:
            lo, hi, integral = st[f"lo{i}"], st[f"hi{i}"], st[f"int{i}"]
            if isinstance(f.dataType, INTEGRAL_TYPES) or integral:
                sug = "bigint" if isinstance(f.dataType, INTEGRAL_TYPES) or -2.0**63 <= lo and hi < 2.0**63 else cur
                for name, a, b in ranges:
                    if lo >= a and hi <= b:
                        sug = name
                        break
            elif allow_float32 and abs(lo) <= 3.4e38 and abs(hi) <= 3.4e38:
                sug = "float"
        elif isinstance(f.dataType, T.StringType) and st["_rows"] > 0:
            sug = "category" if st[f"d{i}"] / st["_rows"] < category_ratio else "string"
        out.append((f.name, cur, sug))
    return df.sparkSession.createDataFrame(out, "column_name string, current_type string, suggested_type string")


def apply_narrowing(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Cast to the suggested types ('category' stays a string column)."""
    casts = {r[0]: r[2] for r in plan.collect() if r[2] not in ("category", "string") and r[1] != r[2]}
    return df.withColumns({x: c(x).cast(t) for x, t in casts.items()})


def normalize_name(col: Column) -> Column:
    """Lower case without underscores or whitespace."""
    return F.regexp_replace(F.lower(col), r"[_\s]", "")


def match_columns(df: DataFrame, requested: Sequence[str]) -> DataFrame:
    """Map loosely typed names (case, '_' and spaces ignored) to the real columns."""
    spark = df.sparkSession
    real = spark.createDataFrame([(x,) for x in df.columns], "column_name string")
    req = spark.createDataFrame([(x,) for x in requested], "requested string")
    return req.join(real, normalize_name(F.col("requested")) == normalize_name(F.col("column_name")), "left")


def conform_to_schema(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Numeric features -> double (invalid -> NULL -> 0), categorical -> text."""
    exprs = {}
    for x, kind in schema.items():
        if kind == "numeric":
            exprs[x] = F.coalesce(F.expr(f"try_cast({q(x)} AS DOUBLE)"), F.lit(0.0))
        else:
            exprs[x] = c(x).cast("string")
    return df.withColumns(exprs)


def feature_schema(df: DataFrame, features: Sequence[str] | None = None, max_values: int = 20) -> DataFrame:
    """Per feature its kind and, for categorical features with at most
    ``max_values`` distinct values, the sorted value list.  Values are counted
    first; lists are made of the columns that are small enough, so no list has
    more than ``max_values`` entries."""
    from tabsmith.operators.frequent import small_value_counts
    from tabsmith.operators.profile import value_counts
    feats = list(features) if features is not None else df.columns
    num = [x for x in feats if is_numeric(df.schema[x].dataType)]
    cat = [x for x in feats if x not in num]
    parts = []
    if num:
        spark = df.sparkSession
        parts.append(spark.createDataFrame([(x, "numeric") for x in num], "feature string, kind string")
                     .withColumn("n_distinct", F.lit(None).cast("bigint"))
                     .withColumn("values", F.lit(None).cast("array<string>")))
    if cat:
        n = value_counts(df, cat, dropna=True).groupBy(F.col("column_name").alias("feature")).agg(F.count(F.lit(1)).alias("n_distinct"))
        small = small_value_counts(df, cat, max_values).where(F.col("value").isNotNull())
        lists = small.groupBy(F.col("column_name").alias("feature")).agg(F.sort_array(F.collect_list("value")).alias("values"))
        g = n.join(lists, "feature", "left").select("feature", F.lit("categorical").alias("kind"), "n_distinct", "values")
        parts.append(g)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Which logical types each chart axis accepts.
CHART_RULES = (
    ("bar", "x", "string"), ("bar", "x", "datetime"), ("bar", "x", "category"), ("bar", "y", "number"),
    ("line", "x", "number"), ("line", "x", "datetime"), ("line", "y", "number"),
    ("scatter", "x", "number"), ("scatter", "x", "datetime"), ("scatter", "y", "number"),
    ("histogram", "x", "number"),
)


def chart_columns(logical: DataFrame) -> DataFrame:
    """Eligible columns per chart type and axis (T1 output joined with the rule table)."""
    rules = logical.sparkSession.createDataFrame(list(CHART_RULES), "chart_type string, axis string, logical_type string")
    return rules.join(logical.select("column_name", "logical_type"), "logical_type").select(
        "chart_type", "axis", "column_name", "logical_type")
