"""Profiling operators.

Design rule: one aggregate per table pass.  Every per-column statistic of a
report is an expression inside a single ``agg`` (partial aggregation on the
map side, one tiny row shuffled per task), and the wide result is turned into
one row per column with ``stack``.  Value counts unpivot the categorical
columns to ``(column_name, value)`` pairs and aggregate them once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.operators.frequent import small_value_counts, top_values
from tabsmith.operators.quantiles import exact_quantiles
from tabsmith.functions.core import (
    FLOAT_TYPES, TEMPORAL_TYPES, c, categorical_columns, is_numeric, nan_to_null, numeric_columns, q, safe_div,
)


def _lit_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _stack(df: DataFrame, labels: Sequence[str], cols_per_label: Sequence[Sequence[str]],
           field_names: Sequence[str], label_name: str = "column_name",
           keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot a one-row wide aggregate: ``labels[i]`` gets the values of
    columns ``cols_per_label[i]`` under ``field_names``; items that are not
    column names of ``df`` are SQL expressions (literals)."""
    present = set(df.columns)
    args = []
    for lab, cols in zip(labels, cols_per_label):
        args.append(_lit_str(lab))
        args.extend(q(x) if x in present else x for x in cols)
    expr = (f"stack({len(labels)}, {', '.join(args)}) AS "
            f"({q(label_name)}, {', '.join(q(f) for f in field_names)})")
    return df.selectExpr(*[q(k) for k in keep], expr)


def _sum_array(cols: Sequence[str]) -> Column:
    """Sum of many integral columns without a deep ``a+b+c...`` expression tree."""
    return F.aggregate(F.array(*[F.col(x).cast("bigint") for x in cols]), F.lit(0).cast("bigint"),
                       lambda acc, v: acc + v)


def exact_distinct(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row with the number of distinct values of ``names[i]`` as ``i``.

    Beside other aggregates, ``count(DISTINCT)`` of many columns would keep the
    buffers of all of them at every distinct value; here a value is one short row
    of (column, value).  Numbers, texts, dates and the like are counted by a text
    that is another one for each value; nested values one column at a time."""
    def text(f: T.StructField) -> Column | None:
        x = c(f.name)
        if isinstance(f.dataType, FLOAT_TYPES):
            return (F.nanvl(x, F.lit(float("nan"))) + F.lit(0.0).cast(f.dataType)).cast("string")  # -0.0 equals 0.0
        if isinstance(f.dataType, T.TimestampType):
            return F.unix_micros(x).cast("string")
        if isinstance(f.dataType, T.BinaryType):
            return F.hex(x)
        plain = is_numeric(f.dataType) or type(f.dataType) in (T.BooleanType, T.DateType, T.TimestampNTZType)
        plain = plain or (isinstance(f.dataType, T.StringType) and f.dataType == T.StringType())
        return x.cast("string") if plain else None

    texts = {i: text(df.schema[x]) for i, x in enumerate(names)}
    cells = [F.struct(F.lit(i).alias("i"), t.alias("v")) for i, t in texts.items() if t is not None]
    out = df.agg(F.lit(0).alias("__one"))
    if cells:
        values = df.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull()).distinct()
        counts = values.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
        out = counts.agg(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(str(i)) for i, t in texts.items() if t is not None])
    for i, t in texts.items():
        if t is None:
            out = out.crossJoin(df.agg(F.count_distinct(c(names[i])).alias(str(i))))  # one row
    return out.select(*[c(str(i)) for i in texts])


def _aggregate(df: DataFrame, aggs: Sequence[Column], prefix: str, exact: bool) -> DataFrame:
    """``aggs`` of the table, with the exact distinct count of its column i as ``prefix`` and i if ``exact``."""
    wide = df.agg(*aggs)
    if not exact or not df.columns:
        return wide
    counts = exact_distinct(df, df.columns)
    return wide.crossJoin(counts.withColumnsRenamed({x: f"{prefix}{x}" for x in counts.columns}))  # one row


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


# ---------------------------------------------------------------------------
# A3 table report (flagship)
# ---------------------------------------------------------------------------

def dataset_report(df: DataFrame, exact: bool = False, rsd: float = 0.02) -> DataFrame:
    """Rows, columns, overall missing %, quality score and per-column type /
    missing % / unique % in one scan.

    ``exact=False`` (default) counts distinct values with HyperLogLog++ - a
    fixed-size sketch per column, so the cost does not grow with the number of
    distinct values.  ``exact=True`` counts them (``exact_distinct``: rows x
    columns short rows are grouped, in a second scan).
    ``rsd`` 0.02 keeps 4096 registers per column; 0.01 quadruples the
    aggregation buffer (measured 4x slower partial aggregation on 11 columns).
    """
    df = nan_to_null(df)
    fields = df.schema.fields
    n_feat = len(fields)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(c(f.name).isNull()).alias(f"m{i}"))
        if not exact:
            aggs.append(F.approx_count_distinct(c(f.name), rsd).alias(f"u{i}"))
    wide = _aggregate(df, aggs, "u", exact).withColumn("total_missing", _sum_array([f"m{i}" for i in range(n_feat)]))
    tall = _stack(wide, [f.name for f in fields],
                  [[_lit_str(dtype_name(f.dataType)), f"m{i}", f"u{i}"] for i, f in enumerate(fields)],
                  ["dtype", "missing", "unique"], label_name="feature_name",
                  keep=["rows", "total_missing"])
    overall = F.coalesce(safe_div(F.col("total_missing"), F.col("rows") * F.lit(n_feat)) * 100.0,
                         F.lit(0.0))
    return tall.select(
        F.col("feature_name"), F.col("dtype"),
        F.round(F.coalesce(safe_div(F.col("missing"), F.col("rows")) * 100.0, F.lit(0.0)), 2)
        .alias("missing_percentage"),
        F.round(F.coalesce(safe_div(F.col("unique"), F.col("rows")) * 100.0, F.lit(0.0)), 2)
        .alias("unique_percentage"),
        F.col("rows").alias("total_records"),
        F.lit(n_feat).cast("bigint").alias("total_features"),
        F.round(overall, 2).alias("overall_missing_percentage"),
        F.when(F.col("rows") > 0, F.round(F.lit(100.0) - overall, 2)).otherwise(F.lit(0.0))
        .alias("data_quality_score"),
    )


# ---------------------------------------------------------------------------
# A1 / A2 describe
# ---------------------------------------------------------------------------

def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False,
                     accuracy: int = 10000) -> DataFrame:
    """pandas ``describe`` for numeric columns: count, mean, std (sample),
    min, 25/50/75 % (linear interpolation), max - one aggregate.

    ``exact`` percentiles come from distributed selection (``quantiles``), the
    others from a bounded sketch in the same aggregate.
    """
    df = nan_to_null(df)
    cols = list(columns) if columns is not None else numeric_columns(df)
    aggs = []
    for i, name in enumerate(cols):
        x = c(name).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if not exact:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).cast("array<double>").alias(f"q{i}"))
    wide = df.agg(*aggs)
    if exact and cols:
        wide = wide.crossJoin(exact_quantiles(df, cols, [0.25, 0.5, 0.75]).select(*[f"q{i}" for i in range(len(cols))]))  # one row
    wide = wide.select(*[F.col(x) for x in wide.columns if not x.startswith("q")],
                       *[F.col(f"q{i}")[j].alias(f"q{i}_{j}") for i in range(len(cols)) for j in range(3)])
    return _stack(wide, cols,
                  [[f"n{i}", f"a{i}", f"s{i}", f"lo{i}", f"q{i}_0", f"q{i}_1", f"q{i}_2", f"hi{i}"]
                   for i in range(len(cols))],
                  ["count", "mean", "std", "min", "p25", "p50", "p75", "max"])


def _unpivot_strings(df: DataFrame, cols: Sequence[str], drop_nulls: bool = False) -> DataFrame:
    """(column_name, value) pairs, every value rendered as text."""
    if not cols:
        raise ValueError("no columns")
    args = ", ".join(f"{_lit_str(x)}, CAST({q(x)} AS STRING)" for x in cols)
    out = df.selectExpr(f"stack({len(cols)}, {args}) AS (column_name, value)")
    return out.where(F.col("value").isNotNull()) if drop_nulls else out


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, dropna: bool = False) -> DataFrame:
    """(column_name, value, count) for many columns in one aggregation."""
    cols = list(columns) if columns is not None else categorical_columns(df)
    return (_unpivot_strings(df, cols, drop_nulls=dropna)
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """pandas ``describe`` for text columns: count, unique, top, freq.
    Ties on the top value go to the smallest value."""
    cols = list(columns) if columns is not None else categorical_columns(df)
    vc = value_counts(df, cols, dropna=True)
    return vc.groupBy("column_name").agg(
        F.sum("count").cast("bigint").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct((-F.col("count")).alias("k"), F.col("value").alias("v"))).alias("top"),
        F.max("count").alias("freq"),
    )


# ---------------------------------------------------------------------------
# A5 / A6 context pieces
# ---------------------------------------------------------------------------

def value_counts_small(df: DataFrame, max_unique: int = 20, columns: Sequence[str] | None = None) -> DataFrame:
    """Value counts (nulls included) of the categorical columns that have at
    most ``max_unique`` distinct non-null values.  A column with more is found
    out by its sketch: its values are never counted or shuffled."""
    cols = list(columns) if columns is not None else categorical_columns(df)
    return small_value_counts(df, cols, max_unique)


def missing_counts(df: DataFrame, only_missing: bool = True) -> DataFrame:
    df = nan_to_null(df)
    cols = df.columns
    wide = df.agg(*[F.count_if(c(x).isNull()).alias(f"m{i}") for i, x in enumerate(cols)])
    tall = _stack(wide, cols, [[f"m{i}"] for i in range(len(cols))], ["missing_count"])
    return tall.where(F.col("missing_count") > 0) if only_missing else tall


def column_info(df: DataFrame) -> DataFrame:
    """A7 'info' block: rows, dtype and non-null count per column."""
    df = nan_to_null(df)
    fields = df.schema.fields
    wide = df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count(c(f.name)).alias(f"n{i}") for i, f in enumerate(fields)])
    return _stack(wide, [f.name for f in fields],
                  [[_lit_str(dtype_name(f.dataType)), f"n{i}"] for i, f in enumerate(fields)],
                  ["dtype", "non_null_count"], keep=["rows"])


def data_context(df: DataFrame, max_unique: int = 20, head: int = 5,
                 order_by: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The pieces of the table context (info, missing, numeric and text
    describe, small value counts, first rows), over the whole table."""
    stats_df = df
    ordered = df.orderBy(*[c(x) for x in (order_by or df.columns)])
    out = {"info": column_info(df), "missing": missing_counts(stats_df),
           "value_counts": value_counts_small(stats_df, max_unique), "head": ordered.limit(head)}
    if numeric_columns(stats_df):
        out["numeric"] = describe_numeric(stats_df)
    if categorical_columns(stats_df):
        out["categorical"] = describe_categorical(stats_df)
    return out


# ---------------------------------------------------------------------------
# A8-A10 correlation
# ---------------------------------------------------------------------------

def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Tall correlation matrix (col_a, col_b, corr), both orders and the
    diagonal; pairwise-complete, undefined -> 0.  NaN counts as missing.

    Two light passes: column means (p values to the driver), then plain sums
    of the mean-shifted values and their products over the rows where both
    members of a pair are present (shifting keeps the sums well conditioned).
    Plain ``sum`` aggregates are far cheaper to generate and run than
    ``covar_pop``/``stddev_pop`` per pair; identical sums are shared by the
    planner when columns have no nulls.  Only the upper triangle is
    aggregated; one ``stack`` emits both orders."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    df = nan_to_null(df.select(*[c(x) for x in cols]))
    xs = [c(x).cast("double") for x in cols]
    st = df.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)],
                *[F.count(x).alias(f"c{i}") for i, x in enumerate(xs)]).first()
    full = [st[f"c{i}"] == st["rows"] for i in range(len(xs))]  # columns without nulls
    zs = [x - F.lit(st[f"m{i}"] if st[f"m{i}"] is not None else 0.0) for i, x in enumerate(xs)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    aggs = []
    for i in range(len(xs)):
        if full[i]:  # shared by every pair of null-free columns
            aggs += [F.sum(zs[i]).alias(f"s{i}"), F.sum(zs[i] * zs[i]).alias(f"q{i}")]
    for i, j in pairs:
        if full[i] and full[j]:
            aggs.append(F.sum(zs[i] * zs[j]).alias(f"ab{i}_{j}"))
            continue
        both = xs[i].isNotNull() & xs[j].isNotNull()
        a, b = F.when(both, zs[i]), F.when(both, zs[j])
        aggs += [F.count(F.when(both, 1)).cast("double").alias(f"n{i}_{j}"), F.sum(a).alias(f"sa{i}_{j}"),
                 F.sum(b).alias(f"sb{i}_{j}"), F.sum(a * a).alias(f"aa{i}_{j}"), F.sum(b * b).alias(f"bb{i}_{j}"),
                 F.sum(a * b).alias(f"ab{i}_{j}")]
    # one row of sums: bounded by the schema width, not by the rows
    s = df.agg(*aggs).first() if aggs else None
    out = []
    for i, j in pairs:
        if full[i] and full[j]:
            n, sa, sb = float(st["rows"]), s[f"s{i}"], s[f"s{j}"]
            aa, bb, ab = s[f"q{i}"], s[f"q{j}"], s[f"ab{i}_{j}"]
        else:
            n, sa, sb = s[f"n{i}_{j}"], s[f"sa{i}_{j}"], s[f"sb{i}_{j}"]
            aa, bb, ab = s[f"aa{i}_{j}"], s[f"bb{i}_{j}"], s[f"ab{i}_{j}"]
        r = 0.0
        if n and sa is not None:
            va, vb, cov = n * aa - sa * sa, n * bb - sb * sb, n * ab - sa * sb
            # zero variance shows up as rounding noise relative to the sums: constant column
            if va > 1e-12 * abs(n * aa) and vb > 1e-12 * abs(n * bb):
                r = max(-1.0, min(1.0, cov / math.sqrt(va * vb)))
        out.append((cols[i], cols[j], float(r), i, j))
        if i != j:
            out.append((cols[j], cols[i], float(r), j, i))
    return df.sparkSession.createDataFrame(out, "col_a string, col_b string, corr double, pos_a int, pos_b int")


def corr_extremes(corr: DataFrame) -> DataFrame:
    """Max, min and mean correlation over off-diagonal cells."""
    off = corr.where(F.col("pos_a") != F.col("pos_b"))
    return off.agg(F.max("corr").alias("max_corr"), F.min("corr").alias("min_corr"),
                   F.avg("corr").alias("avg_corr"))


def corr_strong_pairs(corr: DataFrame, strong: float = 0.6, weak: float = 0.1) -> DataFrame:
    """A10: upper-triangle pairs labelled strong positive / strong negative /
    near zero; other pairs are dropped.  Ordered by |r| for reading."""
    up = corr.where(F.col("pos_a") < F.col("pos_b"))
    kind = (F.when(F.col("corr") > strong, F.lit("strong_positive"))
            .when(F.col("corr") < -strong, F.lit("strong_negative"))
            .when(F.abs(F.col("corr")) < weak, F.lit("near_zero")))
    return (up.withColumn("kind", kind).where(F.col("kind").isNotNull())
            .select("col_a", "col_b", "corr", "kind"))


# ---------------------------------------------------------------------------
# A13-A17 column distributions and profiles
# ---------------------------------------------------------------------------

def column_distribution_numeric(df: DataFrame, column: str, exact: bool = False) -> DataFrame:
    """Counts, mean, population std, extremes and quartiles (``exact``: by distributed selection)."""
    df = nan_to_null(df.select(c(column)))
    x = c(column).cast("double")
    aggs = [F.count(F.lit(1)).alias("total_count"), F.count(x).alias("non_null_count"), F.min(x).alias("min"),
            F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("stddev")]
    if exact:
        agg = df.agg(*aggs).crossJoin(exact_quantiles(df, [column], [0.25, 0.5, 0.75]).select(F.col("q0").alias("p")))  # one row
    else:
        agg = df.agg(*aggs, F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).cast("array<double>").alias("p"))
    return agg.select(
        F.lit(column).alias("column_name"), "total_count", "non_null_count",
        (F.col("total_count") - F.col("non_null_count")).alias("null_count"),
        "min", F.col("p")[0].alias("percentile_25"), F.col("p")[1].alias("percentile_50_median"),
        F.col("p")[2].alias("percentile_75"), "max", "mean", "stddev")


def column_distribution_categorical(df: DataFrame, column: str, top_n: int = 20,
                                    include_null: bool = False) -> DataFrame:
    """Top-N values with counts (ties by value) plus table-level counts."""
    x = c(column).cast("string")
    totals = df.agg(F.count(F.lit(1)).alias("total_count"), F.count_if(x.isNull()).alias("null_count"),
                    F.count_distinct(x).alias("distinct_count"))
    top = top_values(df, [column], top_n, include_null)
    return (top.crossJoin(totals)  # one-row side
            .select(F.lit(column).alias("column_name"), F.col("rank").cast("bigint").alias("rank"), "value", "count", "total_count",
                    "null_count", (F.col("total_count") - F.col("null_count")).alias("non_null_count"),
                    "distinct_count"))


def column_distribution_other(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_count"), F.count(c(column)).alias("non_null_count")).select(
        F.lit(column).alias("column_name"), "total_count",
        (F.col("total_count") - F.col("non_null_count")).alias("null_count"), "non_null_count")


def column_distribution(df: DataFrame, column: str, top_n: int = 20) -> DataFrame:
    """Dispatch by type like the reference tool (numeric / text / other)."""
    dt = df.schema[column].dataType
    if is_numeric(dt):
        return column_distribution_numeric(df, column)
    if isinstance(dt, (T.StringType, T.BooleanType)):
        return column_distribution_categorical(df, column, top_n)
    return column_distribution_other(df, column)


def profile_table(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per column null count / rate, distinct count, numeric min / max /
    mean / population std, text average length - one aggregate for all columns.
    Distinct counts are sketches unless ``exact`` (then a second scan)."""
    df = nan_to_null(df)
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("rows")]
    per = []
    for i, f in enumerate(fields):
        x = c(f.name)
        num = is_numeric(f.dataType)
        txt = isinstance(f.dataType, T.StringType)
        aggs += [] if exact else [F.approx_count_distinct(x).alias(f"d{i}")]
        aggs += [F.count_if(x.isNull()).alias(f"nl{i}"),
                 (F.min(x.cast("double")) if num else F.lit(None).cast("double")).alias(f"mn{i}"),
                 (F.max(x.cast("double")) if num else F.lit(None).cast("double")).alias(f"mx{i}"),
                 (F.avg(x.cast("double")) if num else F.lit(None).cast("double")).alias(f"av{i}"),
                 (F.stddev_pop(x.cast("double")) if num else F.lit(None).cast("double")).alias(f"sd{i}"),
                 (F.avg(F.length(x).cast("double")) if txt else F.lit(None).cast("double")).alias(f"ln{i}")]
        per.append([_lit_str(dtype_name(f.dataType)), f"nl{i}", f"d{i}", f"mn{i}", f"mx{i}",
                    f"av{i}", f"sd{i}", f"ln{i}"])
    tall = _stack(_aggregate(df, aggs, "d", exact), [f.name for f in fields], per,
                  ["type", "null_count", "distinct_count", "min", "max", "mean", "stddev", "avg_length"],
                  keep=["rows"])
    return tall.select(
        "column_name", "type", F.col("rows").alias("total_rows"), "null_count",
        F.coalesce(safe_div(F.col("null_count"), F.col("rows")), F.lit(0.0)).alias("null_rate"),
        "distinct_count", "min", "max", "mean", "stddev", "avg_length")


def variable_cards(df: DataFrame, exact: bool = False) -> DataFrame:
    """Distinct, missing, infinite, zeros, negatives (count and %),
    mean / min / max for numeric columns, unique flag."""
    df = nan_to_null(df)
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("rows")]
    per = []
    null_d = F.lit(None).cast("double")
    null_l = F.lit(None).cast("bigint")
    for i, f in enumerate(fields):
        x = c(f.name)
        num = is_numeric(f.dataType)
        flt = isinstance(f.dataType, FLOAT_TYPES)
        xd = x.cast("double")
        aggs += [] if exact else [F.approx_count_distinct(x).alias(f"d{i}")]
        aggs += [F.count_if(x.isNull()).alias(f"m{i}"),
                 (F.count_if(F.abs(xd) == F.lit(float("inf"))) if flt else
                  (F.lit(0).cast("bigint") if num else null_l)).alias(f"inf{i}"),
                 (F.avg(xd) if num else null_d).alias(f"av{i}"),
                 (F.min(xd) if num else null_d).alias(f"mn{i}"),
                 (F.max(xd) if num else null_d).alias(f"mx{i}"),
                 (F.count_if(xd == 0) if num else null_l).alias(f"z{i}"),
                 (F.count_if(xd < 0) if num else null_l).alias(f"ng{i}")]
        per.append([_lit_str(dtype_name(f.dataType)), "true" if num else "false", f"d{i}", f"m{i}",
                    f"inf{i}", f"av{i}", f"mn{i}", f"mx{i}", f"z{i}", f"ng{i}"])
    tall = _stack(_aggregate(df, aggs, "d", exact), [f.name for f in fields], per,
                  ["type", "is_numeric", "distinct", "missing", "infinite", "mean", "min", "max",
                   "zeros", "negative"], keep=["rows"])

    def p(col):
        return F.round(F.coalesce(safe_div(F.col(col), F.col("rows")) * 100.0, F.lit(0.0)), 1)

    return tall.select(
        "column_name", "type", "is_numeric", "distinct", p("distinct").alias("distinct_pct"),
        "missing", p("missing").alias("missing_pct"), "infinite",
        F.when(F.col("is_numeric"), p("infinite")).alias("infinite_pct"),
        "mean", "min", "max", "zeros", F.when(F.col("is_numeric"), p("zeros")).alias("zeros_pct"),
        "negative", F.when(F.col("is_numeric"), p("negative")).alias("negative_pct"),
        ((F.col("distinct") == F.col("rows")) & (F.col("missing") == 0)).alias("is_unique"),
        F.col("rows"))


def variable_type(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if is_numeric(dt):
        return "numeric"
    if isinstance(dt, TEMPORAL_TYPES):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "categorical"
    return "other"


def dataset_overview(df: DataFrame) -> DataFrame:
    """Variables, observations, missing cells and %, count per variable type."""
    df = nan_to_null(df)
    fields = df.schema.fields
    kinds = [variable_type(f.dataType) for f in fields]
    wide = df.agg(F.count(F.lit(1)).alias("observations"),
                  *[F.count_if(c(f.name).isNull()).alias(f"m{i}") for i, f in enumerate(fields)])
    cells = F.col("observations") * F.lit(len(fields))
    out = wide.select(
        F.lit(len(fields)).cast("bigint").alias("variables"), "observations",
        _sum_array([f"m{i}" for i in range(len(fields))]).alias("missing_cells"))
    out = out.withColumn("missing_cells_pct",
                         F.round(F.coalesce(safe_div(F.col("missing_cells"), cells) * 100.0, F.lit(0.0)), 2))
    for k in ("numeric", "categorical", "datetime", "boolean", "other"):
        out = out.withColumn(f"n_{k}", F.lit(kinds.count(k)).cast("bigint"))
    return out


def quality_alerts(df: DataFrame, exact: bool = False) -> DataFrame:
    """Missing / Unique / Zeros alerts per column with a message."""
    cards = variable_cards(df, exact=exact)
    pct_txt = lambda col: F.round(safe_div(F.col(col), F.col("rows")) * 100.0, 1).cast("string")
    # one pass over the cards: every card yields 0-3 alerts (explode), no union re-reading the cards
    alerts = F.array(
        F.when(F.col("missing") > 0, F.struct(F.lit("Missing").alias("t"), F.concat(
            F.lit("has "), F.col("missing").cast("string"), F.lit(" ("), pct_txt("missing"),
            F.lit("%) missing values")).alias("m"))),
        F.when(F.col("is_unique"), F.struct(F.lit("Unique").alias("t"), F.lit("has unique values").alias("m"))),
        F.when(F.col("zeros") > 0, F.struct(F.lit("Zeros").alias("t"), F.concat(
            F.lit("has "), F.col("zeros").cast("string"), F.lit(" ("), pct_txt("zeros"), F.lit("%) zeros")).alias("m"))))
    out = cards.select("column_name", F.explode(F.filter(alerts, lambda a: a.isNotNull())).alias("a"))
    return out.select("column_name", F.col("a.t").alias("alert_type"), F.col("a.m").alias("message"))


# ---------------------------------------------------------------------------
# A20 duplicates / keys, A21 class balance
# ---------------------------------------------------------------------------

def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, distinct rows, and duplicate rows beyond the first copy.

    The grouping on all columns is a shuffle whose map side already collapses
    the copies; a hot row repeated a billion times is one counter per task."""
    g = df.groupBy(*[c(x) for x in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").cast("bigint").alias("total_rows"),
                 F.count(F.lit(1)).alias("distinct_rows"),
                 F.sum(F.col("n") - 1).cast("bigint").alias("duplicate_rows"))


def candidate_keys(df: DataFrame, exact: bool = False) -> DataFrame:
    """Single-column key test: distinct = rows and no nulls.

    The verdict is exact.  Sketches first rule out the columns with nulls or far
    fewer values than rows; only the others are counted exactly.  So
    ``distinct_count`` is an estimate for columns that aren't near keys, unless
    ``exact``."""
    df = nan_to_null(df)
    names = df.columns
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, x in enumerate(names):
        aggs += [F.approx_count_distinct(c(x), 0.02).alias(f"d{i}"), F.count_if(c(x).isNull()).alias(f"m{i}")]
    st = df.agg(*aggs).first()
    # a key's estimate lies within five standard errors of the rows
    near = [i for i in range(len(names)) if exact or not st[f"m{i}"] and st[f"d{i}"] >= 0.9 * st["rows"]]
    counts = {}
    for i in near:  # a column at a time: one aggregate over several distinct counts expands every row by their number
        counts[i] = df.agg(F.count_distinct(c(names[i]))).first()[0]
    rows = [(x, counts.get(i, st[f"d{i}"]), st[f"m{i}"], i in counts and counts[i] == st["rows"] and st[f"m{i}"] == 0)
            for i, x in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "column_name string, distinct_count bigint, null_count bigint, is_candidate_key boolean")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Count and share per target value (null is a value)."""
    g = df.groupBy(c(target).alias("class_value")).agg(F.count(F.lit(1)).alias("count"))
    tot = df.agg(F.count(F.lit(1)).alias("total"))
    return g.crossJoin(tot).select(  # one-row side
        "class_value", "count", F.coalesce(safe_div(F.col("count"), F.col("total")), F.lit(0.0)).alias("share"))


# ---------------------------------------------------------------------------
# A31 / A32 / C16 facts
# ---------------------------------------------------------------------------

def top_category(df: DataFrame, category: str, measure: str) -> DataFrame:
    """Measure range, number of categories and the category with the
    highest total (ties: smallest category)."""
    per = df.groupBy(c(category).alias("category")).agg(F.sum(c(measure).cast("double")).alias("total"))
    facts = df.agg(F.min(c(measure).cast("double")).alias("measure_min"),
                   F.max(c(measure).cast("double")).alias("measure_max"))
    best = per.agg(F.count(F.lit(1)).alias("n_categories"),
                   F.min_by("category", F.struct((-F.col("total")).alias("k"), F.col("category").alias("v")))
                   .alias("top_category"),
                   F.max("total").alias("top_total"))
    return facts.crossJoin(best)  # two one-row sides


def summary_facts(df: DataFrame) -> DataFrame:
    """Per column dominant-category share (freq/count) for text columns,
    spread (std/mean) and minimum for numeric columns."""
    parts = []
    if categorical_columns(df):
        dc = describe_categorical(df)
        parts.append(dc.select("column_name", F.lit("dominant_share").alias("fact"),
                               safe_div(F.col("freq"), F.col("count")).alias("value")))
    if numeric_columns(df):
        dn = describe_numeric(df, exact=False)
        parts.append(dn.select("column_name", F.lit("spread").alias("fact"),
                               safe_div(F.col("std"), F.col("mean")).alias("value")))
        parts.append(dn.select("column_name", F.lit("minimum").alias("fact"), F.col("min").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def typical_row(df: DataFrame) -> DataFrame:
    """One row - mean of numeric columns, most frequent value (smallest on
    ties) of the others, for which only proposed values are counted."""
    out = []
    for f in df.schema.fields:
        if is_numeric(f.dataType):
            out.append(F.avg(c(f.name).cast("double")).alias(f.name))
    num = df.agg(*out) if out else None
    cats = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    if cats:
        wide = top_values(df, cats, 1).groupBy().pivot("column_name", cats).agg(F.first("value"))
        wide = wide.select(*[c(x) for x in cats])
        res = num.crossJoin(wide) if num is not None else wide  # one-row sides
    else:
        res = num
    return res.select(*[c(x) for x in df.columns])
