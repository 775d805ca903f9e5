"""Column-expression helpers shared by every operator (all JVM-side)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def q(name: str) -> str:
    """Back-tick quote a column name (names may hold dots, spaces, back-ticks)."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    """Column reference that is safe for any header text."""
    return F.col(q(name))


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_string_like(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.BooleanType))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in ex]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in ex]


def hash_bucket(cols: Sequence[str | Column], seed: int | str = 42) -> Column:
    """Deterministic 32-bit bucket from md5 of the key text and a seed.

    Independent of partitioning (unlike rand/sample/randomSplit), so samples,
    splits and folds are stable when executors are lost and tasks re-run.
    Same value as DuckDB ``('0x'||substr(md5(s),1,8))::BIGINT``.
    """
    parts = [x if isinstance(x, Column) else c(x).cast("string") for x in cols]
    s = F.concat_ws("|", *parts, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


HASH_SPACE = 2 ** 32


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: turn NaN into NULL on every float column."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, FLOAT_TYPES):
            exprs.append(F.nanvl(c(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            exprs.append(c(f.name))
    return df.select(*exprs)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every float column (top level) for engine-independent comparison."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, FLOAT_TYPES):
            # "+ 0.0" turns a negative zero into zero (engines differ on -0.0)
            exprs.append((F.round(c(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            exprs.append(c(f.name))
    return df.select(*exprs)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI-safe)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ieee_div(a: Column, b: Column) -> Column:
    """a / b of doubles as DuckDB divides them: x / 0 is infinite, 0 / 0 is NaN (an error in ANSI Spark)."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def pct(a: Column, b: Column) -> Column:
    return F.coalesce(safe_div(a, b) * F.lit(100.0), F.lit(0.0))


def stack_columns(df: DataFrame, names: Sequence[str], fields: Sequence[str],
                  label: str = "column_name") -> DataFrame:
    """Unpivot a one-row-per-table aggregate whose columns are ``{name}__{field}``
    into one row per ``name`` with columns ``fields`` (uses ``stack``)."""
    if not names:
        raise ValueError("no columns to stack")
    n = len(names)
    args = []
    for name in names:
        args.append("'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'")
        args.extend(q(f"{name}__{fld}") for fld in fields)
    expr = f"stack({n}, {', '.join(args)}) AS ({q(label)}, {', '.join(q(f) for f in fields)})"
    keep = [q(x) for x in df.columns if "__" not in x]
    return df.selectExpr(*keep, expr)
