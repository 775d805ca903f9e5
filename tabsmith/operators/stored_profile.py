"""Profiles that are stored per part of a table (a file, a day) and merged.

A part's profile is one row per column: counts, extremes, mean and M2, and two
sketches of fixed size, HyperLogLog for distinct values and KLL for quantiles.
All of them merge, so a report over any set of parts reads the stored rows
only, and new data costs one scan of the new data.

Error of the merged figures: distinct counts about 1.04 / sqrt(2^LG_K) of the
count (one standard error), quantiles about 2.3 / KLL_K^0.9 of the rows; counts,
extremes, mean and deviation are exact.  NaN counts as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.core import c, is_numeric
from tabsmith.operators.clean import present

LG_K = 13     # HyperLogLog: 2^13 registers, standard error 1.1 %
KLL_K = 1000  # KLL: about 0.5 % of the rows


def profile_parts(df: DataFrame, part: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """(part, column_name, type, rows, filled, min, max, mean, m2, length, distinct, quantiles): one aggregate, one row
    per part and column.  ``distinct`` and ``quantiles`` are sketches (numeric columns only for the latter); ``min`` and
    ``max`` are numbers, ``length`` is the total length of a text column."""
    cols = list(columns) if columns is not None else df.columns
    aggs, cells = [F.count(F.lit(1)).alias("rows")], []
    no_d, no_b = F.lit(None).cast("double"), F.lit(None).cast("binary")
    for i, x in enumerate(cols):
        dt = df.schema[x].dataType
        num = is_numeric(dt)
        v = present(x) if num else c(x)
        aggs += [F.count(v).alias(f"n{i}"),
                 # a sketch leaves out empty texts, so every value gets a mark
                 F.hll_sketch_agg(F.concat(F.lit("="), v.cast("string")), F.lit(LG_K)).alias(f"d{i}")]
        if num:
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"s{i}"),
                     F.call_function("kll_sketch_agg_double", v, F.lit(KLL_K)).alias(f"k{i}")]
        elif dt.simpleString() == "string":
            aggs.append(F.sum(F.length(v)).alias(f"l{i}"))
        cells.append(F.struct(
            F.lit(x).alias("column_name"), F.lit(dt.simpleString()).alias("type"), F.col(f"n{i}").alias("filled"),
            (F.col(f"lo{i}") if num else no_d).alias("min"), (F.col(f"hi{i}") if num else no_d).alias("max"),
            (F.col(f"m{i}") if num else no_d).alias("mean"), (F.col(f"s{i}") * F.col(f"n{i}") if num else no_d).alias("m2"),
            (F.col(f"l{i}") if dt.simpleString() == "string" else F.lit(None).cast("bigint")).alias("length"),
            F.col(f"d{i}").alias("distinct"), (F.when(F.col(f"n{i}") > 0, F.col(f"k{i}")) if num else no_b).alias("quantiles")))
    wide = df.groupBy(part.alias("part")).agg(*aggs)
    return wide.select("part", "rows", F.inline(F.array(*cells)))


def store_parts(parts: DataFrame, path: str) -> None:
    """Append the profiles of new parts to a stored table."""
    parts.write.mode("append").parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged_profile(parts: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column over all given parts: counts, distinct values (estimate), extremes, mean, population std,
    average text length, and ``q``, the quantiles (estimates; null without numbers)."""
    known = F.col("filled") > 0
    one = parts.groupBy("column_name").agg(
        F.first("type").alias("type"), F.sum("rows").alias("total_rows"), F.sum("filled").alias("filled"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.try_divide(F.sum(F.when(known, F.col("mean") * F.col("filled"))), F.sum(F.when(known, F.col("filled")))).alias("mean"),
        F.sum("length").alias("length"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_count"),
        F.call_function("kll_merge_agg_double", F.col("quantiles")).alias("sketch"))
    # M2 of the whole: M2 of the parts and of their means around the whole's mean
    spread = parts.join(one.select("column_name", F.col("mean").alias("whole")), "column_name").groupBy("column_name").agg(
        F.sum(F.col("m2") + F.col("filled") * (F.col("mean") - F.col("whole")) * (F.col("mean") - F.col("whole"))).alias("m2"))
    at = F.array(*[F.lit(float(x)) for x in quantiles])
    return one.join(spread, "column_name").select(
        "column_name", "type", "total_rows", (F.col("total_rows") - F.col("filled")).alias("null_count"), "distinct_count", "min", "max", "mean",
        F.sqrt(F.try_divide(F.col("m2"), F.col("filled"))).alias("stddev"),
        F.try_divide(F.col("length"), F.col("filled")).alias("avg_length"),
        F.when(F.col("mean").isNotNull(), F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), at)).alias("q"))
