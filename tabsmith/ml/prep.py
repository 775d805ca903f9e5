"""Task detection, splits and folds (M1-M3).

Splits and folds come from an md5 bucket of a row key, not from ``rand()``:
the assignment does not change when partitions are re-read after a lost
executor, and DuckDB computes the same bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import HASH_SPACE, c, hash_bucket, is_numeric


def detect_task_type(df: DataFrame, target: str, threshold: int = 10, float_max_classes: int = 5) -> DataFrame:
    """M1: string/bool target -> classification; float target with at most
    ``float_max_classes`` distinct values -> classification; integer target
    with values in {0, 1} or fewer than ``threshold`` distinct -> classification;
    otherwise regression.  One aggregate."""
    dt = df.schema[target].dataType
    y = c(target)
    st = df.agg(F.count_distinct(y).alias("n_distinct"), F.count(y).alias("n"),
                (F.coalesce(F.bool_and(y.cast("double").isin(0.0, 1.0)), F.lit(False)) if is_numeric(dt) else F.lit(False))
                .alias("binary01"))
    if isinstance(dt, (T.StringType, T.BooleanType)):
        task, reason = F.lit("classification"), F.lit("text_or_bool")
    elif isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        few = F.col("n_distinct") <= float_max_classes
        task = F.when(few, F.lit("classification")).otherwise(F.lit("regression"))
        reason = F.when(few, F.lit("float_few_values")).otherwise(F.lit("float_many_values"))
    elif is_numeric(dt):
        cls = F.col("binary01") | (F.col("n_distinct") < threshold)
        task = F.when(cls, F.lit("classification")).otherwise(F.lit("regression"))
        reason = (F.when(F.col("binary01"), F.lit("binary_01"))
                  .when(F.col("n_distinct") < threshold, F.lit("few_integer_values"))
                  .otherwise(F.lit("many_integer_values")))
    else:
        # dates and other types: labels to tell apart
        task, reason = F.lit("classification"), F.lit(dt.simpleString())
    return st.select(F.lit(target).alias("target"), task.alias("task_type"), reason.alias("reason"), "n_distinct")


def split_train_test(df: DataFrame, key_cols: Sequence[str], test_fraction: float = 0.3, seed: int = 42,
                     name: str = "split") -> DataFrame:
    """M2: 'train' / 'test' by hash bucket (stable, disjoint, complete)."""
    thr = int(test_fraction * HASH_SPACE)
    return df.withColumn(name, F.when(hash_bucket(key_cols, seed) < F.lit(thr), F.lit("test"))
                         .otherwise(F.lit("train")))


def kfold(df: DataFrame, key_cols: Sequence[str], k: int = 3, seed: int = 42, name: str = "fold") -> DataFrame:
    """M3: plain k-fold - fold = bucket mod k."""
    return df.withColumn(name, F.pmod(hash_bucket(key_cols, seed), F.lit(k)).cast("int"))


def stratified_kfold(df: DataFrame, label: str, key_cols: Sequence[str], k: int = 3, seed: int = 42,
                     name: str = "fold") -> DataFrame:
    """M3: stratified k-fold - inside each class, rows ordered by (bucket, key)
    are dealt round robin, so every fold holds ~1/k of each class.

    The rank inside a class is computed without a per-class window: a global
    range-partitioned sort by (class, bucket, key) numbers all rows (a hot
    class is spread over many tasks), and each class's first position (one
    row per class) turns the global position into the in-class rank."""
    from tabsmith.operators.rows import position_in_group
    keyed = df.withColumn("__b", hash_bucket(key_cols, seed))
    ranked = position_in_group(keyed, [label], [F.col("__b")] + [c(x) for x in key_cols], "__r")
    return ranked.withColumn(name, F.pmod(F.col("__r") - 1, F.lit(k)).cast("int")).drop("__b", "__r")


def stratified_kfold_window(df: DataFrame, label: str, key_cols: Sequence[str], k: int = 3, seed: int = 42,
                            name: str = "fold") -> DataFrame:
    """Reference formulation with a per-class window (one task per class);
    kept for tests - equal to ``stratified_kfold``."""
    w = Window.partitionBy(c(label)).orderBy(hash_bucket(key_cols, seed), *[c(x) for x in key_cols])
    return df.withColumn(name, F.pmod(F.row_number().over(w) - 1, F.lit(k)).cast("int"))
