"""Most frequent values of columns, exactly, without shuffling all distinct values.

Pass 1: a bounded frequent-items sketch per column (``approx_top_k``, all
columns in one aggregate) names candidates.  Pass 2 counts the candidates only:
the shuffle holds candidates, not distinct values.  Then a check whether a value
could have been lost: a value that isn't a candidate has at most
``2 * 3.5 / TRACKED`` of the rows (the sketch's bound), unless the candidates
already account for every row.  Columns that don't pass (flat distributions,
such as keys) are counted value by value; the result is exact either way.

Null is a value of its own, counted beside the sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tabsmith.functions.core import c

TRACKED = 8192      # entries of a sketch
CANDIDATES = 1000   # values a column may propose
_MISSED = 2 * 3.5 / TRACKED  # most rows of a value that isn't proposed, as a share




def _cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value) of every row and column, values as text."""
    cells = [F.struct(F.lit(x).alias("column_name"), c(x).cast("string").alias("value")) for x in cols]
    return df.select(F.inline(F.array(*cells)))


def candidates(df: DataFrame, cols: Sequence[str], others: Sequence[Column] = ()) -> tuple[DataFrame, dict[str, tuple[int, int]], Row]:
    """(column_name, value) of the proposed values, per column the rows and the non-null rows, and the values of
    ``others``: further aggregates of the same scan."""
    aggs = [F.count(F.lit(1)).alias("rows"), *others]
    for i, x in enumerate(cols):
        aggs += [F.call_function("approx_top_k", c(x).cast("string"), F.lit(CANDIDATES), F.lit(TRACKED)).alias(f"t{i}"), F.count(c(x)).alias(f"n{i}")]
    from tabsmith.session import cut_lineage
    wide = cut_lineage(df.agg(*aggs))
    known = wide.drop(*[f"t{i}" for i in range(len(cols))]).first()
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string"), {}, known
    tops = F.array(*[F.struct(F.lit(x).alias("column_name"), F.transform(f"t{i}", lambda t: t["item"]).alias("values"))
                     for i, x in enumerate(cols)])
    named = wide.select(F.inline(tops)).select("column_name", F.explode("values").alias("value")).where(F.col("value").isNotNull()).distinct()
    return named, {x: (known["rows"], known[f"n{i}"]) for i, x in enumerate(cols)}, known


def counted(df: DataFrame, cols: Sequence[str], proposed: tuple | None = None) -> tuple[DataFrame, dict[str, dict]]:
    """Exact (column_name, value, count) of the candidates and of null, and per column what they leave open:
    ``rows``, ``filled``, ``complete`` (they are all values there are) and ``bound`` (most rows of another value)."""
    from tabsmith.session import cut_lineage
    named, sizes = (proposed or candidates(df, cols))[:2]
    sizes = {x: sizes[x] for x in cols}
    counts = cut_lineage(_cells(df, cols).where(F.col("value").isNotNull()).join(named, ["column_name", "value"], "left_semi")
                         .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))
    sums = {r[0]: r[1] for r in counts.groupBy("column_name").agg(F.sum("count")).collect()}
    open_ = {x: {"rows": rows, "filled": n, "complete": sums.get(x, 0) == n, "bound": n * _MISSED} for x, (rows, n) in sizes.items()}
    nulls = [(x, None, rows - n) for x, (rows, n) in sizes.items() if rows > n]
    if nulls:
        counts = counts.unionByName(df.sparkSession.createDataFrame(nulls, "column_name string, value string, count bigint"))
    return counts, open_


def top_values(df: DataFrame, cols: Sequence[str], k: int, include_null: bool = False,
               proposed: tuple | None = None) -> DataFrame:
    """(column_name, value, count, rank): the ``k`` most frequent values of each column, ties by value, null first.
    ``proposed``: the result of ``candidates``, if a caller has it."""
    cols = list(cols)
    if not 0 < k <= CANDIDATES:
        raise ValueError(f"k must be between 1 and {CANDIDATES}")
    counts, state = counted(df, cols, proposed)
    if not include_null:
        counts = counts.where(F.col("value").isNotNull())
    # counted value by value: columns where a value outside the candidates may belong to the top
    kth = {r["column_name"]: (r["n"], r["least"]) for r in _ranked(counts, k).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).collect()}
    full = [x for x in cols if not state[x]["complete"] and (kth.get(x, (0, 0))[0] < k or kth[x][1] <= state[x]["bound"])]
    if full:
        every = _cells(df, full)
        every = every if include_null else every.where(F.col("value").isNotNull())
        counts = counts.where(~F.col("column_name").isin(full)).unionByName(
            every.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))
    return _ranked(counts, k)


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value").asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def small_value_counts(df: DataFrame, cols: Sequence[str], max_unique: int) -> DataFrame:
    """(column_name, value, count, n_unique), null included, of the columns with at most ``max_unique`` values: such a
    column's candidates are all its values, so no other column is counted."""
    if not 0 < max_unique <= CANDIDATES:
        raise ValueError(f"max_unique must be between 1 and {CANDIDATES}")
    counts, state = counted(df, list(cols))
    whole = [x for x in cols if state[x]["complete"]]
    per = counts.where(F.col("value").isNotNull()).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"))
    out = counts.where(F.col("column_name").isin(whole)).join(per.where(F.col("n_unique") <= max_unique), "column_name")
    return out.select("column_name", "value", "count", "n_unique")
