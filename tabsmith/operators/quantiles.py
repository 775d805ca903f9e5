"""Exact quantiles of whole columns by distributed selection.

``F.percentile`` keeps every distinct value of a group in one buffer.  Here a
bounded sketch only proposes, for each quantile, two values that should enclose
it; the table then counts exactly how many rows lie below, at and between them,
and only the rows strictly between them go on.  Each pass leaves about one row
in a thousand (a value that fills a third of the table becomes an end of its
interval and is counted, not carried), and the last few are sorted.  All
columns, quantiles and groups move together; no pass holds more than ``most``
rows of a quantile in one place.

Nulls and NaN take no part.  The result is exact whatever the sketch proposes:
if the counts show that an interval misses its rank, the interval grows to the
side where the rank is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.core import c, q
from tabsmith.session import cut_lineage

ACCURACY = 4000        # of the proposing sketches
MOST = 20_000          # rows of one quantile's interval that are sorted in one place
_GRID = 500


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group keys of which null is a value like any other (no keys: one row on the right)."""
    if not keys:
        return left.crossJoin(right)
    r = right.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(keys)})
    on = [left[q(k)].eqNullSafe(r[f"__r{i}"]) for i, k in enumerate(keys)]
    return left.join(r, on, how).drop(*[f"__r{i}" for i in range(len(keys))])


def _group(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*[c(k) for k in keys])


def _value(name: str) -> Column:
    return F.nanvl(c(name).cast("double"), F.lit(None).cast("double"))


def _intervals(df: DataFrame, keys: list, cols: Sequence[str], fractions: Sequence[float], accuracy: int) -> DataFrame:
    """Per group, column i and quantile j: rank of the lower neighbour (``r``), share of the upper one (``part``) and
    the proposed ends ``lo``, ``hi``, one row each."""
    slack = 2.0 / accuracy
    near = [min(max(f + d, 0.0), 1.0) for f in fractions for d in (-slack, slack)]
    aggs = []
    for i, x in enumerate(cols):
        v = F.col(x)
        aggs += [F.count(v).alias(f"n{i}"), F.percentile_approx(v, near, accuracy).alias(f"p{i}"),
                 F.min(v).alias(f"a{i}"), F.max(v).alias(f"z{i}")]
    wide = _group(df, keys).agg(*aggs)
    cells = []
    for i in range(len(cols)):
        for j, f in enumerate(fractions):
            at = (F.col(f"n{i}") - 1) * F.lit(float(f))
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"n{i}").alias("n"),
                                  F.floor(at).alias("r"), (at - F.floor(at)).alias("part"),
                                  (F.col(f"p{i}")[2 * j] if near[2 * j] > 0 else F.col(f"a{i}")).alias("lo"),
                                  (F.col(f"p{i}")[2 * j + 1] if near[2 * j + 1] < 1 else F.col(f"z{i}")).alias("hi")))
    return cut_lineage(wide.select(*[c(k) for k in keys], F.inline(F.array(*cells))))


def _wide(ends: DataFrame, keys: list, n_cols: int, n_frac: int) -> DataFrame:
    """The ends of all intervals of a group in one row: arrays lo, hi by i * n_frac + j."""
    at = F.sort_array(F.collect_list(F.struct((F.col("i") * n_frac + F.col("j")).alias("k"), "lo", "hi")))
    return _group(ends, keys).agg(at.alias("__ends"))


def _bounded(df: DataFrame, keys: list, ends: DataFrame, n_cols: int, n_frac: int):
    """``df`` and, by i * n_frac + j, the ends of the row's interval: constants without groups (a few values, which the
    driver may hold), else joined by group."""
    if keys:
        return join_groups(df, _wide(ends, keys, n_cols, n_frac), keys), lambda k: (F.col("__ends")[k]["lo"], F.col("__ends")[k]["hi"])
    found = {r["i"] * n_frac + r["j"]: (r["lo"], r["hi"]) for r in ends.select("i", "j", "lo", "hi").collect()}
    return df, lambda k: tuple(F.lit(x).cast("double") for x in found[k])


def _count(df: DataFrame, keys: list, cols: Sequence[str], ends: DataFrame, n_frac: int) -> DataFrame:
    """Exact counts per interval: rows below ``lo``, at it, between, and at ``hi`` (none if that is ``lo``)."""
    j, at = _bounded(df, keys, ends, len(cols), n_frac)
    aggs = []
    for i, x in enumerate(cols):
        v = F.col(x)
        for k in range(i * n_frac, (i + 1) * n_frac):
            lo, hi = at(k)
            aggs += [F.count_if(v < lo).alias(f"b{k}"), F.count_if(v == lo).alias(f"l{k}"),
                     F.count_if((v > lo) & (v < hi)).alias(f"m{k}"), F.count_if((v == hi) & (hi > lo)).alias(f"h{k}")]
    got = _group(j, keys).agg(*aggs)
    cells = [F.struct(F.lit(k // n_frac).alias("i"), F.lit(k % n_frac).alias("j"), F.col(f"b{k}").alias("below"), F.col(f"l{k}").alias("at_lo"),
                      F.col(f"m{k}").alias("inside"), F.col(f"h{k}").alias("at_hi")) for k in range(len(cols) * n_frac)]
    return got.select(*[c(k) for k in keys], F.inline(F.array(*cells)))


def _inside(df: DataFrame, keys: list, cols: Sequence[str], ends: DataFrame, n_frac: int) -> DataFrame:
    """(group, i, j, v): the rows strictly inside the intervals, one row each."""
    j, at = _bounded(df, keys, ends, len(cols), n_frac)
    cells, some = [], F.lit(False)
    for i, x in enumerate(cols):
        v = F.col(x)
        for k in range(i * n_frac, (i + 1) * n_frac):
            lo, hi = at(k)
            inside = (v > lo) & (v < hi)
            some = some | F.coalesce(inside, F.lit(False))
            cells.append(F.when(inside, F.struct(F.lit(i).alias("i"), F.lit(k - i * n_frac).alias("j"), v.alias("v"))))
    # few rows are inside any interval: the others are gone before the cells are made
    return j.where(some).select(*[c(k) for k in keys], F.inline(F.array_compact(F.array(*cells))))


def _narrow(rows: DataFrame, keys: list, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New intervals inside the old ones, and the rows strictly inside them."""
    grid = [g / _GRID for g in range(_GRID + 1)]
    by = [*keys, "i", "j"]
    found = _group(rows, by).agg(F.percentile_approx("v", grid, 4 * _GRID).alias("__grid"))
    at = join_groups(state.where(F.col("wanted")), found, by)
    share = (F.col("r") - F.col("below") - F.col("at_lo")) / F.col("inside") * _GRID
    # two steps of the grid are more than the sketch's error; beyond the grid the old ends stay
    low = F.floor(share).cast("int") - 2
    high = F.ceil(share + F.lit(float(_GRID)) / F.col("inside")).cast("int") + 2
    new = cut_lineage(at.select(*[c(k) for k in by], "n", "r", "part",
                                F.when(low <= 0, F.col("lo")).otherwise(F.get("__grid", low)).alias("lo"),
                                F.when(high >= _GRID, F.col("hi")).otherwise(F.get("__grid", high)).alias("hi"),
                                F.col("below").alias("b0"), F.col("at_lo").alias("l0")))
    marked = join_groups(rows, new.select(*by, "lo", "hi", "b0", "l0"), by)
    v = F.col("v")
    counts = _group(marked, by).agg((F.first("b0") + F.first("l0") + F.count_if(v < F.col("lo"))).alias("below"), F.count_if(v == F.col("lo")).alias("at_lo"),
                                    F.count_if((v > F.col("lo")) & (v < F.col("hi"))).alias("inside"), F.count_if((v == F.col("hi")) & (F.col("hi") > F.col("lo"))).alias("at_hi"))
    state = join_groups(new.drop("b0", "l0"), counts, by)
    kept = marked.where((v > F.col("lo")) & (v < F.col("hi"))).select(*by, "v")
    return _with_wanted(state), kept


def _with_wanted(state: DataFrame) -> DataFrame:
    """Whether one of the two neighbours' ranks lies strictly inside the interval."""
    first, last = F.col("below") + F.col("at_lo"), F.col("below") + F.col("at_lo") + F.col("inside")
    upper = F.least(F.col("r") + 1, F.col("n") - 1)
    return state.withColumn("wanted", ((F.col("r") >= first) & (F.col("r") < last)) | ((upper >= first) & (upper < last)))


def exact_quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float], by: Sequence[str] = (),
                    accuracy: int = ACCURACY, most: int = MOST) -> DataFrame:
    """One row per group of ``by``: ``n{i}`` (non-null values) and ``q{i}``, the exact quantiles of column number i,
    linear between neighbours (null where the group has no value).

    At most three passes over ``df`` (columns and keys only), whatever its size."""
    keys, cols, frac = list(by), list(columns), [float(f) for f in fractions]
    if not cols:
        raise ValueError("no columns")
    names = [f"__k{i}" for i in range(len(keys))]
    df = df.select(*[c(k).alias(n) for k, n in zip(keys, names)], *[_value(x).alias(f"__v{i}") for i, x in enumerate(cols)])
    vals = [f"__v{i}" for i in range(len(cols))]
    ends = _intervals(df, names, vals, frac, accuracy)
    step = [*names, "i", "j"]
    while True:
        state = cut_lineage(_with_wanted(join_groups(ends, _count(df, names, vals, ends, len(frac)), step)))
        # the sketch keeps its bounds; where the counts say otherwise, the interval grows to the side of the rank
        early = F.col("r") < F.col("below")
        late = F.least(F.col("r") + 1, F.col("n") - 1) >= F.col("below") + F.col("at_lo") + F.col("inside") + F.col("at_hi")
        if state.where((F.col("n") > 0) & (early | late)).limit(1).count() == 0:
            break
        ends = cut_lineage(state.select(*step, "n", "r", "part",
                                        F.when(early, F.lit(float("-inf"))).otherwise(F.col("lo")).alias("lo"),
                                        F.when(late, F.lit(float("inf"))).otherwise(F.col("hi")).alias("hi")))
    todo = state.where(F.col("wanted"))
    answers = [_answers(state.where(~F.col("wanted") | F.col("wanted").isNull()), None, step)]
    if (largest := todo.agg(F.max("inside")).first()[0]) is not None:
        rows = _inside(df, names, vals, todo_ends(state), len(frac))
        while largest > most:
            todo, rows = _narrow(cut_lineage(rows), names, todo)
            todo = cut_lineage(todo)
            answers.append(_answers(todo.where(~F.col("wanted")), None, step))
            todo = todo.where(F.col("wanted"))
            largest = todo.agg(F.max("inside")).first()[0] or 0
            rows = join_groups(rows, todo.select(*step), step, "left_semi") if largest else rows
        if largest:
            answers.append(_answers(todo, rows, step))
    every = answers[0]
    for a in answers[1:]:
        every = every.unionByName(a)
    wide = _group(every, names).agg(F.sort_array(F.collect_list(F.struct("i", "j", "n", "answer"))).alias("__all"))
    k = len(frac)
    return wide.select(*[c(n).alias(x) for n, x in zip(names, keys)],
                       *[F.col("__all")[i * k]["n"].alias(f"n{i}") for i in range(len(cols))],
                       *[F.transform(F.slice("__all", i * k + 1, k), lambda s: s["answer"]).alias(f"q{i}") for i in range(len(cols))])


def todo_ends(state: DataFrame) -> DataFrame:
    """Ends of the intervals whose rows are needed; the others get an empty interval, so that arrays stay aligned."""
    nothing = F.lit(None).cast("double")
    return state.select(*[c(x) for x in state.columns if x not in ("lo", "hi")],
                        F.when(F.col("wanted"), F.col("lo")).otherwise(nothing).alias("lo"),
                        F.when(F.col("wanted"), F.col("hi")).otherwise(nothing).alias("hi"))


def _answers(state: DataFrame, rows: DataFrame | None, step: list) -> DataFrame:
    """The quantiles of intervals whose inner rows are given (or not needed)."""
    if rows is None:
        got = state.withColumn("__in", F.array().cast("array<double>"))
    else:
        got = join_groups(state, _group(rows, step).agg(F.sort_array(F.collect_list("v")).alias("__in")), step)

    def at(rank: Column) -> Column:
        inner = rank - F.col("below") - F.col("at_lo")
        return F.when(inner < 0, F.col("lo")).when(inner >= F.col("inside"), F.col("hi")).otherwise(F.get("__in", inner.cast("int")))
    low, high = at(F.col("r")), at(F.least(F.col("r") + 1, F.col("n") - 1))
    value = F.when(F.col("part") == 0, low).otherwise(low * (1 - F.col("part")) + high * F.col("part"))
    return got.select(*[c(x) for x in step], "n", F.when(F.col("n") > 0, value).alias("answer"))
