"""Cleaning operators with separate fit and transform.

Each ``fit_*`` runs one aggregate job and returns a small, bounded result
(one value per column, or at most ``max_unique`` values per column) - the
only data that reaches the driver.  Each transform is a pure column
expression, so a chain of transforms is one projection inside whole-stage
codegen.  Stages are fitted on the output of the previous stage (cap after
smooth after impute), as the reference pipeline does.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import c, is_numeric
from tabsmith.operators.frequent import top_values
from tabsmith.operators.quantiles import exact_quantiles
from tabsmith.operators.windows import fill_bfill_ffill, trailing_mean


@dataclass(frozen=True)
class CleaningConfig:
    remove_duplicates: bool = False
    handle_missing_values: bool = False
    smooth_noisy_data: bool = False
    handle_outliers: bool = False
    reduce_cardinality: bool = False
    encode_categorical_values: bool = False
    feature_scaling: bool = False
    handle_imbalanced_data: bool = False
    # Fixed values of the reference pipeline.
    numeric_missing_strategy: str = "mean"
    smooth_window: int = 3
    outlier_z: float = 3.0
    max_unique_categories: int = 20
    high_cardinality_warning_threshold: int = 100
    # Spark-side choices: row order for smoothing, what happens to untouched columns.
    order_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    remainder: str = "passthrough"   # or "drop" (reference behaviour)
    one_hot_encoding: str = "dense"           # or "sparse": one vector per column
    max_dense_categories: int | None = None   # a limit of the caller's, above which columns are sparse
    id_col: str | None = None                 # row key: never cleaned; new rows of a balanced class have none


@dataclass
class CleanResult:
    df: DataFrame
    fitted: dict = field(default_factory=dict)
    report: dict = field(default_factory=dict)


# ---------------------------------------------------------------------------
# roles
# ---------------------------------------------------------------------------

def column_roles(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, list[str]]:
    """Numeric (non-bool) / categorical (string, bool) / ignored (rest)."""
    ex = set(exclude)
    roles = {"numeric": [], "categorical": [], "ignored": []}
    for f in df.schema.fields:
        if f.name in ex:
            continue
        if isinstance(f.dataType, T.BooleanType) or isinstance(f.dataType, T.StringType):
            roles["categorical"].append(f.name)
        elif is_numeric(f.dataType):
            roles["numeric"].append(f.name)
        else:
            roles["ignored"].append(f.name)
    return roles


# ---------------------------------------------------------------------------
# C1 duplicates
# ---------------------------------------------------------------------------

def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed (nulls equal).  The map side of the
    aggregate already collapses copies, so a row repeated a billion times
    costs one entry per task."""
    return df.dropDuplicates()


# ---------------------------------------------------------------------------
# C2 / C3 imputation
# ---------------------------------------------------------------------------

def present(name: str):
    """A numeric column as double, with NaN as NULL."""
    return F.nanvl(c(name).cast("double"), F.lit(None).cast("double"))


def fit_impute_numeric(df: DataFrame, cols: Sequence[str], strategy: str = "mean") -> dict[str, float | None]:
    """Mean or exact median (by distributed selection) per column; NaN is missing like NULL."""
    if not cols:
        return {}
    if strategy == "mean":
        row = df.agg(*[F.avg(present(x)).alias(f"v{i}") for i, x in enumerate(cols)]).first()
        return {x: row[f"v{i}"] for i, x in enumerate(cols)}
    if strategy == "median":
        row = exact_quantiles(df, cols, [0.5]).first()
        return {x: row[f"q{i}"][0] for i, x in enumerate(cols)}
    raise ValueError(f"unknown strategy {strategy}")


def impute_numeric(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """NULL or NaN -> fitted value; the column becomes double (as pandas does)."""
    return df.withColumns({x: F.coalesce(present(x), F.lit(v).cast("double")) for x, v in values.items()})


def fit_mode(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column; smallest value on ties.  Only
    proposed values are counted and shuffled (``frequent``)."""
    if not cols:
        return {}
    got = {r["column_name"]: r["value"] for r in top_values(df, cols, 1).collect()}
    return {x: got.get(x) for x in cols}


def impute_categorical(df: DataFrame, values: dict[str, str | None]) -> DataFrame:
    return df.withColumns({x: F.coalesce(c(x).cast("string"), F.lit(v)) for x, v in values.items()})


# ---------------------------------------------------------------------------
# C4 smoothing
# ---------------------------------------------------------------------------

def smooth(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = (),
           window: int = 3, rows_per_chunk: int = 2_000_000) -> DataFrame:
    """Trailing rolling mean (``min_periods=1``), then back-fill and forward-fill."""
    if not cols:
        return df
    if not order_by:
        raise ValueError("smoothing needs order_by columns (Spark rows have no order)")
    from tabsmith.operators.windows import assign_chunks
    chunks = assign_chunks(df, partition_by, order_by, rows_per_chunk)  # shared by both steps
    sm = trailing_mean(df, cols, partition_by, order_by, window, rows_per_chunk, chunks=chunks, keep_chunks=True)
    return fill_bfill_ffill(sm, cols, partition_by, order_by, rows_per_chunk, chunks=(sm, chunks[1], chunks[2]))


# ---------------------------------------------------------------------------
# C5 / C6 capping and scaling
# ---------------------------------------------------------------------------

def fit_cap(df: DataFrame, cols: Sequence[str], z: float = 3.0) -> dict[str, tuple[float | None, float | None]]:
    """Bounds mean -/+ z * population std (zero or undefined std -> mean)."""
    if not cols:
        return {}
    aggs = []
    for i, x in enumerate(cols):
        aggs += [F.avg(present(x)).alias(f"m{i}"), F.stddev_pop(present(x)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, x in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        s = 0.0 if s is None else s
        out[x] = (None if m is None else m - z * s, None if m is None else m + z * s)
    return out


def cap(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Clip into the bounds, nulls stay null."""
    exprs = {}
    for x, (lo, hi) in bounds.items():
        v = present(x)
        if lo is not None:
            v = F.when(v.isNull(), v).otherwise(F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))
        exprs[x] = v
    return df.withColumns(exprs)


def fit_scale(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float]]:
    """Mean and population std (zero or undefined -> 1), like scikit-learn's
    StandardScaler; Spark ML's StandardScaler would use the sample std."""
    if not cols:
        return {}
    aggs = []
    for i, x in enumerate(cols):
        aggs += [F.avg(present(x)).alias(f"m{i}"), F.stddev_pop(present(x)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {x: (row[f"m{i}"], 1.0 if not row[f"s{i}"] else row[f"s{i}"]) for i, x in enumerate(cols)}


def scale(df: DataFrame, params: dict[str, tuple[float | None, float]]) -> DataFrame:
    return df.withColumns({x: (present(x) - F.lit(m)) / F.lit(s) for x, (m, s) in params.items()})


# ---------------------------------------------------------------------------
# C7 / C8 categorical reduction and one-hot encoding
# ---------------------------------------------------------------------------

def fit_reduce_cardinality(df: DataFrame, cols: Sequence[str], max_unique: int = 20) -> dict[str, list]:
    """Top ``max_unique`` values per column by (count desc, value asc), null
    counted as a value.  Only proposed values are counted and shuffled
    (``frequent``); the result is bounded by max_unique x columns."""
    if not cols:
        return {}
    out: dict[str, list] = {x: [] for x in cols}
    for r in sorted(top_values(df, cols, max_unique, include_null=True).collect(), key=lambda r: r["rank"]):
        out[r["column_name"]].append(r["value"])
    return out


def reduce_cardinality(df: DataFrame, tops: dict[str, list], other: str = "Other") -> DataFrame:
    exprs = {}
    for x, keep in tops.items():
        vals = [v for v in keep if v is not None]
        xs = c(x).cast("string")
        exprs[x] = F.when(xs.isNull(), xs).when(xs.isin(vals), xs).otherwise(F.lit(other)) if vals else \
            F.when(xs.isNull(), xs).otherwise(F.lit(other))
    return df.withColumns(exprs)


def fit_one_hot(df: DataFrame, cols: Sequence[str], max_dense: int | None = None,
                encoding: str = "dense") -> dict[str, list[str] | None]:
    """Sorted categories per column (``encoding="dense"``: 0/1 columns, however
    many categories there are; their names reach the driver), or ``None`` per
    column (``"sparse"``: one vector by Spark ML, no category list on the
    driver).  Only a caller who gives ``max_dense`` gets dense columns up to
    that many categories and sparse vectors beyond."""
    if encoding not in ("dense", "sparse"):
        raise ValueError(f"encoding must be 'dense' or 'sparse', not {encoding!r}")
    if encoding == "sparse":
        return dict.fromkeys(cols)
    if not cols:
        return {}
    from tabsmith.operators.profile import value_counts
    vc = value_counts(df, cols, dropna=True)
    narrow = list(cols)
    if max_dense is not None:
        n = {r[0]: r[1] for r in vc.groupBy("column_name").count().collect()}
        narrow = [x for x in cols if n.get(x, 0) <= max_dense]
    out: dict[str, list[str] | None] = {x: None for x in cols if x not in narrow}
    if narrow:
        rows = (vc.where(F.col("column_name").isin(narrow)).groupBy("column_name")
                .agg(F.sort_array(F.collect_list("value")).alias("v")).collect())
        got = {r[0]: list(r[1]) for r in rows}
        for x in narrow:
            out[x] = got.get(x, [])
    return out


def _one_hot_wide(df: DataFrame, x: str) -> DataFrame:
    """Sparse one-hot vector ``{x}_vec`` for a column with many categories,
    without collecting the labels: categories are numbered in sorted order by
    a distributed ranking, rows get their number by a join, and unknown or
    null values take one extra slot that ``dropLast`` removes (all zeros, as
    in the dense encoding).  Only the category count reaches the driver."""
    from pyspark.ml.feature import OneHotEncoder
    from tabsmith.operators.rows import position_in_group
    xs = c(x).cast("string")
    vals = df.select(xs.alias("__v")).where(F.col("__v").isNotNull()).distinct().withColumn("__one", F.lit(1))
    ranked = position_in_group(vals, ["__one"], [F.col("__v")], "__pos")
    n_cat = ranked.agg(F.max("__pos")).first()[0] or 0
    idx = ranked.select(F.col("__v").alias("__val"), (F.col("__pos") - 1).cast("double").alias("__i"))
    out = df.join(idx, xs == F.col("__val"), "left").drop("__val")
    meta = {"ml_attr": {"type": "nominal", "num_vals": int(n_cat) + 1, "name": f"{x}__idx"}}
    out = out.withColumn(f"{x}__idx", F.coalesce(F.col("__i"), F.lit(float(n_cat))).alias(f"{x}__idx", metadata=meta)) \
             .drop("__i")
    enc = OneHotEncoder(inputCols=[f"{x}__idx"], outputCols=[f"{x}_vec"], dropLast=True, handleInvalid="error")
    return enc.fit(out).transform(out).drop(f"{x}__idx")


def one_hot(df: DataFrame, categories: dict[str, list[str] | None], drop_original: bool = True) -> DataFrame:
    """Dense 0/1 double columns ``{col}_{value}`` in sorted category order;
    unknown or null -> all zeros.  Columns without a category list -> one sparse vector column."""
    out = df
    for x, cats in categories.items():
        if cats is None:
            out = _one_hot_wide(out, x)
        else:
            xs = c(x).cast("string")
            out = out.withColumns({f"{x}_{v}": F.coalesce((xs == F.lit(v)).cast("double"), F.lit(0.0)) for v in cats})
        if drop_original:
            out = out.drop(x)
    return out


# ---------------------------------------------------------------------------
# C10 / C11 checks
# ---------------------------------------------------------------------------

def balance_check(df: DataFrame, target: str, feature_cols: Sequence[str], min_minority: int = 6) -> DataFrame:
    """SMOTE preconditions as a verdict row: fewer than 2 classes -> skip,
    minority smaller than k+1 -> skip, non-numeric features -> skip, more than
    2 classes -> warn (multi-class oversampling)."""
    all_num = all(is_numeric(df.schema[x].dataType) for x in feature_cols)
    g = df.where(c(target).isNotNull()).groupBy(c(target)).agg(F.count(F.lit(1)).alias("n"))
    s = g.agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("minority_count"),
              F.max("n").alias("majority_count"))
    verdict = (F.when(F.col("n_classes") < 2, F.lit("skip_single_class"))
               .when(F.lit(not all_num), F.lit("skip_non_numeric"))
               .when(F.col("minority_count") < min_minority, F.lit("skip_minority_too_small"))
               .when(F.col("n_classes") > 2, F.lit("warn_multiclass"))
               .otherwise(F.lit("ok")))
    return s.withColumn("verdict", verdict)


def high_cardinality(df: DataFrame, cols: Sequence[str], threshold: int = 100, exact: bool = False) -> DataFrame:
    from tabsmith.operators.profile import _stack
    aggs = [(F.count_distinct(c(x)) if exact else F.approx_count_distinct(c(x))).alias(f"d{i}")
            for i, x in enumerate(cols)]
    tall = _stack(df.agg(*aggs), list(cols), [[f"d{i}"] for i in range(len(cols))], ["n_unique"])
    return tall.where(F.col("n_unique") > threshold)


# ---------------------------------------------------------------------------
# C12 / C13 composed runs, C14 / C15 reports
# ---------------------------------------------------------------------------

def _numeric_aggs(cols: Sequence[str], tag: str = "") -> list:
    aggs = []
    for i, x in enumerate(cols):
        v = present(x)
        aggs += [F.count(v).alias(f"{tag}n{i}"), F.avg(v).alias(f"{tag}m{i}"), F.stddev_pop(v).alias(f"{tag}s{i}"),
                 F.min(v).alias(f"{tag}lo{i}"), F.max(v).alias(f"{tag}hi{i}")]
    return aggs


def _moments(row, cols: Sequence[str], tag: str = "") -> dict[str, dict]:
    return {x: {k: row[f"{tag}{k}{i}"] for k in ("n", "m", "s", "lo", "hi")} for i, x in enumerate(cols)}


def _imputed(st: dict, rows: int, value: float | None) -> dict:
    """Statistics of a column once its gaps hold ``value``: with mean m and M2 of the n present values, and g gaps,
    mean' = (n m + g v) / (n + g) and M2' = M2 + n (m - mean')^2 + g (v - mean')^2."""
    gaps = rows - st["n"]
    if value is None or not gaps:
        return st
    if not st["n"]:
        return {"n": rows, "m": value, "s": 0.0, "lo": value, "hi": value}
    mean = (st["n"] * st["m"] + gaps * value) / rows
    m2 = st["n"] * (st["s"] or 0.0) ** 2 + st["n"] * (st["m"] - mean) ** 2 + gaps * (value - mean) ** 2
    return {"n": rows, "m": mean, "s": math.sqrt(m2 / rows), "lo": min(st["lo"], value), "hi": max(st["hi"], value)}


def clean(df: DataFrame, cfg: CleaningConfig, target: str | None = None) -> CleanResult:
    """Composed cleaning run.  Returns the cleaned frame (lazy), the fitted
    values and a small report.  ``remainder='drop'`` reproduces the
    reference, which loses every column no active step touches.

    The steps are fitted together: one aggregate gives the moments of the
    numeric columns, the sketches of the text columns and the constant columns;
    the statistics after imputation follow from them, so do the cap's bounds,
    and the scale unless the cap changes a column (those columns are scanned
    once more).  A second scan counts the text columns' proposed values, from
    which mode, kept categories and one-hot columns follow.  Smoothing and
    removing duplicates store their result."""
    if cfg.handle_imbalanced_data and not target:
        raise ValueError("balancing classes needs a target")
    fitted: dict = {}
    report: dict = {}
    from tabsmith.operators.frequent import candidates
    from tabsmith.session import cut_lineage
    out = cut_lineage(drop_duplicates(df)) if cfg.remove_duplicates else df
    roles = column_roles(out, exclude=[x for x in (target, cfg.id_col) if x])
    num, cat = list(roles["numeric"]), list(roles["categorical"])
    num_active = cfg.handle_missing_values or cfg.smooth_noisy_data or cfg.handle_outliers or cfg.feature_scaling
    cat_active = cfg.handle_missing_values or cfg.reduce_cardinality or cfg.encode_categorical_values
    # scan 1: everything that is known without another column's or step's result
    aggs = _numeric_aggs(num, "v_")
    for i, x in enumerate(cat):
        aggs += [F.count(c(x)).alias(f"c{i}"), (F.min(c(x)) == F.max(c(x))).alias(f"same{i}"), F.approx_count_distinct(c(x)).alias(f"d{i}")]
    proposed = candidates(out, cat if cat_active else [], aggs)
    row = proposed[2]
    rows, stats = row["rows"], _moments(row, num, "v_")
    # constant: numeric columns without two different values, text columns of one value (null is one)
    filled = {x: row[f"c{i}"] for i, x in enumerate(cat)}
    consts = [x for x in num if stats[x]["n"] < 2 or stats[x]["lo"] == stats[x]["hi"]]
    consts += [x for i, x in enumerate(cat) if not filled[x] or filled[x] == rows and row[f"same{i}"]]
    report["dropped_constant"] = consts
    if cfg.reduce_cardinality or cfg.encode_categorical_values:
        report["high_cardinality"] = [x for i, x in enumerate(cat) if x not in consts and row[f"d{i}"] > cfg.high_cardinality_warning_threshold]
    num, cat = [x for x in num if x not in consts], [x for x in cat if x not in consts]
    out = out.drop(*consts)
    base = out
    # numeric chain
    if cfg.handle_missing_values and num:
        fill = {x: stats[x]["m"] for x in num} if cfg.numeric_missing_strategy == "mean" else \
            fit_impute_numeric(out, num, cfg.numeric_missing_strategy)
        fitted["impute_numeric"] = fill
        out = impute_numeric(out, fill)
        stats = {x: _imputed(stats[x], rows, fill[x]) for x in num}
    if cfg.smooth_noisy_data and num:
        out = cut_lineage(smooth(out, num, cfg.order_by, cfg.partition_by, cfg.smooth_window))
        if cfg.handle_outliers or cfg.feature_scaling:
            stats = _moments(out.agg(*_numeric_aggs(num)).first(), num)
    if cfg.handle_outliers and num:
        bounds = {x: (None, None) if st["m"] is None else (st["m"] - cfg.outlier_z * (st["s"] or 0.0), st["m"] + cfg.outlier_z * (st["s"] or 0.0))
                  for x, st in stats.items() if x in num}
        fitted["cap"] = bounds
        out = cap(out, bounds)
        # scan 2, if any: only columns that the cap changes
        cut = [x for x in num if bounds[x][0] is not None and (stats[x]["lo"] < bounds[x][0] or stats[x]["hi"] > bounds[x][1])]
        if cfg.feature_scaling and cut:
            stats |= _moments(out.agg(*_numeric_aggs(cut)).first(), cut)
    if cfg.feature_scaling and num:
        fitted["scale"] = {x: (stats[x]["m"], stats[x]["s"] or 1.0) for x in num}
        out = scale(out, fitted["scale"])
    # categorical chain
    encoded: list[str] = []
    if cat_active and cat:
        k = cfg.max_unique_categories
        tops: dict[str, list] = {x: [] for x in cat}
        for r in top_values(base, cat, k + 1, include_null=True, proposed=proposed).collect():
            tops[r["column_name"]].append((-r["count"], r["value"] is not None, r["value"]))
        if cfg.handle_missing_values:
            mode = {x: next((v for _, known, v in sorted(t) if known), None) for x, t in tops.items()}
            fitted["impute_categorical"] = mode
            out = impute_categorical(out, mode)
            for x, t in tops.items():  # the gaps now hold the mode
                gaps = rows - filled[x]
                if mode[x] is not None:
                    tops[x] = [(n - gaps * (v == mode[x]), True, v) for n, known, v in t if known]
        kept = {x: [v for _, _, v in sorted(t)[:k]] for x, t in tops.items()}
        if cfg.reduce_cardinality:
            fitted["reduce"] = kept
            out = reduce_cardinality(out, kept)
        if cfg.encode_categorical_values:
            if cfg.reduce_cardinality and cfg.one_hot_encoding == "dense" and cfg.max_dense_categories is None:
                gaps = {x: 0 if cfg.handle_missing_values and mode[x] is not None else rows - filled[x] for x in cat}
                names = {x: {v for v in kept[x] if v is not None} for x in cat}
                for x in cat:  # rows with a value that isn't kept are "Other"
                    if -sum(n for n, _, v in sorted(tops[x])[:k] if v is not None) + gaps[x] < rows:
                        names[x].add("Other")
                fitted["one_hot"] = {x: sorted(v, key=lambda s: s.encode()) for x, v in names.items()}
            else:
                fitted["one_hot"] = fit_one_hot(out, cat, cfg.max_dense_categories, cfg.one_hot_encoding)
            before = set(out.columns)
            out = one_hot(out, fitted["one_hot"])
            encoded = [x for x in out.columns if x not in before]
    if cfg.remainder == "drop":
        keep = (num if num_active else []) + ((encoded if encoded else cat) if cat_active else [])
        keep = ([cfg.id_col] if cfg.id_col else []) + keep + ([target] if target else [])
        out = out.select(*[c(x) for x in keep])
    if cfg.handle_imbalanced_data:
        from tabsmith.operators.smote import smote
        out = cut_lineage(out)  # the neighbours are looked up in it several times
        feats = [x for x in out.columns if x not in (target, cfg.id_col)]
        report["balance"] = verdict = balance_check(out, target, feats).first()["verdict"]
        if not verdict.startswith("skip"):
            out = smote(out, target, feats, id_col=cfg.id_col)
    return CleanResult(out, fitted, report)


def clean_preview(df: DataFrame) -> DataFrame:
    """C14: missing cells, 3-sigma outliers (sample std) over numeric columns,
    duplicate rows beyond the first copy."""
    from tabsmith.operators.profile import duplicate_count
    num = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    st = df.agg(*[F.avg(c(x).cast("double")).alias(f"m{i}") for i, x in enumerate(num)],
                *[F.stddev_samp(c(x).cast("double")).alias(f"s{i}") for i, x in enumerate(num)])
    j = df.crossJoin(st)  # one-row side
    out_flags = [F.when(F.abs(c(x).cast("double") - F.col(f"m{i}")) > 3 * F.col(f"s{i}"), 1).otherwise(0)
                 for i, x in enumerate(num)]
    agg = j.agg(
        F.sum(sum((F.when(c(x).isNull(), 1).otherwise(0) for x in df.columns), F.lit(0))).cast("bigint")
        .alias("missing_cells"),
        F.sum(sum(out_flags, F.lit(0))).cast("bigint").alias("outlier_cells"))
    dup = duplicate_count(df).select("duplicate_rows")
    return agg.crossJoin(dup)


def clean_report(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Original rows, cleaned rows (two counts)."""
    a = original.agg(F.count(F.lit(1)).alias("original_rows"))
    b = cleaned.agg(F.count(F.lit(1)).alias("cleaned_rows"))
    return a.crossJoin(b).withColumn("rows_removed", F.col("original_rows") - F.col("cleaned_rows"))
