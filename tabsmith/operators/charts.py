"""Chart-ready aggregates.

Every chart is an aggregate whose output size is set by the chart (bins,
categories, grid cells), not by the number of rows; only those rows ever
leave the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import c, safe_div
from tabsmith.operators.quantiles import exact_quantiles, join_groups


def _range(df: DataFrame, x: Column, by: Sequence[str] = ()) -> DataFrame:
    """min/max of x (per group), widened by 0.5 when lo = hi (numpy rule)."""
    g = df.groupBy(*[c(b) for b in by]) if by else df.groupBy()
    st = g.agg(F.min(x).alias("_lo0"), F.max(x).alias("_hi0"))
    same = F.col("_lo0") == F.col("_hi0")
    return st.select(*[c(b) for b in by],
                     F.when(same, F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
                     F.when(same, F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """numpy.histogram bin of x for ``bins`` equal-width bins on [lo, hi]
    (last bin closed), including numpy's edge corrections."""
    step = (hi - lo) / F.lit(float(bins))
    raw = F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")
    i = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))

    def edge(k):
        return F.when(k >= F.lit(bins), hi).otherwise(lo + k.cast("double") * step)
    i = F.when(x < edge(i), i - 1).otherwise(i)
    i = F.when((i < F.lit(bins - 1)) & (x >= edge(i + 1)), i + 1).otherwise(i)
    return i


def histogram(df: DataFrame, column: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram with every bin present (zero counts included),
    optionally per colour group.  Label ``"lo - hi"`` rounded to 2 digits."""
    x = F.nanvl(c(column).cast("double"), F.lit(None).cast("double"))  # NaN is missing, too
    base = df.select(*[c(b) for b in by], x.alias("_x")).where(F.col("_x").isNotNull())
    rng = _range(base, F.col("_x"), by)
    keys = list(by)
    # one row per group: joined back to the data on the group key(s)
    j = join_groups(base, rng, keys) if keys else base.crossJoin(rng)
    counts = (j.withColumn("bin", bin_index(F.col("_x"), F.col("_lo"), F.col("_hi"), bins))
              .groupBy(*[c(b) for b in by], "bin").agg(F.count(F.lit(1)).alias("count")))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    lo_e = F.col("_lo") + F.col("bin").cast("double") * step
    hi_e = F.when(F.col("bin") == bins - 1, F.col("_hi")).otherwise(F.col("_lo") + (F.col("bin") + 1).cast("double") * step)
    all_bins = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = join_groups(all_bins, counts, keys + ["bin"], "left")
    return out.select(*[c(b) for b in by], "bin",
                      lo_e.alias("bin_start"), hi_e.alias("bin_end"),
                      F.concat(F.round(lo_e, 2).cast("string"), F.lit(" - "), F.round(hi_e, 2).cast("string"))
                      .alias("label"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def mean_by(df: DataFrame, x: str, y: str, x_type: str | None = None) -> DataFrame:
    """Mean of y per x, rows with a null x or y dropped; ``sort_key``: x for
    datetime/number axes, mean descending for categories; x as text."""
    dt = df.schema[x].dataType
    if x_type is None:
        x_type = ("datetime" if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))
                  else "number" if isinstance(dt, T.NumericType) else "category")
    g = (df.select(c(x).alias("_x"), c(y).cast("double").alias("_y")).dropna()
         .groupBy("_x").agg(F.avg("_y").alias("mean")))
    if x_type in ("category", "string"):
        rank_key = -F.col("mean")
    else:
        rank_key = F.col("_x")
    return g.select(F.col("_x").cast("string").alias("x"), F.col("mean").alias("y"),
                    rank_key.cast("double" if x_type in ("category", "string") else dt).alias("sort_key"))


def pie(df: DataFrame, x: str, y: str, max_slices: int = 15, fold_other: bool = False) -> DataFrame:
    """Sum of y per category and its share.  More than ``max_slices``
    categories: refused (``ok`` false) or, with ``fold_other``, the tail beyond
    the largest ``max_slices - 1`` is folded into 'Other'."""
    from pyspark.sql import Window
    g = df.groupBy(c(x).cast("string").alias("category")).agg(F.sum(c(y).cast("double")).alias("value"))
    tot = g.agg(F.sum("value").alias("_tot"), F.count(F.lit(1)).alias("n_slices"))
    out = g.crossJoin(tot)  # one-row side
    if fold_other:
        w = Window.orderBy(F.col("value").desc(), F.col("category"))  # over categories, not rows
        out = out.withColumn("_r", F.row_number().over(w))
        out = (out.withColumn("category", F.when(F.col("_r") < max_slices, F.col("category")).otherwise(F.lit("Other")))
               .groupBy("category").agg(F.sum("value").alias("value"), F.first("_tot").alias("_tot"),
                                        F.first("n_slices").alias("n_slices")))
        ok = F.lit(True)
    else:
        ok = F.col("n_slices") <= max_slices
    return out.select("category", "value", (safe_div(F.col("value"), F.col("_tot")) * 100.0).alias("percentage"),
                      ok.alias("ok"))


def grouped_stats(df: DataFrame, x: str, y: str, hue: str | None = None, z: float = 1.96) -> DataFrame:
    """Bar/line data: mean, sample std, count and a normal-approximation
    confidence interval of y per x (and colour group)."""
    keys = [c(x)] + ([c(hue)] if hue else [])
    g = df.groupBy(*keys).agg(F.avg(c(y).cast("double")).alias("mean"),
                              F.stddev_samp(c(y).cast("double")).alias("std"),
                              F.count(c(y)).alias("count"))
    half = F.lit(z) * F.col("std") / F.sqrt(F.col("count").cast("double"))
    return g.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def kde(df: DataFrame, column: str, grid: int = 100, fine_bins: int = 512, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on a grid, computed from a fine histogram, so
    the cost after one scan is bins x grid - independent of the row count.
    Bandwidth: Scott's rule, sample std x n^(-1/5) (scipy's default)."""
    x = c(column).cast("double")
    base = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    st = base.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n"),
                  F.stddev_samp("_x").alias("_sd"))
    h = F.lit(bandwidth) if bandwidth else F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    st = st.withColumn("_h", h).withColumn("_w", (F.col("_hi") - F.col("_lo")) / F.lit(float(fine_bins)))
    fb = (base.crossJoin(st)  # one-row side
          .withColumn("b", F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_w")), F.lit(fine_bins - 1)))
          .groupBy("b").agg(F.count(F.lit(1)).alias("nb"), F.avg("_x").alias("cb")))
    pts = fb.crossJoin(st)  # one-row side
    pts = pts.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    gx = F.col("_lo") + F.col("g").cast("double") * (F.col("_hi") - F.col("_lo")) / F.lit(float(grid - 1))
    u = (gx - F.col("cb")) / F.col("_h")
    contrib = F.col("nb") * F.exp(-0.5 * u * u)
    dens = pts.groupBy("g").agg(F.first(gx).alias("x"),
                                (F.sum(contrib) / (F.first("_n") * F.first("_h") * F.lit((2 * 3.141592653589793) ** 0.5)))
                                .alias("density"))
    return dens.select(F.col("g").cast("int").alias("grid_index"), "x", "density")


def boxplot(df: DataFrame, y: str, by: str | None = None, exact: bool = False) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (furthest data inside the fences) and the
    number of points beyond them, per group.  NaN is missing; ``exact``
    quartiles come from distributed selection."""
    keys = [by] if by else []
    yy = F.nanvl(c(y).cast("double"), F.lit(None).cast("double"))
    if exact:
        g = exact_quantiles(df, [y], [0.25, 0.5, 0.75], by=keys).select(*[c(k) for k in keys], F.col("q0").alias("_q"), F.col("n0").alias("n"))
    else:
        pc = F.percentile_approx(yy, [0.25, 0.5, 0.75], 10000)
        g = (df.groupBy(*[c(k) for k in keys]) if keys else df.groupBy()).agg(pc.alias("_q"), F.count(yy).alias("n"))
    g = g.select(*[c(k) for k in keys], "n", F.col("_q")[0].cast("double").alias("q1"),
                 F.col("_q")[1].cast("double").alias("median"), F.col("_q")[2].cast("double").alias("q3"))
    g = g.withColumn("iqr", F.col("q3") - F.col("q1")) \
         .withColumn("_lf", F.col("q1") - 1.5 * F.col("iqr")).withColumn("_hf", F.col("q3") + 1.5 * F.col("iqr"))
    j = df.select(*[c(k) for k in keys], yy.alias("_y")).where(F.col("_y").isNotNull())
    j = join_groups(j, g, keys) if keys else j.crossJoin(g)
    inside = (F.col("_y") >= F.col("_lf")) & (F.col("_y") <= F.col("_hf"))
    w = j.groupBy(*[c(k) for k in keys]).agg(
        F.min(F.when(inside, F.col("_y"))).alias("whisker_low"), F.max(F.when(inside, F.col("_y"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))
    out = join_groups(g, w, keys) if keys else g.crossJoin(w)
    return out.drop("_lf", "_hf")


def heatmap(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(c(a), c(b)).agg(F.count(F.lit(1)).alias("count"))


def density_2d(df: DataFrame, x: str, y: str, nx: int = 20, ny: int = 20) -> DataFrame:
    """Square-cell 2-D histogram (cell ids by arithmetic, then one groupBy)."""
    xx, yy = c(x).cast("double"), c(y).cast("double")
    base = df.select(xx.alias("_x"), yy.alias("_y")).dropna()
    st = base.agg(F.min("_x").alias("_lx"), F.max("_x").alias("_hx"), F.min("_y").alias("_ly"), F.max("_y").alias("_hy"))
    j = base.crossJoin(st)  # one-row side
    cx = F.least(F.floor((F.col("_x") - F.col("_lx")) / F.try_divide(F.col("_hx") - F.col("_lx"), F.lit(float(nx)))),
                 F.lit(nx - 1))
    cy = F.least(F.floor((F.col("_y") - F.col("_ly")) / F.try_divide(F.col("_hy") - F.col("_ly"), F.lit(float(ny)))),
                 F.lit(ny - 1))
    return (j.select(F.coalesce(cx, F.lit(0)).cast("int").alias("cell_x"), F.coalesce(cy, F.lit(0)).cast("int").alias("cell_y"))
            .groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("count")))


def resample(df: DataFrame, ts: str, value: str, unit: str = "day", how: str = "mean",
             fill_gaps: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Time resampling: ``date_trunc(unit)`` buckets with mean or sum;
    optional empty buckets between the first and last one."""
    bucket = F.date_trunc(unit, c(ts).cast("timestamp")).cast("timestamp_ntz")
    agg = F.avg(c(value).cast("double")) if how == "mean" else F.sum(c(value).cast("double"))
    g = df.groupBy(*[c(b) for b in by], bucket.alias("period")).agg(agg.alias(value), F.count(F.lit(1)).alias("n"))
    if not fill_gaps:
        return g
    rng = g.groupBy(*[c(b) for b in by]).agg(F.min("period").alias("_a"), F.max("period").alias("_b"))
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH",
            "hour": "INTERVAL 1 HOUR", "year": "INTERVAL 1 YEAR"}[unit]
    allp = rng.select(*[c(b) for b in by], F.explode(F.expr(f"sequence(_a, _b, {step})")).alias("period"))
    out = allp.join(g, list(by) + ["period"], "left")
    return out.withColumn("n", F.coalesce(F.col("n"), F.lit(0)))


def total_per_group(df: DataFrame, group: str, measure: str) -> DataFrame:
    return df.groupBy(c(group)).agg(F.sum(c(measure).cast("double")).alias("total"))
