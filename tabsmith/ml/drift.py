"""Data drift between a reference and a current table.

One distribution table (column, value, rows in the reference, rows in the
current table) holds all columns.  Numeric columns: two-sample
Kolmogorov-Smirnov statistic (largest ECDF gap) and the Wasserstein-1 distance
normalised by the reference std, from one running sum over the distinct values
of all columns (``cumulative_sums``: no single-partition window).  Categorical
columns: chi-square and the Jensen-Shannon distance, from one aggregate.  Only
a row per column reaches the driver to turn statistics into p-values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.core import c, is_numeric
from tabsmith.ml.metrics import cumulative_sums
from tabsmith.session import cut_lineage


def _tagged(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    a = reference.select(_number(column).alias("x"), F.lit(1).alias("a"))
    b = current.select(_number(column).alias("x"), F.lit(0).alias("a"))
    return a.unionByName(b).where(F.col("x").isNotNull())


def _number(column: str) -> Column:
    return F.nanvl(c(column).cast("double"), F.lit(None).cast("double"))


def distribution_table(reference: DataFrame, current: DataFrame, columns: Sequence[str],
                       period: Column | None = None) -> DataFrame:
    """(column, kind, x, value, period, p, n): how often each value of each
    column occurs in the reference (``p``) and in the current table (``n``, per
    ``period`` if one is given).  Numbers are in ``x`` (null and NaN left out),
    categories in ``value`` (null is one).

    One scan of each table for any number of columns; rows are counted before
    the shuffle.  Stored, as all statistics are read from it."""
    none = F.lit(None).cast("timestamp_ntz")

    def cells(df: DataFrame, side: str, at: Column) -> DataFrame:
        rows = []
        for x in columns:
            num = is_numeric(reference.schema[x].dataType)
            rows.append(F.struct(F.lit(x).alias("column"), F.lit("num" if num else "cat").alias("kind"),
                                 (_number(x) if num else F.lit(None).cast("double")).alias("x"),
                                 (F.lit(None).cast("string") if num else c(x).cast("string")).alias("value")))
        tall = df.select(at.alias("period"), F.inline(F.array(*rows))).where((F.col("kind") == "cat") | F.col("x").isNotNull())
        return tall.withColumns({"p": F.lit(int(side == "p")).cast("bigint"), "n": F.lit(int(side == "n")).cast("bigint")})
    both = cells(reference, "p", none).unionByName(cells(current, "n", none if period is None else period))
    return cut_lineage(both.groupBy("column", "kind", "x", "value", "period").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))


def numeric_statistics(dist: DataFrame, buckets: int = 256) -> DataFrame:
    """Per numeric column of a distribution table: two-sample KS statistic, Wasserstein-1 distance, the reference's
    population std and the sample sizes - one bucketed running sum over all columns."""
    g = dist.where(F.col("kind") == "num").select("column", "x", "p", "n")
    tot = g.groupBy("column").agg(F.sum("p").alias("tot_p"), F.sum("n").alias("tot_n"),
                                  (F.sum(F.col("p") * F.col("x")) / F.sum("p")).alias("mean"))
    cs = cumulative_sums(g, "x", ["p", "n"], buckets, keys=["column"], next_col="x_next").join(tot, "column")  # a row per column
    gap = F.abs(F.try_divide(F.col("cum_p"), F.col("tot_p")) - F.try_divide(F.col("cum_n"), F.col("tot_n")))
    d = F.col("x") - F.col("mean")
    return cs.groupBy("column").agg(
        F.max(gap).alias("ks"), F.sum(gap * (F.col("x_next") - F.col("x"))).alias("w1"),
        F.sqrt(F.try_divide(F.sum(F.col("p") * d * d), F.sum("p").cast("double"))).alias("sd"),
        F.first("tot_p").alias("n_reference"), F.first("tot_n").alias("n_current"))


def category_statistics(dist: DataFrame) -> DataFrame:
    """Per categorical column of a distribution table: chi-square of the current counts against the reference's shares
    (categories absent there ignored), its degrees of freedom and the Jensen-Shannon distance (base 2)."""
    g = dist.where(F.col("kind") == "cat").select("column", "p", "n")
    t = g.join(g.groupBy("column").agg(F.sum("p").alias("tot_p"), F.sum("n").alias("tot_n")), "column")  # a row per column
    p, q_ = F.try_divide(F.col("p"), F.col("tot_p")), F.try_divide(F.col("n"), F.col("tot_n"))
    m = (p + q_) / 2
    exp = p * F.col("tot_n")
    known = F.col("p") > 0

    def kl(a: Column) -> Column:
        return F.sum(F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0)))
    return t.groupBy("column").agg(
        F.sum(F.when(known, F.try_divide((F.col("n") - exp) * (F.col("n") - exp), exp))).alias("chi2"),
        (F.count_if(known) - 1).alias("dof"), F.sqrt(F.greatest(F.lit(0.0), 0.5 * kl(p) + 0.5 * kl(q_))).alias("js"))


def ks_statistic(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Two-sample KS statistic D and the sample sizes."""
    return numeric_statistics(distribution_table(reference, current, [column])).select(
        F.col("ks").alias("statistic"), "n_reference", "n_current")


def ks_pvalue(d: float, n: int, m: int) -> float:
    """Asymptotic Kolmogorov distribution: Q(lambda) = 2 sum (-1)^(k-1) exp(-2 k^2 lambda^2)."""
    if n == 0 or m == 0:
        return float("nan")
    en = math.sqrt(n * m / (n + m))
    lam = (en + 0.12 + 0.11 / en) * d
    if lam < 1e-3:
        return 1.0
    s = 0.0
    for k in range(1, 101):
        term = 2 * (-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam)
        s += term
        if abs(term) < 1e-12:
            break
    return min(max(s, 0.0), 1.0)


def wasserstein_normed(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """W1 = integral |F_ref - F_cur| dx over the merged sorted values,
    divided by the reference standard deviation (population)."""
    st = numeric_statistics(distribution_table(reference, current, [column]))
    return st.select(F.col("w1").alias("wasserstein"), F.try_divide(F.col("w1"), F.col("sd")).alias("statistic"))


def category_distributions(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Aligned category shares of both sides (full outer join of two counts)."""
    from tabsmith.operators.relate import category_alignment
    t = category_alignment(reference, current, column)
    tot = t.agg(F.sum("ref_count").alias("R"), F.sum("cur_count").alias("C"))
    return t.crossJoin(tot).withColumn("ref_share", F.col("ref_count") / F.col("R")) \
        .withColumn("cur_share", F.col("cur_count") / F.col("C"))


def chi_square(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Pearson chi-square of the current counts against the reference shares
    (categories absent from the reference are ignored, as a goodness-of-fit test)."""
    return category_statistics(distribution_table(reference, current, [column])).select(F.col("chi2").alias("statistic"), "dof")


def jensen_shannon(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Jensen-Shannon distance (base-2 logs, in [0, 1]) of the category shares."""
    return category_statistics(distribution_table(reference, current, [column])).select(F.col("js").alias("statistic"))


def chi2_sf(x: float, k: int) -> float:
    """Chi-square survival function via the regularised upper gamma Q(k/2, x/2)."""
    if k <= 0 or x is None:
        return float("nan")
    if x <= 0:
        return 1.0
    a, z = k / 2.0, x / 2.0
    gln = math.lgamma(a)
    if z < a + 1:  # series for P, return 1 - P
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1
            d *= z / ap
            s += d
            if abs(d) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-z + a * math.log(z) - gln))
    b, cc, d = z + 1 - a, 1.0 / 1e-300, 1.0 / (z + 1 - a)  # continued fraction for Q
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        cc = b + an / cc
        cc = 1e-300 if abs(cc) < 1e-300 else cc
        d = 1.0 / d
        de = d * cc
        h *= de
        if abs(de - 1) < 1e-15:
            break
    return min(1.0, math.exp(-z + a * math.log(z) - gln) * h)


def drift_report(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None,
                 drop: Sequence[str] = (), test: str = "distance", p_threshold: float = 0.05,
                 distance_threshold: float = 0.1, share_threshold: float = 0.5) -> DataFrame:
    """Per common column: test, score, drift flag; plus the dataset verdict.

    ``test`` is the caller's choice and never depends on the size of the data:
    "p_value" takes KS (numeric) or chi-square (categorical) at p < 0.05,
    "distance" normalised Wasserstein / Jensen-Shannon distance >= 0.1.  The
    dataset drifts when at least half of the columns do.  One distribution
    table of all columns (a scan of each side) and two aggregates over it; one
    row of statistics per column is collected."""
    if test not in ("distance", "p_value"):
        raise ValueError(f"unknown test {test!r}")
    spark = reference.sparkSession
    common = [x for x in reference.columns if x in current.columns and x not in set(drop)]
    cols = [x for x in (columns or common) if x in common]
    rows = drift_rows(distribution_table(reference, current, cols), cols, test, p_threshold, distance_threshold) if cols else []
    df = spark.createDataFrame(rows, "column string, type string, test string, drift_score double, drift_detected boolean")
    share = (sum(1 for r in rows if r[4]) / len(rows)) if rows else 0.0
    return df.withColumn("dataset_drift", F.lit(share >= share_threshold)).withColumn("drift_share", F.lit(share))


def drift_rows(dist: DataFrame, cols: Sequence[str], test: str, p_threshold: float = 0.05,
               distance_threshold: float = 0.1) -> list[tuple]:
    """(column, type, test, score, drifts) of each column of a distribution table (two columns with no rows on a side
    can't be told apart: score 1 or 0)."""
    num = {r["column"]: r for r in numeric_statistics(dist).collect()}
    cat = {r["column"]: r for r in category_statistics(dist).collect()}
    rows = []
    for x in cols:
        r = num.get(x)
        if x not in cat and test == "p_value":
            score = ks_pvalue(r["ks"], r["n_reference"], r["n_current"]) if r and r["ks"] is not None else 1.0
            rows.append((x, "num", "K-S p_value", float(score), bool(score < p_threshold)))
        elif x not in cat:
            score = r["w1"] / r["sd"] if r and r["sd"] and r["w1"] is not None else 0.0
            rows.append((x, "num", "Wasserstein distance (normed)", float(score), bool(score >= distance_threshold)))
        elif test == "p_value":
            score = chi2_sf(cat[x]["chi2"], cat[x]["dof"])
            rows.append((x, "cat", "chi-square p_value", float(score), bool(score < p_threshold)))
        else:
            score = cat[x]["js"] or 0.0
            rows.append((x, "cat", "Jensen-Shannon distance", float(score), bool(score >= distance_threshold)))
    return rows


def drift_distribution(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Both sides on shared histogram edges (range of the union)."""
    from tabsmith.operators.charts import bin_index
    d = _tagged(reference, current, column)
    st = d.agg(F.min("x").alias("_lo0"), F.max("x").alias("_hi0"))
    st = st.select(F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
                   F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    j = d.crossJoin(st)  # one-row side
    g = j.withColumn("bin", bin_index(F.col("x"), F.col("_lo"), F.col("_hi"), bins)).groupBy("bin").agg(
        F.sum("a").alias("reference_count"), F.sum(1 - F.col("a")).alias("current_count"))
    allb = st.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return allb.join(g, "bin", "left").fillna(0, ["reference_count", "current_count"]) \
        .withColumn("reference_count", F.col("reference_count").cast("bigint")) \
        .withColumn("current_count", F.col("current_count").cast("bigint"))


def drift_over_time(reference: DataFrame, current: DataFrame, column: str | Sequence[str], ts: str, unit: str = "week") -> DataFrame:
    """Per period of the current table, KS statistic of a column against
    the whole reference (several columns: a column ``column`` comes first).

    One distribution table (a scan of each side), a bucketed running sum per
    column for the reference and one per (column, period)."""
    cols = [column] if isinstance(column, str) else list(column)
    period = F.date_trunc(unit, c(ts).cast("timestamp")).cast("timestamp_ntz")
    dist = distribution_table(reference, current, cols, period).where(F.col("kind") == "num")
    # reference ECDF at every distinct value of either side
    u = dist.groupBy("column", "x").agg(F.sum("p").alias("p"))
    ecdf = cumulative_sums(u, "x", ["p"], keys=["column"]).join(u.groupBy("column").agg(F.sum("p").alias("tot_p")), "column")
    ecdf = ecdf.select("column", "x", F.try_divide(F.col("cum_p"), F.col("tot_p")).alias("f_le"),
                       F.try_divide(F.col("cum_p") - F.col("p"), F.col("tot_p")).alias("f_lt"))
    cg = dist.where((F.col("n") > 0) & F.col("period").isNotNull()).select("column", "period", "x", "n")
    t = cumulative_sums(cg.join(ecdf, ["column", "x"]), "x", ["n"], keys=["column", "period"], prefix="_c")  # adds _cn
    t = t.join(cg.groupBy("column", "period").agg(F.sum("n").alias("_N")), ["column", "period"])  # a row per column and period
    g_le = F.col("_cn") / F.col("_N")
    g_lt = (F.col("_cn") - F.col("n")) / F.col("_N")
    # sup |F - G| is reached at a current value or just below it
    t = t.withColumn("_d", F.greatest(F.abs(F.col("f_le") - g_le), F.abs(F.col("f_lt") - g_lt)))
    out = t.groupBy("column", "period").agg(F.max("_d").alias("ks_statistic"), F.sum("n").alias("n_current"))
    return out.drop("column") if isinstance(column, str) else out
