"""Chart queries (A11-A12, A22-A30) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions.core import round_doubles
from tabsmith.operators import charts as CH
from tabsmith.operators.relate import join_dimension
from tabsmith.plans.registry import register
from tabsmith.sources.tables import load, nan_as_null_cte


def _hist_sql(table: str, col: str, bins: int, by: str | None = None) -> str:
    k = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    grp = f"GROUP BY {by}" if by else ""
    edge = lambda i: f"(CASE WHEN {i} >= {bins} THEN hi ELSE lo + CAST({i} AS DOUBLE) * ((hi - lo) / {float(bins)}) END)"
    return f"""
WITH b AS (SELECT {k}CAST({col} AS DOUBLE) AS x FROM {table} WHERE {col} IS NOT NULL),
r0 AS (SELECT {k}min(x) AS lo0, max(x) AS hi0 FROM b {grp}),
r AS (SELECT {k}CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r0),
i0 AS (SELECT {k}x, lo, hi, least(greatest(CAST(floor((x - lo) * ({float(bins)} / (hi - lo))) AS INTEGER), 0), {bins - 1}) AS i FROM b JOIN r {on}),
i1 AS (SELECT {k}x, lo, hi, CASE WHEN x < {edge('i')} THEN i - 1 ELSE i END AS i FROM i0),
i2 AS (SELECT {k}CASE WHEN i < {bins - 1} AND x >= {edge('i + 1')} THEN i + 1 ELSE i END AS bin FROM i1),
cnt AS (SELECT {k}bin, count(*) AS n FROM i2 GROUP BY {k}bin),
allb AS (SELECT {k}lo, hi, CAST(g.range AS INTEGER) AS bin FROM r, range(0, {bins}) g)
SELECT {'allb.' + by + ', ' if by else ''}allb.bin AS bin, round(lo + CAST(allb.bin AS DOUBLE) * ((hi - lo) / {float(bins)}), 6) AS bin_start,
  round(CASE WHEN allb.bin = {bins - 1} THEN hi ELSE lo + CAST(allb.bin + 1 AS DOUBLE) * ((hi - lo) / {float(bins)}) END, 6) AS bin_end,
  CAST(round(lo + CAST(allb.bin AS DOUBLE) * ((hi - lo) / {float(bins)}), 2) AS VARCHAR) || ' - ' ||
  CAST(round(CASE WHEN allb.bin = {bins - 1} THEN hi ELSE lo + CAST(allb.bin + 1 AS DOUBLE) * ((hi - lo) / {float(bins)}) END, 2) AS VARCHAR) AS label,
  coalesce(n, 0) AS count
FROM allb LEFT JOIN cnt ON allb.bin = cnt.bin {'AND allb.' + by + ' = cnt.' + by if by else ''}"""


@register("chart_histogram", _hist_sql("events", "value", 10))
def q_chart_histogram(spark, sf):
    return round_doubles(CH.histogram(load(spark, sf, "events"), "value", 10))


@register("chart_histogram_hue", _hist_sql("events", "value", 10, "event_type"))
def q_chart_histogram_hue(spark, sf):
    return round_doubles(CH.histogram(load(spark, sf, "events"), "value", 10, ["event_type"]))


_PLAIN = nan_as_null_cte("nan_events", ("value", "segment"))


@register("chart_histogram_nan", _PLAIN + ", " + _hist_sql("plain", "value", 10).lstrip()[5:])
def q_chart_histogram_nan(spark, sf):
    """NaN is missing: it has no bin and doesn't widen the range."""
    return round_doubles(CH.histogram(load(spark, sf, "nan_events"), "value", 10))


@register("chart_mean_by_category", """
SELECT CAST(o_orderpriority AS VARCHAR) AS x, round(avg(o_totalprice), 6) AS y, round(-avg(o_totalprice), 6) AS sort_key
FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY o_orderpriority""")
def q_chart_mean_by_category(spark, sf):
    return round_doubles(CH.mean_by(load(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


@register("chart_mean_by_date", """
SELECT CAST(o_orderdate AS VARCHAR) AS x, round(avg(o_totalprice), 6) AS y, o_orderdate AS sort_key
FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY o_orderdate""")
def q_chart_mean_by_date(spark, sf):
    return round_doubles(CH.mean_by(load(spark, sf, "orders"), "o_orderdate", "o_totalprice"))


@register("chart_mean_by_number", """
SELECT CAST(l_linenumber AS VARCHAR) AS x, round(avg(l_quantity), 6) AS y, l_linenumber AS sort_key
FROM lineitem WHERE l_linenumber IS NOT NULL AND l_quantity IS NOT NULL GROUP BY l_linenumber""")
def q_chart_mean_by_number(spark, sf):
    return round_doubles(CH.mean_by(load(spark, sf, "lineitem"), "l_linenumber", "l_quantity"))


@register("chart_pie", """
WITH g AS (SELECT CAST(o_orderpriority AS VARCHAR) AS category, sum(o_totalprice) AS value FROM orders GROUP BY 1)
SELECT category, round(value, 2) AS value, round(value / (SELECT sum(value) FROM g) * 100, 6) AS percentage,
  (SELECT count(*) FROM g) <= 15 AS ok FROM g""")
def q_chart_pie(spark, sf):
    out = CH.pie(load(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return round_doubles(out.withColumn("value", F.round("value", 2)))


@register("chart_grouped", """
SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std,
  count(l_extendedprice) AS count,
  round(avg(l_extendedprice) - 1.96 * stddev_samp(l_extendedprice) / sqrt(CAST(count(l_extendedprice) AS DOUBLE)), 6) AS ci_low,
  round(avg(l_extendedprice) + 1.96 * stddev_samp(l_extendedprice) / sqrt(CAST(count(l_extendedprice) AS DOUBLE)), 6) AS ci_high
FROM lineitem GROUP BY 1, 2""")
def q_chart_grouped(spark, sf):
    return round_doubles(CH.grouped_stats(load(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", "l_linestatus"))


@register("chart_kde", """
WITH b AS (SELECT value AS x FROM events WHERE value IS NOT NULL),
s AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, stddev_samp(x) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h,
             (max(x) - min(x)) / 512.0 AS w FROM b),
fb AS (SELECT least(floor((x - lo) / w), 511) AS bb, count(*) AS nb, avg(x) AS cb FROM b, s GROUP BY 1),
p AS (SELECT g.range AS g, lo + CAST(g.range AS DOUBLE) * (hi - lo) / 99.0 AS gx, nb, cb, n, h FROM fb, s, range(0, 100) g)
SELECT CAST(g AS INTEGER) AS grid_index, round(min(gx), 6) AS x,
  round(sum(nb * exp(-0.5 * ((gx - cb) / h) * ((gx - cb) / h))) / (min(n) * min(h) * sqrt(2 * pi())), 6) AS density
FROM p GROUP BY g""")
def q_chart_kde(spark, sf):
    return round_doubles(CH.kde(load(spark, sf, "events"), "value", 100, 512))


def _boxplot_sql(table: str, y: str, by: str) -> str:
    return f"""q AS (SELECT {by}, count({y}) AS n, quantile_cont({y}, 0.25) AS q1,
             quantile_cont({y}, 0.5) AS median, quantile_cont({y}, 0.75) AS q3 FROM {table} GROUP BY 1),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS hf FROM q),
w AS (SELECT f.{by}, min(CASE WHEN {y} BETWEEN lf AND hf THEN {y} END) AS whisker_low,
             max(CASE WHEN {y} BETWEEN lf AND hf THEN {y} END) AS whisker_high,
             count(*) FILTER (WHERE NOT ({y} BETWEEN lf AND hf)) AS n_outliers
      FROM {table} l JOIN f ON l.{by} IS NOT DISTINCT FROM f.{by} WHERE {y} IS NOT NULL GROUP BY 1)
SELECT f.{by}, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
  round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high, n_outliers
FROM f JOIN w ON f.{by} IS NOT DISTINCT FROM w.{by}"""


@register("chart_boxplot_nan", _PLAIN + ", v AS (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind, value FROM plain), "
          + _boxplot_sql("v", "value", "kind"))
def q_chart_boxplot_nan(spark, sf):
    """Exact quartiles by selection with a third of the rows in the null group, nulls and NaN among the values."""
    df = load(spark, sf, "nan_events").select(F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("kind"), "value")
    return round_doubles(CH.boxplot(df, "value", "kind", exact=True))


@register("chart_boxplot", """
WITH q AS (SELECT l_returnflag, count(l_extendedprice) AS n, quantile_cont(l_extendedprice, 0.25) AS q1,
             quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS hf FROM q),
w AS (SELECT l.l_returnflag, min(CASE WHEN l_extendedprice BETWEEN lf AND hf THEN l_extendedprice END) AS whisker_low,
             max(CASE WHEN l_extendedprice BETWEEN lf AND hf THEN l_extendedprice END) AS whisker_high,
             count(*) FILTER (WHERE NOT (l_extendedprice BETWEEN lf AND hf)) AS n_outliers
      FROM lineitem l JOIN f USING (l_returnflag) WHERE l_extendedprice IS NOT NULL GROUP BY 1)
SELECT f.l_returnflag, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
  round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high, n_outliers FROM f JOIN w USING (l_returnflag)""")
def q_chart_boxplot(spark, sf):
    return round_doubles(CH.boxplot(load(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", exact=True))


@register("chart_heatmap", "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2")
def q_chart_heatmap(spark, sf):
    return CH.heatmap(load(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@register("chart_density_2d", """
WITH b AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
s AS (SELECT min(x) lx, max(x) hx, min(y) ly, max(y) hy FROM b)
SELECT CAST(coalesce(least(floor((x - lx) / ((hx - lx) / 20.0)), 19), 0) AS INTEGER) AS cell_x,
       CAST(coalesce(least(floor((y - ly) / ((hy - ly) / 20.0)), 19), 0) AS INTEGER) AS cell_y, count(*) AS count
FROM b, s GROUP BY 1, 2""")
def q_chart_density_2d(spark, sf):
    return CH.density_2d(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 20, 20)


@register("resample_daily", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY 1""")
def q_resample_daily(spark, sf):
    return round_doubles(CH.resample(load(spark, sf, "events"), "ts", "value", "day", "mean"))


@register("resample_weekly", """
SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS period, round(sum(value), 4) AS value, count(*) AS n FROM events GROUP BY 1""")
def q_resample_weekly(spark, sf):
    out = CH.resample(load(spark, sf, "events"), "ts", "value", "week", "sum")
    return out.withColumn("value", F.round("value", 4))


@register("resample_monthly", """
SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, round(avg(o_totalprice), 6) AS o_totalprice, count(*) AS n
FROM orders GROUP BY 1""")
def q_resample_monthly(spark, sf):
    return round_doubles(CH.resample(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month", "mean"))


@register("resample_daily_filled", """
WITH g AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS period, sum(o_totalprice) AS v, count(*) AS n
           FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
a AS (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS period FROM g)
SELECT a.period, round(g.v, 4) AS o_totalprice, coalesce(g.n, 0) AS n FROM a LEFT JOIN g USING (period)""")
def q_resample_daily_filled(spark, sf):
    df = load(spark, sf, "orders").where(F.col("o_orderstatus") == "P")
    out = CH.resample(df, "o_orderdate", "o_totalprice", "day", "sum", fill_gaps=True)
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


@register("total_per_group", """
SELECT c.c_mktsegment, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1""")
def q_total_per_group(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_totalprice")
    cu = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    j = join_dimension(o, cu, o["o_custkey"] == cu["c_custkey"])
    return CH.total_per_group(j, "c_mktsegment", "o_totalprice").withColumn("total", F.round("total", 2))


@register("stream_resample_daily", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY 1""")
def q_stream_resample_daily(spark, sf):
    """A29 on Structured Streaming: the events file read as a stream,
    watermarked event-time windows, processed with an available-now trigger."""
    from tabsmith.streaming.stream_ops import read_parquet_stream, run_available_now, windowed_resample
    schema = load(spark, sf, "events").schema
    st = read_parquet_stream(spark, f"{sf}/events*.parquet", schema)
    return round_doubles(run_available_now(windowed_resample(st, "ts", "value", "1 day", "1 day")))
