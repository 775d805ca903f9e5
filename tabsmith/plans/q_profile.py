"""Profile queries (A1-A21, A31-A32, C16) and their DuckDB oracles."""

from __future__ import annotations

from tabsmith.functions.core import round_doubles
from tabsmith.operators import profile as P
from tabsmith.plans.registry import register
from tabsmith.plans.schemas import SCHEMAS, cols, dq, numeric_cols, sq, string_cols
from tabsmith.sources.tables import duckdb_view_cte, load, nan_as_null_cte


def _cte(table: str) -> str:
    return duckdb_view_cte(table) if table in ("dirty_events", "text_orders", "label_features") else ""


def _with(table: str, body: str) -> str:
    """Prefix the derived-view CTE (if any) to a query that starts with WITH."""
    pre = _cte(table)
    if not pre:
        return body
    assert body.lstrip().upper().startswith("WITH ")
    return pre + ", " + body.lstrip()[5:]


def _pctd(num: str, den: str) -> str:
    """round-free (num/den)*100 with 0 on empty, same order as the Spark side."""
    return f"coalesce((CAST({num} AS DOUBLE) / NULLIF({den}, 0)) * 100, 0.0)"


# ---------------------------------------------------------------------------
# A3 dataset_report (flagship)
# ---------------------------------------------------------------------------

def dataset_report_sql(table: str) -> str:
    sch = SCHEMAS[table]
    n = len(sch)
    aggs = ", ".join(f"count(*) FILTER (WHERE {dq(c)} IS NULL) AS m{i}, count(DISTINCT {dq(c)}) AS u{i}"
                     for i, (c, _) in enumerate(sch))
    tm = " + ".join(f"m{i}" for i in range(n))
    overall = _pctd(f"({tm})", f"(n * {n})")
    sel = []
    for i, (c, t) in enumerate(sch):
        sel.append(
            f"SELECT {sq(c)} AS feature_name, {sq(t)} AS dtype, round({_pctd(f'm{i}', 'n')}, 2) AS missing_percentage, "
            f"round({_pctd(f'u{i}', 'n')}, 2) AS unique_percentage, n AS total_records, "
            f"CAST({n} AS BIGINT) AS total_features, round({overall}, 2) AS overall_missing_percentage, "
            f"CASE WHEN n > 0 THEN round(100.0 - {overall}, 2) ELSE 0.0 END AS data_quality_score FROM a")
    return _with(table, f"WITH a AS (SELECT count(*) AS n, {aggs} FROM {table})\n" + "\nUNION ALL\n".join(sel))


@register("dataset_report", dataset_report_sql("lineitem"))
def q_dataset_report(spark, sf):
    return P.dataset_report(load(spark, sf, "lineitem"), exact=True)


@register("dataset_report_dirty", dataset_report_sql("dirty_events"))
def q_dataset_report_dirty(spark, sf):
    return P.dataset_report(load(spark, sf, "dirty_events"), exact=True)


# ---------------------------------------------------------------------------
# A1 / A2 describe
# ---------------------------------------------------------------------------

def describe_numeric_sql(table: str) -> str:
    nc = numeric_cols(table)
    parts = []
    for c in nc:
        x = f"CAST({dq(c)} AS DOUBLE)"
        parts.append(
            f"SELECT {sq(c)} AS column_name, count({x}) AS count, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50, "
            f"round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max FROM {table}")
    return _with(table, "WITH z AS (SELECT 1) " + "\nUNION ALL\n".join(parts))


@register("describe_numeric", describe_numeric_sql("lineitem"))
def q_describe_numeric(spark, sf):
    return round_doubles(P.describe_numeric(load(spark, sf, "lineitem"), exact=True))


def describe_categorical_sql(table: str) -> str:
    parts = []
    for c in string_cols(table):
        parts.append(
            f"SELECT {sq(c)} AS column_name, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, "
            f"arg_min(v, (-n, v)) AS top, max(n) AS freq FROM "
            f"(SELECT CAST({dq(c)} AS VARCHAR) AS v, count(*) AS n FROM {table} WHERE {dq(c)} IS NOT NULL GROUP BY 1)")
    return _with(table, "WITH z AS (SELECT 1) " + "\nUNION ALL\n".join(parts))


@register("describe_categorical", describe_categorical_sql("orders"))
def q_describe_categorical(spark, sf):
    return P.describe_categorical(load(spark, sf, "orders"))


# ---------------------------------------------------------------------------
# A5 / A6 / A7
# ---------------------------------------------------------------------------

def _unpivot_sql(table: str, columns: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {sq(c)} AS column_name, CAST({dq(c)} AS VARCHAR) AS value FROM {table}" for c in columns)


def value_counts_small_sql(table: str, max_unique: int = 20) -> str:
    u = _unpivot_sql(table, string_cols(table))
    return _with(table, f"""WITH u AS ({u}),
vc AS (SELECT column_name, value, count(*) AS count FROM u GROUP BY 1, 2),
pc AS (SELECT column_name, count(*) AS n_unique FROM vc WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) <= {max_unique})
SELECT vc.column_name, vc.value, vc.count, pc.n_unique FROM vc JOIN pc ON vc.column_name = pc.column_name""")


@register("value_counts_small", value_counts_small_sql("dirty_events"))
def q_value_counts_small(spark, sf):
    return P.value_counts_small(load(spark, sf, "dirty_events"), 20)


def missing_counts_sql(table: str) -> str:
    parts = [f"SELECT {sq(c)} AS column_name, CAST(count(*) FILTER (WHERE {dq(c)} IS NULL) AS BIGINT) AS missing_count FROM {table}"
             for c in cols(table)]
    return _with(table, "WITH z AS (SELECT 1) SELECT * FROM (" + "\nUNION ALL\n".join(parts)
                 + ") WHERE missing_count > 0")


@register("missing_counts", missing_counts_sql("dirty_events"))
def q_missing_counts(spark, sf):
    return P.missing_counts(load(spark, sf, "dirty_events"))


def column_info_sql(table: str) -> str:
    parts = [f"SELECT {sq(c)} AS column_name, {sq(t)} AS dtype, count({dq(c)}) AS non_null_count, "
             f"count(*) AS rows FROM {table}" for c, t in SCHEMAS[table]]
    return _with(table, "WITH z AS (SELECT 1) " + "\nUNION ALL\n".join(parts))


@register("data_context_info", column_info_sql("events"))
def q_data_context_info(spark, sf):
    return P.column_info(load(spark, sf, "events"))


# ---------------------------------------------------------------------------
# A8-A10 correlation
# ---------------------------------------------------------------------------

def corr_sql(table: str, nc: list[str] | None = None) -> str:
    nc = nc or numeric_cols(table)
    parts = []
    for i, a in enumerate(nc):
        for j, b in enumerate(nc):
            xa, xb = f"CAST({dq(a)} AS DOUBLE)", f"CAST({dq(b)} AS DOUBLE)"
            r = (f"coalesce(covar_pop({xa}, {xb}) / NULLIF(stddev_pop(CASE WHEN {xb} IS NOT NULL THEN {xa} END) * "
                 f"stddev_pop(CASE WHEN {xa} IS NOT NULL THEN {xb} END), 0), 0.0)")
            parts.append(f"SELECT {sq(a)} AS col_a, {sq(b)} AS col_b, {r} AS corr, {i} AS pos_a, {j} AS pos_b "
                         f"FROM {table}")
    return "\nUNION ALL\n".join(parts)


def _corr_oracle(table: str, outer: str) -> str:
    return _with(table, f"WITH cm AS ({corr_sql(table)})\n{outer}")


@register("corr_matrix", _corr_oracle(
    "lineitem", "SELECT col_a, col_b, round(corr, 6) AS corr, CAST(pos_a AS INTEGER) AS pos_a, "
                "CAST(pos_b AS INTEGER) AS pos_b FROM cm"))
def q_corr_matrix(spark, sf):
    return round_doubles(P.corr_matrix(load(spark, sf, "lineitem")))


@register("corr_matrix_nan", nan_as_null_cte("nan_events", ("value", "segment")) + ", cm AS ("
          + corr_sql("plain", ["event_id", "value", "segment", "user_num"]) + """)
SELECT col_a, col_b, round(corr, 6) AS corr, CAST(pos_a AS INTEGER) AS pos_a, CAST(pos_b AS INTEGER) AS pos_b FROM cm""")
def q_corr_matrix_nan(spark, sf):
    """NaN is missing, pair by pair."""
    return round_doubles(P.corr_matrix(load(spark, sf, "nan_events")))


@register("corr_extremes", _corr_oracle(
    "lineitem", "SELECT round(max(corr), 6) AS max_corr, round(min(corr), 6) AS min_corr, "
                "round(avg(corr), 6) AS avg_corr FROM cm WHERE pos_a <> pos_b"))
def q_corr_extremes(spark, sf):
    return round_doubles(P.corr_extremes(P.corr_matrix(load(spark, sf, "lineitem"))))


@register("corr_strong_pairs", _corr_oracle(
    "lineitem", """SELECT col_a, col_b, round(corr, 6) AS corr,
  CASE WHEN corr > 0.6 THEN 'strong_positive' WHEN corr < -0.6 THEN 'strong_negative' ELSE 'near_zero' END AS kind
FROM cm WHERE pos_a < pos_b AND (corr > 0.6 OR corr < -0.6 OR abs(corr) < 0.1)"""))
def q_corr_strong_pairs(spark, sf):
    return round_doubles(P.corr_strong_pairs(P.corr_matrix(load(spark, sf, "lineitem"))))


# ---------------------------------------------------------------------------
# A13-A19
# ---------------------------------------------------------------------------

@register("column_distribution_numeric", """
SELECT 'o_totalprice' AS column_name, count(*) AS total_count, count(o_totalprice) AS non_null_count,
  count(*) - count(o_totalprice) AS null_count, round(min(o_totalprice), 6) AS min,
  round(quantile_cont(o_totalprice, 0.25), 6) AS percentile_25,
  round(quantile_cont(o_totalprice, 0.5), 6) AS percentile_50_median,
  round(quantile_cont(o_totalprice, 0.75), 6) AS percentile_75, round(max(o_totalprice), 6) AS max,
  round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS stddev FROM orders""")
def q_column_distribution_numeric(spark, sf):
    return round_doubles(P.column_distribution_numeric(load(spark, sf, "orders"), "o_totalprice", exact=True))


@register("column_distribution_categorical", """
WITH vc AS (SELECT p_type AS value, count(*) AS count FROM part GROUP BY 1),
t AS (SELECT CAST(sum(count) AS BIGINT) AS total_count,
             CAST(coalesce(sum(CASE WHEN value IS NULL THEN count END), 0) AS BIGINT) AS null_count,
             count(value) AS distinct_count FROM vc),
r AS (SELECT value, count, row_number() OVER (ORDER BY count DESC, value ASC NULLS FIRST) AS rank
      FROM vc WHERE value IS NOT NULL)
SELECT 'p_type' AS column_name, rank, value, count, total_count, null_count,
       total_count - null_count AS non_null_count, distinct_count FROM r, t WHERE rank <= 20""")
def q_column_distribution_categorical(spark, sf):
    return P.column_distribution_categorical(load(spark, sf, "part"), "p_type", 20)


@register("column_distribution_other", """
SELECT 'o_orderdate' AS column_name, count(*) AS total_count, count(*) - count(o_orderdate) AS null_count,
       count(o_orderdate) AS non_null_count FROM orders""")
def q_column_distribution_other(spark, sf):
    return P.column_distribution_other(load(spark, sf, "orders"), "o_orderdate")


def profile_table_sql(table: str) -> str:
    parts = []
    for c, t in SCHEMAS[table]:
        x = dq(c)
        num = t in ("tinyint", "smallint", "int", "bigint", "float", "double")
        txt = t == "string"
        nd = "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT {sq(c)} AS column_name, {sq(t)} AS type, count(*) AS total_rows, "
            f"count(*) FILTER (WHERE {x} IS NULL) AS null_count, "
            f"round(coalesce(CAST(count(*) FILTER (WHERE {x} IS NULL) AS DOUBLE) / NULLIF(count(*), 0), 0.0), 6) AS null_rate, "
            f"count(DISTINCT {x}) AS distinct_count, "
            f"round({f'min(CAST({x} AS DOUBLE))' if num else nd}, 6) AS min, "
            f"round({f'max(CAST({x} AS DOUBLE))' if num else nd}, 6) AS max, "
            f"round({f'avg(CAST({x} AS DOUBLE))' if num else nd}, 6) AS mean, "
            f"round({f'stddev_pop(CAST({x} AS DOUBLE))' if num else nd}, 6) AS stddev, "
            f"round({f'avg(CAST(length({x}) AS DOUBLE))' if txt else nd}, 6) AS avg_length FROM {table}")
    return _with(table, "WITH z AS (SELECT 1) " + "\nUNION ALL\n".join(parts))


@register("profile_table", profile_table_sql("customer"))
def q_profile_table(spark, sf):
    return round_doubles(P.profile_table(load(spark, sf, "customer"), exact=True))


def variable_cards_sql(table: str) -> str:
    return _with(table, "WITH z AS (SELECT 1) " + _variable_cards_body(table))


def _variable_cards_body(table: str) -> str:
    parts = []
    for c, t in SCHEMAS[table]:
        x = dq(c)
        num = t in ("tinyint", "smallint", "int", "bigint", "float", "double")
        flt = t in ("float", "double")
        xd = f"CAST({x} AS DOUBLE)"
        nd, nl = "CAST(NULL AS DOUBLE)", "CAST(NULL AS BIGINT)"

        def p(e):
            return f"round(coalesce((CAST({e} AS DOUBLE) / NULLIF(count(*), 0)) * 100, 0.0), 1)"
        inf = (f"count(*) FILTER (WHERE abs({xd}) = 'inf'::DOUBLE)" if flt else ("CAST(0 AS BIGINT)" if num else nl))
        parts.append(
            f"SELECT {sq(c)} AS column_name, {sq(t)} AS type, {'true' if num else 'false'} AS is_numeric, "
            f"count(DISTINCT {x}) AS distinct, {p(f'count(DISTINCT {x})')} AS distinct_pct, "
            f"count(*) FILTER (WHERE {x} IS NULL) AS missing, {p(f'count(*) FILTER (WHERE {x} IS NULL)')} AS missing_pct, "
            f"{inf} AS infinite, {p(inf) if num else nd} AS infinite_pct, "
            f"round({f'avg({xd})' if num else nd}, 6) AS mean, round({f'min({xd})' if num else nd}, 6) AS min, "
            f"round({f'max({xd})' if num else nd}, 6) AS max, "
            f"{f'count(*) FILTER (WHERE {xd} = 0)' if num else nl} AS zeros, {p(f'count(*) FILTER (WHERE {xd} = 0)') if num else nd} AS zeros_pct, "
            f"{f'count(*) FILTER (WHERE {xd} < 0)' if num else nl} AS negative, "
            f"{p(f'count(*) FILTER (WHERE {xd} < 0)') if num else nd} AS negative_pct, "
            f"(count(DISTINCT {x}) = count(*) AND count(*) FILTER (WHERE {x} IS NULL) = 0) AS is_unique, count(*) AS rows "
            f"FROM {table}")
    return "\nUNION ALL\n".join(parts)


@register("variable_cards", variable_cards_sql("customer"))
def q_variable_cards(spark, sf):
    return round_doubles(P.variable_cards(load(spark, sf, "customer"), exact=True))


def dataset_overview_sql(table: str) -> str:
    sch = SCHEMAS[table]
    n = len(sch)
    miss = " + ".join(f"count(*) FILTER (WHERE {dq(c)} IS NULL)" for c, _ in sch)
    kinds = {"numeric": 0, "categorical": 0, "datetime": 0, "boolean": 0, "other": 0}
    for _, t in sch:
        if t == "boolean":
            kinds["boolean"] += 1
        elif t in ("tinyint", "smallint", "int", "bigint", "float", "double"):
            kinds["numeric"] += 1
        elif t in ("date", "timestamp", "timestamp_ntz"):
            kinds["datetime"] += 1
        elif t == "string":
            kinds["categorical"] += 1
        else:
            kinds["other"] += 1
    ks = ", ".join(f"CAST({v} AS BIGINT) AS n_{k}" for k, v in kinds.items())
    return _with(table, f"""WITH a AS (SELECT count(*) AS observations, CAST({miss} AS BIGINT) AS missing_cells FROM {table})
SELECT CAST({n} AS BIGINT) AS variables, observations, missing_cells,
  round({_pctd('missing_cells', f'(observations * {n})')}, 2) AS missing_cells_pct, {ks} FROM a""")


@register("dataset_overview", dataset_overview_sql("dirty_events"))
def q_dataset_overview(spark, sf):
    return P.dataset_overview(load(spark, sf, "dirty_events"))


def quality_alerts_sql(table: str) -> str:
    body = _variable_cards_body(table)
    pct = lambda e: f"CAST(round((CAST({e} AS DOUBLE) / NULLIF(rows, 0)) * 100, 1) AS VARCHAR)"
    return _with(table, f"""WITH cards AS ({body})
SELECT column_name, 'Missing' AS alert_type,
  'has ' || CAST(missing AS VARCHAR) || ' (' || {pct('missing')} || '%) missing values' AS message
FROM cards WHERE missing > 0
UNION ALL SELECT column_name, 'Unique', 'has unique values' FROM cards WHERE is_unique
UNION ALL SELECT column_name, 'Zeros', 'has ' || CAST(zeros AS VARCHAR) || ' (' || {pct('zeros')} || '%) zeros'
FROM cards WHERE zeros > 0""")


@register("quality_alerts", quality_alerts_sql("dirty_events"))
def q_quality_alerts(spark, sf):
    return P.quality_alerts(load(spark, sf, "dirty_events"), exact=True)


@register("duplicate_count", duckdb_view_cte("dirty_events") + """
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM dirty_events GROUP BY ALL_COLUMNS_PLACEHOLDER)""".replace(
    "ALL_COLUMNS_PLACEHOLDER", ", ".join(cols("dirty_events"))))
def q_duplicate_count(spark, sf):
    return P.duplicate_count(load(spark, sf, "dirty_events"))


def candidate_keys_sql(table: str) -> str:
    parts = [f"SELECT {sq(c)} AS column_name, count(DISTINCT {dq(c)}) AS distinct_count, "
             f"count(*) FILTER (WHERE {dq(c)} IS NULL) AS null_count, "
             f"(count(DISTINCT {dq(c)}) = count(*) AND count(*) FILTER (WHERE {dq(c)} IS NULL) = 0) AS is_candidate_key FROM {table}"
             for c in cols(table)]
    return _with(table, "WITH z AS (SELECT 1) " + "\nUNION ALL\n".join(parts))


@register("candidate_keys", candidate_keys_sql("orders"))
def q_candidate_keys(spark, sf):
    return P.candidate_keys(load(spark, sf, "orders"), exact=True)


@register("class_balance", """
SELECT quality AS class_value, count(*) AS count, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM labels), 6) AS share
FROM labels GROUP BY quality""")
def q_class_balance(spark, sf):
    return round_doubles(P.class_balance(load(spark, sf, "labels"), "quality"))


@register("top_category", """
WITH j AS (SELECT p.p_type AS category, l.l_extendedprice AS m FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
per AS (SELECT category, sum(m) AS total FROM j GROUP BY 1)
SELECT round((SELECT min(m) FROM j), 6) AS measure_min, round((SELECT max(m) FROM j), 6) AS measure_max,
  (SELECT count(*) FROM per) AS n_categories,
  (SELECT category FROM per ORDER BY total DESC, category LIMIT 1) AS top_category,
  round((SELECT max(total) FROM per), 6) AS top_total""")
def q_top_category(spark, sf):
    from tabsmith.operators.relate import join_dimension
    li = load(spark, sf, "lineitem").select("l_partkey", "l_extendedprice")
    part = load(spark, sf, "part").select("p_partkey", "p_type")
    j = join_dimension(li, part, li["l_partkey"] == part["p_partkey"])
    return round_doubles(P.top_category(j, "p_type", "l_extendedprice"))


@register("summary_facts", """
WITH dc AS (SELECT 'o_orderstatus' AS column_name, max(n) AS freq, sum(n) AS cnt FROM
              (SELECT o_orderstatus, count(*) n FROM orders GROUP BY 1)
            UNION ALL SELECT 'o_orderpriority', max(n), sum(n) FROM
              (SELECT o_orderpriority, count(*) n FROM orders GROUP BY 1))
SELECT column_name, 'dominant_share' AS fact, round(CAST(freq AS DOUBLE) / cnt, 6) AS value FROM dc
UNION ALL SELECT 'o_orderkey', 'minimum', round(min(CAST(o_orderkey AS DOUBLE)), 6) FROM orders
UNION ALL SELECT 'o_custkey', 'minimum', round(min(CAST(o_custkey AS DOUBLE)), 6) FROM orders
UNION ALL SELECT 'o_totalprice', 'minimum', round(min(o_totalprice), 6) FROM orders
UNION ALL SELECT 'o_orderkey', 'spread', round(stddev_samp(CAST(o_orderkey AS DOUBLE)) / avg(CAST(o_orderkey AS DOUBLE)), 6) FROM orders
UNION ALL SELECT 'o_custkey', 'spread', round(stddev_samp(CAST(o_custkey AS DOUBLE)) / avg(CAST(o_custkey AS DOUBLE)), 6) FROM orders
UNION ALL SELECT 'o_totalprice', 'spread', round(stddev_samp(o_totalprice) / avg(o_totalprice), 6) FROM orders""")
def q_summary_facts(spark, sf):
    return round_doubles(P.summary_facts(load(spark, sf, "orders")))


@register("typical_row", """
WITH m AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1),
d AS (SELECT CAST(o_orderdate AS VARCHAR) AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT round(avg(CAST(o_orderkey AS DOUBLE)), 6) AS o_orderkey, round(avg(CAST(o_custkey AS DOUBLE)), 6) AS o_custkey,
  (SELECT v FROM m ORDER BY n DESC, v LIMIT 1) AS o_orderstatus, round(avg(o_totalprice), 6) AS o_totalprice,
  (SELECT v FROM d ORDER BY n DESC, v LIMIT 1) AS o_orderdate,
  (SELECT v FROM p ORDER BY n DESC, v LIMIT 1) AS o_orderpriority FROM orders""")
def q_typical_row(spark, sf):
    return round_doubles(P.typical_row(load(spark, sf, "orders")))


@register("approx_distinct")
def q_approx_distinct(spark, sf):
    """A4: the default (scalable) report - HyperLogLog++ distinct counts, a
    fixed-size sketch per column.  Engines' sketches differ, so no SQL oracle;
    tests bound the error against the exact report."""
    return P.dataset_report(load(spark, sf, "lineitem"), exact=False)


# ---------------------------------------------------------------------------
# A3 / A4 / A16 from stored parts
# ---------------------------------------------------------------------------

_MERGED_NUM = ["event_id", "user_id", "value", "segment"]


def _merged_sql() -> str:
    """Counts, extremes, mean and std exactly; of the estimates, that they are inside their bounds."""
    num = [f"SELECT '{x}' AS column_name, count(*) AS total_rows, count(*) - count({x}) AS null_count, CAST(min({x}) AS DOUBLE) AS min, "
           f"CAST(max({x}) AS DOUBLE) AS max, round(avg({x}), 6) AS mean, round(stddev_pop({x}), 6) AS stddev, CAST(NULL AS DOUBLE) AS avg_length, "
           f"true AS distinct_in_bounds, true AS quantiles_in_bounds FROM dirty_events" for x in _MERGED_NUM]
    txt = ("SELECT 'event_type', count(*), count(*) - count(event_type), NULL, NULL, NULL, NULL, round(avg(length(event_type)), 6), true, NULL "
           "FROM dirty_events")
    return duckdb_view_cte("dirty_events") + " UNION ALL ".join([*num, txt])


@register("profile_merged", _merged_sql())
def q_profile_merged(spark, sf):
    """Profiles stored by day in two goes (half of the days is appended later) and merged; the estimates are held
    against exact counts of the table: distinct values within 5 %, ranks of the quantiles within 1.5 %."""
    import uuid

    from pyspark.sql import functions as F

    from tabsmith.operators import stored_profile as S
    from tabsmith.session import scratch_path
    cols = [*_MERGED_NUM, "event_type"]
    df = load(spark, sf, "dirty_events").select("ts", *cols)
    path = scratch_path(spark, f"profile-{uuid.uuid4().hex}")
    day, late = F.to_date("ts"), F.dayofmonth("ts") > 15
    S.store_parts(S.profile_parts(df.where(~late), day, cols), path)
    S.store_parts(S.profile_parts(df.where(late), day, cols), path)
    merged = S.merged_profile(S.read_parts(spark, path))
    found = {r["column_name"]: r for r in merged.collect()}  # one row per column
    aggs = []
    for x in cols:
        aggs.append((F.abs(F.count_distinct(x) - found[x]["distinct_count"]) <= 0.05 * F.count_distinct(x)).alias(f"d_{x}"))
        if x in _MERGED_NUM:
            near = [(F.count_if(F.col(x) < v) <= (f + 0.015) * F.count(x)) & (F.count_if(F.col(x) <= v) >= (f - 0.015) * F.count(x))
                    for f, v in zip((0.25, 0.5, 0.75), found[x]["q"])]
            aggs.append((near[0] & near[1] & near[2]).alias(f"q_{x}"))
    held = df.agg(*aggs).first()
    flags = spark.createDataFrame([(x, held[f"d_{x}"], held[f"q_{x}"] if x in _MERGED_NUM else None) for x in cols],
                                  "column_name string, distinct_in_bounds boolean, quantiles_in_bounds boolean")
    return round_doubles(merged.drop("type", "distinct_count", "q").join(flags, "column_name"))
