"""Row operators: filters, previews, sorts, top-k, deterministic sampling,
per-group latest rows, history truncation, Q/A assembly (P, L, W, U).

Spark has no row order, so every order-dependent operator takes explicit
ordering columns; ties must be broken by a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tabsmith.functions.core import HASH_SPACE, c, hash_bucket, numeric_columns, q, safe_div

try:  # Spark >= 3.4 raises these from pyspark.errors as well
    from pyspark.errors import ParseException
except ImportError:  # pragma: no cover
    from pyspark.sql.utils import ParseException


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [x if isinstance(x, Column) else c(x) for x in cols]


# ---------------------------------------------------------------------------
# P2 / P3 / P4 / P8 / P9 / P12 filters and scenarios
# ---------------------------------------------------------------------------

def focus_filter(df: DataFrame, condition: str | None) -> tuple[DataFrame, bool]:
    """Apply a boolean SQL condition; fall back to all rows when it does not
    parse or resolve.  Returns (frame, applied)."""
    if not condition:
        return df, False
    try:
        out = df.where(F.expr(condition))
        out.schema  # force analysis now, not at the first action  # noqa: B018
        return out, True
    except (AnalysisException, ParseException):
        return df, False


def focus_impact(df: DataFrame, condition: str, measure: str) -> DataFrame:
    """Rows before/after a focus condition and sum/mean of ``measure`` on both
    sides - a single aggregate (both variants in one scan)."""
    cond = F.coalesce(F.expr(condition), F.lit(False))
    x = c(measure).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(cond).alias("rows_after"),
        F.sum(x).alias("sum_before"), F.sum(F.when(cond, x)).alias("sum_after"),
        F.avg(x).alias("mean_before"), F.avg(F.when(cond, x)).alias("mean_after"),
    ).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def what_if(df: DataFrame, changes: Mapping[str, str], metric: str) -> DataFrame:
    """Apply hypothetical column changes (SQL expressions over the original
    columns) and report an aggregate ``metric`` (SQL aggregate expression)
    before, after and the delta: one aggregate for each variant, so two scans."""
    base = F.expr(metric)
    changed = df.withColumns({f"__new_{k}": F.expr(v) for k, v in changes.items()})
    # rewrite the metric over the changed columns by aliasing them back
    after_df = changed.select(*[c(x) for x in df.columns if x not in changes],
                              *[c(f"__new_{k}").alias(k) for k in changes])
    before = df.agg(base.cast("double").alias("before"))
    after = after_df.agg(F.expr(metric).cast("double").alias("after"))
    return (before.crossJoin(after)  # two one-row aggregates
            .withColumn("delta", F.col("after") - F.col("before"))
            .withColumn("delta_pct", safe_div(F.col("after") - F.col("before"), F.abs(F.col("before"))) * 100.0))


def text_search(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring match over several columns (OR)."""
    ql = F.lit(query.lower())
    cond = None
    for x in columns:
        term = F.coalesce(F.lower(c(x).cast("string")).contains(ql), F.lit(False))
        cond = term if cond is None else (cond | term)
    return df.where(cond)


def filter_page(df: DataFrame, filters: Mapping[str, object], order_by: Sequence[str],
                skip: int = 0, limit: int = 100) -> DataFrame:
    """Equality filters with skip/limit paging over an explicit order."""
    out = df
    for k, v in filters.items():
        out = out.where(c(k) == F.lit(v))
    return out.orderBy(*_order(order_by)).offset(skip).limit(limit)


def preview_iso(df: DataFrame) -> DataFrame:
    """Output normalisation: NaN -> NULL, timestamps as ISO-8601 text."""
    from pyspark.sql import types as T
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.nanvl(c(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(c(f.name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            out.append(F.date_format(c(f.name), "yyyy-MM-dd").alias(f.name))
        else:
            out.append(c(f.name))
    return df.select(*out)


# ---------------------------------------------------------------------------
# L1-L6 previews, sorts, top-k
# ---------------------------------------------------------------------------

def preview(df: DataFrame, order_by: Sequence[str], n: int = 100) -> DataFrame:
    """First min(n, rows) rows in key order plus total rows and columns.
    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps n rows."""
    head = df.orderBy(*_order(order_by)).limit(n)
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return head.crossJoin(total).withColumn("total_columns", F.lit(len(df.columns)))  # one-row side


def mini_preview(df: DataFrame, order_by: Sequence[str], n_cols: int = 4, n_rows: int = 4) -> DataFrame:
    return df.select(*[c(x) for x in df.columns[:n_cols]]).orderBy(*_order(order_by)).limit(n_rows)


def sort_latest(df: DataFrame, ts: str, key: str, descending: bool = True) -> DataFrame:
    if descending:
        return df.orderBy(c(ts).desc(), c(key).desc())
    return df.orderBy(c(ts).asc(), c(key).asc())


def sort_key(df: DataFrame, column: str) -> Column:
    """Generic sort key: nulls act as empty text; numbers compare as numbers."""
    from tabsmith.functions.core import is_numeric
    if is_numeric(df.schema[column].dataType):
        return c(column)
    return F.coalesce(c(column).cast("string"), F.lit(""))


def with_position(df: DataFrame, order_by: Sequence[Column], name: str = "position") -> DataFrame:
    """Global 1-based position in a total order, without a single-partition window.

    The range-partitioned sort leaves each partition a contiguous slice;
    ``monotonically_increasing_id`` numbers rows inside a partition in order.
    After a reliable checkpoint (deterministic from then on), a per-partition
    count table (one row per partition) gives each slice its offset.
    """
    from tabsmith.session import cut_lineage
    tagged = cut_lineage(df.sort(*order_by).withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    per = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))  # one row per partition
    out = tagged.join(F.broadcast(offs.select("_pid", "_off", "_m0")), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("bigint")) \
              .drop("_pid", "_mid", "_off", "_m0")


def position_in_group(df: DataFrame, group_cols: Sequence[str], order_by: Sequence[Column],
                      name: str = "position", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """1-based rank of each row inside its group, skew-safe.

    ``with_position`` numbers all rows in (group, order) order with a range
    partitioned sort, which cuts a hot group into many tasks; the first
    position of every group (one row per group, broadcast when their measured
    size is small) turns it into the in-group rank."""
    g = [c(x) for x in group_cols]
    pos = with_position(df, g + list(order_by), "__gpos")
    starts = pos.groupBy(*[x.alias(f"__g{i}") for i, x in enumerate(g)]).agg(F.min("__gpos").alias("__gstart"))
    size = starts.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.octet_length(F.col(f"__g{i}").cast("string"))).alias(f"b{i}")
                                                      for i in range(len(g))]).first()
    if size["n"] * 40 + sum(size[f"b{i}"] or 0 for i in range(len(g))) <= broadcast_bytes:
        starts = F.broadcast(starts)
    cond = None
    for i, x in enumerate(group_cols):
        e = pos[q(x)].eqNullSafe(starts[f"__g{i}"])  # null is a group too
        cond = e if cond is None else (cond & e)
    out = pos.join(starts, cond).drop(*[f"__g{i}" for i in range(len(g))])
    return out.withColumn(name, F.col("__gpos") - F.col("__gstart") + 1).drop("__gpos", "__gstart")


def sort_table(df: DataFrame, column: str, ascending: bool = True, tie_break: Sequence[str] = ()) -> DataFrame:
    """L4 single-column sort with the UI's null rule, plus the row position."""
    k = sort_key(df, column)
    k = k.asc_nulls_first() if ascending else k.desc_nulls_last()
    order = [k] + [c(x).asc() for x in tie_break]
    return with_position(df, order, "row_position")


def top_n(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent values (count desc, value asc)."""
    g = df.groupBy(c(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return g.orderBy(F.col("count").desc(), F.col("value").asc_nulls_first()).limit(n)


def sample_rows(df: DataFrame, order_by: Sequence[str], n: int = 10, cap: int = 100) -> DataFrame:
    """Bounded sample: 1 <= n <= cap rows in key order."""
    k = max(1, min(int(n), cap))
    return df.orderBy(*_order(order_by)).limit(k)


# ---------------------------------------------------------------------------
# L7-L9 deterministic sampling
# ---------------------------------------------------------------------------

def sample_fraction(df: DataFrame, fraction: float, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows whose md5 bucket falls under ``fraction`` of the hash space.
    Stable under repartitioning and task retries (no rand())."""
    if fraction >= 1.0:
        return df
    thr = int(fraction * HASH_SPACE)
    return df.where(hash_bucket(key_cols, seed) < F.lit(thr))


def sample_n(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows: the n smallest hash buckets (key breaks ties).
    TakeOrderedAndProject keeps n rows per task - bounded by n, not by data."""
    b = hash_bucket(key_cols, seed)
    return (df.withColumn("_b", b).orderBy(F.col("_b"), *[c(x) for x in key_cols]).limit(n).drop("_b"))


# Shares of a table taken for comparing and for tuning models.
STAGE_FRACTIONS = {"compare": 0.10, "tune": 0.30}


def sample_policy(df: DataFrame, key_cols: Sequence[str], stage: str = "compare", seed: int = 42,
                  fraction: float | None = None) -> tuple[DataFrame, float]:
    """The sample a stage of model selection works on: the caller's ``fraction``,
    or the stage's.  The size of the table decides nothing."""
    frac = STAGE_FRACTIONS[stage] if fraction is None else fraction
    return sample_fraction(df, frac, key_cols, seed), frac


def sample(df: DataFrame, key_cols: Sequence[str], n: int | None = None, fraction: float | None = None,
           seed: int = 42) -> DataFrame:
    """n overrides fraction; fraction 1.0 (or neither) keeps all rows."""
    if n is not None:
        return sample_n(df, n, key_cols, seed)
    if fraction is not None:
        return sample_fraction(df, fraction, key_cols, seed)
    return df


# ---------------------------------------------------------------------------
# W3-W7 per-group windows
# ---------------------------------------------------------------------------

def latest_k_per_group(df: DataFrame, group: str, ts: str, key: str, k: int = 10) -> DataFrame:
    """Newest k rows per group, numbered oldest first.

    ``row_number() <= k`` is planned with a map-side WindowGroupLimit: every
    task keeps at most k rows per group before the shuffle, so a hot group
    ships k rows per task instead of all of its rows."""
    w = Window.partitionBy(c(group)).orderBy(c(ts).desc(), c(key).desc())
    top = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    w2 = Window.partitionBy(c(group)).orderBy(c(ts).asc(), c(key).asc())
    return top.withColumn("position", F.row_number().over(w2).cast("bigint")).drop("_rn")


def latest_per_group(df: DataFrame, group: str, ts: str, key: str) -> DataFrame:
    """Latest row per group via ``max_by`` (an aggregate: partial per task, no sort)."""
    cols = [x for x in df.columns if x != group]
    st = F.struct(*[c(x) for x in cols])
    agg = df.groupBy(c(group).alias(group)).agg(F.max_by(st, F.struct(c(ts), c(key))).alias("_r"))
    return agg.select(group, *[F.col("_r").getField(x).alias(x) for x in cols])


def truncate_history(df: DataFrame, conv: str, turn: str, max_turns: int = 10, keep_head: int = 2) -> DataFrame:
    """Keep the first ``keep_head`` turns and the last ``2*max_turns`` turns of
    each conversation (all turns when it is not longer than that)."""
    # two top-k selections (each planned with a map-side WindowGroupLimit, so a
    # very long conversation ships only its first / last rows); they number the
    # rows by the same total order, turns that repeat included, and the tail
    # leaves out the ``keep_head`` rows that the head has
    order = [c(turn), *[c(x) for x in df.columns if x not in (conv, turn)]]
    w_up = Window.partitionBy(c(conv)).orderBy(*[x.asc_nulls_first() for x in order])
    w_dn = Window.partitionBy(c(conv)).orderBy(*[x.desc_nulls_last() for x in order])
    head = df.withColumn("_r", F.row_number().over(w_up)).where(F.col("_r") <= keep_head).drop("_r")
    tail = df.withColumn("_r", F.row_number().over(w_dn)).where(F.col("_r") <= 2 * max_turns)
    sizes = df.groupBy(c(conv).alias("_conv")).agg(F.count(F.lit(1)).alias("_n"))
    tail = tail.join(sizes, c(conv).eqNullSafe(F.col("_conv"))).where(F.col("_r") <= F.col("_n") - keep_head)
    return head.unionByName(tail.select(*[c(x) for x in df.columns]))


def assemble_qa_pairs(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                      text: str = "text", question_role: str = "user", answer_roles: Sequence[str] = ("assistant",),
                      sep: str = "\n", rows_per_chunk: int = 2_000_000) -> DataFrame:
    """Gaps-and-islands: each question row opens an island closed by the next
    question; answer rows of the island are joined in turn order.  Rows
    before the first question belong to no pair.  The island number is a
    running count of questions per conversation (``running_sum``: a very long
    conversation is cut into order ranges instead of one window partition);
    the answer text of an island is its own output value."""
    from tabsmith.operators.windows import running_sum
    isl = running_sum(df, F.when(c(role) == question_role, 1).otherwise(0), [conv], [turn], "_q",
                      rows_per_chunk=rows_per_chunk)
    isl = isl.where(F.col("_q") > 0)
    is_q = c(role) == question_role
    is_a = c(role).isin(list(answer_roles))
    g = isl.groupBy(c(conv).alias(conv), F.col("_q").cast("bigint").alias("pair_index")).agg(
        F.max_by(F.when(is_q, c(text)), F.when(is_q, c(turn))).alias("question"),
        F.min(F.when(is_q, c(turn))).alias("question_turn"),
        F.sort_array(F.collect_list(F.when(is_a, F.struct(c(turn).alias("t"), c(text).alias("x"))))).alias("_parts"),
    )
    return g.select(conv, "pair_index", "question_turn", "question",
                    F.array_join(F.transform("_parts", lambda s: s["x"]), sep).alias("answer"),
                    F.size("_parts").cast("bigint").alias("n_answer_parts"))


# ---------------------------------------------------------------------------
# U / P6 / P7 schema-level set operations
# ---------------------------------------------------------------------------

def schema_diff(left: DataFrame, right: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Columns only on one side / common to both (names, case-sensitive), as a table."""
    spark = left.sparkSession
    ex = set(drop)
    lcols = [(x, left.schema[x].dataType.simpleString()) for x in left.columns if x not in ex]
    rcols = [(x, right.schema[x].dataType.simpleString()) for x in right.columns if x not in ex]
    l_df = spark.createDataFrame(lcols, "column_name string, left_type string")
    r_df = spark.createDataFrame(rcols, "column_name string, right_type string")
    j = l_df.join(r_df, "column_name", "full_outer")
    side = (F.when(F.col("left_type").isNull(), F.lit("right_only"))
            .when(F.col("right_type").isNull(), F.lit("left_only")).otherwise(F.lit("both")))
    return j.withColumn("side", side)


def constant_columns(df: DataFrame) -> DataFrame:
    """Numeric: sample variance 0 or undefined; others: at most one distinct
    value counting null as a value (all null, or no null and min = max).
    One aggregate with fixed-size buffers (no distinct counting)."""
    from tabsmith.operators.profile import _stack
    num = set(numeric_columns(df))
    aggs = []
    per = []
    for i, x in enumerate(df.columns):
        if x in num:
            aggs.append(F.coalesce(F.var_samp(c(x).cast("double")), F.lit(0.0)).alias(f"v{i}"))
            aggs.append((F.coalesce(F.var_samp(c(x).cast("double")), F.lit(0.0)) == 0).alias(f"k{i}"))
            per.append(["true", f"v{i}", f"k{i}"])
        else:
            one = (F.count(c(x)) == 0) | ((F.count_if(c(x).isNull()) == 0) & (F.min(c(x)) == F.max(c(x))))
            aggs.append(F.lit(None).cast("double").alias(f"v{i}"))
            aggs.append(one.alias(f"k{i}"))
            per.append(["false", f"v{i}", f"k{i}"])
    return _stack(df.agg(*aggs), df.columns, per, ["is_numeric", "variance", "is_constant"])


def drop_constant_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Fit (one aggregate, bounded result) then drop."""
    flags = constant_columns(df).where("is_constant").select("column_name").collect()
    names = [r[0] for r in flags]
    return df.drop(*names), names
