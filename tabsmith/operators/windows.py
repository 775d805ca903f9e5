"""Ordered-row window operators that stay distributed when one group is huge.

A plain ``Window.partitionBy(k).orderBy(o)`` sends every row of a key to one
task; a key holding a third of the table (or a window with no key at all)
would run in a single task.  When some key has more than ``rows_per_chunk``
rows, the table is sorted by (key, whole order, rest of the row) in ranges, and
each range is cut into chunks of that many rows.  The cuts go by rank, so text
order columns, nulls and tied order values are cut like any other, and the
window runs per (key, chunk):

* trailing frames get the last ``w-1`` rows before the chunk from a boundary
  table (the last ``w-1`` rows of each key in each chunk);
* back/forward fill use the first and last non-null value of each key in each
  chunk, carried over the chunks of the key;
* running sums add the totals of the key's earlier chunks.

Keys that are null are one key like any other.  Results are exact wherever the
cuts are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.core import c, q

_K = "__k"        # constant key used when no partition columns are given
_CH = "__chunk"   # number of the cut, ascending in key and order
_CARRY = "__carry"


def _join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys of which null is a value like any other; the keys come from ``left``."""
    r = right.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(keys)})
    on = [left[q(k)].eqNullSafe(r[f"__r{i}"]) for i, k in enumerate(keys)]
    return left.join(r, on, how).drop(*[f"__r{i}" for i in range(len(keys))])


def assign_chunks(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                  rows_per_chunk: int = 2_000_000) -> tuple[DataFrame, list[str], bool]:
    """Add a chunk column (0 if every key fits one task).

    Returns (frame, partition columns incl. key stand-in, chunked?).  One small
    count job looks for a hot key; when there is none nothing else happens.
    Otherwise the rows are sorted in ranges by (keys, order, hash of the row,
    row number): equal rows are cut too.  The sorted rows are stored, so every
    later step sees the same cuts."""
    from tabsmith.session import cut_lineage
    if not keys:
        df = df.withColumn(_K, F.lit(0))
        keys = [_K]
    keys = list(keys)
    counts = df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    st = counts.agg(F.max("__n").alias("most"), F.sum("__n").alias("rows")).first()
    if not st["most"] or st["most"] <= rows_per_chunk:
        return df.withColumn(_CH, F.lit(0)), keys, False
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = int(min(-(-st["rows"] // rows_per_chunk), max(shuffles, 2)))
    order = [c(x) for x in [*keys, *order_by]]
    order.append(F.xxhash64(*[c(x) for x, t in df.dtypes if not t.startswith(("map", "variant"))]))
    order.append(F.col("__row"))
    cut = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the low 33 bits of the new id count a range's rows, in order
    at = F.monotonically_increasing_id()
    cut = cut.drop("__row").withColumn("__at", at)
    place = F.col("__at").bitwiseAND((1 << 33) - 1)
    cut = cut.withColumn(_CH, F.col("__at") - place + F.floor(place / rows_per_chunk)).drop("__at")
    return cut_lineage(cut), keys, True


def _before(chunked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (key, chunk): rows of the key in it and in the chunks before it - a row per key and chunk."""
    sizes = chunked.groupBy(*[c(k) for k in keys], _CH).agg(F.count(F.lit(1)).alias("__size"))
    w = Window.partitionBy(*[c(k) for k in keys]).orderBy(_CH).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("__before", F.coalesce(F.sum("__size").over(w), F.lit(0)))


def _carried(base: DataFrame, keys: Sequence[str], order: list, back: int) -> DataFrame:
    """The last ``back`` rows of a key before each of its chunks, tagged with that chunk.

    Boundary table: the last ``back`` rows of each key in each chunk, numbered
    over the key; a row goes to the later chunks that begin at most ``back``
    rows after it (usually the next one)."""
    w = Window.partitionBy(*[c(k) for k in keys], _CH).orderBy(*[x.desc() for x in order])
    tails = base.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= back)
    before = _before(base, keys)
    tails = _join_keys(tails, before, [*keys, _CH], "inner")
    tails = tails.withColumn("__at", F.col("__before") + F.col("__size") - F.col("__rn")).drop("__before", "__size", "__rn")
    starts = before.groupBy(*[c(k) for k in keys]).agg(
        F.collect_list(F.struct(F.col(_CH).alias("ch"), F.col("__before").alias("at"))).alias("__starts"))
    out = _join_keys(tails, starts, keys, "inner")
    later = F.filter("__starts", lambda s: (s["ch"] > F.col(_CH)) & (s["at"] - F.col("__at") <= back))
    return out.withColumn(_CH, F.explode(F.transform(later, lambda s: s["ch"]))).drop("__starts", "__at")


def trailing_mean(df: DataFrame, value_cols: Sequence[str], keys: Sequence[str], order_by: Sequence[str],
                  window: int = 3, rows_per_chunk: int = 2_000_000, suffix: str = "",
                  chunks: tuple | None = None, keep_chunks: bool = False) -> DataFrame:
    """Mean over the current and ``window-1`` preceding rows (``min_periods=1``,
    nulls ignored) per key in ``order_by`` order.  Output column
    ``{col}{suffix}`` (replaces the column when ``suffix`` is empty).
    ``chunks``: a precomputed ``assign_chunks`` result to share between steps."""
    orig_cols = [x for x in df.columns if x not in (_K, _CH)]
    ch, pkeys, chunked = chunks if chunks is not None else assign_chunks(df, keys, order_by, rows_per_chunk)
    order = [c(o) for o in order_by]
    back = window - 1
    ch = ch.withColumn(_CARRY, F.lit(False))
    if chunked and back > 0:
        ch = ch.unionByName(_carried(ch, pkeys, order, back).withColumn(_CARRY, F.lit(True)))
    # the carried rows come before the chunk's own, also where order values are tied across the cut
    frame = Window.partitionBy(*[c(k) for k in pkeys], _CH).orderBy(F.col(_CARRY).desc(), *order).rowsBetween(-back, 0)
    out = ch.withColumns({f"{v}{suffix}": F.avg(c(v).cast("double")).over(frame) for v in value_cols})
    out = out.where(~F.col(_CARRY))
    keep = list(orig_cols) + [f"{v}{suffix}" for v in value_cols if suffix]
    if keep_chunks:
        keep += [x for x in (_K, _CH) if x in out.columns and x not in keep]
    return out.select(*[c(x) for x in keep])


def fill_bfill_ffill(df: DataFrame, value_cols: Sequence[str], keys: Sequence[str], order_by: Sequence[str],
                     rows_per_chunk: int = 2_000_000, chunks: tuple | None = None) -> DataFrame:
    """Back-fill (next non-null in order), then forward-fill (previous
    non-null), per key.  Exact across the chunks of hot keys."""
    orig_cols = [x for x in df.columns if x not in (_K, _CH)]
    ch, pkeys, chunked = chunks if chunks is not None else assign_chunks(df, keys, order_by, rows_per_chunk)
    ordc = [c(o) for o in order_by]
    part = [c(k) for k in pkeys] + [F.col(_CH)]
    # "first non-null at or after" = "last non-null so far" in reverse order: a growing
    # frame is evaluated incrementally, whereas an unbounded-following frame is
    # re-aggregated for every row (quadratic in the partition size)
    after = Window.partitionBy(*part).orderBy(*[x.desc() for x in ordc]).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy(*ordc).rowsBetween(Window.unboundedPreceding, 0)
    fills = {}
    for i, v in enumerate(value_cols):
        fills[f"__b{i}"] = F.last(c(v), ignorenulls=True).over(after)
        fills[f"__f{i}"] = F.last(c(v), ignorenulls=True).over(before)
    out = ch.withColumns(fills)
    if chunked:
        ordkey = F.struct(*ordc)
        ends = ch.groupBy(*[c(k) for k in pkeys], _CH).agg(
            *[F.min_by(c(v), F.when(c(v).isNotNull(), ordkey)).alias(f"__fst{i}") for i, v in enumerate(value_cols)],
            *[F.max_by(c(v), F.when(c(v).isNotNull(), ordkey)).alias(f"__lst{i}") for i, v in enumerate(value_cols)])
        kw = Window.partitionBy(*[c(k) for k in pkeys])
        nxt = kw.orderBy(F.col(_CH).desc()).rowsBetween(Window.unboundedPreceding, -1)
        prv = kw.orderBy(_CH).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*[c(k) for k in pkeys], _CH,
                           *[F.last(f"__fst{i}", ignorenulls=True).over(nxt).alias(f"__nb{i}") for i in range(len(value_cols))],
                           *[F.last(f"__lst{i}", ignorenulls=True).over(prv).alias(f"__pf{i}") for i in range(len(value_cols))])
        out = _join_keys(out, ends, [*pkeys, _CH], "left")
        for i in range(len(value_cols)):
            out = out.withColumn(f"__b{i}", F.coalesce(f"__b{i}", f"__nb{i}"))
            out = out.withColumn(f"__f{i}", F.coalesce(f"__f{i}", f"__pf{i}"))
    out = out.withColumns({v: F.coalesce(c(v), F.col(f"__b{i}"), F.col(f"__f{i}")) for i, v in enumerate(value_cols)})
    return out.select(*[c(x) for x in orig_cols])


def running_sum(df: DataFrame, value: Column | str, keys: Sequence[str], order_by: Sequence[str], name: str,
                rows_per_chunk: int = 2_000_000) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order_by`` order.

    With a hot key the sum inside a chunk is a window over (key, chunk), and
    the totals of the key's earlier chunks (one row each) are added."""
    v = c(value) if isinstance(value, str) else value
    base = df.withColumn("__val", v)
    orig_cols = [x for x in base.columns if x not in (_K, _CH)]
    ch, pkeys, chunked = assign_chunks(base, keys, order_by, rows_per_chunk)
    kc = [c(k) for k in pkeys]
    w = Window.partitionBy(*kc, _CH).orderBy(*[c(o) for o in order_by]).rowsBetween(Window.unboundedPreceding, 0)
    out = ch.withColumn(name, F.sum("__val").over(w))
    if chunked:
        tot = ch.groupBy(*kc, _CH).agg(F.sum("__val").alias("__t"))
        wb = Window.partitionBy(*kc).orderBy(_CH).rowsBetween(Window.unboundedPreceding, -1)
        off = tot.select(*kc, _CH, F.coalesce(F.sum("__t").over(wb), F.lit(0)).alias("__off"))
        out = _join_keys(out, off, [*pkeys, _CH], "left")
        out = out.withColumn(name, F.col(name) + F.col("__off"))
    return out.select(*[c(x) for x in orig_cols if x != "__val"], name)
