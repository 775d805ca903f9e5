"""Exact k-nearest-neighbour join (J5) with pivot pruning.

Brute force would pair every row with every row of its group.  Instead:

1. a deterministic hash sample of each group becomes the pivots (about one
   per ``cell_rows`` rows, at most ``max_pivots``);
2. every point measures its distance to the pivots of its group (rows x
   pivots, not rows x rows; in slices of about ``BLOCK`` rows) and joins the
   cell of its nearest pivot;
3. a group's rows, in the order of cell and distance to the pivot, are cut into
   blocks of ``BLOCK`` rows: a block holds rings of one large cell, or several
   small cells;
4. the k-th nearest row inside its own block bounds a query's k-th neighbour
   distance, so does d(q, pivot) + radius of a cell with more than k members
   (triangle inequality).  A ring of distances lo to hi around a pivot can't
   hold a neighbour if d(q, pivot) is above hi or below lo by more than the
   bound; a block of queries meets the blocks with a ring that survives for one
   of them;
5. ``CHUNK`` blocks of queries meet up to ``SLAB`` of these blocks in one group
   of rows, so vectors are not sent once for each pair of blocks.  A pair of
   blocks is one matrix product, which proposes; the distances of what it can't
   rule out are then summed exactly, and at most k rows of a query leave a group;
6. ``row_number() <= k`` (a map-side WindowGroupLimit) keeps k per query.

Exact for every input; how much is pruned depends on how clustered the
data are (in high dimensions pruning weakens and the join approaches the
brute-force pair count, in blocks of bounded size).  Ids identify rows.  Rows
without an id or a group, and vectors that are null or hold null or non-finite
values, take no part; vectors of different lengths aren't compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as arrow
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.core import HASH_SPACE, c, hash_bucket

BLOCK = 1000  # rows of a block
CHUNK = 4     # blocks of queries that meet others together
SLAB = 16     # blocks that a chunk meets at once


def euclidean(a: Column, b: Column) -> Column:
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, v: s + v))


def distances(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of every vector to every other, summed value by value (as ``euclidean``)."""
    total = np.zeros((len(vectors), len(others)))
    for i in range(others.shape[1]):
        step = vectors[:, i, None] - others[None, :, i]
        total += step * step
    return np.sqrt(total)


def nearest_of_block(ids: np.ndarray, vectors: np.ndarray, other_ids: np.ndarray, others: np.ndarray,
                     k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries, positions of their (at most k) nearest others and the distances; ties by id.
    With ``bound``, a distance for each query, only others up to there.

    The matrix product's squares are off by less than ``slack``; distances are summed value by value."""
    # numbers in the order of the ids, the same for equal ids
    number = np.unique(np.concatenate([ids, other_ids]), return_inverse=True)[1]
    own, other = number[:len(ids)], number[len(ids):]
    size = np.abs(vectors).max(initial=0.0) + np.abs(others).max(initial=0.0)
    with np.errstate(over="ignore"):
        slack = 64 * (vectors.shape[1] + 4) ** 2 * np.finfo(float).eps * size * size
    if np.isfinite(slack / np.finfo(float).eps):
        shift = others.mean(axis=0)
        a, b = vectors - shift, others - shift
        near = (-2.0 * a) @ b.T
        near += (a * a).sum(axis=1)[:, None]
        near += (b * b).sum(axis=1)[None, :]
        limit = np.full(len(ids), np.inf) if bound is None else bound * bound
        free = np.flatnonzero(~np.isfinite(limit))  # queries without a bound: the k nearest by the product, own row apart
        if len(free):
            most = min(k + 1, len(others))
            limit[free] = np.partition(near[free], most - 1, axis=1)[:, most - 1]
        at, to = np.nonzero(near <= (limit + 2 * slack)[:, None])
        apart = own[at] != other[to]
        at, to = at[apart], to[apart]
    else:  # squares that are too large for the product
        at, to = np.nonzero(own[:, None] != other[None, :])
    total = np.zeros(len(at))
    with np.errstate(over="ignore"):
        for i in range(vectors.shape[1]):
            step = vectors[at, i] - others[to, i]
            total += step * step
    distance = np.sqrt(total)
    order = np.lexsort((other[to], distance, at))
    at, to, distance = at[order], to[order], distance[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[first], to[first], distance[first]


def _matrix(column: arrow.ChunkedArray, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy().reshape(-1, width)


def _repeated(table: arrow.Table, names: list[str], n: int) -> dict[str, arrow.Array]:
    """The first row's values of ``names``, ``n`` times."""
    return {x: table[x].slice(0, 1).combine_chunks().take(arrow.array(np.zeros(n, np.int64))) for x in names}


def needed_blocks(to_pivot: np.ndarray, bound: np.ndarray, rings: dict[str, np.ndarray], k: int) -> np.ndarray:
    """Blocks that may hold one of the k nearest rows of a query.  ``to_pivot``: distances of the queries to the
    pivots; ``bound``: of their k-th neighbours; ``rings``: cell, block, lo, hi and rows of every ring."""
    cells, at = np.unique(rings["cell"], return_inverse=True)
    radius, members = np.full(len(cells), -np.inf), np.zeros(len(cells), np.int64)
    np.maximum.at(radius, at, rings["hi"])
    np.add.at(members, at, rings["rows"])
    full = members > k
    if full.any():
        bound = np.minimum(bound, (to_pivot[:, cells[full]] + radius[full]).min(axis=1))
    found = []
    for s in range(0, len(at), 1000):
        cell, lo, hi = (rings[x][s:s + 1000] for x in ("cell", "lo", "hi"))
        d = to_pivot[:, cell]
        reach = bound[:, None] + 1e-9 * (d + hi)  # what sums and roots may be off
        found.append(((d - hi <= reach) & (lo - d <= reach)).any(axis=0))
    return np.unique(rings["block"][np.concatenate(found)])


def knn_join(df: DataFrame, id_col: str, vec_col: str, k: int = 5, group_col: str | None = None,
             cell_rows: int = 2000, max_pivots: int = 64, seed: int = 42) -> DataFrame:
    """k nearest other rows of the same group for every row:
    (group, id, neighbor_id, rank, distance); ties by neighbour id."""
    from tabsmith.operators.rows import position_in_group
    from tabsmith.session import cut_lineage
    g = c(group_col) if group_col else F.lit(0)
    pts = df.select(g.alias("__own"), c(id_col).alias("__id"), c(vec_col).cast("array<double>").alias("__v"),
                    hash_bucket([id_col], seed).alias("__h"))
    pts = pts.where(F.col("__own").isNotNull() & F.col("__id").isNotNull() & (F.size("__v") > 0)
                    & F.forall("__v", lambda x: F.abs(x) < F.lit(float("inf"))))
    pts = pts.withColumn("__size", F.size("__v"))
    keys, block, chunk, slab = ["__own", "__size"], BLOCK, CHUNK, SLAB
    own_type, id_type = (pts.schema[x].dataType.simpleString() for x in ("__own", "__id"))
    keyed = f"__own {own_type}, __size int"
    cnt = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    n_piv = F.least(F.lit(max_pivots), F.greatest(F.lit(1), F.ceil(F.col("__n") / F.lit(float(cell_rows)))))
    thr = n_piv.cast("double") / F.col("__n") * F.lit(float(HASH_SPACE))
    sampled = pts.join(cnt, keys).where(F.col("__h") < thr).select(*keys, "__id", "__v")
    first = pts.groupBy(*keys).agg(F.min_by(F.struct("__id", "__v"), F.struct("__h", "__id")).alias("__s")) \
               .select(*keys, "__s.__id", "__s.__v")  # every group has a pivot
    piv = sampled.unionByName(first).dropDuplicates([*keys, "__id"])
    # the pivots of a group as one array (at most max_pivots entries per group)
    pivs = piv.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__id", "__v"))).alias("__P"))
    pivs = cut_lineage(pivs.select(*keys, F.flatten("__P.__v").alias("__pivots")))
    slices = cnt.select(*keys, F.ceil(F.col("__n") / block).alias("__slices"))
    sliced = pts.join(slices, keys).withColumn("__slice", F.pmod("__h", "__slices")).select(*keys, "__slice", "__id", "__v")
    each = pivs.join(slices, keys).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__slices") - 1)).alias("__slice"), "__pivots")

    def assign(points: arrow.Table, pivots: arrow.Table) -> arrow.Table:
        width = pivots["__size"][0].as_py()
        d = distances(_matrix(points["__v"], width), _matrix(pivots["__pivots"], width))
        cell = d.argmin(axis=1)
        return points.select([*keys, "__id", "__v"]).append_column("__cell", arrow.array(cell.astype(np.int32))) \
                     .append_column("__dc", arrow.array(d[np.arange(len(cell)), cell]))

    placed = sliced.groupBy(*keys, "__slice").cogroup(each.groupBy(*keys, "__slice")).applyInArrow(
        assign, f"{keyed}, __id {id_type}, __v array<double>, __cell int, __dc double")
    placed = position_in_group(placed, keys, [F.col("__cell"), F.col("__dc"), F.col("__id")], "__pos")
    placed = placed.withColumn("__b", F.floor((F.col("__pos") - 1) / block)).drop("__pos")

    def pack(table: arrow.Table) -> arrow.Table:
        ids, vectors = table["__id"].to_numpy(), _matrix(table["__v"], table["__size"][0].as_py())
        cell, dc = table["__cell"].to_numpy(), table["__dc"].to_numpy()
        at, _, distance = nearest_of_block(ids, vectors, ids, vectors, k)
        bound = np.full(len(ids), np.inf)
        last = np.arange(len(at)) - np.searchsorted(at, at) == k - 1
        bound[at[last]] = distance[last]
        cells = np.unique(cell)
        rings = [{"cell": int(x), "lo": float(dc[cell == x].min()), "hi": float(dc[cell == x].max()), "rows": int((cell == x).sum())} for x in cells]
        lists = {"__ids": table["__id"], "__vs": pc.list_flatten(table["__v"])}
        lists = {x: arrow.ListArray.from_arrays([0, len(v)], arrow.concat_arrays(v.chunks)) for x, v in lists.items()}
        return arrow.table(_repeated(table, [*keys, "__b"], 1) | lists | {"__tau": arrow.array([bound]), "__rings": arrow.array(
            [rings], arrow.list_(arrow.struct([("cell", arrow.int32()), ("lo", arrow.float64()), ("hi", arrow.float64()), ("rows", arrow.int64())])))})

    # one row for each block, with bounds of its rows and its rings
    packed = cut_lineage(placed.groupBy(*keys, "__b").applyInArrow(
        pack, f"{keyed}, __b bigint, __ids array<{id_type}>, __vs array<double>, __tau array<double>, "
              "__rings array<struct<cell: int, lo: double, hi: double, rows: bigint>>"))
    # a group's rings: at most max_pivots, and one more for each block
    rings = packed.select(*keys, "__b", F.inline("__rings")).groupBy(*keys).agg(
        *[F.collect_list(x).alias(f"__{x}") for x in ("cell", "lo", "hi", "rows")], F.collect_list("__b").alias("__block"))
    asked = packed.select(*keys, "__b", F.floor(F.col("__b") / chunk).alias("__chunk"), "__vs", "__tau") \
                  .join(pivs.join(rings, keys), keys)

    def wanted(table: arrow.Table) -> arrow.Table:
        width = table["__size"][0].as_py()
        pivots = _matrix(table["__pivots"].slice(0, 1), width)
        found = {x: pc.list_flatten(table[f"__{x}"].slice(0, 1)).to_numpy() for x in ("cell", "lo", "hi", "rows", "block")}
        of, to = [], []
        for r in range(table.num_rows):
            d = distances(_matrix(table["__vs"].slice(r, 1), width), pivots)
            blocks = needed_blocks(d, pc.list_flatten(table["__tau"].slice(r, 1)).to_numpy(), found, k)
            of.append(np.full(len(blocks), table["__b"][r].as_py()))
            to.append(blocks)
        of, to = np.concatenate(of), np.concatenate(to)
        part = np.unique(to, return_inverse=True)[1] // slab
        return arrow.table(_repeated(table, [*keys, "__chunk"], len(to)) | {"__slab": part, "__b": of, "__to": to})

    met = cut_lineage(asked.groupBy(*keys, "__chunk").applyInArrow(wanted, f"{keyed}, __chunk bigint, __slab bigint, __b bigint, __to bigint"))
    at = [*keys, "__chunk", "__slab"]
    queries = met.select(*at, "__b").distinct().join(packed, [*keys, "__b"]) \
                 .select(*at, "__b", F.lit(None).cast("array<bigint>").alias("__for"), "__ids", "__vs", "__tau")
    members = met.groupBy(*at, "__to").agg(F.collect_list("__b").alias("__for")).withColumnRenamed("__to", "__b") \
                 .join(packed, [*keys, "__b"]).select(*at, "__b", "__for", "__ids", "__vs", F.lit(None).cast("array<double>").alias("__tau"))

    def nearest(table: arrow.Table) -> arrow.Table:
        width = table["__size"][0].as_py()
        asking, members = {}, []
        for r in range(table.num_rows):
            ids, vectors = pc.list_flatten(table["__ids"].slice(r, 1)).combine_chunks(), _matrix(table["__vs"].slice(r, 1), width)
            ask = table["__for"][r].as_py()
            if ask is None:
                asking[table["__b"][r].as_py()] = (ids, vectors, pc.list_flatten(table["__tau"].slice(r, 1)).to_numpy(), [])
            else:
                members.append((ask, ids, vectors))
        for ask, other_ids, others in members:
            for b in ask:
                ids, vectors, bound, got = asking[b]
                at, to, distance = nearest_of_block(ids.to_numpy(zero_copy_only=False), vectors, other_ids.to_numpy(zero_copy_only=False), others, k, bound)
                got.append((at, other_ids.take(arrow.array(to)), distance))
        parts = []
        for ids, _, _, got in asking.values():
            at, distance = (np.concatenate([x[i] for x in got]) for i in (0, 2))
            others = arrow.concat_arrays([x[1] for x in got])
            order = np.lexsort((np.unique(others.to_numpy(zero_copy_only=False), return_inverse=True)[1], distance, at))
            order = order[np.arange(len(at)) - np.searchsorted(at[order], at[order]) < k]
            parts.append(arrow.table(_repeated(table, ["__own"], len(order)) | {
                "__q": ids.take(arrow.array(at[order])), "__x": others.take(arrow.array(order)), "distance": distance[order]}))
        return arrow.concat_tables(parts)

    d = queries.unionByName(members).groupBy(*at).applyInArrow(nearest, f"__own {own_type}, __q {id_type}, __x {id_type}, distance double")
    w = Window.partitionBy("__own", "__q").orderBy("distance", "__x")
    top = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = top.select(F.col("__own").alias(group_col or "__group"), F.col("__q").alias(id_col),
                     F.col("__x").alias("neighbor_id"), F.col("rank").cast("int").alias("rank"), "distance")
    return out.drop("__group") if not group_col else out


def knn_brute_force(df: DataFrame, id_col: str, vec_col: str, k: int = 5, group_col: str | None = None) -> DataFrame:
    """Reference implementation for tests on small fixtures (all pairs of a group)."""
    g = c(group_col) if group_col else F.lit(0)
    a = df.select(g.alias("__g"), c(id_col).alias("__q"), c(vec_col).cast("array<double>").alias("__vq"))
    b = df.select(g.alias("__g"), c(id_col).alias("__x"), c(vec_col).cast("array<double>").alias("__vx"))
    d = a.join(b, "__g").where(F.col("__q") != F.col("__x")) \
         .select("__g", "__q", "__x", euclidean(F.col("__vq"), F.col("__vx")).alias("distance"))
    w = Window.partitionBy("__g", "__q").orderBy("distance", "__x")
    top = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = top.select(F.col("__g").alias(group_col or "__group"), F.col("__q").alias(id_col),
                     F.col("__x").alias("neighbor_id"), F.col("rank").cast("int").alias("rank"), "distance")
    return out.drop("__group") if not group_col else out
