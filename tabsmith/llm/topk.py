"""Exact top-k search by inner product with a paged M-tree.

With one more component, ``sqrt(M^2 - |x|^2)`` (M: the largest norm), the
largest inner products are the smallest Euclidean distances, a metric:

1. Index.  Vectors go to the nearest of a bounded sample of pivots (a crowded
   pivot is split by a hash of the id); each such shard becomes a tree of
   nodes, written as pages: a routing object, its covering radius, and for
   every entry its distance to that object (the parent distance).
2. Search.  A block of queries walks a shard's tree best-first: the node with
   the smallest bound of any query comes next.  Entries whose stored parent
   distance already puts them out of reach (triangle inequality) are skipped
   without a computation; nodes are skipped by their covering radius.  The
   first bound of a query is its k-th score within the sample, so that shards
   out of reach aren't even sent to it.
3. The k best of each shard are merged per query.

Scores are exact integers (doubles as long as they hold them exactly, else
Python integers), so pruning only has to be safe, which a small slack ensures.

Edge cases: vectors that are null or hold null or non-finite components take no
part; shorter vectors count as padded with zeros; an empty vector scores 0;
a query isn't compared with rows of its own id; equal query rows count once;
ties go to the smaller id; with fewer candidates than ``k`` all are returned;
an empty table gives an empty result.
"""

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.core import q
from tabsmith.session import cut_lineage

PIVOTS = 1_024        # at most so many shards' pivots, and so many vectors for the first bounds
SHARD_ROWS = 16_384   # vectors aimed at in a shard
PAGE_ROWS = 256       # entries of a leaf page
FAN = 12              # entries of an inner page
BLOCK_QUERIES = 512   # queries that walk a tree together
SLACK = 1e-6


class Space:
    """Dimension, largest squared norm, and how components are packed."""

    def __init__(self, dim: int, top: int, largest: int):
        self.dim, self.top = dim, top
        self.kind = next(t for t in (np.int16, np.int32, np.int64) if largest <= np.iinfo(t).max)
        self.plain = top < 2 ** 52  # all inner products are exact in doubles

    def pack(self, x) -> bytes:
        row = np.zeros(self.dim, self.kind)
        row[:len(x)] = x
        return row.tobytes()

    def unpack(self, rows) -> np.ndarray:
        return np.frombuffer(b"".join(rows), self.kind).reshape(-1, self.dim)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.plain:
            return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
        wide = a.astype(object) @ b.astype(object).T
        return np.clip(wide, -2 ** 63 + 1, 2 ** 63 - 1).astype(np.int64)

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that makes all norms equal."""
        x = x.astype(float)
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.top - (x * x).sum(1)))[:, None]])

    def reach(self, norms: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance within which a score of at least ``score`` lies (norms: squared, of the queries)."""
        wide = np.sqrt(np.maximum(0.0, norms + self.top - 2.0 * score))
        return wide + SLACK * (1 + math.sqrt(self.top) + np.sqrt(norms))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Positions of up to ``n`` routing objects, each farthest from those before."""
    chosen, near = [0], distances(x[:1], x)[0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x[chosen[-1:]], x)[0])
    return np.array(chosen)


def build(ids: np.ndarray, x: np.ndarray, lifted: np.ndarray):
    """Pages of one shard: (node, parent, centre, radius, parent distance, ids, vectors' positions, entries' distances)."""
    number, todo = itertools.count(), [(-1, np.arange(len(ids)), lifted[:1], 0.0)]
    while todo:
        parent, at, centre, up = todo.pop()
        node = next(number)
        to = distances(centre, lifted[at])[0]
        radius = float(to.max())
        if len(at) <= PAGE_ROWS:
            at = at[np.argsort(ids[at], kind="stable")]
            yield node, parent, centre[0], radius, up, at, distances(centre, lifted[at])[0]
            continue
        yield node, parent, centre[0], radius, up, at[:0], to[:0]
        some = at[:: max(1, len(at) // 512)]
        routing = some[far_apart(lifted[some], FAN)]
        if len(routing) > 1:
            side = distances(lifted[at], lifted[routing]).argmin(1)
            parts = [(at[side == k], lifted[routing[k]:routing[k] + 1]) for k in range(len(routing))]
        else:
            parts = [(at, centre)]
        for part, c in parts:
            if len(part) == len(at):  # equal vectors: pages by number
                todo += [(node, p, c, float(distances(centre, c)[0, 0])) for p in np.array_split(part, -(-len(part) // PAGE_ROWS))]
            elif len(part):
                todo.append((node, part, c, float(distances(centre, c)[0, 0])))


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.scores = np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros((n, k), bool)

    def bound(self) -> np.ndarray:
        """A score that the k-th of each query is known to reach."""
        own = np.where(self.full[:, -1], self.scores[:, -1].astype(float), -np.inf)
        return np.maximum(own, self.floor)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """Entries of a page (ids ascending) with their scores for some queries."""
        low = np.where(valid, scores, np.iinfo(np.int64).min)
        first = np.argsort(-low.astype(float) if low.size and np.abs(scores).max() < 2 ** 52 else ~low, axis=1, kind="stable")[:, :self.k]
        s = np.hstack([self.scores[rows], np.take_along_axis(low, first, 1)])
        i = np.hstack([self.ids[rows], ids[first]])
        f = np.hstack([self.full[rows], np.take_along_axis(valid, first, 1)])
        order = np.lexsort((i, ~s, ~f), axis=1)[:, :self.k]
        self.scores[rows], self.ids[rows], self.full[rows] = (np.take_along_axis(a, order, 1) for a in (s, i, f))


def search(nodes: dict, space: Space, query_ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """Best-first search of a block of queries in one shard's pages.

    ``nodes``: node -> (centre, radius, ids, vectors, entries' distances, children, their centres, radii, parent distances)."""
    wide = np.hstack([x.astype(float), np.zeros((len(x), 1))])
    norms = (wide * wide).sum(1)
    best, order = Best(len(x), k, floor), itertools.count()
    start = np.arange(len(x))
    heap = [(0.0, next(order), 0, start, distances(wide, nodes[0][0][None, :])[:, 0])]
    while heap:
        _, _, node, rows, to = heapq.heappop(heap)
        _, radius, ids, vectors, near, children, centres, radii, up = nodes[node]
        reach = space.reach(norms[rows], best.bound()[rows])
        open_ = to - radius <= reach
        rows, to, reach = rows[open_], to[open_], reach[open_]
        if not len(rows):
            continue
        if not children:
            may = np.abs(to[:, None] - near[None, :]) <= reach[:, None]
            rows_in, cols = may.any(1), may.any(0)
            if rows_in.any():
                r = rows[rows_in]
                s = space.scores(x[r], vectors[cols])
                valid = query_ids[r][:, None] != ids[cols][None, :]
                valid &= s >= best.bound()[r][:, None]
                hit = valid.any(1)
                if hit.any():
                    best.add(r[hit], s[hit], ids[cols], valid[hit])
            continue
        may = np.abs(to[:, None] - up[None, :]) - radii[None, :] <= reach[:, None]
        for c in np.flatnonzero(may.any(0)):
            r = rows[may[:, c]]
            d = distances(wide[r], centres[c:c + 1])[:, 0]
            low = d - radii[c]
            heapq.heappush(heap, (float(low.min()), next(order), children[c], r, d))
    return best


def load(table: pa.Table, space: Space) -> dict:
    """Pages of a shard as ``search`` takes them."""
    rows = table.to_pylist()
    below: dict = {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r)
    nodes = {}
    for r in rows:
        kids = below.get(r["node"], [])
        nodes[r["node"]] = (np.frombuffer(r["centre"]), r["radius"], np.array(r["ids"], np.int64), space.unpack([r["vectors"]]),
                            np.array(r["near"]), [c["node"] for c in kids],
                            np.frombuffer(b"".join(c["centre"] for c in kids)).reshape(len(kids), space.dim + 1),
                            np.array([c["radius"] for c in kids]), np.array([c["up"] for c in kids]))
    return nodes


PAGE = "shard long, node long, parent long, centre binary, radius double, up double, ids array<long>, vectors binary, near array<double>"


def scaled(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``id, x``: components turned into floor(scale * x); unfit vectors are left out."""
    v = df.select(F.col(q(id_col)).cast("long").alias("id"), F.col(q(vector_col)).cast("array<double>").alias("v"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fit).select(
        "id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("x"))


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id",
          vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows for which ``is_query`` (a condition on ``id``) holds."""
    spark = vectors.sparkSession
    base = cut_lineage(scaled(vectors, id_col, vector_col, scale))
    size = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    biggest = F.aggregate("x", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c.cast("double"))))
    n, dim, top, largest, n_queries = base.agg(
        F.count(F.lit(1)), F.max(F.size("x")), F.max(size), F.max(biggest), F.sum(is_query.cast("long"))).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space = Space(max(1, dim), int(math.ceil(top)), int(min(largest, 2 ** 63 - 1)))
    drawn = base.orderBy(F.xxhash64("id", "x"), "id").limit(PIVOTS).collect()
    sample_ids, sample = np.array([r["id"] for r in drawn]), space.unpack([space.pack(r["x"]) for r in drawn])
    pivots = space.lift(sample[:max(1, min(PIVOTS, -(-n // shard_rows)))])

    def assign(batches):
        for batch in batches:
            packed = [space.pack(v) for v in batch.column("x").to_pylist()]
            if packed:
                near = distances(space.lift(space.unpack(packed)), pivots).argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary()), pa.array(near)], ["id", "v", "pivot"])

    placed = cut_lineage(base.mapInArrow(assign, "id long, v binary, pivot long"))
    # one row per pivot: how many shards it needs
    counts = {r["pivot"]: r["count"] for r in placed.groupBy("pivot").count().collect()}
    first = dict(zip(counts, itertools.accumulate([0, *(-(-c // shard_rows) for c in counts.values())])))
    plan = spark.createDataFrame([(p, first[p], -(-c // shard_rows)) for p, c in counts.items()], "pivot long, first long, parts long")
    sharded = placed.join(F.broadcast(plan), "pivot").select(
        (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))).alias("shard"), "id", "v")

    def paged(key, table):
        ids, x = table.column("id").to_numpy(), space.unpack(table.column("v").to_pylist())
        rows = [(key[0].as_py(), node, parent, centre.tobytes(), radius, up, ids[at].tolist(), x[at].tobytes(), near.tolist())
                for node, parent, centre, radius, up, at, near in build(ids, x, space.lift(x))]
        names = [c.split()[0] for c in PAGE.split(", ")]
        return pa.table(dict(zip(names, map(list, zip(*rows)))), schema=PAGE_ARROW)

    pages = cut_lineage(sharded.groupBy("shard").applyInArrow(paged, PAGE))
    # one row per shard: its root's centre and radius
    roots = pages.filter("parent = -1").select("shard", "centre", "radius").orderBy("shard").collect()
    shard_ids, radii = np.array([r["shard"] for r in roots]), np.array([r["radius"] for r in roots])
    centres = np.frombuffer(b"".join(r["centre"] for r in roots)).reshape(len(roots), -1)
    blocks = max(1, -(-n_queries // block_queries))

    def routed(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            packed = batch.column("v").to_pylist()
            if not len(ids):
                continue
            x = space.unpack(packed)
            s = space.scores(x, sample).astype(float)
            s[ids[:, None] == sample_ids[None, :]] = -np.inf
            floor = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(ids), -np.inf)
            wide = np.hstack([x.astype(float), np.zeros((len(x), 1))])
            reach = space.reach((wide * wide).sum(1), floor)
            need = distances(wide, centres) - radii[None, :] <= reach[:, None]
            row, col = np.nonzero(need)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard_ids[col]), batch.column("block").take(pa.array(row)), pa.array(ids[row]),
                 pa.array(packed, pa.binary()).take(pa.array(row)), pa.array(floor[row])], ["shard", "block", "id", "v", "floor"])

    asked = (placed.filter(is_query).select("id", "v").distinct()
             .withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))))
    asked = cut_lineage(asked.mapInArrow(routed, "shard long, block long, id long, v binary, floor double"))
    pairs = asked.select(F.col("shard").alias("to"), F.col("block").alias("page_block")).distinct()
    sent = pages.join(pairs, F.col("shard") == F.col("to")).drop("shard")

    def walked(key, queries, table):
        if not queries.num_rows or not table.num_rows:
            return pa.table({"query_id": [], "v": [], "vec_id": [], "score": []}, schema=FOUND_ARROW)
        ids, packed = queries.column("id").to_numpy(), queries.column("v").to_pylist()
        best = search(load(table, space), space, ids, space.unpack(packed), queries.column("floor").to_numpy(), k)
        row, col = np.nonzero(best.full)
        return pa.table({"query_id": ids[row], "v": [packed[i] for i in row], "vec_id": best.ids[row, col],
                         "score": best.scores[row, col]}, schema=FOUND_ARROW)

    found = (asked.groupBy("shard", "block").cogroup(sent.groupBy("to", "page_block"))
             .applyInArrow(walked, "query_id long, v binary, vec_id long, score long"))
    ranked = Window.partitionBy("query_id", "v").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


PAGE_ARROW = pa.schema([("shard", pa.int64()), ("node", pa.int64()), ("parent", pa.int64()), ("centre", pa.binary()),
                        ("radius", pa.float64()), ("up", pa.float64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()),
                        ("near", pa.list_(pa.float64()))])
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("v", pa.binary()), ("vec_id", pa.int64()), ("score", pa.int64())])
