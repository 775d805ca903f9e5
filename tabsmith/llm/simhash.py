"""SimHash near-dedup with vantage-point trees.

Fingerprints: a bit of a text's 64-bit fingerprint is 1 if it is set in over
half of the XXH64 hashes (seed 42) of its word shingles, repeats included.

Links (at most ``max_bits`` differing bits) are found between *distinct*
fingerprints, so copies cost nothing:

1. The 64 bits are cut into ``m = max_bits // 2 + 1`` blocks; a linked pair
   differs in at most ``max_bits // m`` bits of one block at least.  Each block
   has a vantage-point tree whose distance counts the bits of that block, with
   that small radius, since a radius of four bits among 64 would visit most of
   a tree.
2. The top of each tree is fitted on a bounded sample (``sample_rows``).  Every
   fingerprint is routed down it: left if its distance from the vantage point
   is at most ``mu + radius``, right if it is above ``mu`` (the triangle bound:
   no link leaves both sides), so those on a boundary visit both shards.
3. A shard's task goes on with the tree in memory (vantage points are then the
   shard's own fingerprints; where a block can't divide them, all 64 bits and
   the full radius do), compares what is left exactly, and returns one link to
   a representative per fingerprint, never all pairs of a group.
4. Components of the links (``components.py``) give every document its group.

Nothing is capped: the sample only decides where shards are cut.

Edge cases: a null or empty text has fingerprint zero and links like any other;
a text with fewer words than a shingle is one shingle; null ids count in no
minimum (a group of null ids only has a null component); repeated rows stay
repeated rows; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import q
from tabsmith.llm.common import free_name, words_of
from tabsmith.llm.components import connected_components
from tabsmith.session import cut_lineage

SAMPLE_ROWS = 16_384     # fingerprints the tree tops are fitted on
SHARD_ROWS = 8_192       # fingerprints aimed at in a shard
BLOCK_ROWS = 192         # below this a shard's tree compares all with all
HASH_ROWS = 1 << 15      # shingle hashes counted at a time
HOT_SHARE = 1_000        # a fingerprint held by more than one in so many rows is hot, so there are at most that many
FULL = (1 << 64) - 1


# ---------------------------------------------------------------- fingerprints

def fingerprint(text, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of one text (A-Z lower-cased)."""
    words = words_of(text)
    if not words:
        return 0
    line = b" ".join(words).lower()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    n, votes, digest = len(starts), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, HASH_ROWS):
        pairs = zip(starts[at:at + HASH_ROWS].tolist(), ends[at:at + HASH_ROWS].tolist())
        h = np.array([digest(line[a:b], 42) for a, b in pairs], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * votes > n))


def with_fingerprint(docs: DataFrame, shingle: int = 4, text_col: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""
    @F.arrow_udf(T.LongType())
    def simhash(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x.as_py(), shingle) for x in text], np.uint64).view(np.int64))

    return docs.withColumn(name, simhash(F.col(q(text_col))))


# ---------------------------------------------------------- vantage-point trees

def distance(x: np.ndarray, point: int, mask: int) -> np.ndarray:
    """Differing bits within ``mask``."""
    return np.bitwise_count((x ^ np.uint64(point)) & np.uint64(mask))


def block_masks(max_bits: int) -> tuple[list[int], int]:
    """Masks of the bit blocks, and the radius within a block."""
    m = max_bits // 2 + 1
    cuts = [64 * k // m for k in range(m + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])], max_bits // m


def best_split(x: np.ndarray, metrics, tries: int = 4):
    """(vantage point, mask, radius, mu) whose larger side is smallest, or None if no split helps.

    ``metrics``: (mask, radius) in order of preference; the sides are
    ``d <= mu + radius`` and ``d > mu``."""
    for mask, radius in metrics:
        best, size = None, 0.9 * len(x)
        for at in np.linspace(0, len(x) - 1, tries).astype(int):
            count = np.bincount(distance(x, int(x[at]), mask), minlength=66 + radius)
            below = np.cumsum(count)
            larger = np.maximum(below[radius:], len(x) - below[:len(below) - radius])
            mu = int(np.argmin(larger))
            if larger[mu] < size:
                best, size = (int(x[at]), mask, radius, mu), larger[mu]
        if best:
            return best
    return None


def fit_tree(sample: np.ndarray, metrics, depth: int, leaves: list):
    """Tree top as nested tuples (vantage point, mask, radius, mu, left, right); a leaf is its number."""
    split = best_split(sample, metrics) if depth and len(sample) >= 32 else None
    if split is None:
        leaves.append(len(sample))
        return len(leaves) - 1
    point, mask, radius, mu = split
    d = distance(sample, point, mask)
    return (*split, fit_tree(sample[d <= mu + radius], metrics, depth - 1, leaves),
            fit_tree(sample[d > mu], metrics, depth - 1, leaves))


def route(x: np.ndarray, tree):
    """(leaf, positions in ``x``) for every leaf that members of ``x`` belong to or visit."""
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at
            continue
        point, mask, radius, mu, left, right = node
        d = distance(x[at], point, mask)
        todo += [(left, at[d <= mu + radius]), (right, at[d > mu])]


def link_all(x: np.ndarray, max_bits: int):
    """Spanning links of a set that no tree divides: breadth first, each fingerprint leaves the set when reached."""
    left = np.arange(len(x))
    while len(left):
        reached, left = [int(left[0])], left[1:]
        root = reached[0]
        while reached and len(left):
            near = distance(x[left], int(x[reached.pop()]), FULL) <= max_bits
            if near.any():
                hit, left = left[near], left[~near]
                yield np.full(len(hit), x[root]), x[hit]
                reached += hit.tolist()


def links(x: np.ndarray, metrics, max_bits: int):
    """Pairs of arrays of linked fingerprints that connect all that is linked within ``x``."""
    todo = [x]
    while todo:
        x = todo.pop()
        if len(x) <= BLOCK_ROWS:
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= max_bits
            yield from link_all(x[near.sum(1) > 1], max_bits)
            continue
        split = best_split(x, metrics)
        if split is None:
            yield from link_all(x, max_bits)
            continue
        point, mask, radius, mu = split
        d = distance(x, point, mask)
        todo += [x[d <= mu + radius], x[d > mu]]


class Groups:
    """Union-find over the fingerprints that have a link."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def shard_links(x: np.ndarray, metrics, max_bits: int) -> tuple[list[int], list[int]]:
    """(fingerprint, representative) for all that are linked within a shard."""
    groups = Groups()
    for a, b in links(np.unique(x), metrics, max_bits):
        for i, j in zip(a.tolist(), b.tolist()):
            groups.join(i, j)
    found = [(i, groups.root(i)) for i in groups.up]
    return [i for i, r in found if i != r], [r for i, r in found if i != r]


def near_links(fps: DataFrame, max_bits: int = 4, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints ``fp`` that connect all pairs of at most ``max_bits`` bits."""
    total = fps.count()
    # a slice of the hash range with about twice the sample, so that each task sends its share of it only
    bucket, share = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)), min(1.0, 2 * sample_rows / max(1, total))
    drawn = fps.select("fp", bucket.alias("bucket")).filter(F.col("bucket") < int(share * (1 << 30)) + 1)
    sample = np.array([r[0] for r in drawn.orderBy("bucket", "fp").limit(sample_rows).collect()], np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, total / shard_rows)))) + 1) if total > shard_rows else 0
    masks, radius = block_masks(max_bits)
    metrics = [[(mask, radius), (FULL, max_bits)] for mask in masks]
    trees = [fit_tree(sample, m, depth, []) for m in metrics]

    def routed(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, tree in enumerate(trees):
                for leaf, at in route(x, tree):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), leaf * len(trees) + k)), pa.array(x[at].view(np.int64))], ["shard", "fp"])

    def linked(key, table):
        x = table.column("fp").to_numpy().view(np.uint64)
        a, b = shard_links(x, metrics[key[0].as_py() % len(trees)], max_bits)
        return pa.table({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64)})

    return (fps.select("fp").mapInArrow(routed, "shard long, fp long")
            .groupBy("shard").applyInArrow(linked, "a long, b long"))


def with_class(own: DataFrame, classes: DataFrame) -> DataFrame:
    """``own`` with the column ``first`` of its fingerprint's class.

    Rows of a hot fingerprint take it from a broadcast of the hot classes (at
    most ``HOT_SHARE`` rows, as each holds more than that share of all rows),
    so no key of the shuffled join holds more than one row in ``HOT_SHARE``."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot, rest = F.col("n") * HOT_SHARE > total, classes.select("fp", "first")
    hot = F.broadcast(classes.filter(hot).select("fp", "first"))
    return own.join(hot, "fp").unionByName(own.join(hot.select("fp"), "fp", "left_anti").join(rest, "fp"))


def near_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                text_col: str = "text", row_key: bool = False) -> DataFrame:
    """``id, fp, component_id`` per document: the smallest id that links reach from it.

    With ``row_key``, also ``row_hash`` (of the text) and the struct ``first``:
    (id, hash) of the group's first document, by which callers pick one row."""
    i = F.col(q(id_col))
    own = cut_lineage(with_fingerprint(docs, shingle, text_col).select(
        i.alias("id"), F.xxhash64(F.col(q(text_col))).alias("row_hash"), "fp"))
    least = F.struct(F.col("id").isNull().alias("none"), "id", "row_hash")
    fps = cut_lineage(own.groupBy("fp").agg(F.min(least).alias("first"), F.count(F.lit(1)).alias("n")), own.count())
    total = fps.count()
    # a link for a fingerprint in the shard that it has in each block's tree, more at the shards' boundaries
    links = len(block_masks(max_bits)[0]) * total
    roots = cut_lineage(connected_components(near_links(fps, max_bits), links), 2 * total)
    linked = roots.join(fps, F.col("node") == F.col("fp")).select("fp", "root", "first")
    tops = linked.groupBy("root").agg(F.min("first").alias("top"))
    tops = linked.select("fp", "root").join(tops, "root").select("fp", "top")
    classes = cut_lineage(fps.join(tops, "fp", "left").select("fp", "n", F.coalesce("top", "first").alias("first")), total)
    out = with_class(own, classes)
    keep = [F.col("id").alias(id_col), "fp", F.col("first.id").alias("component_id")]
    return out.select(*keep, *(["row_hash", "first"] if row_key else []))


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row of each group of ``docs``: its first by id (nulls last), then by the hash of the text.

    The texts are shuffled once, by a hash of (id, hash of the text): rows that
    are dropped as repeats have it in common, so they already lie together."""
    found = near_groups(docs, shingle, max_bits, id_col, text_col, row_key=True)
    key, own, other_key, other_id, other = (free_name(x, docs) for x in ("__key", "__hash", "__first_key", "__first_id", "__first"))
    first = found.select(F.col("first.id").alias(other_id), F.col("first.row_hash").alias(other)).distinct()
    first = first.withColumn(other_key, F.xxhash64(other_id, other))
    d = docs.withColumn(own, F.xxhash64(F.col(q(text_col)))).withColumn(key, F.xxhash64(F.col(q(id_col)), F.col(own)))
    # the key alone deals the rows out, so the rest of the condition is no equality that the planner would shuffle by
    same = F.least(F.col(q(id_col)).eqNullSafe(F.col(other_id)).cast("int"), (F.col(own) == F.col(other)).cast("int"))
    mine = (F.col(key) == F.col(other_key)) & (same == 1)
    return d.join(first, mine, "left_semi").dropDuplicates([key, id_col, own]).drop(key, own)
