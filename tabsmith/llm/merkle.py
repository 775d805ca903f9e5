"""Merkle manifest of a dataset: a tree per group of rows, a tree over the groups, and a proof for each row.

Rows are leaves; every ``FANOUT`` consecutive nodes of a group become the hash
of their digests (as hex text) until one node, the subroot, remains.  The
subroots, in group order, give the root the same way.

Proofs are made while the leaves stream by (``Appender``): a completed node
joins the open run of its level, takes the digests before it as its partial
witness, and extends the witnesses of the nodes already there; a full run
closes and its hash is appended to the level above.  Spark deals the leaves of
a group to aligned blocks of ``BLOCK`` (a power of the fan-out), so a block is
streamed alone; the block roots are the next round's leaves.  Then the
witnesses go down again: a block's rows extend their own by their block's.

Digests, not texts, are shuffled.  A hot group is cut into blocks like any
other; a task holds one block.

Edge cases: null fields hash as ``-``; rows of a group with equal keys are
ordered by leaf, a null key comes first; repeated rows are leaves of their own;
a null group is a group, and the first; an empty table has no tree; extra
columns, whatever their names, are passed through (those named like the
results are replaced).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import q
from tabsmith.llm.common import free_name
from tabsmith.operators.rows import position_in_group
from tabsmith.session import cut_lineage

FANOUT = 16
BLOCK = FANOUT ** 3
STEPS = "array<struct<place:int,others:string>>"
_STEPS = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field is ``-`` if null, else its length in UTF-8 bytes, ``:`` and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


class Node:
    """A completed subtree: its digest, and the witness of its place in the run (its siblings so far)."""
    __slots__ = ("digest", "place", "witness", "parent", "steps")

    def __init__(self, value: str):
        self.digest, self.place, self.witness, self.parent, self.steps = value, 0, [], None, None


class Appender:
    """Appends digests to a tree of ``levels`` levels; ``finish`` closes what is open and returns the top digest."""

    def __init__(self, levels: int):
        self.open = [[] for _ in range(levels)]
        self.top = None

    def append(self, value: str) -> Node:
        node = Node(value)
        self._join(0, node)
        return node

    def _join(self, level: int, node: Node) -> None:
        if level == len(self.open):
            self.top = node
            return
        run = self.open[level]
        node.place = len(run)
        for earlier in run:
            node.witness.append(earlier.digest)
            earlier.witness.append(node.digest)
        run.append(node)
        if len(run) == FANOUT:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        parent = Node(digest("".join(n.digest for n in run)))
        for n in run:
            n.parent = parent
        self._join(level + 1, parent)

    def finish(self) -> str:
        for level, run in enumerate(self.open):
            if run:
                self._close(level)
        return self.top.digest

    @staticmethod
    def steps(node: Node, outer: list) -> list:
        """(place, other digests of the run) from the node's level upwards; ``outer`` continues above the tree's top."""
        if node.parent is None:
            return outer
        if node.steps is None:
            node.steps = [(node.place, "".join(node.witness))] + Appender.steps(node.parent, outer)
        return node.steps


def fold(value: str, steps: list) -> str:
    """The root that a digest and its witness give."""
    for place, others in steps:
        value = digest(others[:64 * place] + value + others[64 * place:])
    return value


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes inside one block: up to their top, or to the block's root if there are more blocks."""
    levels, most = 0, 1
    while most < min(n, BLOCK):
        levels, most = levels + 1, most * FANOUT
    return levels


def _blocks(batches):
    """(header, rows) of each block: a block is a row with ``pos`` -1 and the block's rows after it."""
    header, parts = None, []
    for batch in batches:
        starts = np.flatnonzero(batch.column("pos").to_numpy(zero_copy_only=False) == -1).tolist()
        heads = set(starts)
        for a, b in zip([0, *starts], [*starts, batch.num_rows]):
            if a == b:
                continue
            if a in heads:
                if header is not None:
                    yield header, pa.Table.from_batches(parts)
                header, parts = batch.slice(a, 1).to_pylist()[0], []
                a += 1
            if b > a:
                parts.append(batch.slice(a, b - a))
    if header is not None:
        yield header, pa.Table.from_batches(parts)


def _streamed(nodes: DataFrame, headers: DataFrame) -> DataFrame:
    """Nodes (tree, pos, digest, ...) behind the header of their block, sorted, each block in one partition."""
    size = F.lit(BLOCK).cast("long")
    both = headers.withColumn("pos", F.lit(-1).cast("long")).unionByName(
        nodes.withColumn("block", ((F.col("pos") - F.pmod(F.col("pos"), size)) / size).cast("long")),
        allowMissingColumns=True)
    return both.repartition(F.col("tree"), F.col("block")).sortWithinPartitions("tree", "block", "pos")


def _up(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """Root of each block of nodes: (tree, pos of the block, digest, ``below``: number of nodes of the tree)."""
    def run(batches):
        for head, rows in _blocks(batches):
            tree = Appender(levels_of(head["n"]))
            for value in rows.column("digest").to_pylist():
                tree.append(value)
            yield pa.RecordBatch.from_pylist([{"tree": head["tree"], "pos": head["block"], "digest": tree.finish(),
                                               "below": head["n"]}], schema)
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("below", pa.int64())])
    headers = counts.select("tree", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("block"))
    return cut_lineage(_streamed(nodes.select("tree", "pos", "digest"), headers)
                       .mapInArrow(run, "tree string, pos long, digest string, below long"))


def _rounds(nodes: DataFrame, counts: DataFrame) -> list:
    """The nodes of each round, from the given ones to one node a tree."""
    most = counts.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    while True:
        out.append(_up(out[-1], counts))
        most = -(-most // BLOCK)
        if most <= 1:
            return out
        counts = counts.select("tree", F.ceil(F.col("n") / BLOCK).alias("n"))


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Witnesses of the nodes (tree, pos, digest, below) from those of their blocks (``above``: tree, pos, below, steps)."""
    def run(batches):
        for head, rows in _blocks(batches):
            tree = Appender(levels_of(head["n"]))
            seen = [tree.append(value) for value in rows.column("digest").to_pylist()]
            tree.finish()
            outer = [(s["place"], s["others"]) for s in head["steps"]]
            steps = [[{"place": a, "others": b} for a, b in tree.steps(node, outer)] for node in seen]
            part = rows.select(["tree", "pos", "digest", "below"]).append_column("steps", pa.array(steps, _STEPS))
            yield from part.combine_chunks().to_batches()
    headers = above.select("tree", F.col("pos").alias("block"), F.col("below").alias("n"), "steps")
    return cut_lineage(_streamed(nodes.select("tree", "pos", "digest", "below"), headers)
                       .mapInArrow(run, f"tree string, pos long, digest string, below long, steps {STEPS}"))


RESULTS = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def prove(rows: DataFrame, leaf_col: str, group_col: str, key_col: str, check_col: str | None = None,
          proofs: bool = False) -> DataFrame:
    """``rows`` with ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of the siblings' digests, joined, from the leaf
    upwards), ``folded_root`` (from the witness and the digest in ``check_col``, or where that is null the leaf) and
    ``verified`` (it equals the root); with ``proofs`` also ``proof``, the witness itself: per level the place in the
    run and the other digests.

    ``leaf_col`` holds digests; groups are ordered by UTF-8 bytes, rows of a group by ``key_col``, then leaf."""
    results = RESULTS + (["proof"] if proofs else [])
    kept = [c for c in rows.columns if c.lower() not in results]
    at = rows.select(F.col(q(group_col)).cast("string").alias("tree"), F.col(q(key_col)).alias("key"),
                     F.col(q(leaf_col)).alias("digest"),
                     (F.col(q(check_col)) if check_col else F.lit(None).cast("string")).alias("check"),
                     F.struct(*[F.col(q(c)) for c in kept], F.lit(0).alias(free_name("__one", rows))).alias("row"))
    leaves = cut_lineage(position_in_group(at, ["tree"], [F.col("key"), F.col("digest")], "pos")
                         .withColumn("pos", F.col("pos") - 1).drop("key"))
    counts = cut_lineage(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    trees = _rounds(leaves, counts)
    # the subroots are the leaves of one more tree
    tops = trees[-1].select(F.lit("").alias("all"), F.col("tree").alias("group"), "digest", "below")
    tops = cut_lineage(position_in_group(tops, ["all"], [F.col("group")], "pos").withColumn("pos", F.col("pos") - 1)
                       .withColumnRenamed("all", "tree"))
    forest = _rounds(tops, tops.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    root = forest[-1].select("digest").first()
    if root is None:
        trees, forest = trees[:2], forest[:2]
    above = forest[-1].select("tree", "pos", "digest", "below", F.array().cast(STEPS).alias("steps"))
    for nodes in forest[-2:0:-1]:
        above = _down(nodes, above)
    above = _down(tops, above)  # steps of the subroots, back under their groups
    above = above.join(tops.select(F.col("pos").alias("p"), "group"), F.col("pos") == F.col("p")) \
                 .select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("pos"), "digest", "below", "steps",
                         F.col("digest").alias("subroot"))
    for nodes in trees[-2:0:-1]:
        subroots = above.select(F.col("tree").alias("g"), "subroot").distinct() if len(trees) > 2 else None
        above = _down(nodes, above).join(subroots, F.col("tree").eqNullSafe(F.col("g"))).drop("g")
    whole = root[0] if root else ""

    def run(batches):
        for head, block in _blocks(batches):
            tree = Appender(levels_of(head["n"]))
            leaves_ = block.column("digest").to_pylist()
            seen = [tree.append(value) for value in leaves_]
            tree.finish()
            outer = [(s["place"], s["others"]) for s in head["steps"]]
            joined, folded, steps_ = [], [], []
            for node, check in zip(seen, block.column("check").to_pylist()):
                steps = tree.steps(node, outer)
                joined.append(digest("".join(others for _, others in steps)))
                folded.append(fold(node.digest if check is None else check, steps))
                if proofs:
                    steps_.append([{"place": a, "others": b} for a, b in steps])
            n = len(leaves_)
            out = {"row": block.column("row"), "leaf": block.column("digest"),
                   "subroot": pa.repeat(pa.scalar(head["subroot"], pa.string()), n),
                   "root": pa.repeat(pa.scalar(whole), n), "proof_sha256": pa.array(joined, pa.string()),
                   "folded_root": pa.array(folded, pa.string())}
            out["verified"] = pc.equal(out["folded_root"], out["root"])
            if proofs:
                out["proof"] = pa.array(steps_, _STEPS)
            yield from pa.table(out).combine_chunks().to_batches()

    headers = above.select("tree", F.col("pos").alias("block"), F.col("below").alias("n"), "steps", "subroot")
    texts = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType([T.StructField("row", leaves.schema["row"].dataType)] + [T.StructField(c, T.StringType()) for c in texts]
                          + [T.StructField("verified", T.BooleanType())])
    if proofs:
        schema = schema.add("proof", above.schema["steps"].dataType)
    out = _streamed(leaves.select("tree", "pos", "digest", "check", "row"), headers).mapInArrow(run, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *results)
