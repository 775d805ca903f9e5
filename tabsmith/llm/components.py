"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two group-and-join steps over the edges; the edges shrink to
stars, so a component's size or diameter never lands in one task, and nothing
but a count and a checksum of the edges reaches the driver.  Rounds are cut by
written tables in the shared folder, so a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.session import cut_lineage


def _star(edges: DataFrame, neighbours: DataFrame, larger: bool) -> DataFrame:
    low = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = neighbours.join(low, "u")
    if larger:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``edges`` (its first two columns); the
    root is the component's smallest node.  Self-links and nulls are ignored.
    ``rows``: about how many edges there are, if known (``cut_lineage``)."""
    a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    e, before = cut_lineage(e, rows), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(e, both, larger=True)
        e = cut_lineage(_star(large, large, larger=False), 2 * now[0])  # a round adds a link to a node's smallest at most
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
