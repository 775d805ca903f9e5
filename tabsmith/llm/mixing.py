"""Mixing sources to target weights.

Sizes are added up per source, each source gets a target and from it a
repetition rate ``target / size``; a document is then taken ``floor(rate)``
times, and once more with probability ``rate - floor(rate)``, decided by a hash
of its id, its text and a seed (no ``rand()``: reruns and retries agree).  The
hash has one seed per source: of ``SEEDS`` seeds, all tried in one aggregate over
the sizes, the one whose copies come nearest to the source's target.

Targets share the total by weight; a target stops at ``max_repeat`` times its
source's size and the excess is shared again by weight until none is above.
That is a fixed point of one number, the tokens per unit of weight of the
sources that aren't stopped: each round is one aggregate over the table of
sources, of which three sums reach the driver.

Edge cases: a null text has size 0; null is a source of its own, last in
order; a source of size 0 has target and rate 0; an empty table gives an empty
result; rows that are equal in id and text share one decision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.core import q
from tabsmith.llm.common import free_name, n_words
from tabsmith.operators.rows import with_position
from tabsmith.session import cut_lineage

# A table of sources up to this many bytes of names is broadcast.
BROADCAST_BYTES = 4 << 20
SEEDS = 16


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3,
                   source_col: str = "source", size_col: str = "size") -> DataFrame:
    """``source, source_size, target, rate`` for each source of ``sizes``.

    Sources in order of code points (null last) get ``weights``, repeated."""
    per = sizes.groupBy(F.col(q(source_col)).alias("source")).agg(
        F.sum(q(size_col)).cast("long").alias("source_size"))
    per = cut_lineage(per)
    placed = with_position(per, [F.col("source").asc_nulls_last()], "place")
    nth = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]),
                       (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = cut_lineage(placed.select("source", "source_size", nth.alias("weight"),
                                       (F.col("source_size") * max_repeat).alias("most")))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    rest, weight = total, None
    while True:
        # stopped: its share of what the others leave would be above its limit
        over = (F.lit(False) if weight is None else
                F.col("weight") * F.lit(rest).cast("decimal(38,0)") > F.col("most") * F.lit(weight).cast("decimal(38,0)"))
        row = placed.agg(F.sum(F.when(over, F.col("most"))).alias("stopped"),
                         F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        now = (total - (row["stopped"] or 0), row["weight"] or 0)
        if now == (rest, weight) or not now[1]:
            break
        rest, weight = now
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(weight or 1))
    target = F.least(F.col("most").cast("double"), share)
    return placed.select("source", "source_size", target.alias("target"),
                         F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def copies(rate, doc_id, digest, seed):
    """How often a document is taken at ``rate``; ``digest`` is the MD5 of its text, ``seed`` a column."""
    key = F.md5(F.concat_ws("\x1f", seed.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("\x00")), digest))
    u = F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    whole = F.floor(rate)
    return (whole + F.when(u < rate - whole, F.lit(1)).otherwise(F.lit(0))).cast("long")


def text_digest(text):
    return F.md5(F.coalesce(text, F.lit("")))


def with_seeds(sized: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """``targets`` with the ``seed`` of each source: of ``SEEDS`` from ``seed`` on, the one whose copies take nearest to
    the target (ties: the smallest).  ``sized``: ``id, digest, size, source`` of all documents."""
    d = with_rates(sized, targets)
    sums = [F.sum(copies(F.col("rate"), F.col("id"), F.col("digest"), F.lit(s)) * F.col("size")).alias(f"s{s}") for s in range(seed, seed + SEEDS)]
    per = d.groupBy("source").agg(F.first("target").alias("target"), *sums)
    near = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{s}") - F.col("target")).alias("gap"), F.lit(s).alias("seed"))
                                 for s in range(seed, seed + SEEDS)]))
    chosen = cut_lineage(per.select(F.col("source").alias("__of"), near["seed"].alias("seed")))
    return targets.join(chosen, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")


def with_rates(docs: DataFrame, targets: DataFrame, source_col: str = "source") -> DataFrame:
    """``docs`` with the columns ``source_size, target, rate`` of each row's source.

    The table of sources is broadcast only when its measured size is small;
    beyond that the join shuffles and AQE splits a hot source."""
    size = targets.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("source"), F.lit(0)))).first()
    name = free_name("__source", docs, targets)
    t = targets.withColumnRenamed("source", name)
    if size[0] * 40 + (size[1] or 0) <= BROADCAST_BYTES:
        t = F.broadcast(t)
    return docs.join(t, F.col(q(source_col)).eqNullSafe(F.col(name)), "left").drop(name)


def plan_mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, seed: int = 0,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: ``id, size, source_size, target, copies, taken, seed``."""
    sized, targets = _planned(docs, weights, max_repeat, seed, id_col, text_col, source_col)
    return (with_rates(sized, targets)
            .withColumn("copies", copies(F.col("rate"), F.col("id"), F.col("digest"), F.col("seed")))
            .select(F.col("id").alias(id_col), "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken"), "seed"))


def _planned(docs: DataFrame, weights, max_repeat: int, seed: int, id_col: str, text_col: str, source_col: str):
    """(id, source, size, digest) of all documents, stored: the texts are read once; and the sources' rates and seeds."""
    sized = cut_lineage(docs.select(F.col(q(id_col)).alias("id"), F.col(q(source_col)).alias("source"),
                                    n_words(F.col(q(text_col))).alias("size"), text_digest(F.col(q(text_col))).alias("digest")))
    targets = cut_lineage(source_targets(sized, weights, max_repeat))
    return sized, cut_lineage(with_seeds(sized, targets, seed))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, seed: int = 0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    _, targets = _planned(docs, weights, max_repeat, seed, id_col, text_col, source_col)
    rate, n, own = free_name("__rate", docs), free_name("__n", docs), free_name("__seed", docs)
    targets = targets.select("source", F.col("rate").alias(rate), F.col("seed").alias(own))
    return (with_rates(docs, targets, source_col)
            .withColumn(n, copies(F.col(rate), F.col(q(id_col)), text_digest(F.col(q(text_col))), F.col(own)))
            .filter(F.col(n) > 0)
            .withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
            .select(*[F.col(q(c)) for c in docs.columns]))
