"""SMOTE oversampling as Spark joins.

Every class smaller than the largest one (and with more than k rows) gets
synthetic rows until it matches the majority count.  Each minority row is a
base for about the same number of synthetic rows (hash-ordered round robin);
for synthetic row j of base x a neighbour among x's k nearest same-class
rows and a step in [0, 1) are drawn from md5 buckets of (id, j), so the
output is deterministic and independent of partitioning:
``x + step * (neighbour - x)`` on every feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.core import HASH_SPACE, c, hash_bucket
from tabsmith.operators.neighbors import knn_join


def numbered_rows(df: DataFrame, name: str = "__rid") -> DataFrame:
    """``df`` with an id per row that depends on the data only: its values, and a number among equal rows."""
    from tabsmith.operators.rows import position_in_group
    values = F.to_json(F.struct(*[c(x) for x in df.columns]), {"ignoreNullFields": "false"})
    out = position_in_group(df.withColumn("__values", values), ["__values"], [], "__nth")
    return out.withColumn(name, F.concat_ws("#", "__values", F.col("__nth").cast("string"))).drop("__values", "__nth")


def smote(df: DataFrame, target: str, features: Sequence[str], id_col: str | None = None, k: int = 5,
          seed: int = 42, synthetic_flag: str = "is_synthetic") -> DataFrame:
    """Original rows plus synthetic minority rows (``is_synthetic`` true;
    the id column of synthetic rows is NULL)."""
    from tabsmith.operators.rows import position_in_group
    feats = list(features)
    idc = id_col or "__rid"
    # read by the counts, the neighbours, the draws and the result: made once
    from tabsmith.session import cut_lineage
    df = cut_lineage(df)
    base = df if id_col else cut_lineage(numbered_rows(df))
    cnt = base.groupBy(c(target).alias("__y")).agg(F.count(F.lit(1)).alias("__n"))
    mx = cnt.agg(F.max("__n").alias("__M"))
    need = cnt.crossJoin(mx).where((F.col("__n") < F.col("__M")) & (F.col("__n") > k))  # one row per class
    mino = base.join(need, base[target] == need["__y"]).drop("__y")
    vec = F.array(*[c(x).cast("double") for x in feats])
    nn = knn_join(mino.select(c(idc).alias("__id"), c(target).alias("__t"), vec.alias("__vec")),
                  "__id", "__vec", k=k, group_col="__t")
    # synthetic rows per base: (M - n) // n, plus one for the first (M - n) % n bases in hash order
    ranked = position_in_group(mino.withColumn("__hb", hash_bucket([idc], seed)), [target],
                               [F.col("__hb"), c(idc)], "__pos")
    extra = F.col("__M") - F.col("__n")
    q = (extra / F.col("__n")).cast("long") + F.when(F.col("__pos") <= extra % F.col("__n"), 1).otherwise(0)
    reps = ranked.withColumn("__q", q).where(F.col("__q") > 0) \
                 .withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__q") - 1)))
    key_j = [c(idc), F.col("__j").cast("string")]
    reps = reps.withColumn("__rank", (F.pmod(hash_bucket(key_j + [F.lit("nn")], seed), F.lit(k)) + 1).cast("int")) \
               .withColumn("__step", hash_bucket(key_j + [F.lit("step")], seed).cast("double") / F.lit(float(HASH_SPACE)))
    pick = reps.join(nn.select(F.col("__id").alias(idc), F.col("rank").alias("__rank"), "neighbor_id"),
                     [idc, "__rank"])
    nb = base.select(c(idc).alias("neighbor_id"), *[c(x).alias(f"__nb_{x}") for x in feats])
    syn = pick.join(nb, "neighbor_id")
    out_cols = [x for x in df.columns]
    synth = syn.select(*[
        (c(x).cast("double") + F.col("__step") * (F.col(f"__nb_{x}").cast("double") - c(x).cast("double"))).alias(x)
        if x in feats else (c(x) if x == target else F.lit(None).cast(df.schema[x].dataType).alias(x))
        for x in out_cols])
    orig = df.select(*[c(x).cast("double").alias(x) if x in feats else c(x) for x in out_cols])
    return orig.withColumn(synthetic_flag, F.lit(False)).unionByName(synth.withColumn(synthetic_flag, F.lit(True)))
