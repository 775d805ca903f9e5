"""Exact Shapley contributions of tree models.

Features that an order hasn't switched to the row's value yet hold the
background's (the mean of a slot; its most frequent value where the tree treats
it as a category).  Then a leaf is reached by a set of switched features exactly
if it holds those path features where only the row's value fits (a of them) and
none where only the background's does (b of them); so, over all orders, each of
the first gets ``(a-1)! b! / (a+b)!`` of the leaf's value and each of the second
``- a! (b-1)! / (a+b)!``.  Summed over the leaves this equals walking every
order of the features, without sampling any.

The paths of a model are a small table (its size is the model's); rows are
scored by it in Arrow batches, in one pass without a shuffle.  Text features are
explained by the sum of their one-hot slots.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.ml.models import Prepared, model_input


class Path:
    """A leaf: its value (a number, or one per class) and what its path asks of each slot."""

    def __init__(self, value, asks: dict):
        self.value, self.asks = np.asarray(value, float), asks

    def fits(self, slot: int, x):
        low, high, sets = self.asks[slot]
        ok = (x > low) & (x <= high)
        for inside, categories in sets:
            ok = ok & (np.isin(x, categories) == inside)
        return ok


def _walk(node, asks: dict, value_of, out: list) -> None:
    if node.getClass().getSimpleName() == "LeafNode":
        out.append(Path(value_of(node), asks))
        return
    split = node.split()
    slot = split.featureIndex()
    low, high, sets = asks.get(slot, (-math.inf, math.inf, ()))
    if split.getClass().getSimpleName() == "ContinuousSplit":
        t = split.threshold()
        left, right = (low, min(high, t), sets), (max(low, t), high, sets)
    else:
        categories = list(split.leftCategories())
        left, right = (low, high, (*sets, (True, categories))), (low, high, (*sets, (False, categories)))
    _walk(node.leftChild(), asks | {slot: left}, value_of, out)
    _walk(node.rightChild(), asks | {slot: right}, value_of, out)


def tree_paths(stage, task: str) -> list[Path]:
    """The paths of a fitted tree, forest or boosted model, whose values add up to its prediction: the value, the
    probability of each class, or for boosted classifiers the margin."""
    java = stage._java_obj
    kind = type(stage).__name__
    trees = list(java.trees()) if hasattr(stage, "trees") else [java]
    weights = list(java.treeWeights()) if hasattr(stage, "treeWeights") else [1.0]
    boosted = kind.startswith("GBT")

    def value_of(node):
        if task == "regression" or boosted:
            return node.prediction()
        stats = np.array(list(node.impurityStats().stats()), float)
        return stats / max(stats.sum(), 1e-300)
    out: list[Path] = []
    for tree, w in zip(trees, weights):
        paths: list[Path] = []
        _walk(tree.rootNode(), {}, value_of, paths)
        share = w if boosted else 1.0 / len(trees)
        out += [Path(p.value * share, p.asks) for p in paths]
    return out


def contributions(paths: list[Path], x: np.ndarray, background: np.ndarray, pick=None):
    """(per row and slot, base per row, prediction per row); ``pick``: the class to explain, per row."""
    n, slots = x.shape
    out, base, pred = np.zeros((n, slots)), np.zeros(n), np.zeros(n)
    fact = [math.factorial(k) for k in range(2 * 64)]
    share_in = np.zeros((65, 65))
    share_out = np.zeros((65, 65))
    for a in range(65):
        for b in range(65 - a):
            share_in[a, b] = fact[a - 1] * fact[b] / fact[a + b] if a else 0.0
            share_out[a, b] = -fact[a] * fact[b - 1] / fact[a + b] if b else 0.0
    for path in paths:
        value = path.value if path.value.ndim == 0 else path.value[pick]
        row_fits = {s: path.fits(s, x[:, s]) for s in path.asks}
        back_fits = {s: bool(path.fits(s, background[s])) for s in path.asks}
        reached = np.ones(n, bool)
        only_row, only_back = np.zeros(n, int), np.zeros(n, int)
        for s, ok in row_fits.items():
            if back_fits[s]:
                only_back += ~ok
            else:
                only_row += ok
                reached &= ok  # neither fits: no order reaches the leaf
        for s, ok in row_fits.items():
            if back_fits[s]:
                out[:, s] += np.where(reached & ~ok, share_out[only_row, only_back], 0.0) * value
            else:
                out[:, s] += np.where(reached, share_in[only_row, only_back], 0.0) * value
        pred += np.where(reached & (only_back == 0), value, 0.0)
        if all(back_fits.values()):
            base += value
    return out, base, pred


def _slots(prep: Prepared, scored: DataFrame) -> list[int]:
    """Number of the source feature (numeric ones, then text ones) of every slot."""
    out = list(range(len(prep.numeric)))
    for k, x in enumerate(prep.categorical):
        attr = scored.schema[f"__o_{x}"].metadata["ml_attr"]
        size = attr.get("num_attrs") or sum(len(v) for v in attr["attrs"].values())
        out += [len(prep.numeric) + k] * size
    return out


def explain_trees(model: PipelineModel, prep: Prepared, df: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """``df`` with ``contrib_{feature}`` of every feature, ``base_value`` and ``prediction``, which they add up to
    (the predicted value; for classifiers the probability of ``predicted_class``, for boosted ones the margin).

    ``background``: a frame of one row with the features' values to compare with, instead of the means over ``df``."""
    stage = model.stages[-1]
    paths = tree_paths(stage, prep.task)
    if max((len(p.asks) for p in paths), default=0) > 64:
        raise ValueError("paths with more than 64 different slots")
    names = [*prep.numeric, *prep.categorical]
    scored = model.transform(model_input(df, prep, None))
    source = np.array(_slots(prep, scored))
    if background is not None:
        base_row = model.transform(model_input(background, prep, None)).select("features").first()["features"].toArray()
    elif df.isEmpty():
        base_row = np.zeros(len(source))
    else:
        base_row = scored.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
        for s in {s for p in paths for s, ask in p.asks.items() if ask[2]}:
            base_row[s] = round(base_row[s])
    by_class = prep.task != "regression" and not type(stage).__name__.startswith("GBT")

    def run(batches):
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy()
            x = flat.reshape(batch.num_rows, len(source))
            pick = batch.column("cls").to_numpy().astype(int) if by_class else None
            slots, base, pred = contributions(paths, x, base_row, pick)
            features = [slots[:, source == k].sum(1) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("cls"), *map(pa.array, [*features, base, pred])],
                                             ["row", "predicted_class", *[f"f{k}" for k in range(len(names))], "base_value", "prediction"])
    base = scored.select(F.struct(*[F.col(f"`{x}`") for x in df.columns]).alias("row"), F.col("prediction").cast("double").alias("cls"),
                         vector_to_array("features").alias("x"))
    schema = T.StructType([base.schema["row"], T.StructField("predicted_class", T.DoubleType())]
                          + [T.StructField(x, T.DoubleType()) for x in [*[f"f{k}" for k in range(len(names))], "base_value", "prediction"]])
    out = base.mapInArrow(run, schema)
    cols = [F.col("row")[x].alias(x) for x in df.columns] + [F.col(f"f{k}").alias(f"contrib_{x}") for k, x in enumerate(names)]
    cols += [F.col("base_value"), F.col("prediction")]
    return out.select(*cols, *([F.col("predicted_class")] if prep.task != "regression" else []))
