"""Quality classifier by Bradley-Terry pairwise ranking.

A linear score over text features is learned from preference pairs (a good
text is preferred over a bad one) by logistic loss on the differences of their
features; the scores of the pairs' documents then give the cut: the quantile at
the share of bad labels is mapped to the probability ``cut``.

The model is fitted on every labelled row that isn't held out, and on all pairs
of a good and a bad one: the texts' features (15 numbers) are made in one pass
and stored with their labels, without a shuffle of texts; mean, deviation, cut
and each Newton step are aggregates over the stored table.  The loss of a pair
depends on the difference of two scores only, so its sums over all pairs follow
from sums over the rows of a grid of scores (``GRID`` steps at most), which
weigh a row on its two nearest grid points.  Scoring is one pass over the texts
without a shuffle.  Ids, languages, sources and labels are no inputs of a score.

Edge cases: a null text counts as empty and gets a score like any other; null
labels or ids are not learned from; of repeated labels for an id the largest
counts; without two classes to learn from every score is the constant 0.5;
very long texts are read whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import q
from tabsmith.llm.common import words_of
from tabsmith.llm.repetition import covered, repeats, rolling_hashes
from tabsmith.operators.quantiles import exact_quantiles
from tabsmith.session import cut_lineage, files_for

GRID = 4_096           # most steps of the grid of scores (either sign),
STEP = 1 / 32          # and the width of a step where they suffice
RIDGE = 1e-3
STEPS = 30             # most Newton steps
FEATURES = ["log_words", "mean_word", "upper", "shouted", "symbols", "digits", "bars", "bangs", "stops", "distinct",
            "adjacent", "repeat_5", "dup_lines", "short_lines", "top_word"]
_SYMBOLS = list(b"#*$%&<>@^~_=+\\")


def features(text) -> list:
    """The features of one text; shares lie in 0..1."""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(b" ".join(words), np.uint8), minlength=256)
    size = int(count.sum())
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    shout = np.fromiter((w.isupper() and len(w) > 1 for w in known), bool, len(known))
    per_word = np.bincount(ids)
    repeat = 0.0
    for k, h in rolling_hashes(ids, (5,)).items():
        _, later = repeats(ids, h, k)
        repeat = float(covered(later, k, n).mean()) if len(later) else 0.0
    lines = [x for x in text.split("\n") if x]
    return [
        float(np.log1p(n)), min(size / n, 30.0) / 30, float(count[65:91].sum()) / size, float(shout[ids].mean()),
        float(count[_SYMBOLS].sum()) / size, float(count[48:58].sum()) / size, float(count[124]) / size,
        float(count[33]) / size, float(count[46] + count[44]) / n, len(known) / n,
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, repeat, 1 - len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)), float(per_word.max()) / n,
    ]


def standard(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / sd, -8, 8)


def grid_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Slots (twice the grid point, one more for good rows) and per slot the sums of 1, z and the products of z's
    numbers (upper triangle), each row shared between the two grid points around its score."""
    i, j = np.triu_indices(z.shape[1])
    rows = np.hstack([np.ones((len(z), 1)), z, z[:, i] * z[:, j]])
    at = z @ w / step
    low = np.floor(at)
    share = (at - low)[:, None]
    slot = np.concatenate([low, low + 1]).astype(np.int64) * 2 + np.concatenate([y, y])
    rows = np.vstack([rows * (1 - share), rows * share])
    slots, place = np.unique(slot, return_inverse=True)
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(len(slots)))
    return slots, np.add.reduceat(rows[order], starts, axis=0)


def pair_sums(slots: np.ndarray, sums: np.ndarray, step: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the mean over all pairs of log(1 + exp(bad score - good score)), from ``grid_sums``."""
    i, j = np.triu_indices(size)
    good, bad = slots % 2 == 1, slots % 2 == 0
    g, b = sums[good], sums[bad]
    at_g, at_b = (slots[good] // 2) * step, (slots[bad] // 2) * step
    n_g, n_b = g[:, 0], b[:, 0]
    pull_g, bend_g = np.zeros(len(g)), np.zeros(len(g))
    pull_b, bend_b, cross = np.zeros(len(b)), np.zeros(len(b)), np.zeros((size, size))
    for k in range(0, len(g), 256):  # bounded: 256 grid points against all
        part = slice(k, k + 256)
        p = 1 / (1 + np.exp(np.clip(at_g[part, None] - at_b[None, :], -30, 30)))
        bend = p * (1 - p)
        pull_g[part], bend_g[part] = p @ n_b, bend @ n_b
        pull_b += n_g[part] @ p
        bend_b += n_g[part] @ bend
        cross += g[part, 1:size + 1].T @ bend @ b[:, 1:size + 1]
    pairs = n_g.sum() * n_b.sum()
    grad = (pull_b @ b[:, 1:size + 1] - pull_g @ g[:, 1:size + 1]) / pairs
    own = np.zeros((size, size))
    own[i, j] = bend_g @ g[:, size + 1:] + bend_b @ b[:, size + 1:]
    own = own + np.triu(own, 1).T
    return grad, (own - cross - cross.T) / pairs


def summed_on_grid(rows: DataFrame, mean: np.ndarray, sd: np.ndarray, w: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """``grid_sums`` of all ``rows``: partial sums per task, added up by slot.

    The slots that reach the driver are bounded by the grid, whatever the number of rows."""
    def partial(batches):
        kept: dict = {}
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(w))
                for k, m in zip(*grid_sums(standard(x, mean, sd), batch.column("y").to_numpy().astype(np.int64), w, step)):
                    kept[k] = kept[k] + m if k in kept else m
        yield from as_batch(kept)

    def added(batches):
        kept: dict = {}
        for batch in batches:
            m = batch.column("m").flatten().to_numpy().reshape(batch.num_rows, -1)
            for k, row in zip(batch.column("slot").to_pylist(), m):
                kept[k] = kept[k] + row if k in kept else row
        yield from as_batch(kept)

    def as_batch(kept):
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array([m.tolist() for m in kept.values()], pa.list_(pa.float64()))],
                                             ["slot", "m"])

    # no more tasks than cores, as the slots are few; a task's partial rows come in any order: sorted, so that reruns add them up alike
    parts = rows.mapInArrow(partial, "slot long, m array<double>").repartition("slot")
    parts = parts.coalesce(files_for(rows.sparkSession, 0)).sortWithinPartitions("slot", "m")
    found = sorted(parts.mapInArrow(added, "slot long, m array<double>").collect())
    return np.array([r["slot"] for r in found], np.int64), np.array([r["m"] for r in found], float)


def fit_pairs(rows: DataFrame, mean: np.ndarray, sd: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Bradley-Terry weights: Newton steps on the mean of log(1 + exp(-w . (good - bad))) over all pairs + ridge |w|^2 / 2."""
    size = len(mean)
    w = np.zeros(size)
    for _ in range(STEPS):
        step = max(STEP, 8 * np.abs(w).sum() / GRID)  # scores lie within 8 times the sum of the weights
        grad, hess = pair_sums(*summed_on_grid(rows, mean, sd, w, step), step, size)
        move = np.linalg.solve(hess + ridge * np.eye(size), grad + ridge * w)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return np.round(w, 9)


def fit(rows: DataFrame, cut: float) -> dict:
    """Model from all ``rows`` (``x`` features, ``y`` label); at the score quantile of the share of bad labels the
    probability is ``cut``."""
    n = len(FEATURES)
    each = [F.col("x")[k] for k in range(n)]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 0).alias("bad"), F.count_if(F.col("y") == 1).alias("good"),
                    F.array(*[F.avg(e) for e in each]).alias("mean"), F.array(*[F.stddev_pop(e) for e in each]).alias("sd")).first()
    if not seen["bad"] or not seen["good"]:
        return {"weights": [0.0] * n, "at": 0.0, "slope": 1.0, "lift": 0.0}
    # rounded, as sums of doubles depend on the order in which tasks end
    mean, sd = np.round(seen["mean"], 12), np.round(np.array(seen["sd"]) + 1e-9, 12)
    w = fit_pairs(rows.filter(F.col("y").isin(0, 1)), mean, sd)

    @F.arrow_udf(T.DoubleType())
    def raw(x: pa.Array) -> pa.Array:
        return pa.array(standard(x.flatten().to_numpy().reshape(len(x), n), mean, sd) @ w)

    # the cut: quantile at the share of bad labels, midway to the nearest score on either side of it
    k = min(max(1, seen["bad"]), seen["n"] - 1)
    scores = cut_lineage(rows.select(raw(F.col("x")).alias("score")))
    at = exact_quantiles(scores, ["score"], [(k - 0.5) / (seen["n"] - 1)]).first()["q0"][0]
    return {"mean": mean.tolist(), "sd": sd.tolist(), "weights": w.tolist(), "at": at,
            "slope": 1.0, "lift": float(np.log(cut / (1 - cut)))}


def probability(x: np.ndarray, model: dict) -> np.ndarray:
    if "mean" not in model:
        return np.full(len(x), 0.5)
    z = standard(x, np.array(model["mean"]), np.array(model["sd"]))
    s = z @ np.array(model["weights"]) - model["at"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * s + model["lift"], -30, 30)))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(text: pa.Array) -> pa.Array:
    return pa.array([features(x.as_py()) for x in text], pa.list_(pa.float64()))


def held_out(id_col):
    """Rows that are never learned from: crc32 of the id as text, mod 5, is 0 (a null id is held out)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, cut: float = 0.3,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Fit on all labelled ids that aren't held out.

    Features are made before the join, so that no text is shuffled: a row of them is some 150 bytes."""
    i, y = F.col(q(id_col)), F.col(q(label_col))
    known = (labels.filter(i.isNotNull() & y.isNotNull() & ~held_out(i)).groupBy(i.alias("id")).agg(F.max(y).cast("int").alias("y")))
    made = (docs.filter(i.isNotNull() & ~held_out(i))
            .select(i.alias("id"), F.xxhash64(F.col(q(text_col))).alias("h"), _features(F.col(q(text_col))).alias("x")))
    # one row for an id
    rows = made.join(known, "id").groupBy("id", "y").agg(F.min_by("x", "h").alias("x"))
    # the labelled rows alone are dealt out again, so that each step of the fit scans a file for each FILE_ROWS of them
    return fit(cut_lineage(rows.select("x", "y").repartition(files_for(docs.sparkSession, known.count()))), cut)


def score(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that its text is good."""
    @F.arrow_udf(T.DoubleType())
    def scored(text: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py()) for t in text], float).reshape(len(text), len(FEATURES))
        return pa.array(probability(x, model))

    return docs.withColumn(name, scored(F.col(q(text_col))))
