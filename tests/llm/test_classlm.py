"""Class-based language model against brute force."""

import itertools
import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import classlm


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [classlm.END]


def brute_scores(docs, of, classes):
    """{row: (n_tokens, n_known, train_tokens, base, score)} of docs (key, train, text) with the words' classes ``of``."""
    end, unseen = classes, classes + 1
    n, steps = Counter(), Counter()
    for _, train, text in docs:
        if train:
            t = tokens(text)
            n.update(t)
            path = [end] + [end if w == classlm.END else of[w] for w in t]
            steps.update(zip(path, path[1:]))
    total, types = sum(n.values()), len(n)
    words, once = Counter(), Counter()
    for w, k in n.items():
        c = end if w == classlm.END else of[w]
        words[c] += k
        once[c] += k == 1
    k = classes + 1
    share = [(words[c] + 1) / (total + k) for c in range(k)]
    new = [(once[c] + 1) / (words[c] + once[c] + 2) for c in range(classes)] + [0.0]

    def follow(a, b):
        if b == unseen:
            return sum(follow(a, c) * new[c] for c in range(k))
        if a == unseen:
            return share[b]
        kinds = sum(1 for c in range(k) if steps[a, c]) + 1
        return (steps[a, b] + kinds * share[b]) / (sum(steps[a, c] for c in range(k)) + kinds)
    out = []
    for key, _, text in docs:
        t, before, score = tokens(text), end, 0.0
        for w in t:
            c = end if w == classlm.END else of[w] if n[w] else unseen
            score += math.log10(follow(before, c)) + (0 if c in (end, unseen) else math.log10((1 - new[c]) * n[w] / words[c]))
            before = c
        base = sum(math.log10((n[w] + 1) / (total + types + 1)) for w in t)
        out.append((key, len(t), sum(1 for w in t if n[w]), total, base, score))
    return out


def classes_of(model):
    found = dict(zip(model.words, model.of.tolist()))
    found.update({r["word"]: r["c"] for r in model.rare.collect()})
    return found


@pytest.fixture(scope="module")
def small(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60").select("doc_id", "text").collect()
    docs = [(r["doc_id"], r["doc_id"] % 4 != 1, r["text"]) for r in rows]
    df = spark.createDataFrame(docs, "id long, learn boolean, text string")
    return docs, classlm.Model(df, "text", F.col("learn"), classes=5, rounds=4, clustered=40, most=300)


def test_scores_against_brute_force(small):
    docs, model = small
    assert 40 < len(model.words) <= 300 and model.rare.count() > 300
    got = sorted(tuple(r) for r in model.score().select("id", *classlm.RESULTS).collect())
    want = sorted(brute_scores(docs, classes_of(model), 5))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)
    held = [r for r in got if r[0] % 4 == 1]
    assert sum(r[5] for r in held) > sum(r[4] for r in held)  # better than word frequencies on texts it hasn't seen


def test_probabilities_sum_to_one(small):
    _, model = small
    t, of = model.tables, classes_of(model)
    counts = dict(zip(model.words, model.counts.tolist())) | {r["word"]: r["n"] for r in model.rare.collect()}
    for before in range(7):
        total = 10 ** t.step[before, 5] + 10 ** t.step[before, 6]
        total += sum(10 ** (t.step[before, c] + t.emit[c]) * counts[w] for w, c in of.items())
        assert abs(total - 1) < 1e-9


def test_clusters_and_places(spark, small):
    docs, model = small
    assert classlm.dictionary(classlm.count(spark.createDataFrame(docs, "id long, learn boolean, text string").filter("learn"), "text"), 300)[0] \
        == [(w, n) for w, n in zip(model.words, model.counts.tolist())]
    near = classlm.pairs_of(model.encoded, 40)
    number = {w: i for i, w in enumerate(model.words[:40])} | {classlm.END: 40}
    pairs = Counter()
    for _, train, text in docs:
        if train:
            ids = [40] + [number.get(w, -1) for w in tokens(text)]
            pairs.update((a, b) for a, b in zip(ids, ids[1:]) if a >= 0 and b >= 0)
    found = Counter()
    for r in near.collect():
        for x, n in zip(np.frombuffer(r["near"], np.int32).tolist(), np.frombuffer(r["n"], np.int64).tolist()):
            found[(r["w"], x >> 1) if x & 1 == 0 else (x >> 1, r["w"])] += n
    assert found == Counter({p: 2 * n for p, n in pairs.items()})

    def bigrams(own):
        m = np.zeros((6, 6))
        for (a, b), n in pairs.items():
            m[own[a], own[b]] += n
        return m
    start = np.append(np.arange(40) % 5, 5)
    own, m = classlm.exchange(near, 40, 5, 4)
    assert (m == bigrams(own)).all()
    assert classlm.likelihood(m) > classlm.likelihood(bigrams(start))
    # one step of each word, against moving it everywhere
    m = bigrams(start)
    for w in range(40):
        after, before = np.zeros(6), np.zeros(6)
        for (a, b), n in pairs.items():
            if a == w and b != w:
                after[start[b]] += n
            if b == w and a != w:
                before[start[a]] += n
        trials = []
        for c in range(5):
            moved = start.copy()
            moved[w] = c
            trials.append(classlm.likelihood(bigrams(moved)))
        got = classlm.best_class(m, classlm.f(m), start[w], after, before, pairs[w, w], 5)
        assert trials[got] >= max(trials) - 1e-5
    # the other words: their neighbours' classes decide
    contexts = Counter()
    for _, train, text in docs:
        if train:
            t = [classlm.END] + tokens(text)
            for a, b in zip(t, t[1:]):
                for w, other, side in ((a, b, 0), (b, a, 1)):
                    if w not in number and other in number:
                        contexts[w, side * 6 + own[number[other]]] += 1
    smooth = bigrams(own) + 0.5
    of = classes_of(model)
    model_own = np.append(model.of[:40], 5)
    if (model_own == own).all():
        gain = np.vstack([np.log(smooth / smooth.sum(1, keepdims=True))[:5].T, np.log(smooth / smooth.sum(0, keepdims=True))[:, :5]])
        score = {}
        for (w, code), n in contexts.items():
            score[w] = score.get(w, 0) + gain[code] * n
        assert score and all(s[of[w]] >= s.max() - 1e-5 for w, s in score.items())


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a B a b A"), (3, "a B a b A"), (4, " \n\t\x0b "), (5, "x " * 3000 + "w" * 200), (None, "a é É"), (6, "zz zz a")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "id long, text string, key string, score int")
    train = F.coalesce(F.col("id") != 6, F.lit(True))
    model = classlm.Model(df, "text", train, classes=3, rounds=2, clustered=2, most=3)
    got = model.score().collect()
    assert {r["key"] for r in got} == {"k"} and len(got) == len(rows)
    docs = [(r[0], r[0] != 6, r[1]) for r in rows]
    want = sorted(brute_scores(docs, classes_of(model), 3), key=str)
    mine = sorted(((r["id"], *[r[c] for c in classlm.RESULTS]) for r in got), key=str)
    assert [r[:4] for r in mine] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in mine], [r[4:] for r in want])
    nothing = classlm.Model(df, "text", F.lit(False), classes=3, rounds=1)  # nothing to learn from
    for r in nothing.score().collect():
        assert r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"])
    assert classlm.Model(df.filter("id = 99"), "text", train, classes=3, rounds=1).score().count() == 0


def test_one_class_is_word_frequencies():
    t = classlm.Tables(np.array([[6.0, 2.0], [2.0, 0.0]]), np.array([8.0, 2.0]), np.array([1.0, 0.0]))
    assert np.allclose((10 ** t.step)[:, :2].sum(1), 1)
    assert list(itertools.chain(t.step.shape)) == [3, 3]


class Local:
    """A table of Arrow batches whose steps run here, one after the other: what a worker does."""

    def __init__(self, batches):
        self.batches = batches

    def mapInArrow(self, fn, schema):
        return Local(fn(iter(self.batches)))

    def __getattr__(self, name):  # the rest of the plan leaves the rows as they are
        return lambda *a, **k: self

    def collect(self):
        return [r for b in self.batches for r in b.to_pylist()]


def traced(run):
    """What ``run`` returns, and the MB of Python and numpy objects that it held at most."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_words_of_texts():
    texts = ["", None, " a  B\x1c\x1d b\x0b\x0c\r\n\u00c9 x  \x85 Z", "\t", "x", "a\x00b \x1e\x1f c", "\u0130I \u212a"]
    words, begins = classlm.words_lowered(pa.array(["cut", *texts]).slice(1))
    assert [words[a:b].to_pylist() for a, b in itertools.pairwise(begins.tolist())] == [tokens(x)[:-1] for x in texts]


def test_words_of_a_slice_are_not_python_objects(spark):
    text = " ".join(f"w{i % 5000}" for i in range(500_000))
    batch = pa.RecordBatch.from_arrays([pa.array([text, text])], ["text"])
    batches, most = traced(lambda: list(classlm.count(Local([batch]), "text").batches))
    found = Counter()
    for b in batches:
        for r in b.to_pylist():
            found[r["word"]] += r["n"]
    assert found == Counter({f"w{i}": 200 for i in range(5000)} | {classlm.END: 2})
    assert most < 15  # of 3 MB a text; 23 bytes for each word's place, 60 MB as Python objects


def test_exchange_takes_slices_of_a_batch(spark):
    words, each, rng = 400, 5000, np.random.default_rng(1)
    near, n = ([rng.integers(0, top, each).astype(kind) for _ in range(words)] for top, kind in ((2 * words, np.int32), (9, np.int64)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(words), pa.int32()), pa.array([x.tobytes() for x in near], pa.binary()),
                                        pa.array([x.tobytes() for x in n], pa.binary())], ["w", "near", "n"])
    table = Local([batch])
    (own, bigrams), most = traced(lambda: classlm.exchange(table, words, 4, 2))
    assert len(own) == words + 1 and bigrams.sum() == sum(k[x % 2 == 0].sum() for x, k in zip(near, n))
    assert most < 70  # 2,000,000 neighbours; 170 MB if all are taken together


def test_places_take_bounded_entries(spark):
    words, k, rng = 1024, 129, np.random.default_rng(1)
    seen = pa.ListArray.from_arrays(pa.array(np.arange(words + 1) * 2 * k, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(np.tile(np.arange(2 * k), words), pa.int32()), pa.array(rng.integers(1, 9, 2 * k * words))], ["code", "n"]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(words), pa.int32()), pa.nulls(words, pa.string()), seen], ["id", "word", "seen"])
    bigrams = rng.integers(0, 99, (k, k)).astype(float)
    rows, most = traced(lambda: classlm.place(Local([batch]), bigrams, k - 1).collect())
    smooth = bigrams + 0.5
    gain = np.vstack([np.log(smooth / smooth.sum(1, keepdims=True))[:-1].T, np.log(smooth / smooth.sum(0, keepdims=True))[:, :-1]])
    n = seen.flatten().field(1).to_numpy().reshape(words, 2 * k)
    assert [r["c"] for r in rows] == np.round(n @ gain, 6).argmax(1).tolist()
    assert most < 60  # 264,192 entries; 270 MB for 512 words at once
