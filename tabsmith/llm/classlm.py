"""Class-based n-gram language model with Brown classes.

``P(word | before) = P(class of word | class before) * P(word | its class)``,
over lower-cased words and one end per text (which also stands before the
first word).

* ``count``: words of the training rows, all of them.
* Classes: the ``CLUSTERED`` most frequent words are clustered by exchange:
  a word moves to the class where the likelihood of the class bigrams (their
  mutual information) becomes largest, half of the words a round, against the
  counts of the round's start; the best round stays.  Every other word takes
  the class that one such step gives it, from its neighbours among those words.
* The model: counts of all class bigrams and of all words, smoothed.  A
  transition leans on the class frequencies (Witten-Bell); each class keeps a
  share for unseen words, by the words seen once in it.  Together the words and
  one unseen word have probability 1 after any class.

The texts are read twice: for the counts, and to store them as word numbers of
the dictionary (at most ``DICTIONARY`` words of at most ``WORD_BYTES`` bytes,
the only part that is sent to all workers); rarer words stay words, and get
their class and count by joins.  Word pairs are counted before they're shuffled;
a clustered word's neighbours are one row of at most 2 * ``CLUSTERED`` entries.

Edge cases: a null or empty text is its end alone; very long texts are scored
whole; repeated rows count and are scored each; nothing to learn from leaves
every token unseen; an empty table gives an empty result; extra columns are
passed through (those named like the results are replaced).
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import q
from tabsmith.llm.common import free_name, text_slices
from tabsmith.session import cut_lineage

END = "\n"  # the end's entry among the words: no word holds a line break
CLASSES, ROUNDS = 128, 8
CLUSTERED, DICTIONARY, WORD_BYTES = 1 << 14, 1 << 18, 64
TEXT_BYTES, ID_BYTES = 4 << 20, 2 << 20  # of texts, or of their word numbers, that a worker looks at together
PLACED = 1 << 13  # entries of the neighbours' classes that it looks at together
RESULTS = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def words_lowered(texts):
    """Words of all texts of an Arrow array, A-Z lowered, and where each text's begin (and the last one's end).

    They stay in Arrow: as Python objects they would take ten times their bytes, of which a worker keeps a part."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)  # white space at a text's ends leaves empty words
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some), before[lists.offsets.to_numpy()]


def parts(batches, column: str, most: int):
    """Slices of the batches with about ``most`` bytes of a column; what a batch took is given back, as workers stay on."""
    for batch in batches:
        yield from text_slices(batch, column, most)
        pa.default_memory_pool().release_unused()


# -------------------------------------------------------------------- counts

def count(rows: DataFrame, text_col: str) -> DataFrame:
    """Words of the texts and the end: (word, n)."""
    def run(batches):
        for part in parts(batches, "text", TEXT_BYTES):
            seen = words_lowered(part.column("text"))[0].value_counts()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([seen.field("values"), pa.array([END])]),
                                              pa.concat_arrays([seen.field("counts"), pa.array([part.num_rows])])], ["word", "n"])
    texts = rows.select(F.coalesce(F.col(q(text_col)), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(vocab: DataFrame, most: int) -> tuple[list, int]:
    """The frequent words of at most ``WORD_BYTES`` bytes with their counts, frequent first, and the least count that a
    word of that length needs to be among them: the least (of 16 steps a doubling) that leaves at most ``most`` words."""
    short = vocab.filter((F.octet_length("word") <= WORD_BYTES) & (F.col("word") != END))
    steps = short.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n"))
    least, total = None, 0
    for r in steps.orderBy(F.col("step").desc()).collect():
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    if least is None:
        return [], 1 << 62
    found = [(r["word"], r["n"]) for r in short.filter(F.col("n") >= least).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0].encode())), least


# ------------------------------------------------------- texts as word numbers

@functools.lru_cache(maxsize=1)
def _entries(blob: bytes):
    """The dictionary's words by number."""
    return pc.split_pattern(pa.array([blob], pa.string()), "\n").flatten() if blob else pa.array([], pa.string())


def encode(rows: DataFrame, text_col: str, train: Column, shared) -> DataFrame:
    """(key, row, train, ids, tails): the texts as numbers of dictionary words (-1: another), and the other words.

    Stored, since ``key`` numbers the rows."""
    kept = [c for c in rows.columns if c != text_col]

    def run(batches):
        entries = _entries(shared.value)
        for part in parts(batches, "text", TEXT_BYTES):
            words, begins = words_lowered(part.column("text"))
            own = pc.fill_null(pc.index_in(words, value_set=entries), -1).to_numpy()
            other = own < 0
            ids = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((begins * 4).astype(np.int32)), pa.py_buffer(own)])
            tails = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(other)])[begins].astype(np.int32)), words.filter(pa.array(other)))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("row"), part.column("train"), ids, tails],
                                             ["key", "row", "train", "ids", "tails"])
    d = rows.select(F.monotonically_increasing_id().alias("key"), F.struct(*[F.col(q(c)) for c in kept], F.lit(0).alias(free_name("__one", rows))).alias("row"),
                    F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(q(text_col)), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("key", T.LongType()), d.schema["row"], T.StructField("train", T.BooleanType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("tails", T.ArrayType(T.StringType()))])
    return cut_lineage(d.mapInArrow(run, schema))


def _sequence(ids, end: int):
    """Ids of the texts of an Arrow array, each followed by ``end``, and where each begins; the first is led by ``end``."""
    parts = [np.array([end], np.int32)]
    stop = parts[0]
    for x in ids.to_pylist():
        parts += [np.frombuffer(x, np.int32), stop]
    flat = np.concatenate(parts)
    sizes = np.array([len(p) + 1 for p in parts[1::2]], np.int64)
    return flat, np.concatenate([[1], 1 + np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)


def _counted(codes: np.ndarray, most: int, weights=None):
    """Distinct codes below ``most`` and how often they occur (or their weight)."""
    if most <= 1 << 21:
        n = np.bincount(codes, weights, minlength=most)
        found = np.flatnonzero(n)
        return found, n[found].astype(np.int64)
    return np.unique(codes, return_counts=True)


def pairs_of(encoded: DataFrame, clustered: int) -> DataFrame:
    """Neighbours of each clustered word (the end is number ``clustered``) among them: (w, near, n), where ``near`` packs
    2 * neighbour + side as 32-bit numbers (side 0 is after the word, 1 before it) and ``n`` their counts as 64-bit ones:
    the rounds read this table again and again, so it isn't stored as arrays of structs."""
    def run(batches):
        for part in parts(batches, "ids", ID_BYTES):
            # the end's number is not one of the dictionary's: word number ``clustered`` is not clustered
            flat, _ = _sequence(part.column("ids"), -2)
            flat = np.where(flat == -2, clustered, np.where(flat >= clustered, -1, flat)).astype(np.int64)
            a, b = flat[:-1], flat[1:]
            both = (a >= 0) & (b >= 0)
            code, n = np.unique(a[both] * (clustered + 1) + b[both], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((code // (clustered + 1)).astype(np.int32)),
                                              pa.array((code % (clustered + 1)).astype(np.int32)), pa.array(n)], ["a", "b", "n"])
    pairs = encoded.filter("train").select("ids").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    sides = F.array(F.struct(F.col("a").alias("w"), F.lit(0).alias("side"), F.col("b").alias("o"), F.col("n")),
                    F.struct(F.col("b").alias("w"), F.lit(1).alias("side"), F.col("a").alias("o"), F.col("n")))
    # the rounds read the table again and again: dealt out once, for all of them
    rows = pairs.select(F.inline(sides)).repartition(4 * encoded.sparkSession.sparkContext.defaultParallelism, "w")

    def pack(batches):
        for batch in batches:
            flat, at = batch.column("near").flatten(), batch.column("near").offsets.to_numpy()
            side, other, n = (flat.field(k).to_numpy() for k in range(3))
            near = (other * 2 + side).astype(np.int32)
            cuts = list(zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("w"), pa.array([near[a:b].tobytes() for a, b in cuts], pa.binary()),
                 pa.array([n[a:b].tobytes() for a, b in cuts], pa.binary())], ["w", "near", "n"])
    lists = rows.groupBy("w").agg(F.collect_list(F.struct("side", "o", "n")).alias("near"))
    return cut_lineage(lists.mapInArrow(pack, "w int, near binary, n binary"))


# ------------------------------------------------------------------- exchange

def f(x):
    """x log x, 0 at 0."""
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(n: np.ndarray) -> float:
    """Class bigram likelihood, up to a constant of the words."""
    return float(f(n).sum() - f(n.sum(1)).sum() - f(n.sum(0)).sum())


def best_class(n, fn, own, after, before, twice, classes) -> int:
    """The class where a word of class ``own`` fits best: ``n`` are the class bigrams with it, ``fn = f(n)``, ``after``
    and ``before`` the classes of its neighbours, ``twice`` how often it follows itself."""
    rows, cols = np.flatnonzero(before), np.flatnonzero(after)
    m, fm = n.copy(), fn.copy()
    m[own] -= after
    m[:, own] -= before
    m[own, own] -= twice
    fm[own], fm[:, own] = f(m[own]), f(m[:, own])
    left, right = m.sum(1) + before, m.sum(0) + after  # the neighbours stay in their classes
    diag, fdiag = m.diagonal(), fm.diagonal()
    gain = (f(m[:, cols] + after[cols]) - fm[:, cols]).sum(1) + (f(m[rows] + before[rows, None]) - fm[rows]).sum(0)
    gain -= f(diag + after) + f(diag + before) - f(diag + after + before + twice) - fdiag
    gain -= f(left + after.sum() + twice) - f(left) + f(right + before.sum() + twice) - f(right)
    gain = np.round(gain[:classes], 6)
    return own if gain[own] >= gain.max() else int(gain.argmax())


def _near(batch):
    """Flat (row, side, other word, n) of a batch of packed neighbours."""
    near, n = ([np.frombuffer(x, kind) for x in batch.column(name).to_pylist()] for name, kind in (("near", np.int32), ("n", np.int64)))
    row = np.repeat(np.arange(batch.num_rows), [len(x) for x in near])
    flat = np.concatenate([np.zeros(0, np.int32), *near])
    return row, flat & 1, flat >> 1, np.concatenate([np.zeros(0, np.int64), *n])


def exchange(near: DataFrame, n_words: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the clustered words (the end has class ``classes``) and their class bigrams."""
    k = classes + 1

    def bigrams(own: np.ndarray) -> np.ndarray:
        def run(batches):
            total = np.zeros(k * k)
            for part in parts(batches, "near", ID_BYTES):
                row, side, other, n = _near(part)
                w = part.column("w").to_numpy()
                after = side == 0
                total += np.bincount(own[w[row[after]]] * k + own[other[after]], n[after], minlength=k * k)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["code", "n"])
        out = np.zeros(k * k)
        for r in near.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
            out[r["code"]] = r["n"]
        return out.reshape(k, k)

    def moves(own: np.ndarray, n: np.ndarray, half: int) -> dict:
        def run(batches):
            fn = f(n)
            for part in parts(batches, "near", ID_BYTES):
                w = part.column("w").to_numpy()
                row, side, other, times = _near(part)
                self_ = other == w[row]
                code = (row * 2 + side) * k + own[other]
                seen = np.bincount(code[~self_], times[~self_], minlength=2 * k * len(w)).reshape(len(w), 2, k)
                twice = np.bincount(row[self_ & (side == 0)], times[self_ & (side == 0)], minlength=len(w))
                mine = np.flatnonzero((w % 2 == half) & (w < n_words))
                new = [best_class(n, fn, own[w[i]], seen[i, 0], seen[i, 1], twice[i], classes) for i in mine.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(w[mine], pa.int32()), pa.array(new, pa.int32())], ["w", "c"])
        return {r["w"]: r["c"] for r in near.mapInArrow(run, "w int, c int").collect()}

    own = np.append(np.arange(n_words) % classes, classes).astype(np.int64)
    n = bigrams(own)
    best = (likelihood(n), own, n)
    for step in range(rounds):
        new = own.copy()
        for w, c in moves(own, n, step % 2).items():
            new[w] = c
        if (new == own).all() and step % 2:
            break
        own, n = new, bigrams(new)
        if likelihood(n) > best[0]:
            best = (likelihood(n), own, n)
    return best[1], best[2]


def place(contexts: DataFrame, bigrams: np.ndarray, classes: int) -> DataFrame:
    """Class of each (id, word) by one exchange step at the given class bigrams, from ``contexts`` (id, word, code, n):
    code is the class of a neighbour after it, or classes + 1 more for one before it."""
    k = classes + 1
    smooth = bigrams + 0.5
    after = np.log(smooth / smooth.sum(1, keepdims=True))[:classes]   # [class, class after it]
    before = np.log(smooth / smooth.sum(0, keepdims=True))[:, :classes]  # [class before it, class]
    gain = np.vstack([after.T, before])  # [code, class]

    def run(batches):
        for batch in batches:
            seen = batch.column("seen")
            ends, flat = seen.offsets.to_numpy(), seen.flatten()
            code, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            out = np.zeros(batch.num_rows, np.int32)
            cuts = np.flatnonzero(np.diff((ends[:-1] - ends[0]) // PLACED)) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), batch.num_rows] if batch.num_rows else []):
                lo, hi = ends[a] - ends[0], ends[b] - ends[0]
                sums = np.add.reduceat(gain[code[lo:hi]] * n[lo:hi, None], ends[a:b] - ends[a], axis=0)
                out[a:b] = np.round(sums, 6).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("word"), pa.array(out)], ["id", "word", "c"])
    assert gain.shape == (2 * k, classes)
    # one shuffle: words that aren't clustered are rare, so none fills a partition
    packed = contexts.repartition("id", "word").groupBy("id", "word", "code").agg(F.sum("n").alias("n")) \
                     .groupBy("id", "word").agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("seen"))
    return packed.mapInArrow(run, "id int, word string, c int")


def contexts_of(encoded: DataFrame, own: np.ndarray, clustered: int, classes: int) -> DataFrame:
    """(id, word, code, n): the classes beside the words that aren't clustered; id -1 for words beyond the dictionary."""
    k = classes + 1

    def run(batches):
        for part in parts(batches, "ids", ID_BYTES):
            flat, _ = _sequence(part.column("ids"), -2)
            flat = flat.astype(np.int64)
            beside = np.where(flat == -2, classes, np.where((flat >= 0) & (flat < clustered), own[np.clip(flat, 0, max(clustered - 1, 0))], -1))
            tails = part.column("tails").flatten().dictionary_encode()
            names, tail = tails.dictionary, tails.indices.to_numpy().astype(np.int64)
            word = flat.copy()
            word[flat == -1] = -3 - tail  # words beyond the dictionary: -3, -4, ...
            free = np.flatnonzero((flat >= clustered) | (flat == -1))
            out = []
            for side, at in ((0, free + 1), (1, free - 1)):
                ok = beside[at] >= 0
                out.append(((word[free[ok]] + 3 + len(names)) * 2 + side) * k + beside[at[ok]])
            code, n = np.unique(np.concatenate(out), return_counts=True)
            code, side_class = code // (2 * k), code % (2 * k)
            w = code - 3 - len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(w >= 0, w, -1).astype(np.int32)), names.take(pa.array(np.maximum(-3 - w, -1), mask=w >= 0)),
                 pa.array(side_class.astype(np.int32)), pa.array(n)], ["id", "word", "code", "n"])
    return encoded.filter("train").select("ids", "tails").mapInArrow(run, "id int, word string, code int, n long")


# ---------------------------------------------------------------------- model

class Tables:
    """Log10 probabilities: ``step[class before, class]`` (then the end, then unseen words) and the classes' emissions."""

    def __init__(self, bigrams: np.ndarray, words: np.ndarray, once: np.ndarray):
        """``bigrams`` and ``words`` (tokens per class) with the end last, ``once``: words seen once per class."""
        k = len(words)
        self.unseen = k
        share = (words + 1) / (words.sum() + k)
        follow = (bigrams > 0).sum(1) + 1.0
        step = (bigrams + follow[:, None] * share) / (bigrams.sum(1) + follow)[:, None]
        new = (once + 1) / (words + once + 2)
        new[-1] = 0.0  # the end is always known
        step = np.vstack([step, share])
        self.step = np.log10(np.hstack([step, (step @ new)[:, None]]))
        with np.errstate(divide="ignore"):
            self.emit = np.where(words > 0, np.log10((1 - new) / np.maximum(words, 1)), 0.0)  # and log10 of the word's count
        self.emit[-1] = 0.0


class Model:
    """Counts, classes and tables learned from the rows where ``train`` holds; ``score`` gives all rows' results."""

    def __init__(self, rows: DataFrame, text_col: str, train: Column, classes: int = CLASSES, rounds: int = ROUNDS,
                 clustered: int = CLUSTERED, most: int = DICTIONARY):
        sc = rows.sparkSession.sparkContext
        self.classes = classes
        vocab = cut_lineage(count(rows.filter(train), text_col))
        r = vocab.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == END, F.col("n"))).alias("ends")).first()
        self.tokens, self.types, self.ends = r["n"] or 0, r["v"], r["ends"] or 0
        frequent, least = dictionary(vocab, most)
        clustered = min(clustered, len(frequent))
        self.words, self.counts = [w for w, _ in frequent], np.array([n for _, n in frequent], np.int64)
        self.encoded = encode(rows, text_col, train, sc.broadcast("\n".join(self.words).encode()))
        near = pairs_of(self.encoded, clustered)
        own, bigrams = exchange(near, clustered, classes, rounds)
        placed = cut_lineage(place(contexts_of(self.encoded, own[:clustered], clustered, classes), bigrams, classes))
        of = np.zeros(len(frequent), np.int16)
        of[:clustered] = own[:clustered]
        for r in placed.filter("id >= 0").select("id", "c").collect():  # at most the dictionary
            of[r["id"]] = r["c"]
        self.of = of
        rare = vocab.filter((F.col("word") != END) & ((F.col("n") < least) | (F.octet_length("word") > WORD_BYTES)))
        self.rare = rare = cut_lineage(rare.join(placed.filter("id = -1").select("word", "c"), "word", "left")
                           .select("word", "n", F.coalesce("c", F.lit(0)).alias("c")))
        self.tails = cut_lineage(self._tails(rare))
        self._learn(rare)

    def _pass(self, fn, schema: str, train_only: bool = False, tails: bool = False) -> DataFrame:
        """``fn(part, classes, begins)`` over slices of the stored texts; classes: -1 for words beyond the dictionary."""
        shared, end = self.encoded.sparkSession.sparkContext.broadcast(self.of), self.classes

        def run(batches):
            of = np.append(shared.value, np.int16(-1)).astype(np.int64)
            for part in parts(batches, "ids", ID_BYTES):
                flat, begins = _sequence(part.column("ids"), -2)
                yield from fn(part, flat, np.where(flat == -2, end, of[np.maximum(flat, -1)]), begins)
        rows = self.encoded.filter("train") if train_only else self.encoded
        return rows.select("key", "train", "ids", *(["tails"] if tails else [])).mapInArrow(run, schema)

    def _tails(self, rare: DataFrame) -> DataFrame:
        """Every word beyond the dictionary in the texts: (key, train, n, prev, c, next); next is -1 before another such."""
        end, unseen = self.classes, self.classes + 1

        def each(part, flat, own, begins):
            at = np.flatnonzero(own < 0)
            doc = np.searchsorted(begins, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(doc)), part.column("train").take(pa.array(doc)), pa.array(at), part.column("tails").flatten(),
                 pa.array(own[at - 1].astype(np.int32)), pa.array(own[at + 1].astype(np.int32))], ["key", "train", "pos", "word", "prev", "next"])
        found = self._pass(each, "key long, train boolean, pos long, word string, prev int, next int", tails=True)
        found = found.join(rare, "word", "left").select("key", "train", "pos", "prev", "next", F.coalesce("n", F.lit(0)).alias("n"),
                                                        F.when(F.col("n").isNull(), unseen).otherwise(F.col("c")).alias("c"))
        before = F.lag("c").over(Window.partitionBy("key").orderBy("pos"))
        return found.withColumn("prev", F.when(F.col("prev") < 0, before).otherwise(F.col("prev"))).drop("pos")

    def _learn(self, rare: DataFrame) -> None:
        k = self.classes + 1
        bigrams = np.zeros(k * k)

        def each(part, flat, own, begins):
            a, b = own[:-1], own[1:]
            both = (a >= 0) & (b >= 0)
            code, n = _counted(a[both] * k + b[both], k * k)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])
        steps = F.array(*[x.cast("long") for x in (F.col("prev") * k + F.col("c"), F.when(F.col("next") >= 0, F.col("c") * k + F.col("next")))])
        rare_steps = self.tails.filter("train").select(F.explode(steps).alias("code")).dropna().groupBy("code").agg(F.count(F.lit(1)).alias("n"))
        for r in self._pass(each, "code long, n long", train_only=True).unionByName(rare_steps).groupBy("code").agg(F.sum("n").alias("n")).collect():
            bigrams[r["code"]] = r["n"]
        words = np.bincount(self.of, self.counts, minlength=k).astype(float)
        once = np.bincount(self.of[self.counts == 1], minlength=k).astype(float)
        for r in rare.groupBy("c").agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect():
            words[r["c"]] += r["n"]
            once[r["c"]] += r["once"]
        words[-1] = self.ends
        self.tables = Tables(bigrams.reshape(k, k), words, once)

    def score(self) -> DataFrame:
        """The rows with ``n_tokens``, ``n_known`` (seen in training), ``train_tokens``, ``base_score`` (add-one word
        frequencies) and ``score``, log10 probabilities of the texts."""
        t, counts, end = self.tables, self.counts, self.classes
        per, known_end = np.log10(self.tokens + self.types + 1), int(self.ends > 0)
        base_end = np.log10(self.ends + 1) - per
        shared = self.encoded.sparkSession.sparkContext.broadcast(
            (np.log10(counts + 1.0) - per, np.log10(np.maximum(counts, 1.0)) + t.emit[self.of]))
        schema = "key long, n_tokens long, n_known long, base_score double, score double"
        names = ["key", "n_tokens", "n_known", "base_score", "score"]

        def frequent(part, flat, own, begins):
            bases, emits = (np.append(x, 0.0) for x in shared.value)
            at = np.clip(flat, -1, None)  # -1 takes the 0 at the end
            base = np.where(flat == -2, base_end, bases[at])
            known = np.where(flat == -2, known_end, flat >= 0).astype(np.int64)
            step = np.zeros(len(flat))
            both = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0))
            step[both + 1] = t.step[own[both], own[both + 1]]
            score = step + np.where(flat == -2, 0.0, emits[at])
            if part.num_rows:
                sizes = np.diff(begins, append=len(flat))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sizes), *[
                    pa.array(np.add.reduceat(x, begins)) for x in (known, base, score)]], names)

        def rest(batches):
            for batch in batches:
                prev, c, nxt, n = (batch.column(x).to_numpy() for x in ("prev", "c", "next", "n"))
                emit = np.append(t.emit, 0.0)[c] + np.log10(np.maximum(n, 1))
                score = t.step[prev, c] + np.where(n > 0, emit, 0.0) + np.where(nxt >= 0, t.step[c, np.maximum(nxt, 0)], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.zeros(len(n), np.int64)), pa.array((n > 0).astype(np.int64)),
                                                  pa.array(np.log10(n + 1.0) - per), pa.array(score)], names)
        both = self._pass(frequent, schema).unionByName(self.tails.select("key", "n", "prev", "c", "next").mapInArrow(rest, schema))
        sums = both.groupBy("key").agg(*[F.sum(c).alias(c) for c in names[1:]])
        kept = [c for c in self.encoded.schema["row"].dataType.fieldNames()[:-1] if c.lower() not in RESULTS]
        out = self.encoded.select("key", "row").join(sums, "key")
        return out.select(*[F.col("row")[c].alias(c) for c in kept], "n_tokens", "n_known", F.lit(self.tokens).cast("long").alias("train_tokens"),
                          "base_score", "score")
