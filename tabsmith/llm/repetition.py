"""Quality rules by repetition coverage.

Per text: rolling hashes of word n-grams of several lengths (numpy) find the
n-grams that occur again, and the rules look at the share of the text's
characters that lies inside repeated n-grams and repeated lines.  Equal hashes
are compared word by word, so counts are exact.

One pass over the texts, no shuffle; only the text column goes to Python.

Edge cases: a null or empty text has no words and fails the base rule; very
long texts are measured whole (memory grows with one text only); repeated rows
get equal results; extra columns are passed through.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import q
from tabsmith.llm.common import words_of

SYMBOLS = "#*$%&|<>"
# Shares of characters inside n-grams that occurred earlier in the text, by
# n-gram length, and the same for lines.  Twice the published web-text limits:
# those also reject short clean texts that hold one line or passage twice.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINE_LIMIT = 0.40
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
          ("n_repeat_words", "long"), ("dup_line_share", "double"), ("dup_ngram_excess", "double")]


def rolling_hashes(ids: np.ndarray, lengths) -> dict:
    """Hash of every n-gram of ``ids`` for each length: ``h(i, n) = h(i, n-1) * B + id(i+n-1)`` mod 2^64."""
    base = np.uint64(0x9E3779B97F4A7C15)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    out, h = {}, mixed
    for n in range(2, max(lengths) + 1):
        if len(ids) < n:
            break
        h = h[:-1] * base + mixed[n - 1:]
        if n in lengths:
            out[n] = h
    return out


def repeats(ids: np.ndarray, h: np.ndarray, n: int):
    """Start positions of n-grams that occur twice or more, and those of them that are not the first."""
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    if not len(same):
        return same, same
    a, b = order[same], order[same + 1]
    if any((ids[a + k] != ids[b + k]).any() for k in range(n)):  # a collision: compare the n-grams themselves
        grams = np.lib.stride_tricks.sliding_window_view(ids, n)
        _, first, group, count = np.unique(grams, axis=0, return_index=True, return_inverse=True, return_counts=True)
        group = group.reshape(-1)
        every = np.flatnonzero(count[group] > 1)
        return every, every[first[group[every]] != every]
    return np.union1d(a, b), b


def covered(starts: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which words lie inside the n-grams at ``starts``."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(text) -> tuple:
    """The values of ``FIELDS`` for one text."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    chars = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in known), np.int64, len(known))[ids]
    total = int(chars.sum())
    symbols = sum(text.count(s) for s in SYMBOLS)

    dup_lines = dup_line_chars = 0
    if "\n" in text:
        seen = set()
        for line in text.split("\n"):
            if line in seen:
                dup_lines += 1
                dup_line_chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in words_of(line))
            elif words_of(line):
                seen.add(line)

    repeat_words, excess = 0, 0.0
    lengths = sorted({*NGRAM_LIMITS, WINDOW})
    for k, h in rolling_hashes(ids, lengths).items():
        every, later = repeats(ids, h, k)
        if not len(every):
            break  # no n-gram occurs again, so no longer one does
        if k == WINDOW:
            repeat_words = int(covered(every, k, n).sum())
        if k in NGRAM_LIMITS:
            share = float(chars[covered(later, k, n)].sum()) / total
            excess = max(excess, share / NGRAM_LIMITS[k])
    return n, total, symbols, dup_lines, repeat_words, dup_line_chars / total if total else 0.0, excess


SCHEMA = T.StructType([T.StructField(name, T.LongType() if kind == "long" else T.DoubleType()) for name, kind in FIELDS])
_ARROW = pa.struct([(name, pa.int64() if kind == "long" else pa.float64()) for name, kind in FIELDS])


@F.arrow_udf(SCHEMA)
def _measured(text: pa.Array) -> pa.Array:
    rows = [measure(x.as_py()) for x in text]
    columns = list(zip(*rows)) or [()] * len(FIELDS)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], fields=list(_ARROW))


def rules(m):
    """(base_failed, repetitive) from a column of measures."""
    failed = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)
    return failed, (m["dup_ngram_excess"] > 1.0) | (m["dup_line_share"] > LINE_LIMIT)


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``FIELDS``, ``base_failed`` and ``kept`` (which replace columns of these names).

    ``dup_ngram_excess`` is the largest share of repeated characters relative
    to its limit, over the n-gram lengths: above 1 the text is rejected."""
    own = [name for name, _ in FIELDS] + ["base_failed", "kept"]
    d = docs.withColumn("__m", _measured(F.col(q(text_col))))
    failed, repetitive = rules(F.col("__m"))
    return d.select(*[F.col(q(c)) for c in docs.columns if c.lower() not in own],
                    *[F.col("__m")[name].alias(name) for name, _ in FIELDS],
                    failed.alias("base_failed"), (~failed & ~repetitive).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes the rules."""
    d = docs.withColumn("__m", _measured(F.col(q(text_col))))
    failed, repetitive = rules(F.col("__m"))
    return d.filter(~failed & ~repetitive).drop("__m")
