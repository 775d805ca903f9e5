"""Periodic runs of words, found on a Re-Pair grammar of each text.

A run is a maximal stretch of words with smallest period ``q`` that is at
least ``min_exponent`` periods and ``min_words`` words long.  Per text:

1. Re-Pair: word ids are replaced pair by pair, the most frequent pairs first,
   by nonterminals.  All texts of a slice are compressed together, round by
   round: a pair occurrence is replaced if no overlapping occurrence has a more
   frequent pair.  What is left of a text gets a balanced tree of top nodes.
2. Every run has a lowest node that holds it, and crosses the boundary between
   that node's two children.  So each distinct nonterminal is searched once, at
   its boundary, for all periods; stretches are measured by prefix hashes.
3. The intervals of a nonterminal are translated to all its positions in the
   derivation, and those inside a longer one of the same period are dropped.

Hashes only measure: each reported run is compared word by word, and a text
whose runs don't stand that (a hash collision) is searched period by period.

One pass over the texts without a shuffle; a worker holds a slice of about
``SLICE_BYTES`` or one text.  A text in which no pair of words repeats has no
nonterminal and therefore no run.

Edge cases: a null or empty text has no words and no runs; very long texts are
searched whole; repeated rows get equal results; extra columns are passed
through, except those named like the results, which are replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import q
from tabsmith.llm.common import free_name, words_of

SLICE_BYTES = 4 << 20
CANDIDATES = 1 << 21  # (node, period) pairs looked at together
_MOD, _BASE = np.int64(2147483647), 1103515245


def _grouped(key: np.ndarray):
    """Distinct values of ``key`` and which of them each element is."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], inverse


class Grammar:
    """Re-Pair grammar of several texts: ``words`` are their word ids one after another, ``ends`` the texts' ends.

    Symbols below ``n_words`` are words, the others nodes with ``left``,
    ``right``, ``size`` (in words) and one position ``at`` where they occur.
    ``levels`` are ranges of nodes, children before parents; ``roots`` is the
    top node of each text with nonterminals (and its position)."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        self.n_words = int(words.max()) + 1 if len(words) else 0
        self.left, self.right, self.size, self.at, self.levels = [], [], [], [], []
        self.count = 0
        self.sizes = np.ones(self.n_words, np.int64)
        self._compress(words, ends)
        self.left, self.right, self.at = (np.concatenate(x) if x else np.zeros(0, np.int64)
                                          for x in (self.left, self.right, self.at))

    def _add(self, left, right, at):
        """New nodes; returns their symbols."""
        first = self.n_words + self.count
        self.left.append(left)
        self.right.append(right)
        self.at.append(at)
        self.sizes = np.concatenate([self.sizes, self.sizes[left] + self.sizes[right]])
        self.levels.append((self.count, self.count + len(left)))
        self.count += len(left)
        return np.arange(first, first + len(left))

    def _compress(self, words, ends):
        n = len(words)
        sym = words.astype(np.int64).copy()
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        bits = max(1, int(2 * n + 1).bit_length())
        if bits * 2 + len(ends).bit_length() > 63:
            raise OverflowError("too many words in one slice")
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[ends > 0] - 1] = n
        before[np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]] = -1
        alive, rank = np.ones(n + 1, bool), np.full(n + 2, -1, np.int64)  # rank[-1], rank[n]: no neighbour
        alive[n] = False
        live = np.flatnonzero(after < n)
        ruled = np.zeros(len(ends), bool)
        while len(live):
            nxt = after[live]
            code = (((doc[live] << bits) | sym[live]) << bits) | sym[nxt]
            pairs, which = _grouped(code)
            # aaaa holds the pair aa at every second place only
            chained = np.zeros(len(live), bool)
            chained[1:] = (nxt[:-1] == live[1:]) & (which[1:] == which[:-1])
            place = np.arange(len(live))
            first = np.maximum.accumulate(np.where(chained, 0, place))
            counted = (place - first) % 2 == 0
            times = np.bincount(which[counted], minlength=len(pairs))
            stay = times[which] >= 2
            live, nxt, which, counted = live[stay], nxt[stay], which[stay], counted[stay]
            if not len(live):
                break
            order, often = np.zeros(len(pairs), np.int64), np.flatnonzero(times >= 2)
            # pairs of equal frequency by a hash, so that neighbours don't wait for each other along a text
            mixed = pairs[often].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            order[often[np.lexsort((mixed, times[often]))]] = np.arange(len(often))
            can, mine = live[counted], order[which[counted]]
            rank[can] = mine
            best = (rank[before[can]] < mine) & (rank[after[can]] < mine)
            rank[can] = -1
            won, pair = can[best], which[counted][best]
            used = np.bincount(pair, minlength=len(pairs))
            won, pair = won[used[pair] >= 2], pair[used[pair] >= 2]
            kept, rule = _grouped(pair)
            at = np.empty(len(kept), np.int64)
            at[rule] = won
            names = self._add(sym[at], sym[after[at]], at)
            ruled[doc[at]] = True
            gone = after[won]
            sym[won] = names[rule]
            alive[gone] = False
            far = after[gone]
            after[won] = far
            before[far[far < n]] = won[far < n]
            again = np.zeros(n + 1, bool)
            again[live] = True
            again[won] = True
            again[before[won]] = True  # -1 is the last place, which isn't alive
            again &= alive
            live = np.flatnonzero(again)
            live = live[after[live] < n]
        # balanced top nodes over what is left of the texts that have nonterminals
        at = np.flatnonzero(alive[:n] & ruled[doc])
        top, of = sym[at], doc[at]
        while len(top):
            start = np.flatnonzero(np.diff(of, prepend=-1))
            k = np.arange(len(top)) - np.repeat(start, np.diff(start, append=len(top)))
            paired = np.zeros(len(top), bool)
            paired[:-1] = (k[:-1] % 2 == 0) & (of[:-1] == of[1:])
            lead = np.flatnonzero(paired)
            if not len(lead):
                break
            top[lead] = self._add(top[lead], top[lead + 1], at[lead])
            keep = k % 2 == 0
            top, of, at = top[keep], of[keep], at[keep]
        self.roots, self.root_at = top, at


def _stretches(words, prefix, power, i, period, low, high):
    """From places ``i`` with ``words[i] == words[i + period]``: the ends of the stretch of such places within
    ``[low, high - period)``, by binary search over prefix hashes."""
    def same(a, length):
        b = a + period
        one = (prefix[a + length] - prefix[a]) % _MOD * power[period] % _MOD
        return one == (prefix[b + length] - prefix[b]) % _MOD

    def longest(most, start_of):
        fits, over = np.zeros(len(i), np.int64), most + 1
        while True:
            open_ = over - fits > 1
            if not open_.any():
                return fits
            mid = np.where(open_, (fits + over) // 2, fits)
            ok = same(start_of(mid), mid)
            fits, over = np.where(open_ & ok, mid, fits), np.where(open_ & ~ok, mid, over)
    ahead = longest(high - period - i, lambda k: i)
    back = longest(i - low, lambda k: i - k)
    return i - back, i + ahead


def _crossing(words, g: Grammar, exponent: int, least: int):
    """Per node, the intervals (node, start, end, period) at its own position that cross its boundary."""
    n = len(words)
    size = g.sizes[g.n_words:]
    nodes = np.flatnonzero(size >= least)
    empty = (np.zeros(0, np.int64),) * 4
    if not len(nodes):
        return empty
    # three words together, so that chance hits are rare
    three = np.arange(-n - 2, 0)
    if n >= 3:
        _, pairs = _grouped(words[:-1] * np.int64(g.n_words) + words[1:])
        _, three[:n - 2] = _grouped(pairs[:-1] * np.int64(g.n_words) + words[2:])
    powers = np.empty(n + 1, np.int64)
    powers[0] = 1
    done = 1
    while done <= n:  # doubling
        step = powers[done - 1] * _BASE % _MOD
        take = min(done, n + 1 - done)
        powers[done:done + take] = powers[:take] * step % _MOD
        done += take
    prefix = np.zeros(n + 1, np.int64)
    np.cumsum((words + 1) % _MOD * powers[:n] % _MOD, out=prefix[1:])
    found = []
    periods = size[nodes] // exponent
    block = np.cumsum(periods) // CANDIDATES
    for part in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(block)) + 1):
        count = periods[part]
        node = np.repeat(nodes[part], count)
        period = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count) + 1
        low = g.at[node]
        mid = low + g.sizes[g.left[node]]
        high = low + size[node]
        i = mid - period  # the run reaches a period to the left of the boundary ...
        j = np.maximum(i - 2, 0)
        left = (i >= low) & ((three[np.maximum(i, 0)] == three[mid]) | (i - 2 >= low) & (three[j] == three[j + period]))
        right = (mid - 1 + period < high) & (three[mid - 1] == three[np.minimum(mid - 1 + period, n - 1)])  # ... or not
        for hit, place in ((left, i), (right, mid - 1)):
            at = np.flatnonzero(hit)
            if len(at):
                a, b = _stretches(words, prefix, powers, place[at], period[at], low[at], high[at])
                end = b + period[at]
                good = (end - a >= np.maximum(least, exponent * period[at])) & (a <= place[at]) & (b > place[at])
                found.append((node[at][good], a[good], end[good], period[at][good]))
    if not found:
        return empty
    node, start, end, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, end, start, node))  # of equal intervals, only the smallest period is one
    node, start, end, period = node[order], start[order], end[order], period[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[new], start[new], end[new], period[new]


def _everywhere(g: Grammar, node, start, end, period):
    """The intervals at every position where the derivation has their node."""
    has = np.zeros(g.n_words + g.count, bool)
    has[g.n_words + node] = True
    want = has.copy()
    for a, b in g.levels:
        want[g.n_words + a:g.n_words + b] |= want[g.left[a:b]] | want[g.right[a:b]]
    first = np.searchsorted(node, np.arange(g.count))
    many = np.searchsorted(node, np.arange(g.count), side="right") - first
    sym, at, out = g.roots, g.root_at, []
    while len(sym):
        sym, at = sym[want[sym]], at[want[sym]]
        k = sym - g.n_words
        count = many[k]
        row = np.repeat(first[k] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shift = np.repeat(at - g.at[k], count)
        out.append((start[row] + shift, end[row] + shift, period[row]))
        sym, at = np.concatenate([g.left[k], g.right[k]]), np.concatenate([at, at + g.sizes[g.left[k]]])
    return tuple(np.concatenate(x) for x in zip(*out))


def _maximal(start, end, period):
    """Without the intervals inside another one of the same period; by start, then period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    group = np.cumsum(np.diff(period, prepend=-1) != 0)
    reach = np.maximum.accumulate(end + group * (int(end.max()) + 1))
    keep = np.ones(len(start), bool)
    keep[1:] = (group[1:] != group[:-1]) | (reach[1:] > reach[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_by_period(words: np.ndarray, exponent: int, least: int) -> list:
    """Runs (start, length, period) of one text by comparing it with itself at every distance."""
    n, seen, out = len(words), set(), []
    for p in range(1, n // exponent + 1):
        same = np.concatenate([[False], words[:-p] == words[p:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), (edge[1::2] + p).tolist()):
            if b - a >= max(least, exponent * p) and (a, b) not in seen:
                seen.add((a, b))
                out.append((a, b - a, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _stands(words, start, length, period) -> bool:
    end = start + length
    return bool((words[start:end - period] == words[start + period:end]).all()) \
        and (start == 0 or words[start - 1] != words[start - 1 + period]) \
        and (end == len(words) or words[end] != words[end - period])


def find_runs(texts: list, exponent: int = 4, least: int = 6) -> list:
    """For each list of words its runs ``(start, length, period)``, by start, then period."""
    known: dict = {}
    sizes = [len(t) for t in texts]
    words = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, sum(sizes))
    ends = np.cumsum(np.array(sizes, np.int64))
    out = [[] for _ in texts]
    if not len(words):
        return out
    try:
        g = Grammar(words, ends)
    except OverflowError:
        if len(texts) == 1:
            raise
        return [find_runs([t], exponent, least)[0] for t in texts]
    node, start, end, period = _crossing(words, g, exponent, least)
    if not len(node):
        return out
    start, end, period = _maximal(*_everywhere(g, node, start, end, period))
    doc = np.searchsorted(ends, start, side="right")
    first = ends - np.array(sizes)
    for d, a, b, p in zip(doc.tolist(), start.tolist(), end.tolist(), period.tolist()):
        out[d].append((a - int(first[d]), b - a, p))
    for d in np.unique(doc).tolist():
        own = words[first[d]:ends[d]]
        if not all(_stands(own, *r) for r in out[d]):
            out[d] = runs_by_period(own, exponent, least)
    return out


def collapse(words: list, runs: list) -> list:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


RUN = T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
                       T.StructField("collapsed", T.StringType())])


def _slices(texts, limit):
    part, size = [], 0
    for x in texts:
        text = x.as_py()
        if part and size + len(text or "") > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


def periodic_runs(docs: DataFrame, text_col: str = "text", min_exponent: int = 4, min_words: int = 6) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period in words, by start, then period) and ``collapsed``:
    the words, joined by one space, without those that a run repeats after its first period."""
    if min_exponent < 4 or min_words < 6:
        raise ValueError("runs of at least 4 periods and 6 words only")

    @F.arrow_udf(RESULT)
    def measured(text: pa.Array) -> pa.Array:
        n, runs, kept = [], [], []
        for part in _slices(text, SLICE_BYTES):
            texts = [words_of(t) for t in part]
            for words, found in zip(texts, find_runs(texts, min_exponent, min_words)):
                n.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                kept.append(b" ".join(collapse(words, found)))
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()),
             pa.array(runs, pa.list_(pa.struct([pa.field(x, pa.int64(), False) for x in ("start", "length", "period")]))),
             pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    own, name = RESULT.fieldNames(), free_name("__runs", docs)
    d = docs.withColumn(name, measured(F.col(q(text_col))))
    return d.select(*[F.col(q(c)) for c in docs.columns if c.lower() not in own], *[F.col(name)[x].alias(x) for x in own])


def longest_run(runs):
    """Of an array of runs, the one with the largest exact length / period (ties: smallest start, then period); null if none."""
    def better(a, b):
        one, two = a["length"] * b["period"], b["length"] * a["period"]
        return (one > two) | (one == two) & ((a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["period"] < b["period"]))
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(better(b, a), b).otherwise(a))


def repeat_tail(text, start, period):
    """The words of ``text`` joined by one space, with the words from number ``start`` on replaced by repetitions of
    the ``period`` words that begin there."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rest = F.size(words) - start
    tail = F.flatten(F.array_repeat(F.slice(words, start + 1, period), F.ceil(rest / period).cast("int")))
    return F.array_join(F.concat(F.slice(words, 1, start), F.slice(tail, 1, rest)), " ")
