"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the code points cuts each text where its value says so
(moved to the next white space, which begins the next chunk), so a passage that documents share is cut alike in
all of them; a chunk is encoded once by a worker and found again by its text.
For tokenizers that drop white space, the pieces between the spaces of a new
chunk are reused in the same way: the library only sees pieces that a worker
hasn't met.  A word and the marks after it are reused apart only where the
tokenizer also parts them: its own normaliser and pre-tokenizer decide, since a
word that ends in a letter can end in a combining mark once normalised.

Chunks are encoded apart, so every join is checked: the words at both sides of
it are encoded as one string, and where its ids differ from those of its parts,
the string is widened until both ends agree with the ids encoded apart (at the
latest: the two whole chunks), and its ids replace theirs.  Results are those
of encoding the whole text.

The job is one pass over the texts without a shuffle, so the reuse holds within
a worker (its caches live as long as it does, and are bounded in entries and in
bytes; an evicted entry is encoded again, and one of more than ``LARGEST`` bytes
isn't kept at all).  Sharing chunks between workers would shuffle
every chunk's text and ids, several times the input.

Decoding joins the vocabulary's strings of the ids, as the library does for a
tokenizer without a decoder part; for others the library's decode is called.

Edge cases: a null text counts as empty and gives no ids and an empty text;
very long texts are cut like others (a text without white space is one chunk,
encoded as a whole and not kept); a batch is worked on in slices of
``SLICE_BYTES``; special tokens' strings in a text become their ids, as in the
library's default.
"""

import os
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import q
from tabsmith.llm.common import text_slices

SLICE_BYTES = 4 << 20
WINDOW = 16                    # code points the rolling hash looks at
GROUP = 64                     # words encoded as one string
MEAN_CHUNK = 1024              # code points between cuts, on average
PIECES = 600_000               # pieces,
CHUNKS = 8_000                 # chunks and windows a worker remembers
PIECE_BYTES, CHUNK_BYTES = 128 << 20, 48 << 20  # and their bytes, about
LARGEST = 64 << 10             # bytes of the largest entry that is kept
SPACE = re.compile("[ \\t-\\r]")
MARKS = ".,;:!?"               # marks that a word may be followed by
_BASE = 0x01000193


def chunk_ends(text: str, mean: int = MEAN_CHUNK) -> list[int]:
    """Where chunks end: at the first white space after a window whose rolling hash is 0 modulo ``mean``."""
    if len(text) < 2 * WINDOW:
        return [len(text)]
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # polynomial hash of every window, by doubling: h(2w) = h(w) * B^w + h(w) shifted by w
    h, width = x, 1
    while width < WINDOW:
        h = h[:-width] * np.uint32(pow(_BASE, width, 1 << 32)) + h[width:]
        width *= 2
    hits = np.flatnonzero((h >> np.uint32(8)) % np.uint32(mean) == 0) + WINDOW
    ends, at = [], 0
    for hit in hits.tolist():
        if hit >= at:
            found = SPACE.search(text, hit)
            if found is None:
                break
            at = found.start()
            ends.append(at)
    return [*ends, len(text)]


class Cache:
    """The last ``most / 2`` to ``most`` entries used, of about ``size`` bytes at most: a young and an old half.

    When the young half is full it becomes the old one, and what was old and
    not asked for since is forgotten (to be computed again if it comes back)."""

    def __init__(self, most: int, size: int):
        self.half, self.young, self.old = most // 2, {}, {}
        self.half_size, self.size = size // 2, 0  # of the young half

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        size = sys.getsizeof(key) + sys.getsizeof(value) + 100  # and its place in the table
        if size > LARGEST:
            return
        if len(self.young) >= self.half or self.size + size > self.half_size:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = value
        self.size += size


class Codec:
    """A tokenizer with its caches; ids travel as 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain_decoder = self.tokenizer.decoder is None
        # whether white space only separates, and words end before marks, so that a chunk's ids are those of its pieces
        plain = not any(set(t.content) & set(MARKS + " \n") for t in self.tokenizer.get_added_tokens_decoder().values())
        self.spaceless = plain and self.raw([" a1\n  b, \né. c?! "])[0] == b"".join(
            self.raw(["a1", "b", ",", "é", ".", "c", "?!"]))
        self.pieces = Cache(PIECES, PIECE_BYTES)
        self.chunks, self.joins = Cache(CHUNKS, CHUNK_BYTES), Cache(CHUNKS, CHUNK_BYTES)
        self.parted = {}  # last characters of words: whether marks after them are pieces of their own
        of = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.tokens = [of.get(i, "") for i in range(max(of) + 1)]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.array([bool(suffix) and t.endswith(suffix) for t in self.tokens])

    def raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in found]

    def raw_pieces(self, pieces: list[str]) -> list[bytes]:
        """``raw``, with words of letters encoded many to a string: where the tokenizer marks the last token of a
        word, the ids are parted there again; if there aren't as many ends as words, each is encoded on its own."""
        if not self.last.any():
            return self.raw(pieces)
        words = [p for p in pieces if p.isalpha()]
        groups = [words[k:k + GROUP] for k in range(0, len(words), GROUP)]
        found = {}
        for group, ids in zip(groups, self.raw([" ".join(g) for g in groups])):
            ends = (np.flatnonzero(self.last[np.frombuffer(ids, np.uint32)]) + 1) * 4
            if len(ends) == len(group) and ends[-1] == len(ids):
                cuts = [0, *ends.tolist()]
                found.update((w, ids[a:b]) for w, a, b in zip(group, cuts, cuts[1:]))
        rest = [p for p in pieces if p not in found]
        found.update(zip(rest, self.raw(rest)))
        return [found[p] for p in pieces]

    def known(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of chunks (or parts of chunks between spaces): each distinct one is encoded once, from its pieces."""
        ids = {t: self.chunks.get(t) for t in texts}
        new = [t for t, found in ids.items() if found is None]
        if self.spaceless:
            young = self.pieces.young
            parts = [t.replace("\n", " ").split(" ") for t in new]
            found = [list(map(young.get, ps)) for ps in parts]
            gaps = {p: None for ps, got in zip(parts, found) if None in got for p, x in zip(ps, got) if x is None}
            self.fill(gaps)
            for ps, got in zip(parts, found):
                if None in got:
                    got[:] = [gaps[p] if x is None else x for p, x in zip(ps, got)]
            made = list(map(b"".join, found))
        else:
            made = self.raw(new)
        for t, found in zip(new, made):
            ids[t] = found
            self.chunks.put(t, found)
        return ids

    def ends_before_marks(self, word: str) -> bool:
        """Whether the normalised word ends in a character that the tokenizer parts from any mark after it."""
        last = word[-1:]
        if not last.isalpha():
            return False
        if not last.isascii() and self.tokenizer.normalizer:
            last = self.tokenizer.normalizer.normalize_str(word)[-1:]
        if last not in self.parted:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.parted[last] = bool(last) and all(len(cut(last + m)) == 2 for m in MARKS)
        return self.parted[last]

    def fill(self, gaps: dict) -> None:
        """Ids of pieces that aren't among the young; a word and the marks after it are looked up apart."""
        recall = self.pieces.get
        bare = {}
        for p in gaps:
            if (found := recall(p)) is None and (word := p.rstrip(MARKS)) != p and self.ends_before_marks(word):
                bare[p] = (word, p[len(word):])
            gaps[p] = found
        want = {p: None for p, found in gaps.items() if found is None and p not in bare}
        for pair in bare.values():
            want.update((x, found) for x in pair if x not in want and ((found := recall(x)) or True))
        missing = [p for p, found in want.items() if found is None]
        for p, found in zip(missing, self.raw_pieces(missing)):
            want[p] = found
            self.pieces.put(p, found)
        for p, found in gaps.items():
            if found is None:
                gaps[p] = want[p] if p not in bare else want[bare[p][0]] + want[bare[p][1]]
                if p in bare:
                    self.pieces.put(p, gaps[p])

    def windows(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of strings across joins, encoded as one string each."""
        ids = {t: self.joins.get(t) for t in texts}
        new = [t for t, found in ids.items() if found is None]
        for t, found in zip(new, self.raw(new)):
            ids[t] = found
            self.joins.put(t, found)
        return ids

    def repair(self, left: str, right: str) -> bytes:
        """Ids of two neighbouring chunks that can't be encoded apart.

        The window over the join is widened until doing so adds just the ids
        that the added text has when encoded apart, or to both chunks."""
        n, before = 1, None
        while True:
            a, b = tail(left, n), head(right, n)
            whole = self.raw([left[a:] + right[:b]])[0]
            if before is not None:
                a0, b0, inner = before
                one, two = self.raw([left[a:a0], right[b0:b]])
                if whole == one + inner + two:
                    one, two = self.raw([left[:a0], right[b0:]])
                    return one + inner + two
            if a == 0 and b == len(right):
                return whole
            n, before = 2 * n, (a, b, whole)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        split = []
        for text in texts:
            ends = chunk_ends(text)
            split.append([text[a:b] for a, b in zip([0, *ends], ends)])
        ids = self.known([p for parts in split for p in parts])
        seams = {(left, right): (left[tail(left, 1):], right[:head(right, 1)])
                 for parts in split for left, right in zip(parts, parts[1:])}
        sides = self.known([s for pair in seams.values() for s in pair])
        whole = self.windows([a + b for a, b in seams.values()])
        good = {key: whole[a + b] == sides[a] + sides[b] for key, (a, b) in seams.items()}
        out = []
        for parts in split:
            at, done = parts[0], [ids[parts[0]]]
            for last, part in zip(parts, parts[1:]):
                if good[last, part]:
                    at = part
                    done.append(ids[part])
                else:  # the repaired pair is one chunk from here on
                    done[-1] = self.repair(at, part)
                    at += part
            out.append(np.frombuffer(b"".join(done), np.uint32))
        return out

    def decode(self, ids) -> str:
        """The text of a list of ids, special tokens included."""
        if not self.plain_decoder:
            return self.tokenizer.decode(list(ids), skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids))


def tail(text: str, n: int) -> int:
    """Where the last ``n`` words of a chunk begin, at a space or its start."""
    at = len(text)
    for _ in range(n):
        at = text.rfind(" ", 0, at)
        if at <= 0:
            return 0
    return at


def head(text: str, n: int) -> int:
    """Where the first ``n`` words of a chunk end, before a space (its first character doesn't count) or at its end."""
    at = 0
    for _ in range(n):
        at = text.find(" ", at + 1)
        if at < 0:
            return len(text)
    return at


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a tokenizer file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids",
           decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of its whole texts (``array<int>``) and, if a name is given, the text decoded from them."""
    columns = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    base = docs.select(*[F.col(q(c)) for c in columns])

    def run(batches):
        tool = codec(tokenizer_path)
        for batch in batches:
            for part in text_slices(batch, text_col, SLICE_BYTES):
                ids = tool.encode([t or "" for t in part.column(text_col).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids).astype(np.int32))
                made = [pa.ListArray.from_arrays(pa.array(offsets), values)]
                if decoded_col:
                    made.append(pa.array([tool.decode(i.tolist()) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*columns, ids_col, *([decoded_col] if decoded_col else [])])

    made = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + [T.StructField(decoded_col, T.StringType())] * bool(decoded_col)
    return base.mapInArrow(run, T.StructType([*base.schema.fields, *made]))


def decode(docs: DataFrame, tokenizer_path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the text of a column of ids (null: empty)."""
    @F.arrow_udf(T.StringType())
    def decoded(ids: pa.Array) -> pa.Array:
        tool = codec(tokenizer_path)
        return pa.array([tool.decode(i.as_py() or []) for i in ids], pa.string())

    return docs.withColumn(name, decoded(F.col(q(ids_col))))


def digests(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``."""
    ids = F.col(q(ids_col))
    return encoded.select(
        F.col(q(id_col)).alias(id_col), F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", ids.cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col(q(decoded_col)), 256).alias("decoded_sha256"))
