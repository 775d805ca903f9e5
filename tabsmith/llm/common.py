"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.core import q

# A word is a run of code points other than space and U+0009..U+000D.
# ``bytes.split()`` cuts at exactly these, so Python code splits the UTF-8 bytes.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(col):
    """Number of words of a text column (null: 0), in the JVM."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes (null: none)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, under the same names (quoted, so dots are safe)."""
    return df.select(*[F.col(q(c)) for c in cols])


def free_name(name: str, *frames: DataFrame) -> str:
    """A column name made from ``name`` that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(batch, column: str, max_bytes: int):
    """Cut an Arrow batch into slices with about ``max_bytes`` of text each
    (a slice has one row at least), to bound a worker's memory."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes.astype(np.int64)) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
