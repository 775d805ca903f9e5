"""Scalar text/JSON/array helpers as JVM column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabsmith.functions.core import c

# Patterns whose behaviour must equal the reference.
# keep word characters, hyphen, dot and space; then runs of spaces/dots -> "_".
SANITIZE_DROP = r"(?U)[^\w\-. ]"
SANITIZE_COLLAPSE = r"[ .]+"
# fenced python block, case-insensitive, dot matches newline.
PY_BLOCK = r"(?is)```python\s*(.*?)\s*```"
# fenced html blocks (all of them).
HTML_BLOCK = r"```html\s*([\s\S]*?)\s*```"
# an image path inside back-ticks.
IMAGE_REF = r"`([^`]+\.(?:png|jpg|jpeg|gif|webp))`"
# leading bullet of a list line.
BULLET_PREFIX = r"^\s*[-*+]?\s*"


def strip_ws(x: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def sanitize_name(col: Column | str) -> Column:
    x = c(col) if isinstance(col, str) else col
    return F.regexp_replace(F.regexp_replace(x, SANITIZE_DROP, ""), SANITIZE_COLLAPSE, "_")


def extract_python_code(col: Column | str) -> Column:
    """Body of the first fenced python block (trimmed) or NULL when absent."""
    x = c(col) if isinstance(col, str) else col
    has = x.rlike(PY_BLOCK)
    return F.when(has, strip_ws(F.regexp_extract(x, PY_BLOCK, 1)))


def strip_python_code(col: Column | str) -> Column:
    """The text with every fenced python block removed, trimmed."""
    x = c(col) if isinstance(col, str) else col
    return strip_ws(F.regexp_replace(x, PY_BLOCK, ""))


def extract_html_blocks(col: Column | str) -> Column:
    """All fenced html block bodies; the raw text as a one-element array when none."""
    x = c(col) if isinstance(col, str) else col
    blocks = F.regexp_extract_all(x, F.lit(HTML_BLOCK), 1)
    return F.when(F.size(blocks) > 0, blocks).otherwise(F.array(x))


def extract_image_ref(col: Column | str) -> Column:
    x = c(col) if isinstance(col, str) else col
    return F.when(x.rlike(IMAGE_REF), F.regexp_extract(x, IMAGE_REF, 1))


def clean_list_lines(col: Column | str, k: int | None = None) -> Column:
    """Split into lines, drop blank lines, strip bullet prefixes, keep the first k."""
    x = c(col) if isinstance(col, str) else col
    lines = F.split(x, "\n")
    kept = F.filter(lines, lambda s: F.length(strip_ws(s)) > 0)
    cleaned = F.transform(kept, lambda s: strip_ws(F.regexp_replace(s, BULLET_PREFIX, "")))
    return F.slice(cleaned, 1, k) if k else cleaned


def json_field(col: Column | str, path: str) -> Column:
    x = c(col) if isinstance(col, str) else col
    return F.get_json_object(x, path)


def row_to_json(cols: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[c(x) for x in cols]))
