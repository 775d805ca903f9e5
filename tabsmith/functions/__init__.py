from tabsmith.functions.core import (  # noqa: F401
    HASH_SPACE, c, categorical_columns, hash_bucket, is_numeric, nan_to_null,
    numeric_columns, pct, q, round_doubles, safe_div, stack_columns,
)
