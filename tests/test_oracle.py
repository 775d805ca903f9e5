"""Layer 1: every registered query against its DuckDB oracle on sf0.001
(the driver runs the same comparison on sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, digest, kind_duck, kind_spark, norm  # noqa: E402

ORACLES = E.oracle_sql()
# the training-data queries are compared in tests/llm
LLM = ("op", "pipeline")
KEYS = sorted(k for k in ORACLES if not (k.startswith(LLM) and (k == "pipeline" or k[2:3].isdigit())))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf, duck, key):
    sdf = E.queries()[key](spark, sf)
    s_schema = sorted((f.name, kind_spark(f.dataType.simpleString())) for f in sdf.schema.fields)
    names = [f.name for f in sdf.schema.fields]
    s_rows = [tuple(norm(r[n]) for n in sorted(names)) for r in sdf.collect()]
    rel = duck.sql(ORACLES[key])
    d_schema = sorted((n, kind_duck(str(t))) for n, t in zip(rel.columns, rel.types))
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    d_rows = [tuple(norm(r[i]) for i in order) for r in rel.fetchall()]
    assert s_schema == d_schema
    assert len(s_rows) == len(d_rows)
    assert digest(s_rows) == digest(d_rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 11
    assert {"feature_name", "dtype", "missing_percentage", "unique_percentage", "total_records",
            "data_quality_score"} <= set(df.columns)
