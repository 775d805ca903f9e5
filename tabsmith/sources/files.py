"""File, JDBC and in-memory sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import c, nan_to_null

# Tokens pandas reads as missing by default.
PANDAS_NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                    "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
             multiline: bool = False, na_tokens: Iterable[str] = PANDAS_NA_TOKENS, **options) -> DataFrame:
    """CSV scan with a header.

    Splittable (``multiLine`` off) files are cut into splits of
    ``spark.sql.files.maxPartitionBytes`` and read in parallel.  Prefer an explicit ``schema`` at scale:
    inferring types costs one extra pass over the files.  Missing-value tokens
    and float NaN become NULL, before types are inferred.  ``multiline`` reads
    quoted line breaks; such files aren't cut into splits.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    reader = reader.option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.csv(path)
    df = df.toDF(*[x.strip() for x in df.columns])  # T7: trim header names
    tokens = list(na_tokens)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    df = df.withColumns({x: F.when(~c(x).isin(tokens), c(x)) for x in texts})
    return nan_to_null(df if schema is not None else infer_text_types(df))


def infer_text_types(df: DataFrame) -> DataFrame:
    """Text columns whose every value parses as one type get it (whole numbers,
    numbers, true/false, dates, timestamps, in this order); one aggregate."""
    kinds = ("int", "bigint", "double", "boolean", "date", "timestamp")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    fits = {"date": lambda v: v.rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$") & v.try_cast("date").isNotNull(),
            "timestamp": lambda v: v.rlike(r"^\s*\d{4}-\d{2}-\d{2}[ T]") & v.try_cast("timestamp").isNotNull()}
    def aggs(left):
        return [F.bool_and(fits.get(k, lambda v, k=k: v.try_cast(k).isNotNull())(c(texts[i])) | c(texts[i]).isNull()).alias(f"{k}{i}")
                for i, k in left]

    cells = [(i, k) for i in range(len(texts)) for k in kinds]
    # a type that one of the first rows refutes is not tried on the others; all rows must fit the chosen one
    few = df.limit(200).agg(*aggs(cells)).first()
    left = [(i, k) for i, k in cells if few[f"{k}{i}"] is not False]
    r = df.agg(*aggs(left), *[F.count(c(x)).alias(f"n{i}") for i, x in enumerate(texts)]).first().asDict()
    chosen = {x: next((k for k in kinds if r.get(f"{k}{i}")), None) for i, x in enumerate(texts) if r[f"n{i}"]}
    return df.withColumns({x: c(x).try_cast(k) for x, k in chosen.items() if k})


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite", rows_per_file: int | None = None) -> None:
    """CSV sink with a header and no index (S3/S11).  One file only on request:
    ``coalesce(1)`` funnels all rows through one task.  ``rows_per_file`` bounds
    files that hold quoted line breaks: each of those is read by one task."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode(mode).option("header", True).option("escape", '"')
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Iterable[str] = ()) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def materialize_once(df: DataFrame, path: str) -> DataFrame:
    """Write the cleaned version only if absent, then read it back.

    ``mode('ignore')`` keeps an existing table; readers always get the stored copy.
    """
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_sql_query(spark: SparkSession, url: str, query: str | None = None, table: str | None = None,
                   properties: Mapping[str, str] | None = None, partition_column: str | None = None,
                   lower_bound: int | None = None, upper_bound: int | None = None,
                   num_partitions: int | None = None) -> DataFrame:
    """Relational source.  A ``query`` is read by one task; a ``table``
    with a numeric ``partition_column`` and bounds is read by ``num_partitions``
    parallel range queries."""
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if query is not None:
        if partition_column:
            raise ValueError("partition_column needs table=, not query=")
        return r.option("query", query).load()
    r = r.option("dbtable", table)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
             .option("upperBound", upper_bound).option("numPartitions", num_partitions or 8))
    return r.load()


def from_records(spark: SparkSession, records: list[dict], schema: T.StructType | str | None = None) -> DataFrame:
    """A (small) list of dicts as a table.  For volume, use ``from_json_lines``."""
    return spark.createDataFrame(records, schema=schema)


def from_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S8 at scale: JSON-lines files with a declared schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def list_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Registered tables with their row and column counts.

    One counting job per table, results unioned; no data leaves the executors
    except the counts."""
    parts = []
    for name, df in tables.items():
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count"))
                     .select(F.lit(name).alias("table_name"),
                             F.lit(len(df.columns)).alias("column_count"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
