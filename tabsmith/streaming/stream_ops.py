"""Structured Streaming reuse of the batch operators (survey section 2.12).

The reference has no streams; these are the two natural extensions: a
windowed, watermarked resample (A29) and stateless batch scoring (M16) on a
``readStream`` source.  Both reuse the batch expressions unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import c
from tabsmith.session import scratch_path


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int = 64) -> DataFrame:
    """File stream over Parquet files (schema declared: no inference on streams)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def windowed_resample(stream: DataFrame, ts: str, value: str, every: str = "1 day", watermark: str = "1 day",
                      how: str = "mean", by: tuple[str, ...] = ()) -> DataFrame:
    """Event-time tumbling windows with a watermark: late rows older than the
    watermark are dropped and window state is evicted once it passes."""
    t = c(ts).cast("timestamp")
    agg = F.avg(c(value).cast("double")) if how == "mean" else F.sum(c(value).cast("double"))
    return (stream.withColumn("__t", t).withWatermark("__t", watermark)
            .groupBy(F.window("__t", every), *[c(b) for b in by])
            .agg(agg.alias(value), F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("period"), *[c(b) for b in by], value, "n"))


def score_stream(stream: DataFrame, model, prep, target: str | None = None) -> DataFrame:
    """Stateless scoring of each micro-batch with a fitted pipeline."""
    from tabsmith.ml.models import predict
    return predict(model, prep, stream, target)


def run_available_now(stream_result: DataFrame, output_mode: str = "complete", name: str | None = None) -> DataFrame:
    """Process everything available, then stop; return the result as a batch
    DataFrame.  The memory sink keeps the (small, per-window) aggregate on the
    driver; the checkpoint lives in the shared checkpoint folder."""
    spark = stream_result.sparkSession
    qname = name or f"tabsmith_stream_{uuid.uuid4().hex[:8]}"
    q = (stream_result.writeStream.format("memory").queryName(qname).outputMode(output_mode)
         .option("checkpointLocation", scratch_path(spark, f"stream-{qname}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(qname)
