"""Live screening: records stream in, guardrail hits stream out by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.guardrails import violations


def screen(records: DataFrame) -> DataFrame:
    """Works alike on a table and on a stream: each record with the rules it breaks."""
    return records.withColumn("rules", violations(F.col("rendered_text"), F.col("artifact_type")))


def windowed_hits(screened: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Records and violations of each window and artifact type; on streams rows later than ``late`` no longer count."""
    rows = screened.withWatermark(ts, late) if screened.isStreaming else screened
    out = rows.groupBy(F.window(ts, width).alias("w"), "artifact_type").agg(F.count("*").alias("n"), F.count_if(F.size("rules") > 0).alias("violations"))
    return out.select(F.col("w.start").alias("window_start"), "artifact_type", "n", "violations")
