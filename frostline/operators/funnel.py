"""The record funnel: the ordered checks that keep or drop a generated record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.guardrails import screener_verdict, violations

# Fixed value: the least confidence of a kept record.
CONFIDENCE_FLOOR = 0.6


def with_outcome(log: DataFrame) -> DataFrame:
    """Adds verdict, rules and outcome; the first check that fails names the outcome."""
    out = log.withColumn("verdict", screener_verdict(F.col("screener_reply")))
    out = out.withColumn("rules", violations(F.col("rendered_text"), F.col("artifact_type")))
    outcome = (
        F.when(F.col("verdict") != "CONSISTENT", "dropped_screener")
        .when(F.size("rules") > 0, "dropped_guardrail")
        .when(~F.col("round_trip_ok"), "dropped_roundtrip")
        .when(F.coalesce("confidence", F.lit(0.0)) < CONFIDENCE_FLOOR, "dropped_low_confidence")
        .otherwise("kept")
    )
    return out.withColumn("outcome", outcome)
