"""The domain's frames as projections of the given tables. All of them are lazy and column-pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading a row: series_id, product, reading_c and the attributes of the series."""
    events = table(spark, sf_dir, "events")
    out = events.select(
        F.col("user_id").alias("series_id"),
        "event_id",
        "ts",
        F.expr("CASE user_id % 4 WHEN 0 THEN 'finfish_seafood' WHEN 1 THEN 'table_eggs' WHEN 2 THEN 'chilled_dairy' ELSE 'frozen_goods' END").alias("product"),
        F.expr("CASE WHEN event_type = 'error' AND value < 2 THEN -99.9D WHEN user_id % 4 = 3 THEN value / 25D - 22D ELSE value / 25D END").alias("reading_c"),
    )
    return out.withColumns(
        {
            "missing": F.expr("series_id % 13 = 0"),
            "sensor_fault": F.expr("series_id % 7 = 0"),
            "peak_season": F.expr("series_id % 5 = 0"),
            "days_since_production": F.expr("CASE WHEN series_id % 17 <> 0 THEN series_id % (CASE series_id % 4 WHEN 0 THEN 8 WHEN 1 THEN 31 WHEN 2 THEN 13 ELSE 183 END) END"),
        }
    )


#: The product and the fault mode of a record.
CELL = (
    "concat(CASE doc_id % 4 WHEN 0 THEN 'finfish_seafood' WHEN 1 THEN 'table_eggs' WHEN 2 THEN 'chilled_dairy' ELSE 'frozen_goods' END, '|',"
    " CASE doc_id div 4 % 5 WHEN 0 THEN 'in_spec' WHEN 1 THEN 'door_open' WHEN 2 THEN 'compressor_fail' WHEN 3 THEN 'setpoint_drift' ELSE 'sensor_artifact' END)"
)
#: Text added to some rows so that every guardrail rule has cases.
_INJECTED = "CASE WHEN doc_id % 29 = 0 THEN ' product_code=x1' WHEN doc_id % 31 = 0 THEN ' we recommend expedite sale now' WHEN doc_id % 12 = 0 THEN ' 2026-07-22 09:' ELSE '' END"


def generation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated record a row, as the record funnel leaves it."""
    docs = table(spark, sf_dir, "documents")
    return docs.selectExpr(
        "doc_id",
        "doc_id % 8 + 1 AS wave",
        f"{CELL} AS cell",
        "lang AS language",
        "CASE doc_id % 4 WHEN 0 THEN 'logger_csv' WHEN 1 THEN 'chat_message' WHEN 2 THEN 'qc_form_ocr' ELSE 'voice_note' END AS artifact_type",
        "CASE doc_id % 6 WHEN 0 THEN 'AE' WHEN 1 THEN 'SA' WHEN 2 THEN 'QA' WHEN 3 THEN 'KW' WHEN 4 THEN 'OM' ELSE 'BH' END AS jurisdiction",
        "CASE doc_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'hold_for_qa' ELSE 'reject' END AS disposition",
        "CASE doc_id % 5 WHEN 0 THEN ' consistent ' WHEN 1 THEN 'INCONSISTENT' WHEN 2 THEN 'leaks_label' WHEN 3 THEN 'Consistent' ELSE 'maybe' END AS screener_reply",
        "doc_id % 10 = 0 AS is_adversarial",
        "doc_id % 11 <> 0 AS round_trip_ok",
        "CASE WHEN doc_id % 19 = 0 THEN NULL ELSE (n_chars % 100) / 100D END AS confidence",
        f"concat(coalesce(text, ''), {_INJECTED}) AS rendered_text",
    )
