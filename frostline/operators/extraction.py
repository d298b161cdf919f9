"""Checks of extracted records: JSON in model replies, its schema, and the round trip against the source series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .planning import PRODUCTS

# Fixed value: readings may differ by less than so many degrees.
TOLERANCE_C = 1.5
#: Code points of stored texts, of rationales and of texts for review.
STORED, RATIONALE, REVIEWED = 4000, 2000, 3000
#: Severity from which a category is unsafe.
UNSAFE = 4

_NUMBER = r"(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+,\d+\))"


def json_slice(reply: Column) -> Column:
    """From the first brace to the last one; null where there is none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))


def with_schema_check(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds v (the parsed slice, a variant) and schema_valid: required keys are there, and every key has a type it may have."""
    out = rows.withColumn("v", F.try_parse_json(json_slice(F.col(reply))))
    kind = lambda key: F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant"))
    null_or = lambda key, ok: (kind(key) == "VOID") | ok
    absent_or = lambda key, ok: kind(key).isNull() | ok
    text = F.try_variant_get("v", "$.product", "string")
    items = F.try_variant_get("v", "$.readings_c", "array<string>")
    number = lambda key: kind(key).rlike(f"^{_NUMBER}$")
    whole = lambda key: number(key) & (F.try_variant_get("v", f"$.{key}", "double") % 1 == 0)
    numbers = (kind("readings_c").rlike(f"^ARRAY<{_NUMBER}>$") & ~F.exists(items, lambda x: x.isNull())) | (F.size(items) == 0)
    words = kind("missing_fields").rlike("^ARRAY<STRING>$") | (F.size(F.try_variant_get("v", "$.missing_fields", "array<string>")) == 0)
    checks = [
        null_or("product", (kind("product") == "STRING") & text.isin(*PRODUCTS)),
        null_or("readings_c", numbers),
        null_or("interval_min", whole("interval_min")),
        absent_or("ambient_c", null_or("ambient_c", number("ambient_c"))),
        absent_or("days_since_production", null_or("days_since_production", whole("days_since_production"))),
        absent_or("peak_season", null_or("peak_season", kind("peak_season") == "BOOLEAN")),
        absent_or("missing_fields", words),
    ]
    valid = F.lit(True)
    for c in checks:
        valid = valid & F.coalesce(c, F.lit(False))
    return out.withColumn("schema_valid", valid & F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))


def round_trip(product: Column, readings: Column, missing_fields: Column, got_product: Column, got: Column) -> Column:
    """A struct (passed, confidence): ranges of both series compared, not positions."""
    empty = F.coalesce(F.size(got) == 0, F.lit(True)) | got.isNull()
    none = readings.isNull() | (F.size(readings) == 0)
    told = lambda ok: F.struct(ok.alias("passed"), ok.cast("double").alias("confidence"))
    low, high = F.abs(F.array_min(readings) - F.array_min(got)), F.abs(F.array_max(readings) - F.array_max(got))
    near = F.struct(((low < TOLERANCE_C) & (high < TOLERANCE_C)).alias("passed"), F.greatest(F.lit(0.0), 1.0 - (low + high) / (2 * TOLERANCE_C)).alias("confidence"))
    same = F.coalesce(product == got_product, F.lit(False))
    return F.when(~same, told(F.lit(False))).when(F.array_contains(missing_fields, "readings_c"), told(empty)).when(none | empty, told(none & empty)).otherwise(near)


def is_safe(categories: Column) -> Column:
    """No category's severity reaches UNSAFE; a null severity is 0."""
    return F.forall(F.coalesce(categories, F.array().cast("array<struct<category:string,severity:int>>")), lambda c: F.coalesce(c["severity"], F.lit(0)) < UNSAFE)


def with_full_outcome(rows: DataFrame, floor: float = 0.6) -> DataFrame:
    """The whole cascade over columns error, safe, verdict, rules, schema_valid, round_trip_ok, confidence.

    The first check that fails names the outcome; what a record did not reach is null.
    """
    outcome = (
        F.when(F.col("error"), "dropped_error").when(~F.col("safe"), "dropped_safety").when(F.col("verdict") != "CONSISTENT", "dropped_screener")
        .when(F.size("rules") > 0, "dropped_guardrail").when(~F.coalesce("schema_valid", F.lit(False)), "dropped_schema")
        .when(~F.coalesce("round_trip_ok", F.lit(False)), "dropped_roundtrip").when(F.coalesce("confidence", F.lit(0.0)) < floor, "dropped_low_confidence").otherwise("kept")
    )
    out = rows.withColumn("outcome", outcome)
    stage = F.array_position(F.array(*map(F.lit, ("dropped_error", "dropped_safety", "dropped_screener", "dropped_guardrail", "dropped_schema", "dropped_roundtrip", "dropped_low_confidence", "kept"))), F.col("outcome"))
    reached = {"verdict": 3, "schema_valid": 5, "round_trip_ok": 6, "confidence": 6}
    return out.withColumns({c: F.when(stage >= n, F.col(c)) for c, n in reached.items()})
