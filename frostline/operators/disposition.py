"""Dispositions of temperature series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.rules import INTERVAL_MIN, RULES, clean_readings, first_rule, is_out_of_band, is_sentinel, product_specs

SPECS = ("min_c", "max_c", "refreeze_c", "hold_min", "reject_min", "shelf_days")


def _with_specs(rows: DataFrame, specs: DataFrame | None, by: tuple[str, ...]) -> DataFrame:
    """Rows with the bounds of their product. The four built-in specs are broadcast; loaded ones come as the caller marks them."""
    specs = F.broadcast(product_specs(rows.sparkSession)) if specs is None else specs
    return rows.join(specs.select(*by, *SPECS) if "clause" in specs.columns else specs, list(by), "left")


def label_series(readings: DataFrame, *keys: str, specs: DataFrame | None = None, by: tuple[str, ...] = ("product",), rules: tuple = RULES) -> DataFrame:
    """One row for each series: aggregates of its readings and the rule that decides. ``days_since_production`` may be null.

    Rules that read no temperatures report none: no peak, no minutes and no shelf life for an unknown product or
    missing fields; where all readings are sentinels only their number.

    specs: bounds from elsewhere, one row for each value of the columns ``by``, such as those of loaded packs.
    One shuffle on the keys with partial sums.
    """
    r = _with_specs(readings, specs, by)
    clean = ~is_sentinel(F.col("reading_c"))
    per = r.groupBy(*keys, "product", "min_c", "max_c", "refreeze_c", "hold_min", "reject_min", "shelf_days").agg(
        F.count("*").alias("n_readings"),
        F.count_if(~clean).alias("n_excluded"),
        F.max(F.when(clean, F.col("reading_c"))).alias("peak_c"),
        (F.count_if(clean & is_out_of_band(F.col("reading_c"))) * INTERVAL_MIN).alias("excursion_min"),
        F.bool_or("missing").alias("missing"),
        F.bool_or("sensor_fault").alias("sensor_fault"),
        F.bool_or("peak_season").alias("peak_season"),
        F.max("days_since_production").alias("days_since_production"),
    )
    return decided(per, rules).select(*keys, *LABEL_COLUMNS)


LABEL_COLUMNS = ("product", "n_readings", "n_excluded", "peak_c", "excursion_min", "remaining_days", "disposition", "rule_id")


def decided(per: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Adds the deciding rule to aggregates of series and blanks what that rule does not report."""
    per = per.withColumn("remaining_days", F.col("shelf_days") - F.col("days_since_production")).withColumn("label", first_rule(rules))
    rule = F.col("label.rule_id")
    unread = rule.isin("R000_unknown_product", "R001_missing_fields")
    blank = unread | (rule == "R002_all_readings_sentinel")
    out = per.withColumns({"disposition": F.col("label.disposition"), "rule_id": rule})
    return out.withColumns(
        {
            "n_excluded": F.when(unread, F.lit(0)).otherwise(F.col("n_excluded")),
            "excursion_min": F.when(blank, F.lit(0)).otherwise(F.col("excursion_min")),
            "peak_c": F.when(~blank, F.col("peak_c")),
            "remaining_days": F.when(~blank, F.col("remaining_days")),
        }
    )


def label_states(states: DataFrame, specs: DataFrame | None = None, by: tuple[str, ...] = ("product",), rules: tuple = RULES) -> DataFrame:
    """The same for rows that hold whole series: product, readings_c, missing_fields (arrays, null: empty), interval_min,
    days_since_production, sensor_fault, peak_season. Adds the label's columns; no shuffle."""
    s = _with_specs(states, specs, by)
    readings = F.coalesce("readings_c", F.array().cast("array<double>"))
    s = s.withColumn("clean", clean_readings(readings)).withColumn("n_readings", F.size(readings).cast("long"))
    s = s.withColumns(
        {
            "n_excluded": F.col("n_readings") - F.size("clean"),
            "peak_c": F.array_max("clean"),
            "excursion_min": F.size(F.filter("clean", is_out_of_band)) * F.coalesce("interval_min", F.lit(INTERVAL_MIN)),
            "missing": F.coalesce(F.size("missing_fields") > 0, F.lit(False)),
        }
    )
    return decided(s, rules).select(*states.columns, *(c for c in LABEL_COLUMNS if c not in states.columns))
