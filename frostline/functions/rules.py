"""Column expressions of the disposition rules: product bounds, sentinels and the ordered rule table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Product, minimum C, maximum C, refreeze flag C, hold minutes, reject minutes, shelf days.
PRODUCTS = (
    ("finfish_seafood", 0.0, 4.0, None, 60, 180, 5),
    ("table_eggs", 0.0, 5.0, None, 240, 720, 28),
    ("chilled_dairy", 0.0, 5.0, None, 90, 240, 10),
    ("frozen_goods", None, -18.0, -12.0, 30, 120, 180),
)
# Bands (minimum C, maximum C, refreeze flag C) and the band of each product.
BANDS = (("chilled_fresh_seafood", 0.0, 4.0, None), ("chilled_general", 0.0, 5.0, None), ("frozen", None, -18.0, -12.0))
PRODUCT_BANDS = (("finfish_seafood", "chilled_fresh_seafood", 60, 180, 5), ("table_eggs", "chilled_general", 240, 720, 28), ("chilled_dairy", "chilled_general", 90, 240, 10), ("frozen_goods", "frozen", 30, 120, 180))
#: The flag of a frozen band that names none.
REFREEZE_DEFAULT_C = -12.0
# Sentinels of any signal, from which 0.0 is taken out for temperatures, and the bounds from which a reading can't be a temperature.
ALL_SENTINELS = (-99.9, -999.0, 999.0, 0.0)
SENTINELS = (-99.9, -999.0, 999.0)
SENTINEL_LOW, SENTINEL_HIGH = -50.0, 80.0
SENTINEL_SHARE = 0.02
INTERVAL_MIN = 15


def product_specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRODUCTS, "product string, min_c double, max_c double, refreeze_c double, hold_min int, reject_min int, shelf_days int")


def specs_from_bands(bands: DataFrame, products: DataFrame) -> DataFrame:
    """Product specs from bands (band, min_c, max_c, refreeze_c) and products (product, band, hold_min, reject_min, shelf_days)."""
    refreeze = F.when(F.col("band") == "frozen", F.coalesce("refreeze_c", F.lit(REFREEZE_DEFAULT_C)))
    return products.join(F.broadcast(bands), "band").select("product", "min_c", "max_c", refreeze.alias("refreeze_c"), "hold_min", "reject_min", "shelf_days")


def bands_from_json(raw: DataFrame) -> DataFrame:
    """Bands from rows (name, spec), spec being JSON text: range_c gives both bounds, else max_c; specs that are no objects go."""
    v = raw.select(F.col("name").alias("band"), F.try_parse_json("spec").alias("v")).where(F.expr("schema_of_variant(v) LIKE 'OBJECT%'"))
    got = lambda path: F.try_variant_get("v", path, "double")
    ranged = F.try_variant_get("v", "$.range_c", "array<double>")
    return v.select("band", F.get(ranged, F.lit(0)).alias("min_c"), F.coalesce(F.get(ranged, F.lit(1)), got("$.max_c")).alias("max_c"), got("$.refreeze_flag_c").alias("refreeze_c"))


def bands_of_packs(packs: DataFrame, *keys: str) -> DataFrame:
    """(keys, band, min_c, max_c, refreeze_c, basis) of loaded packs (keys, v): every object under temperature_bands, whatever
    its name. range_c gives both bounds, else max_c the upper one; values that are no objects are notes, not bands."""
    spark = packs.sparkSession
    each = packs.select(*keys, F.try_variant_get("v", "$.temperature_bands", "variant").alias("bands"))
    each = each.lateralJoin(spark.tvf.variant_explode(F.col("bands").outer())).where(F.expr("schema_of_variant(value) LIKE 'OBJECT%'"))
    got = lambda path, kind="double": F.try_variant_get("value", path, kind)
    ranged = got("$.range_c", "array<double>")
    return each.select(
        *keys, F.col("key").alias("band"), F.get(ranged, F.lit(0)).alias("min_c"), F.coalesce(F.get(ranged, F.lit(1)), got("$.max_c")).alias("max_c"),
        got("$.refreeze_flag_c").alias("refreeze_c"), F.coalesce(got("$.basis", "string"), F.lit("")).alias("basis"),
    )


def specs_of_packs(bands: DataFrame, *keys: str, products: tuple = PRODUCT_BANDS) -> DataFrame:
    """Product specs under each pack's bands; a pack without the band of a product fails the task.

    The frozen band's refreeze flag has a default; other bands have none. Products are a handful of literals.
    """
    rows = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(p, ("product", "band", "hold_min", "reject_min", "shelf_days"), strict=True))) for p in products))
    wanted = bands.select(*keys).distinct().select(*keys, F.explode(rows).alias("p")).select(*keys, "p.*")
    found = wanted.join(bands.withColumn("found", F.lit(True)), [*keys, "band"], "left")
    problem = F.raise_error(F.concat(F.lit("no temperature band "), F.col("band"))).cast("double")
    refreeze = F.when(F.col("band") == "frozen", F.coalesce("refreeze_c", F.lit(REFREEZE_DEFAULT_C)))
    lowest = F.when(F.col("band") != "frozen", F.col("min_c"))
    return found.select(*keys, "product", lowest.alias("min_c"), F.when(F.col("found"), F.col("max_c")).otherwise(problem).alias("max_c"), refreeze.alias("refreeze_c"), "hold_min", "reject_min", "shelf_days", F.col("basis").alias("clause"))


def temperature_sentinels(values: Column) -> Column:
    """A sentinel set for temperatures: 0.0 is a reading there."""
    return F.array_except(values, F.array(F.lit(0.0)))


def clean_readings(readings: Column) -> Column:
    """The readings of an array that are no sentinels."""
    return F.filter(readings, lambda x: ~is_sentinel(x))


def is_sentinel(reading: Column) -> Column:
    return reading.isNull() | reading.isin(*SENTINELS) | (reading <= SENTINEL_LOW) | (reading >= SENTINEL_HIGH)


def is_out_of_band(reading: Column) -> Column:
    below = F.col("min_c").isNotNull() & (reading < F.col("min_c"))
    return below | (reading > F.col("max_c"))


#: (condition, disposition, rule) in order; the first that holds decides. Columns: those of ``label_series``.
RULES = (
    ("max_c IS NULL", "insufficient_data", "R000_unknown_product"),
    ("missing OR n_readings = 0", "insufficient_data", "R001_missing_fields"),
    ("n_excluded = n_readings", "insufficient_data", "R002_all_readings_sentinel"),
    ("remaining_days <= 0", "reject", "R010_expired"),
    ("peak_c > refreeze_c", "reject", "R011_partial_thaw"),
    ("sensor_fault", "hold_for_qa", "R020_sensor_artifact"),
    (f"n_excluded / n_readings > {SENTINEL_SHARE}", "hold_for_qa", "R021_sentinel_threshold_exceeded"),
    ("excursion_min >= reject_min", "reject", "R030_excursion_over_reject"),
    ("excursion_min >= hold_min", "hold_for_qa", "R031_excursion_over_hold"),
    ("excursion_min > 0 AND remaining_days <= 2", "hold_for_qa", "R040_minor_excursion_short_life"),
    ("excursion_min > 0 AND peak_season AND remaining_days <= 4", "hold_for_qa", "R041_peak_season_short_life"),
    ("excursion_min > 0", "accept", "R050_minor_excursion_in_tolerance"),
    ("remaining_days <= 1", "hold_for_qa", "R042_end_of_life"),
    ("true", "accept", "R060_in_spec"),
)


def first_rule(rules: tuple = RULES) -> Column:
    """A struct (disposition, rule_id) of the first rule that holds."""
    out = None
    for condition, disposition, rule in rules:
        value = F.struct(F.lit(disposition).alias("disposition"), F.lit(rule).alias("rule_id"))
        out = F.when(F.expr(condition), value) if out is None else out.when(F.expr(condition), value)
    return out


def rule_text(rules: tuple = RULES, products: tuple = PRODUCTS) -> str:
    """All that decides a label as text: the rules in order, the products' bounds in order of name, the sentinels."""
    lines = ["|".join(rule) for rule in rules] + ["|".join(map(str, p)) for p in sorted(products)]
    return "\n".join([*lines, "|".join(map(str, (*SENTINELS, SENTINEL_LOW, SENTINEL_HIGH, INTERVAL_MIN)))])


def fingerprint(rules: tuple = RULES, products: tuple = PRODUCTS) -> str:
    """12 hex digits that change with any rule, bound or order of rules."""
    return hashlib.sha256(rule_text(rules, products).encode()).hexdigest()[:12]


def stamped(labels: DataFrame, rules: tuple = RULES, products: tuple = PRODUCTS) -> DataFrame:
    """Labels with the fingerprint of the rules that gave them."""
    return labels.withColumn("engine", F.lit(fingerprint(rules, products)))


def stale(labels: DataFrame, rules: tuple = RULES, products: tuple = PRODUCTS) -> DataFrame:
    """Stamped labels with whether they are of other rules than these; labels without a stamp are."""
    return labels.withColumn("stale", ~F.col("engine").eqNullSafe(F.lit(fingerprint(rules, products))))
