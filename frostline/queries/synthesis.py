"""Synthesis queries over requests made from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.operators import synthesis as S
from frostline.operators.disposition import label_states
from frostline.queries.results import _specs as loaded_specs
from frostline.registry import query
from frostline.sources.adapters import table

_REQUEST = """o_orderkey AS rng_seed, CASE o_orderkey % 4 WHEN 0 THEN 'finfish_seafood' WHEN 1 THEN 'table_eggs' WHEN 2 THEN 'chilled_dairy' ELSE 'frozen_goods' END AS product,
 CASE o_custkey % 5 WHEN 0 THEN 'in_spec' WHEN 1 THEN 'door_open' WHEN 2 THEN 'compressor_fail' WHEN 3 THEN 'setpoint_drift' ELSE 'sensor_artifact' END AS fault,
 CASE o_custkey % 4 WHEN 0 THEN 'logger_csv' WHEN 1 THEN 'chat_message' WHEN 2 THEN 'qc_form_ocr' ELSE 'voice_note' END AS artifact_type, o_custkey % 7 = 0 AS is_adversarial, o_custkey % 11 = 0 AS is_abstention"""
_SPECS = "specs(product, min_c, max_c, hold_min, shelf_days) AS (VALUES ('finfish_seafood', 0.0::DOUBLE, 4.0::DOUBLE, 60, 5), ('table_eggs', 0.0, 5.0, 240, 28), ('chilled_dairy', 0.0, 5.0, 90, 10), ('frozen_goods', NULL, -18.0, 30, 180))"


def _draw(name: str, low: str = "0.0::DOUBLE", high: str = "1.0::DOUBLE") -> str:
    return f"({low} + ({high} - {low}) * (('0x' || left(sha256(rng_seed || ':' || {name}), 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE))"


_BASE = f"""WITH q AS (SELECT {_REQUEST} FROM orders), {_SPECS}, b AS (SELECT *, coalesce(min_c, max_c - 7.0::DOUBLE) AS lo FROM q JOIN specs USING (product)),
h AS (SELECT *, (lo + max_c) / 2 AS middle, (max_c - lo) / 2 AS half FROM b),
s AS (SELECT rng_seed, product, fault, is_adversarial, is_abstention, hold_min, shelf_days, max_c, lo, list_transform(range(96), lambda i: round(middle + {_draw("'base' || i", '-half * 0.6::DOUBLE', 'half * 0.6::DOUBLE')}, 2)) AS base,
  {_draw("'drift'", '0.02::DOUBLE', '0.08::DOUBLE')} AS drift, floor({_draw("'at'", '0', '88')})::INT AS at_, floor({_draw("'long'", '2', '9')})::INT AS long_, {_draw("'warm'", '22.0::DOUBLE', '38.0::DOUBLE')} AS warm FROM h)
"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    import re

    return table(spark, sf_dir, "orders").selectExpr(*(x.strip() for x in re.split(r"(?<= AS rng_seed),|(?<= AS product),|(?<= AS fault),|(?<= AS artifact_type),|(?<= AS is_adversarial),", _REQUEST)))


def _told(column: str) -> list:
    """A series as comparable numbers."""
    return [F.size(column).alias("n"), F.round(F.aggregate(column, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.array_max(column).alias("highest"), F.array_min(column).alias("lowest")]


_TOLD = "len({0}) AS n, round(list_sum({0}), 4) AS total, list_max({0}) AS highest, list_min({0}) AS lowest"


@query(_BASE + "SELECT rng_seed, " + _TOLD.format("base") + " FROM s WHERE fault = 'in_spec'")
def series_in_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.with_series(_requests(spark, sf_dir).where("fault = 'in_spec'").join(F.broadcast(S.product_specs(spark)), "product"))
    return rows.select("rng_seed", *_told("readings_c"))


@query(_BASE + ", d AS (SELECT rng_seed, list_transform(base, lambda x, i: round(x + i * drift, 2)) AS r FROM s WHERE fault = 'setpoint_drift') SELECT rng_seed, " + _TOLD.format("r") + " FROM d")
def series_setpoint_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.with_series(_requests(spark, sf_dir).where("fault = 'setpoint_drift'").join(F.broadcast(S.product_specs(spark)), "product"))
    return rows.select("rng_seed", *_told("readings_c"))


@query(_BASE + f", d AS (SELECT rng_seed, list_transform(base, lambda x, i: CASE WHEN i - 1 BETWEEN at_ AND at_ + long_ - 1 THEN round(x + (warm - x) * {_draw(chr(39) + 'pull' + chr(39) + ' || (i - 1)', '0.4::DOUBLE', '0.9::DOUBLE')}, 2) ELSE x END) AS r FROM s WHERE fault = 'door_open') SELECT rng_seed, " + _TOLD.format("r") + " FROM d")
def series_door_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.with_series(_requests(spark, sf_dir).where("fault = 'door_open'").join(F.broadcast(S.product_specs(spark)), "product"))
    return rows.select("rng_seed", *_told("readings_c"))


@query()
def synthetic_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fault modes with overlays; the compressor's fold and the sensor's kinds have no practical SQL and are tested row by row."""
    return S.synthesize(_requests(spark, sf_dir))


@query()
def synthetic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispositions of synthetic states, in one pass without a shuffle before the count."""
    return label_states(S.synthesize(_requests(spark, sf_dir))).groupBy("fault", "disposition").agg(F.count("*").alias("n"))


@query(_BASE + "SELECT DISTINCT product, lo AS floor_c FROM s")
def operating_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floors of the specs that the first region's pack gives."""
    return loaded_specs(spark, sf_dir).where("pack = 0").select("product", S.operating_floor(F.col("min_c"), F.col("max_c")).alias("floor_c"))


@query(_BASE + f""", a AS (SELECT rng_seed, CASE WHEN is_abstention THEN ['readings_c', 'days_since_production', 'interval_min'][floor({_draw("'hidden'", '1', '4')})::INT] END AS hidden FROM s)
SELECT rng_seed, array_to_string(list_filter(['product', 'readings_c', 'interval_min', 'ambient_c', 'days_since_production', 'peak_season'], lambda k: k IS DISTINCT FROM hidden), ',') AS fields FROM a""")
def visible_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = S.synthesize(_requests(spark, sf_dir))
    return states.select("rng_seed", F.array_join(S.visible_names(states), ",").alias("fields"))


@query(f"WITH q AS (SELECT {_REQUEST} FROM orders) SELECT rng_seed, CASE artifact_type WHEN 'logger_csv' THEN 2400 WHEN 'qc_form_ocr' THEN 900 ELSE 500 END AS render_tokens, CASE artifact_type WHEN 'logger_csv' THEN 1200 WHEN 'qc_form_ocr' THEN 700 ELSE 400 END AS extract_tokens FROM q")
def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("artifact_type")
    return _requests(spark, sf_dir).select("rng_seed", S.token_budget(kind, S.RENDER_TOKENS).alias("render_tokens"), S.token_budget(kind, S.EXTRACT_TOKENS).alias("extract_tokens"))


@query()
def render_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = S.synthesize(_requests(spark, sf_dir))
    return states.select("rng_seed", S.render_prompt(S.visible_fields(states), F.col("artifact_type"), F.lit("AE")).alias("prompt"))
