"""Funnel queries: JSON of replies, schema, round trip, safety and the whole cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.catalog import _LOG, _funnel
from frostline.operators import extraction as E
from frostline.registry import query
from frostline.sources.adapters import table

_REPLY = """CASE doc_id % 8 WHEN 0 THEN 'no json here' WHEN 1 THEN 'Answer: {"product": "table_eggs", "readings_c": [1.5, 2.0], "interval_min": 15} done'
 WHEN 2 THEN '{"product": "unknown", "readings_c": [1], "interval_min": 15}' WHEN 3 THEN '{"product": null, "readings_c": null, "interval_min": null}'
 WHEN 4 THEN '{"product": "frozen_goods", "readings_c": ["x"], "interval_min": 15}' WHEN 5 THEN '{"product": "chilled_dairy", "interval_min": 15}' WHEN 6 THEN '{"product": "chilled_dairy", "readings_c": [], "interval_min": 1.5}'
 ELSE concat('{"product": "finfish_seafood", "readings_c": [', CAST(doc_id % 5 AS string), ', ', CAST(doc_id % 9 AS string), '.5], "interval_min": 15, "peak_season": ', CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE '"yes"' END, '}') END"""
_SLICE = f"WITH r AS (SELECT doc_id, {_REPLY} AS reply FROM documents), s AS (SELECT doc_id, nullif(regexp_extract(reply, '(?s)(\\{{.*\\}})', 1), '') AS slice FROM r)"
_KEYED = """, j AS (SELECT doc_id, slice, CASE WHEN slice IS NOT NULL AND json_valid(slice) THEN slice END AS j FROM s),
k AS (SELECT doc_id, slice, j, json_type(j, '$.product') AS tp, json_extract_string(j, '$.product') AS p, json_type(j, '$.readings_c') AS tr, json_extract(j, '$.readings_c[*]') AS items, json_type(j, '$.interval_min') AS ti, json_type(j, '$.peak_season') AS ts FROM j),
c AS (SELECT doc_id, slice, coalesce(j IS NOT NULL AND tp IS NOT NULL AND tr IS NOT NULL AND ti IS NOT NULL AND (tp = 'NULL' OR (tp = 'VARCHAR' AND p IN ('finfish_seafood', 'table_eggs', 'chilled_dairy', 'frozen_goods')))
  AND (tr = 'NULL' OR (tr = 'ARRAY' AND len(list_filter(items, lambda e: json_type(e) NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE'))) = 0)) AND ti IN ('NULL', 'UBIGINT', 'BIGINT') AND (ts IS NULL OR ts IN ('NULL', 'BOOLEAN')), false) AS schema_valid FROM k)
"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_REPLY} AS reply")


@query(_SLICE + " SELECT doc_id, slice FROM s")
def json_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("doc_id", E.json_slice(F.col("reply")).alias("slice"))


@query(_SLICE + _KEYED + "SELECT doc_id, schema_valid FROM c")
def schema_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_schema_check(_replies(spark, sf_dir)).select("doc_id", "schema_valid")


_SERIES = """SELECT doc_id, CASE WHEN doc_id % 25 = 0 THEN [] ELSE [(doc_id % 7)::DOUBLE, (doc_id % 11)::DOUBLE, (doc_id % 5)::DOUBLE - 2] END AS src, doc_id % 9 = 0 AS hidden, doc_id % 8 <> 0 AS same FROM documents"""
_ROUND = f"""WITH a AS ({_SERIES}), b AS (SELECT *, CASE WHEN doc_id % 6 = 0 THEN [] ELSE list_transform(src, lambda x: x + (doc_id % 4) * 0.6::DOUBLE) END AS got FROM a),
e AS (SELECT *, abs(list_min(src) - list_min(got)) AS lo, abs(list_max(src) - list_max(got)) AS hi FROM b),
t AS (SELECT doc_id, CASE WHEN NOT same THEN false WHEN hidden THEN len(got) = 0 WHEN len(src) = 0 OR len(got) = 0 THEN len(src) = 0 AND len(got) = 0 ELSE lo < 1.5 AND hi < 1.5 END AS passed,
  CASE WHEN NOT same THEN 0.0::DOUBLE WHEN hidden THEN (len(got) = 0)::INT::DOUBLE WHEN len(src) = 0 OR len(got) = 0 THEN (len(src) = 0 AND len(got) = 0)::INT::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (lo + hi) / 3.0::DOUBLE) END AS confidence FROM e)
"""


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 25 = 0 THEN CAST(array() AS array<double>) ELSE array(CAST(doc_id % 7 AS double), CAST(doc_id % 11 AS double), CAST(doc_id % 5 AS double) - 2D) END AS src",
        "CASE WHEN doc_id % 9 = 0 THEN array('readings_c') ELSE CAST(array() AS array<string>) END AS missing_fields", "CASE WHEN doc_id % 8 <> 0 THEN 'a' ELSE 'b' END AS got_product",
    )
    rows = rows.withColumn("got", F.expr("CASE WHEN doc_id % 6 = 0 THEN CAST(array() AS array<double>) ELSE transform(src, x -> x + (doc_id % 4) * 0.6D) END"))
    trip = E.round_trip(F.lit("a"), F.col("src"), F.col("missing_fields"), F.col("got_product"), F.col("got"))
    return rows.withColumn("trip", trip).select("doc_id", "trip.passed", "trip.confidence")


@query(_ROUND + "SELECT doc_id, passed, round(confidence, 9) AS confidence FROM t")
def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trips(spark, sf_dir).select("doc_id", "passed", F.round("confidence", 9).alias("confidence"))


@query("SELECT doc_id, coalesce(n_chars % 7, 0) < 4 AND doc_id % 6 < 4 AS safe FROM documents")
def safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    part = lambda name, e: F.struct(F.lit(name).alias("category"), F.expr(e).cast("int").alias("severity"))
    return rows.select("doc_id", E.is_safe(F.array(part("a", "n_chars % 7"), part("b", "doc_id % 6"), part("c", "NULL"))).alias("safe"))


@query(
    _LOG + ", " + _SLICE.removeprefix("WITH ").replace("FROM r)", "FROM r)") + _KEYED + ", " + _ROUND.removeprefix("WITH ") + """, w AS (SELECT h.doc_id, h.verdict, h18 OR h15 OR h02 AS hit, c.schema_valid, t.passed, t.confidence,
  CASE WHEN h.doc_id % 41 = 0 THEN 'dropped_error' WHEN h.doc_id % 37 = 0 THEN 'dropped_safety' WHEN h.verdict <> 'CONSISTENT' THEN 'dropped_screener' WHEN h18 OR h15 OR h02 THEN 'dropped_guardrail' WHEN NOT c.schema_valid THEN 'dropped_schema'
    WHEN NOT t.passed THEN 'dropped_roundtrip' WHEN t.confidence < 0.6 THEN 'dropped_low_confidence' ELSE 'kept' END AS outcome FROM h JOIN c USING (doc_id) JOIN t USING (doc_id))
SELECT doc_id, outcome, CASE WHEN outcome NOT IN ('dropped_error', 'dropped_safety') THEN verdict END AS verdict, CASE WHEN outcome IN ('dropped_schema', 'dropped_roundtrip', 'dropped_low_confidence', 'kept') THEN schema_valid END AS schema_valid,
  CASE WHEN outcome IN ('dropped_roundtrip', 'dropped_low_confidence', 'kept') THEN passed END AS round_trip_ok, round(CASE WHEN outcome IN ('dropped_roundtrip', 'dropped_low_confidence', 'kept') THEN confidence END, 9) AS confidence FROM w"""
)
def full_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight outcomes. The joins are on the record's id; the checks come from three sources."""
    log = _funnel(spark, sf_dir).select("doc_id", "verdict", "rules").withColumns({"error": F.expr("doc_id % 41 = 0"), "safe": F.expr("doc_id % 37 <> 0")})
    checked = E.with_schema_check(_replies(spark, sf_dir)).select("doc_id", "schema_valid")
    rows = log.join(checked, "doc_id").join(_trips(spark, sf_dir).withColumnRenamed("passed", "round_trip_ok"), "doc_id")
    out = E.with_full_outcome(rows)
    return out.select("doc_id", "outcome", "verdict", "schema_valid", "round_trip_ok", F.round("confidence", 9).alias("confidence"))


@query("SELECT doc_id, left(text, 40) AS stored, length(left(text, 4000)) AS n_stored FROM documents")
def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.substring("text", 1, 40).alias("stored"), F.char_length(F.substring("text", 1, E.STORED)).alias("n_stored"))
