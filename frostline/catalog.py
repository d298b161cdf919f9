"""Every query of the engine by name, with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions.rules import is_sentinel
from frostline.operators.disposition import label_series as label
from frostline.operators.evaluation import latest_by_key, macro_f1, vote_categorical, vote_numeric
from frostline.operators.funnel import with_outcome
from frostline.operators.planning import nearest_rank, slice_summary
from frostline.registry import ORACLE_SQL, QUERIES, query
from frostline.sources.adapters import generation_log, table, telemetry
from frostline.streaming.replay import screen, windowed_hits

_TELEMETRY = """WITH t AS (SELECT user_id AS series_id, event_id, ts,
    CASE user_id % 4 WHEN 0 THEN 'finfish_seafood' WHEN 1 THEN 'table_eggs' WHEN 2 THEN 'chilled_dairy' ELSE 'frozen_goods' END AS product,
    CASE WHEN user_id % 17 <> 0 THEN user_id % (CASE user_id % 4 WHEN 0 THEN 8 WHEN 1 THEN 31 WHEN 2 THEN 13 ELSE 183 END) END AS days,
    CASE WHEN event_type = 'error' AND value < 2 THEN -99.9::DOUBLE WHEN user_id % 4 = 3 THEN value / 25.0::DOUBLE - 22.0::DOUBLE ELSE value / 25.0::DOUBLE END AS reading_c
  FROM events),
specs(product, min_c, max_c, refreeze_c, hold_min, reject_min, shelf_days) AS (VALUES
  ('finfish_seafood', 0.0::DOUBLE, 4.0::DOUBLE, NULL::DOUBLE, 60, 180, 5), ('table_eggs', 0.0, 5.0, NULL, 240, 720, 28), ('chilled_dairy', 0.0, 5.0, NULL, 90, 240, 10), ('frozen_goods', NULL, -18.0, -12.0, 30, 120, 180)),
r AS (SELECT t.*, specs.* EXCLUDE (product), (reading_c IS NULL OR reading_c IN (-99.9, -999, 999) OR reading_c <= -50 OR reading_c >= 80) AS bad FROM t LEFT JOIN specs USING (product)),
"""
_LABEL = """p AS (SELECT {keys}, product, any_value(max_c) AS max_c, any_value(refreeze_c) AS refreeze_c, any_value(hold_min) AS hold_min, any_value(reject_min) AS reject_min,
    any_value(shelf_days) AS shelf_days, max(days) AS days, count(*) AS n_readings, count(*) FILTER (bad) AS n_excluded, max(reading_c) FILTER (NOT bad) AS peak_c,
    15 * count(*) FILTER (NOT bad AND (reading_c > max_c OR (min_c IS NOT NULL AND reading_c < min_c))) AS excursion_min
  FROM r GROUP BY {keys}, product),
q AS (SELECT *, shelf_days - days AS remaining_days FROM p),
s AS (SELECT *, CASE WHEN max_c IS NULL THEN 'R000_unknown_product' WHEN series_id % 13 = 0 THEN 'R001_missing_fields' WHEN n_excluded = n_readings THEN 'R002_all_readings_sentinel'
    WHEN remaining_days <= 0 THEN 'R010_expired' WHEN peak_c > refreeze_c THEN 'R011_partial_thaw' WHEN series_id % 7 = 0 THEN 'R020_sensor_artifact'
    WHEN n_excluded * 1.0::DOUBLE / n_readings > 0.02 THEN 'R021_sentinel_threshold_exceeded' WHEN excursion_min >= reject_min THEN 'R030_excursion_over_reject'
    WHEN excursion_min >= hold_min THEN 'R031_excursion_over_hold' WHEN excursion_min > 0 AND remaining_days <= 2 THEN 'R040_minor_excursion_short_life'
    WHEN excursion_min > 0 AND series_id % 5 = 0 AND remaining_days <= 4 THEN 'R041_peak_season_short_life' WHEN excursion_min > 0 THEN 'R050_minor_excursion_in_tolerance'
    WHEN remaining_days <= 1 THEN 'R042_end_of_life' ELSE 'R060_in_spec' END AS rule_id FROM q),
m AS (SELECT *, CASE left(rule_id, 4) WHEN 'R000' THEN 'insufficient_data' WHEN 'R001' THEN 'insufficient_data' WHEN 'R002' THEN 'insufficient_data'
    WHEN 'R010' THEN 'reject' WHEN 'R011' THEN 'reject' WHEN 'R030' THEN 'reject' WHEN 'R050' THEN 'accept' WHEN 'R060' THEN 'accept' ELSE 'hold_for_qa' END AS disposition FROM s),
l AS (SELECT * REPLACE (CASE WHEN rule_id[:4] IN ('R000', 'R001') THEN 0 ELSE n_excluded END AS n_excluded, CASE WHEN rule_id[:4] IN ('R000', 'R001', 'R002') THEN 0 ELSE excursion_min END AS excursion_min,
    CASE WHEN rule_id[:4] NOT IN ('R000', 'R001', 'R002') THEN peak_c END AS peak_c, CASE WHEN rule_id[:4] NOT IN ('R000', 'R001', 'R002') THEN remaining_days END AS remaining_days) FROM m)
"""
_SERIES = _TELEMETRY + _LABEL.format(keys="series_id")
_COLUMNS = "product, n_readings, n_excluded, peak_c, excursion_min, remaining_days, disposition, rule_id"

_LOG = """WITH g AS (SELECT doc_id, doc_id % 8 + 1 AS wave, CASE doc_id % 4 WHEN 0 THEN 'finfish_seafood' WHEN 1 THEN 'table_eggs' WHEN 2 THEN 'chilled_dairy' ELSE 'frozen_goods' END || '|' ||
    CASE doc_id // 4 % 5 WHEN 0 THEN 'in_spec' WHEN 1 THEN 'door_open' WHEN 2 THEN 'compressor_fail' WHEN 3 THEN 'setpoint_drift' ELSE 'sensor_artifact' END AS cell, lang AS language,
    CASE doc_id % 4 WHEN 0 THEN 'logger_csv' WHEN 1 THEN 'chat_message' WHEN 2 THEN 'qc_form_ocr' ELSE 'voice_note' END AS artifact_type,
    CASE doc_id % 6 WHEN 0 THEN 'AE' WHEN 1 THEN 'SA' WHEN 2 THEN 'QA' WHEN 3 THEN 'KW' WHEN 4 THEN 'OM' ELSE 'BH' END AS jurisdiction,
    CASE doc_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'hold_for_qa' ELSE 'reject' END AS disposition,
    CASE doc_id % 5 WHEN 0 THEN ' consistent ' WHEN 1 THEN 'INCONSISTENT' WHEN 2 THEN 'leaks_label' WHEN 3 THEN 'Consistent' ELSE 'maybe' END AS screener_reply,
    doc_id % 10 = 0 AS is_adversarial, doc_id % 11 <> 0 AS round_trip_ok, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE (n_chars % 100) / 100.0::DOUBLE END AS confidence,
    coalesce(text, '') || CASE WHEN doc_id % 29 = 0 THEN ' product_code=x1' WHEN doc_id % 31 = 0 THEN ' we recommend expedite sale now' WHEN doc_id % 12 = 0 THEN ' 2026-07-22 09:' ELSE '' END AS rendered_text
  FROM documents),
h AS (SELECT *, CASE WHEN upper(trim(screener_reply)) IN ('CONSISTENT', 'INCONSISTENT', 'LEAKS_LABEL') THEN upper(trim(screener_reply)) ELSE 'UNPARSEABLE' END AS verdict,
    regexp_matches(rendered_text, '(?i)product_code\\s*=|\\bcell\\s*[:=]|\\bscenario\\s*[:=]|rule_engine_sha|prompt_template_hash') AS h18,
    regexp_matches(rendered_text, '(?i)\\bexpedite[\\s_-]?sale\\b|\\bexpedite\\b[^.\\n]{0,30}\\bsale\\b') AS h15,
    artifact_type = 'logger_csv' AND regexp_matches(rendered_text, '\\d{4}-\\d{2}-\\d{2}[ T]\\d{2}:\\s*$') AS h02 FROM g),
f AS (SELECT *, h18::INT + h15::INT + h02::INT AS n_rules, CASE WHEN verdict <> 'CONSISTENT' THEN 'dropped_screener' WHEN h18 OR h15 OR h02 THEN 'dropped_guardrail' WHEN NOT round_trip_ok THEN 'dropped_roundtrip'
    WHEN coalesce(confidence, 0) < 0.6 THEN 'dropped_low_confidence' ELSE 'kept' END AS outcome FROM h)
"""


def _funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_outcome(generation_log(spark, sf_dir))


@query(_SERIES + f"SELECT series_id, {_COLUMNS} FROM l")
def label_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(telemetry(spark, sf_dir), "series_id")


@query(_TELEMETRY.replace("event_id, ts,", "event_id, ts, CAST(ts AS DATE) AS day,", 1) + _LABEL.format(keys="series_id, day") + f"SELECT series_id, day, {_COLUMNS} FROM l")
def label_series_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(telemetry(spark, sf_dir).withColumn("day", F.to_date("ts")), "series_id", "day")


@query(_SERIES + "SELECT product, disposition, count(*) AS n FROM l GROUP BY ALL")
def disposition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_series(spark, sf_dir).groupBy("product", "disposition").agg(F.count("*").alias("n"))


@query(_SERIES + "SELECT rule_id, count(*) AS n FROM l GROUP BY ALL")
def rule_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_series(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(_SERIES + "SELECT count(*) FILTER (disposition = 'expedite_sale') AS n_expedite, count(*) AS n FROM l")
def expedite_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_series(spark, sf_dir).agg(F.count_if(F.col("disposition") == "expedite_sale").alias("n_expedite"), F.count("*").alias("n"))


@query(_LOG + "SELECT doc_id, wave, cell, verdict, outcome FROM f")
def outcome_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _funnel(spark, sf_dir).select("doc_id", "wave", "cell", "verdict", "outcome")


@query(_LOG + "SELECT outcome, count(*) AS n FROM f WHERE outcome <> 'kept' GROUP BY ALL")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _funnel(spark, sf_dir).where("outcome <> 'kept'").groupBy("outcome").agg(F.count("*").alias("n"))


@query(_LOG + "SELECT cell, wave, round(avg((outcome = 'kept')::INT), 3) AS rate, count(*) AS attempted FROM f GROUP BY ALL")
def survival_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = (F.col("outcome") == "kept").cast("int")
    return _funnel(spark, sf_dir).groupBy("cell", "wave").agg(F.round(F.avg(kept), 3).alias("rate"), F.count("*").alias("attempted"))


@query(_LOG + "SELECT cell, language, artifact_type, jurisdiction, count(*) AS requested, count(*) FILTER (outcome = 'kept') AS kept, max(wave) AS last_wave FROM f GROUP BY GROUPING SETS ((cell), (language), (artifact_type), (jurisdiction), ())")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _funnel(spark, sf_dir)
    axes = [F.col(c) for c in ("cell", "language", "artifact_type", "jurisdiction")]
    sets = rows.groupingSets([[a] for a in axes] + [[]], *axes)
    return sets.agg(F.count("*").alias("requested"), F.count_if(F.col("outcome") == "kept").alias("kept"), F.max("wave").alias("last_wave"))


@query(_LOG + "SELECT rule_id, count(*) AS n FROM (SELECT unnest([CASE WHEN h18 THEN 'GCC-EDGE-018' END, CASE WHEN h15 THEN 'GCC-EDGE-015' END, CASE WHEN h02 THEN 'GCC-EDGE-002' END]) AS rule_id FROM f) WHERE rule_id IS NOT NULL GROUP BY ALL")
def guardrail_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _funnel(spark, sf_dir).select(F.explode("rules").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(_LOG + "SELECT jurisdiction, artifact_type, count(*) AS n, count(*) FILTER (n_rules > 0) AS violations, round(avg((n_rules > 0)::INT), 6) AS rate, round(avg(confidence), 6) AS mean_confidence FROM f GROUP BY GROUPING SETS ((jurisdiction), (artifact_type), ())")
def audit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _funnel(spark, sf_dir)
    axes = [F.col("jurisdiction"), F.col("artifact_type")]
    hit = F.size("rules") > 0
    sets = rows.groupingSets([[a] for a in axes] + [[]], *axes)
    return sets.agg(F.count("*").alias("n"), F.count_if(hit).alias("violations"), F.round(F.avg(hit.cast("int")), 6).alias("rate"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("SELECT doc_id FROM documents WHERE CAST('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) % 100 < 5")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    part = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    return table(spark, sf_dir, "documents").where(part < 5).select("doc_id")


_PREDICTED = "SELECT l_returnflag AS truth, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS predicted, l_linestatus AS grp FROM lineitem"
_F1 = f"""WITH p AS ({_PREDICTED}), c AS (SELECT {{g}} truth, predicted, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT {{g}} truth AS label, CASE WHEN truth = predicted THEN n ELSE 0 END AS tp, n FROM c UNION ALL SELECT {{g}} predicted, 0, n FROM c),
k AS (SELECT {{g}} label, 2.0::DOUBLE * sum(tp) / sum(n) AS f1, sum(n) AS total FROM s GROUP BY ALL)
SELECT {{g}} round(avg(f1), 6) AS macro_f1, CAST(sum(total) / 2 AS BIGINT) AS n FROM k {{by}}"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("truth"), predicted.alias("predicted"), F.col("l_linestatus").alias("grp"))


@query(_F1.format(g="", by=""))
def macro_f1_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro_f1(_predictions(spark, sf_dir))


@query(_F1.format(g="grp,", by="GROUP BY grp"))
def group_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro_f1(_predictions(spark, sf_dir), "grp")


@query("WITH v AS (SELECT conv_id AS item, (length(text) % 5 + 1)::DOUBLE AS vote FROM conversations), m AS (SELECT item, quantile_cont(vote, 0.5) AS median FROM v GROUP BY item), a AS (SELECT item, median, round(avg((abs(vote - median) <= 1e-6)::INT), 6) AS agreement FROM v JOIN m USING (item) GROUP BY ALL) SELECT *, agreement < 0.6 AS escalated FROM a")
def numeric_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item"), (F.char_length("text") % 5 + 1).cast("double").alias("vote"))
    return vote_numeric(votes)


@query("WITH c AS (SELECT conv_id AS item, role AS vote, count(*) AS n, min(turn) AS seen FROM conversations GROUP BY ALL), b AS (SELECT item, max_by(vote, (n, -seen)) AS vote, round(max(n) * 1.0::DOUBLE / sum(n), 6) AS agreement FROM c GROUP BY item) SELECT *, agreement < 0.6 AS escalated FROM b")
def categorical_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item"), F.col("role").alias("vote"), F.col("turn").alias("position"))
    return vote_categorical(votes)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by_key(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT date_trunc('hour', ts) AS window_start, CASE event_id % 2 WHEN 0 THEN 'logger_csv' ELSE 'chat_message' END AS artifact_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS violations FROM events GROUP BY ALL")
def replay_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "product_code=1").otherwise("fine")
    kind = F.when(F.col("event_id") % 2 == 0, "logger_csv").otherwise("chat_message")
    records = table(spark, sf_dir, "events").select("ts", text.alias("rendered_text"), kind.alias("artifact_type"))
    return windowed_hits(screen(records))


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def jurisdiction_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("s"))
    joined = per.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", "r_name", "customers", F.round("s", 2).alias("balance"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(avg(value), 6) AS mean, max(value) FILTER (rk = CASE WHEN floor(n * 0.99::DOUBLE) < 1 THEN n ELSE floor(n * 0.99::DOUBLE) END) AS p99 FROM r GROUP BY event_type")
def p99_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rank(table(spark, sf_dir, "events"), "event_type", "value")


@query(_LOG + ", c AS (SELECT cell, round(avg((outcome = 'kept')::INT), 6) AS f1 FROM f GROUP BY cell) SELECT min_by(cell, (f1, cell)) AS worst_cell, min(f1) AS worst_f1, count(*) FILTER (f1 >= 0.8) AS n_passing, round(avg(f1), 6) AS mean_f1 FROM c")
def slice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = (F.col("outcome") == "kept").cast("int")
    return slice_summary(_funnel(spark, sf_dir).groupBy("cell").agg(F.round(F.avg(kept), 6).alias("f1")))


@query("WITH s AS (SELECT user_id AS series_id, list(CASE WHEN event_type = 'error' AND value < 2 THEN -99.9::DOUBLE WHEN user_id % 4 = 3 THEN value / 25.0::DOUBLE - 22.0::DOUBLE ELSE value / 25.0::DOUBLE END) AS x FROM events GROUP BY 1) SELECT series_id, len(list_filter(x, lambda v: v > -50 AND v < 80)) AS n_clean, len(x) - len(list_filter(x, lambda v: v > -50 AND v < 80)) AS n_excluded FROM s")
def sentinel_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = is_sentinel(F.col("reading_c"))
    return telemetry(spark, sf_dir).groupBy("series_id").agg(F.count_if(~bad).alias("n_clean"), F.count_if(bad).alias("n_excluded"))


@query("SELECT o_orderpriority, avg(date_diff('day', o_orderdate, l_shipdate)) AS mean_days, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def shelf_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.avg(F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))).alias("mean_days"), F.count("*").alias("n"))
