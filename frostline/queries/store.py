"""Queries of the store: waves, exports, upserts, uniqueness, retention; each writes to a new shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.catalog import _LOG, _funnel
from frostline.functions.guardrails import DETAILS, detailed
from frostline.registry import query
from frostline.sources import store as S
from frostline.sources.adapters import table
from frostline.sources.packs import load_lines

_ROWS = ("doc_id", "wave", "cell", "outcome")


def _stored(spark: SparkSession, sf_dir: str) -> S.Store:
    store = S.Store(spark, S.shared_root(spark))
    store.append("generation_log", _funnel(spark, sf_dir).select(*_ROWS, F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("_id")), by="wave")
    return store


@query(_LOG + "SELECT doc_id, cell, outcome FROM f WHERE wave = 3")
def wave_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).scan("generation_log", 3).select("doc_id", "cell", "outcome")


@query(_LOG + "SELECT doc_id, wave FROM f WHERE wave <> 5")
def wave_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    store.delete_wave("generation_log", 5, dry_run=True)
    store.delete_wave("generation_log", 5)
    return store.scan("generation_log").select("doc_id", "wave")


@query(_LOG + "SELECT doc_id, wave, CASE WHEN wave = 2 THEN 'redone' ELSE outcome END AS outcome FROM f")
def wave_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    redone = _funnel(spark, sf_dir).where("wave = 2").select(*_ROWS).withColumn("outcome", F.lit("redone"))
    store.replace_waves("generation_log", redone)
    return store.scan("generation_log").select("doc_id", "wave", "outcome")


@query(_LOG + "SELECT doc_id, wave, cell, outcome FROM f WHERE outcome = 'kept' OR doc_id % 10 = 3")
def exported_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table as JSON lines without its id, read back: rows kept or of no told outcome."""
    store = S.Store(spark, S.shared_root(spark))
    rows = _funnel(spark, sf_dir).select(*_ROWS).withColumn("outcome", F.when(F.expr("doc_id % 10 <> 3"), F.col("outcome")))
    store.append("generation_log", rows.withColumn("_id", F.lit("x")))
    out = f"{store.root}-export"
    store.export(out)
    back = S.jsonl_kept(spark, f"{out}/generation_log", "doc_id long, wave int, cell string, outcome string")
    told = _funnel(spark, sf_dir).select("doc_id", F.col("outcome").alias("was"))
    return back.join(told, "doc_id").select("doc_id", "wave", "cell", F.coalesce("outcome", "was").alias("outcome"))


@query("SELECT c_custkey AS k, c_name, NULL::VARCHAR AS s_name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def csv_of_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of different keys under one sorted header, written as CSV and read back."""
    both = S.union_of_keys(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"))
    path = f"{S.shared_root(spark)}/csv"
    S.write_csv(both, path)
    return spark.read.option("header", True).schema("c_name string, k long, s_name string").csv(path)


def _sql_details(text: str = "d.detail") -> str:
    rows = ", ".join(f"('{rule}', '{hit}', '{detail}')" for (rule, detail), hit in zip(DETAILS, ("h18", "h15", "h02"), strict=True))
    return _LOG + f""", d(rule_id, flag, detail) AS (VALUES {rows}),
b AS (SELECT f.doc_id, d.rule_id, d.detail, CASE d.flag WHEN 'h18' THEN 1 WHEN 'h15' THEN 2 ELSE 3 END AS place FROM f JOIN d ON CASE d.flag WHEN 'h18' THEN h18 WHEN 'h15' THEN h15 ELSE h02 END)
"""


@query(_sql_details() + "SELECT doc_id, rule_id, detail, place AS rule_place FROM b")
def violation_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule with its detail, a row each."""
    order = F.array_position(F.array(*(F.lit(r) for r, _ in DETAILS)), F.col("v.rule_id")).cast("int")
    return _funnel(spark, sf_dir).select("doc_id", F.explode(detailed(F.col("rules"))).alias("v")).select("doc_id", "v.*", order.alias("rule_place"))


@query(_sql_details() + "SELECT doc_id, string_agg(rule_id, ';' ORDER BY place) AS rule_ids, string_agg(detail, ' | ' ORDER BY place) AS details FROM b GROUP BY doc_id")
def violation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.violation_lines(_funnel(spark, sf_dir)).select("doc_id", "rule_ids", "details")


@query(_LOG + """SELECT doc_id, outcome, CASE outcome WHEN 'kept' THEN 'ok' WHEN 'dropped_guardrail' THEN 'rules ' || n_rules ELSE '' END AS note, CASE WHEN outcome = 'kept' THEN confidence END AS confidence,
  CASE WHEN outcome = 'dropped_guardrail' THEN n_rules END AS n_rules, CASE WHEN outcome = 'dropped_screener' THEN verdict END AS verdict FROM f""")
def merged_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each outcome with their own extra fields, appended one after the other under a growing schema."""
    log, store = _funnel(spark, sf_dir), S.Store(spark, S.shared_root(spark))
    extras = {
        "kept": {"note": F.lit("ok"), "confidence": F.col("confidence")},
        "dropped_guardrail": {"note": F.concat(F.lit("rules "), F.size("rules").cast("string")), "n_rules": F.size("rules")},
        "dropped_screener": {"verdict": F.col("verdict")},
    }
    base = ["doc_id", "wave", "cell", "outcome", "note"]
    rows = S.written(log.withColumn("note", F.lit("")), "log")
    for outcome, own in extras.items():
        store.append("generation_log", S.merge_extras(rows.where(F.col("outcome") == outcome), own).select(*base, *(c for c in own if c not in base)), by="wave")
    store.append("generation_log", rows.where(~F.col("outcome").isin(*extras)).select(*base), by="wave")
    return store.scan("generation_log", evolving=True).select("doc_id", "outcome", "note", "confidence", "n_rules", "verdict")


#: Records as JSON lines, some of them malformed.
_LINE = """CASE WHEN doc_id % 37 = 0 THEN concat('{"doc_id": ', doc_id) WHEN doc_id % 41 = 0 THEN '[1, 2]' WHEN doc_id % 43 = 0 THEN concat('{"doc_id": ', doc_id, '}') WHEN doc_id % 47 = 0 THEN ' '
 ELSE concat('{"doc_id": ', doc_id, ', "lang": "', lang, '", "n_chars": ', n_chars, ', "more": null}') END"""
_KIND = "CASE WHEN doc_id % 37 = 0 THEN 'not JSON' WHEN doc_id % 41 = 0 THEN 'not an object' WHEN doc_id % 43 = 0 THEN 'lacks lang' WHEN doc_id % 47 = 0 THEN 'blank' ELSE '' END"


def _loaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    root = S.shared_root(spark)
    table(spark, sf_dir, "documents").select(F.expr(_LINE).alias("value")).write.text(f"{root}/lines")
    return load_lines(spark, f"{root}/lines", "doc_id long, lang string, n_chars long", f"{root}/quarantine", ("doc_id", "lang"))


@query(f"SELECT doc_id, lang, n_chars FROM documents WHERE {_KIND} = ''")
def loaded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir)[0]


@query(f"SELECT {_KIND} AS reason, count(*) AS n FROM documents WHERE {_KIND} NOT IN ('', 'blank') GROUP BY ALL")
def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query(_LOG + """, n AS (SELECT count(*) AS a, count(*) FILTER (wave = 4) AS w FROM f) SELECT 'generation_log' AS name, a AS before, w AS of_wave, a - w AS reset, 0 AS after FROM n
  UNION ALL SELECT 'access_audit', a, 0, 0, a FROM n UNION ALL SELECT 'ledger', 8, 0, 8, 0""")
def store_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table before, deleted with one wave, deleted by the whole reset, and after. The audit trail stays."""
    store = _stored(spark, sf_dir)
    store.append("access_audit", store.scan("generation_log").select("doc_id"))
    store.append("ledger", spark.range(1, 9).select(F.col("id").alias("closed")))
    size = lambda: {name: store.scan(name).count() for name in store.tables()}
    before, planned, of_wave = size(), store.reset(dry_run=True), store.reset(wave=4)
    reset = store.reset()
    after = size()
    if planned != {k: v for k, v in before.items() if k != "access_audit"}:
        raise AssertionError("a dry run counts what a reset deletes")
    return spark.createDataFrame([(k, before[k], of_wave.get(k, 0), reset.get(k, 0), after[k]) for k in before], "name string, before long, of_wave long, reset long, after long")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.key_violations(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def unexpired_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    return S.unexpired(events.join(F.broadcast(now), F.lit(True)), F.col("now"), days=2).select("event_id")


@query("SELECT ts::DATE AS day, count(*) AS stored, count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY) AS visible FROM events WHERE ts::DATE >= ((SELECT max(ts) FROM events) - INTERVAL 2 DAY)::DATE GROUP BY ALL")
def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of each day, and what a scan shows, after the days that have expired as a whole were removed."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    first_day = now.select(F.to_date(F.col("now") - F.make_dt_interval(F.lit(2)))).first()[0]
    store = S.Store(spark, S.shared_root(spark))
    store.append_by_day("events", events.select("event_id", "ts"))
    store.remove_expired("events", first_day)
    left = store.scan("events")
    visible = S.unexpired(left.join(F.broadcast(now), F.lit(True)), F.col("now"), days=2).groupBy("day").agg(F.count("*").alias("visible"))
    return left.groupBy("day").agg(F.count("*").alias("stored")).join(visible, "day", "left").select("day", "stored", F.coalesce("visible", F.lit(0)).alias("visible"))


@query("SELECT conv_id, string_agg(role, chr(10) ORDER BY turn, role) AS joined FROM conversations GROUP BY conv_id")
def joined_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.joined_text(table(spark, sf_dir, "conversations"), "conv_id", text="role", ts="turn")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    store = S.Store(spark, sf_dir)
    return store.point("orders.parquet", o_orderkey=orders.agg(F.min("o_orderkey")).first()[0]).select("o_orderkey", "o_custkey", "o_totalprice")
