"""Queries of gates, holdout metrics, votes and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.catalog import _LOG, _funnel
from frostline.operators import judging as J
from frostline.operators.evaluation import macro_f1
from frostline.operators.planning import top_confusions
from frostline.plans import gates
from frostline.registry import query
from frostline.sources.adapters import table
from frostline.sources.store import Store, shared_root, written


def _bounds(name: str, rows: tuple) -> str:
    number = lambda x: "NULL::DOUBLE" if x is None else f"{x}::DOUBLE"
    return f"{name}(metric, op, lo, hi, bound) AS (VALUES " + ", ".join(f"('{m}', '{op}', {number(lo)}, {number(hi)}, '{gates.bound_text(lo, hi)}')" for m, op, lo, hi in rows) + ")"


_EVALUATED = """SELECT metric, value, coalesce(ok, false) AS passed,
  CASE WHEN value IS NULL THEN 'not measured' WHEN NOT ok THEN printf('%.6f', value) || ' fails ' || op || ' ' || bound ELSE '' END AS reason FROM
  (SELECT b.metric, op, bound, round(value, 6) AS value, CASE op WHEN '>=' THEN value >= lo WHEN '<=' THEN value <= lo ELSE value BETWEEN lo AND hi END AS ok FROM b LEFT JOIN m USING (metric))"""
_GENERATION = _LOG + """, sv AS (SELECT *, CASE WHEN outcome NOT IN ('dropped_screener', 'dropped_guardrail') THEN doc_id % 97 <> 0 END AS schema_valid FROM f),
kept AS (SELECT * FROM sv WHERE outcome = 'kept'),
tg AS (SELECT cell, 10 + count(*) // 10 AS n FROM f GROUP BY cell), kc AS (SELECT cell, count(*) AS kept FROM kept GROUP BY cell),
m AS (SELECT 'schema_validity' AS metric, count(*) FILTER (schema_valid) * 1.0::DOUBLE / greatest(count(*), 1) AS value FROM sv
  UNION ALL SELECT 'round_trip_recovery', coalesce(avg(round_trip_ok::INT), 0) FROM kept
  UNION ALL SELECT 'screener_flag_rate', count(*) FILTER (verdict <> 'CONSISTENT') * 1.0::DOUBLE / greatest(count(*), 1) FROM sv
  UNION ALL SELECT 'guardrail_violation_rate', coalesce(avg((n_rules > 0)::INT), 0) FROM kept
  UNION ALL SELECT 'max_class_share', coalesce(max(c) * 1.0::DOUBLE / sum(c), 1.0::DOUBLE) FROM (SELECT count(*) AS c FROM kept GROUP BY disposition)
  UNION ALL SELECT 'cell_fill_deviation', coalesce(avg(abs(coalesce(kept, 0) - n) * 1.0::DOUBLE / greatest(n, 1)), 0) FROM tg LEFT JOIN kc USING (cell))
"""


def _generation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = ~F.col("outcome").isin("dropped_screener", "dropped_guardrail")
    return _funnel(spark, sf_dir).withColumn("schema_valid", F.when(reached, F.expr("doc_id % 97 <> 0")))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _generation_log(spark, sf_dir)
    return J.generation_metrics(log, log.groupBy("cell").agg((10 + F.floor(F.count("*") / 10)).alias("n")))


def _targets(log: DataFrame) -> DataFrame:
    return log.groupBy("cell").agg((10 + F.floor(F.count("*") / 10)).alias("n"))


#: With the share of near duplicates among the kept records' vectors; the probe has no SQL.
_GATE_A = _GENERATION.rstrip()[:-1] + """
  UNION ALL SELECT 'near_duplicate_rate', CASE WHEN (SELECT count(*) FROM kept) = 0 THEN 1.0 WHEN count(*) < 2 THEN 0.0 ELSE avg(coalesce(c > 0.95, false)::INT) END FROM
    (SELECT a.vec_id, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS c FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM kept)) a
     LEFT JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM kept)) b ON a.vec_id <> b.vec_id GROUP BY a.vec_id))
"""


def _gate_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = written(_generation_log(spark, sf_dir), "gate-log")
    return J.gate_a_metrics(log, _targets(log), table(spark, sf_dir, "embeddings"))


@query(_GATE_A + ", " + _bounds("b", gates.GATE_A) + ", ev AS (" + _EVALUATED + ") SELECT metric, value IS NOT NULL OR metric = 'leakage_probe_acc' AS measured, passed OR metric = 'leakage_probe_acc' AS passed FROM ev")
def gate_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate A over all eight computed metrics. The log's dispositions follow from ids, so the probe finds no leak."""
    return gates.evaluate(spark, _gate_a(spark, sf_dir)).select("metric", F.col("value").isNotNull().alias("measured"), "passed")


@query(_GATE_A + "SELECT metric, round(value, 9) AS value FROM m UNION ALL SELECT 'leakage_probe_acc', NULL::DOUBLE")
def gate_a_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The computed metrics; the fitted probe's, which has no SQL, is left open here and shows in ``leakage_probe``."""
    value = F.when(F.col("metric") != "leakage_probe_acc", F.round("value", 9))
    return _gate_a(spark, sf_dir).select("metric", value.alias("value"))


@query(_GENERATION + "SELECT metric, round(value, 9) AS value FROM m")
def generation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("metric", F.round("value", 9).alias("value"))


@query(_GENERATION + ", " + _bounds("b", gates.GATE_A) + _EVALUATED)
def gate_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.evaluate(spark, _metrics(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(_GENERATION + ", " + _bounds("b", gates.GATE_A) + ", e AS (" + _EVALUATED + ") SELECT bool_and(passed) AS passed, array_to_string(list_sort(list(metric || ': ' || reason) FILTER (NOT passed)), '; ') AS failures FROM e")
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.verdict(gates.evaluate(spark, _metrics(spark, sf_dir))).select("passed", F.array_join("failures", "; ").alias("failures"))


@query(_GENERATION + ", o AS (SELECT * FROM m UNION ALL SELECT 'language_authenticity', 4.0::DOUBLE UNION ALL SELECT 'annotator_kappa', 0.8::DOUBLE) SELECT metric, round(value, 9) AS value FROM o")
def human_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    human = spark.createDataFrame([("language_authenticity", 4.0), ("annotator_kappa", 0.8)], "metric string, value double")
    judged = _metrics(spark, sf_dir).unionByName(spark.createDataFrame([("annotator_kappa", 0.1)], "metric string, value double"))
    return J.with_override(judged, human).select("metric", F.round("value", 9).alias("value"))


_ITEMS = _LOG + """, i AS (SELECT doc_id, wave, cell, jurisdiction, is_adversarial, doc_id % 13 = 0 AS is_abstention, disposition AS truth,
  CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 6 = 1 OR (is_adversarial AND doc_id % 4 = 0) THEN 'reject' ELSE disposition END AS predicted, (doc_id % 10) / 20.0::DOUBLE AS hallucination, doc_id % 3 <> 0 AS abstention_correct FROM f),
j AS (SELECT doc_id, wave, cell, predicted IS NULL AS malformed, coalesce(predicted = truth, false) AS correct, CASE WHEN predicted IS NOT NULL THEN hallucination END AS hallucination,
  CASE WHEN predicted IS NOT NULL AND is_abstention THEN abstention_correct END AS abstention_correct FROM i)
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _funnel(spark, sf_dir).selectExpr(
        "doc_id", "wave", "cell", "jurisdiction", "is_adversarial", "doc_id % 13 = 0 AS is_abstention", "disposition AS truth",
        "CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 6 = 1 OR (is_adversarial AND doc_id % 4 = 0) THEN 'reject' ELSE disposition END AS predicted", "(doc_id % 10) / 20D AS hallucination", "doc_id % 3 <> 0 AS abstention_correct",
    )


def _f1(where: str, name: str = "c") -> str:
    """A subquery for the macro F1 of some items."""
    return f"""(SELECT avg(f1) FROM (SELECT label, 2.0::DOUBLE * sum(tp) / sum(n) AS f1 FROM (SELECT truth AS label, (truth = coalesce(predicted, ''))::INT AS tp, 1 AS n FROM i WHERE {where}
      UNION ALL SELECT coalesce(predicted, ''), 0, 1 FROM i WHERE {where}) GROUP BY label))"""


@query(_ITEMS + "SELECT doc_id, cell, malformed, correct, hallucination, abstention_correct FROM j")
def item_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.item_records(_items(spark, sf_dir)).select("doc_id", "cell", "malformed", "correct", "hallucination", "abstention_correct")


@query(_ITEMS + "SELECT cell, round(avg(correct::INT), 9) AS f1, count(*) AS n FROM j GROUP BY cell")
def cell_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.cell_accuracy(J.item_records(_items(spark, sf_dir))).withColumn("f1", F.round("f1", 9))


_HOLDOUT_METRICS = _ITEMS + f""", m AS (SELECT 'malformed_json_rate' AS metric, count(*) FILTER (malformed) * 1.0::DOUBLE / greatest(count(*), 1) AS value FROM j UNION ALL SELECT 'hallucinated_field_rate', coalesce(avg(hallucination), 0) FROM j
  UNION ALL SELECT 'abstention_precision', coalesce(avg(abstention_correct::INT), 1) FROM j UNION ALL SELECT 'abstention_recall', coalesce(avg(abstention_correct::INT), 1) FROM j
  UNION ALL SELECT 'adversarial_gap', abs({_f1('is_adversarial')} - {_f1('NOT is_adversarial')}) UNION ALL SELECT 'holdout_delta', abs({_f1('wave = 8')} - {_f1('wave <> 8')})
  UNION ALL SELECT 'cross_jurisdiction_delta', greatest({', '.join(_f1(f"jurisdiction = '{c}'") for c in ('AE', 'SA', 'QA', 'KW', 'OM', 'BH'))}) - least({', '.join(_f1(f"jurisdiction = '{c}'") for c in ('AE', 'SA', 'QA', 'KW', 'OM', 'BH'))}))
"""


def _holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    out = J.holdout_metrics(J.item_records(items))
    for more in (J.f1_gap(items, F.col("is_adversarial"), "adversarial_gap"), J.f1_gap(items, F.col("wave") == 8, "holdout_delta"), J.group_delta(items, F.col("jurisdiction"), "cross_jurisdiction_delta")):
        out = out.unionByName(more)
    return out


@query(_HOLDOUT_METRICS + "SELECT metric, round(value, 9) AS value FROM m")
def holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holdout_metrics(spark, sf_dir).select("metric", F.round("value", 9).alias("value"))


@query(_HOLDOUT_METRICS + ", " + _bounds("b", gates.GATE_B) + _EVALUATED)
def gate_b_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.evaluate(spark, _holdout_metrics(spark, sf_dir), gates.GATE_B).withColumn("value", F.round("value", 6))


@query(_ITEMS + "SELECT f.doc_id, f.wave, i.predicted FROM f JOIN i USING (doc_id) WHERE f.outcome = 'kept' AND f.wave BETWEEN 1 AND 6 AND ('0x' || left(sha256(f.doc_id::VARCHAR), 8))::BIGINT % 100 < 5")
def holdout_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.holdout_items(_funnel(spark, sf_dir), _items(spark, sf_dir).select("doc_id", "predicted"), 6).select("doc_id", "wave", "predicted")


@query(_ITEMS + "SELECT truth, predicted, count(*) AS n FROM i WHERE truth IS DISTINCT FROM predicted GROUP BY ALL ORDER BY n DESC, truth, predicted NULLS FIRST LIMIT 5")
def top_confusions_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_confusions(_items(spark, sf_dir))


_VOTES = "v AS (SELECT conv_id AS item, (length(text) % 5 + 1)::DOUBLE AS vote FROM conversations), md AS (SELECT item, quantile_cont(vote, 0.5) AS median FROM v GROUP BY item), ag AS (SELECT item, median, round(avg((abs(vote - median) <= 1e-6)::INT), 6) AS agreement FROM v JOIN md USING (item) GROUP BY ALL)"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item"), (F.char_length("text") % 5 + 1).cast("double").alias("vote"))


@query(f"WITH {_VOTES}, s AS (SELECT *, agreement < 0.6 AS escalated, CASE WHEN item % 3 = 0 THEN 2.0::DOUBLE END AS strict FROM ag) SELECT item, CASE WHEN escalated AND strict IS NOT NULL THEN strict ELSE median END AS consensus, CASE WHEN escalated AND strict IS NOT NULL THEN 1.0::DOUBLE ELSE agreement END AS agreement, escalated FROM s")
def strict_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").select(F.col("conv_id").alias("item"), F.lit(2.0).alias("strict")).distinct()
    return J.self_consistency(_votes(spark, sf_dir), strict)


@query(f"WITH {_VOTES} SELECT item, round(least(agreement, 1.0::DOUBLE - (coalesce(nullif((item % 6)::DOUBLE, 0), 5.0::DOUBLE) - 1.0::DOUBLE) / 4.0::DOUBLE), 9) AS kappa FROM ag")
def review_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frostline.operators.evaluation import vote_numeric

    return vote_numeric(_votes(spark, sf_dir)).select("item", F.round(J.board_kappa(F.col("agreement"), F.col("item") % 6), 9).alias("kappa"))


_REPLIES = "CASE conv_id % 4 WHEN 0 THEN 'I say {\"verdict\": \"keep\"}.' WHEN 1 THEN '{\"verdict\": 3}' WHEN 2 THEN 'none' ELSE '{\"other\": 1}' END"


@query(f"WITH r AS (SELECT conv_id, turn, {_REPLIES} AS reply FROM conversations), s AS (SELECT conv_id, turn, nullif(regexp_extract(reply, '(?s)(\\{{.*\\}})', 1), '') AS j FROM r) SELECT conv_id, turn, json_extract_string(CASE WHEN json_valid(j) THEN j END, '$.verdict') AS vote FROM s")
def parsed_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", J.parsed_vote(F.expr(_REPLIES)).alias("vote"))


_REVIEWS = "CASE WHEN doc_id % 9 = 0 THEN 'timeout' END AS error, quality = toxic AS agrees, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN {none} WHEN 2 THEN {empty} ELSE {one} END AS concerns"
_REVIEWED = "WITH r AS (SELECT " + _REVIEWS.format(none="['none']", empty="[]", one="['dates']") + " FROM labels)"


@query(_REVIEWED + " SELECT count(*) FILTER (error IS NULL AND agrees) AS agree, count(*) FILTER (error IS NULL AND NOT agrees) AS disagree, count(*) FILTER (error IS NOT NULL) AS errored, count(*) FILTER (error IS NULL AND concerns IS NOT NULL AND len(concerns) > 0 AND concerns <> ['none']) AS flagged, round(count(*) FILTER (error IS NULL AND agrees) * 1.0::DOUBLE / greatest(count(*), 1), 6) AS rate FROM r")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _REVIEWS.format(none="array('none')", empty="CAST(array() AS array<string>)", one="array('dates')").split(" AS concerns")[0] + " AS concerns"
    return J.review_summary(table(spark, sf_dir, "labels").selectExpr(*_columns(rows)))


def _columns(text: str) -> list[str]:
    """Splits 'a AS x, b AS y, c AS z' at the commas after names."""
    import re

    return re.split(r"(?<= AS error), |(?<= AS agrees), ", text)


@query(_LOG + "SELECT doc_id, cell, disposition, left(rendered_text, 3000) AS text FROM f WHERE outcome = 'kept' ORDER BY doc_id LIMIT 20")
def rows_for_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first kept rows: a limit is the feature."""
    rows = _funnel(spark, sf_dir).where("outcome = 'kept'").orderBy("doc_id").limit(20)
    return rows.select("doc_id", "cell", "disposition", F.substring("rendered_text", 1, 3000).alias("text"))


_CELL_F1 = _LOG + ", c AS (SELECT wave, cell, round(avg((outcome = 'kept')::INT), 6) AS f1 FROM f GROUP BY ALL)"


def _cell_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _funnel(spark, sf_dir).groupBy("wave", "cell").agg(F.round(F.avg((F.col("outcome") == "kept").cast("int")), 6).alias("f1"))


@query(_CELL_F1 + ", w AS (SELECT wave, count(*) AS requested, count(*) FILTER (outcome = 'kept') AS kept FROM f GROUP BY wave) SELECT w.wave, requested, kept, min_by(cell, (f1, cell)) AS worst_cell, min(f1) AS worst_f1, round(avg(f1), 6) AS mean_f1, count(*) FILTER (f1 >= 0.8) AS cells_passing FROM w JOIN c USING (wave) GROUP BY ALL")
def closed_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.ledger_row(_cell_f1(spark, sf_dir), _funnel(spark, sf_dir)).drop("cell_f1").withColumn("mean_f1", F.round("mean_f1", 6))


@query(_CELL_F1 + ", w AS (SELECT wave, count(*) AS requested, count(*) FILTER (outcome = 'kept') AS kept FROM f GROUP BY wave) SELECT w.wave, requested, kept, min_by(cell, (f1, cell)) AS worst_cell, min(f1) AS worst_f1, count(*) FILTER (f1 >= 0.8) AS cells_passing FROM w JOIN c USING (wave) GROUP BY ALL")
def ledger_after_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves are closed twice, at first with empty rows for some: the ledger keeps one row a wave, the last one written."""
    store = Store(spark, shared_root(spark))
    rows = written(J.ledger_row(_cell_f1(spark, sf_dir), _funnel(spark, sf_dir)), "ledger-rows")
    store.replace_waves("ledger", rows.where("wave <= 5").withColumns({"requested": F.lit(0).cast("long"), "worst_cell": F.lit("")}))
    store.replace_waves("ledger", rows)
    return store.scan("ledger").select("wave", "requested", "kept", "worst_cell", "worst_f1", "cells_passing")


@query(_CELL_F1 + ", w AS (SELECT wave, min(f1) AS worst FROM c GROUP BY wave) SELECT wave, worst, lag(worst) OVER (ORDER BY wave) AS before, coalesce(worst < lag(worst) OVER (ORDER BY wave), false) AS fell FROM w")
def worst_cell_by_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each wave beside the one before. The window sees one row a wave."""
    worst = _cell_f1(spark, sf_dir).groupBy("wave").agg(F.min("f1").alias("worst"))
    before = F.lag("worst").over(Window.orderBy("wave"))
    return worst.select("wave", "worst", before.alias("before"), F.coalesce(F.col("worst") < before, F.lit(False)).alias("fell"))


@query(_LOG + ", c AS (SELECT cell, avg((outcome = 'kept')::INT) FILTER (wave <= 4) AS b, avg((outcome = 'kept')::INT) FILTER (wave > 4) AS n FROM f GROUP BY cell), o AS (SELECT coalesce(min(n) < min(b), false) AS worst_fell, count(*) FILTER (b >= 0.8 AND coalesce(n, 0) < 0.8) AS cells_lost FROM c) SELECT *, NOT worst_fell AND cells_lost = 0 AS passed FROM o")
def ratchet_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of the log from one pass over it."""
    kept = (F.col("outcome") == "kept").cast("int")
    both = _funnel(spark, sf_dir).groupBy("cell").agg(F.avg(F.when(F.col("wave") <= 4, kept)).alias("b"), F.avg(F.when(F.col("wave") > 4, kept)).alias("n"))
    return gates.ratchet_rows(both)


@query(_LOG + "SELECT disposition, count(*) AS n, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM f WHERE outcome = 'kept' GROUP BY disposition")
def disposition_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass; the window sees one row a disposition."""
    counts = _funnel(spark, sf_dir).where("outcome = 'kept'").groupBy("disposition").agg(F.count("*").alias("n"))
    return counts.select("disposition", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query(_ITEMS + f"SELECT round({_f1('true')}, 6) AS macro_f1, count(*) AS n FROM i")
def overall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro_f1(_items(spark, sf_dir).withColumn("predicted", F.coalesce("predicted", F.lit(""))))


_AUDIT = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {key} AS key, count(*) AS n, count(*) FILTER (n_rules > 0) AS violations FROM f GROUP BY ALL" for kind, key in (("all", "''"), ("cell", "cell"), ("jurisdiction", "jurisdiction"), ("artifact_type", "artifact_type"), ("disposition", "disposition"), ("screener", "verdict"), ("outcome", "outcome")))
_BY_RULE = " UNION ALL ".join(f"SELECT 'rule', '{rule}', count(*), count(*) FROM f WHERE {hit} HAVING count(*) > 0" for rule, hit in (("GCC-EDGE-018", "h18"), ("GCC-EDGE-015", "h15"), ("GCC-EDGE-002", "h02")))


@query(_LOG + _AUDIT + " UNION ALL " + _BY_RULE)
def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit in one pass: records and violations in all, by axis, by disposition, verdict, outcome and rule."""
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    axes = [pair("all", F.lit("")), *(pair(kind, F.col(c)) for kind, c in (("cell", "cell"), ("jurisdiction", "jurisdiction"), ("artifact_type", "artifact_type"), ("disposition", "disposition"), ("screener", "verdict"), ("outcome", "outcome")))]
    each = F.concat(F.array(*axes), F.transform("rules", lambda r: pair("rule", r)))
    rows = _funnel(spark, sf_dir).select((F.size("rules") > 0).alias("hit"), F.explode(each).alias("x"))
    return rows.groupBy("x.kind", "x.key").agg(F.count("*").alias("n"), F.count_if("hit").alias("violations"))


@query(_CELL_F1 + " SELECT wave, round(avg(f1), 6) AS mean_f1, min_by(cell, (f1, cell)) AS worst_cell, count(*) FILTER (f1 >= 0.1) AS passing FROM c GROUP BY wave")
def map_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, least and counted values of each wave's map of cells."""
    maps = _cell_f1(spark, sf_dir).groupBy("wave").agg(F.map_from_entries(F.collect_list(F.struct("cell", "f1"))).alias("m"))
    values = F.map_values("m")
    least = F.array_min(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]
    return maps.select(
        "wave", F.round(F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values), 6).alias("mean_f1"), least.alias("worst_cell"), F.size(F.filter(values, lambda x: x >= 0.1)).cast("long").alias("passing")
    )
