"""Votes of mixed types, bands of packs, fingerprints of rules, and results handed in as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.catalog import _COLUMNS, _LABEL, _SERIES, _TELEMETRY
from frostline.functions import rules as R
from frostline.operators import voting as V
from frostline.operators.disposition import label_series
from frostline.operators.judging import item_records
from frostline.plans import results as H
from frostline.queries.judging import _ITEMS, _bounds, _items
from frostline.plans import gates
from frostline.registry import query
from frostline.sources.adapters import table, telemetry
from frostline.sources.packs import dimension

# ---- votes

#: Replies of judges: numbers, numbers and texts, texts, nothing, halves and truth values, some broken.
_REPLY = """CASE conv_id % 6
 WHEN 0 THEN concat('I rate {"verdict": ', CAST(length(text) % 3 AS string), ', "rationale": "r', CAST(turn AS string), '"} done')
 WHEN 1 THEN CASE WHEN turn % 2 = 0 THEN '{"verdict": 3}' ELSE '{"verdict": "keep", "rationale": "so"}' END
 WHEN 2 THEN concat('{"rationale": "t', CAST(turn AS string), '", "verdict": "', role, '"}')
 WHEN 3 THEN 'no verdict here'
 WHEN 4 THEN CASE turn % 3 WHEN 0 THEN '{"verdict": 2.5}' WHEN 1 THEN '{"verdict": true}' ELSE '{"verdict": null}' END
 ELSE CASE turn % 2 WHEN 0 THEN '{broken' ELSE concat('{"verdict": ', CAST(turn AS string), '}') END END"""
_STRICT = """CASE conv_id % 4 WHEN 0 THEN '{"verdict": "hold", "rationale": "strict"}' WHEN 1 THEN '{"verdict": 4}' WHEN 2 THEN 'none' END"""
_VOTES = f"""WITH r AS (SELECT conv_id AS item, turn AS position, nullif(regexp_extract({_REPLY}, '(?s)(\\{{.*\\}})', 1), '') AS j FROM conversations),
v AS (SELECT item, position, json_type(j, '$.verdict') AS kind, json_extract_string(j, '$.verdict') AS t, coalesce(json_extract_string(j, '$.rationale'), '') AS rationale FROM r WHERE j IS NOT NULL AND json_valid(j)),
w AS (SELECT item, position, rationale, CASE kind WHEN 'VARCHAR' THEN NULL WHEN 'BOOLEAN' THEN (t = 'true')::INT::DOUBLE ELSE t::DOUBLE END AS number,
  CASE WHEN kind = 'BOOLEAN' THEN CASE t WHEN 'true' THEN 'True' ELSE 'False' END ELSE t END AS said FROM v WHERE kind IS NOT NULL AND kind <> 'NULL'),
n AS (SELECT item, bool_and(number IS NOT NULL) AS numeric_, quantile_cont(number, 0.5) AS median, count(*) AS n_votes, string_agg(rationale, '; ' ORDER BY position)[:2000] AS rationale FROM w GROUP BY item),
m AS (SELECT item, max_by(said, (n, -seen)) AS said, max(n) AS most FROM (SELECT item, said, count(*) AS n, min(position) AS seen FROM w GROUP BY ALL) GROUP BY item),
a AS (SELECT n.item, n_votes, numeric_, median, m.said, rationale, CASE WHEN numeric_ THEN (SELECT count(*) FILTER (abs(w.number - median) <= 1e-6) FROM w WHERE w.item = n.item) ELSE most END * 1.0::DOUBLE / n_votes AS agreement FROM n JOIN m USING (item)),
c AS (SELECT i.item, coalesce(n_votes, 0) AS n_votes, CASE WHEN numeric_ THEN median END AS number, CASE WHEN NOT numeric_ THEN said END AS said, coalesce(agreement, 0) AS agreement, coalesce(agreement, 0) < 0.6 AS escalated,
  coalesce(rationale, 'all judge votes unparseable') AS rationale FROM (SELECT DISTINCT item FROM r) i LEFT JOIN a USING (item))
"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item"), F.col("turn").alias("position"), F.expr(_REPLY).alias("reply"))


@query(_VOTES + "SELECT item, n_votes, number, said, round(agreement, 9) AS agreement, escalated, rationale FROM c")
def mixed_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.consensus(_replies(spark, sf_dir)).withColumn("agreement", F.round("agreement", 9))


@query(_VOTES + """, s AS (SELECT DISTINCT conv_id AS item, conv_id % 4 AS k FROM conversations),
x AS (SELECT c.*, k, escalated AND n_votes > 0 AND k IN (0, 1) AS taken FROM c JOIN s USING (item))
SELECT item, n_votes, CASE WHEN taken THEN CASE k WHEN 1 THEN 4.0::DOUBLE END ELSE number END AS number, CASE WHEN taken THEN CASE k WHEN 0 THEN 'hold' END ELSE said END AS said,
  CASE WHEN taken THEN 1.0::DOUBLE ELSE round(agreement, 9) END AS agreement, escalated, CASE WHEN taken THEN CASE k WHEN 0 THEN 'strict' ELSE '' END ELSE rationale END AS rationale FROM x""")
def mixed_votes_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item"), F.expr(_STRICT).alias("reply")).distinct()
    return V.with_strict(V.consensus(_replies(spark, sf_dir)), strict).withColumn("agreement", F.round("agreement", 9))


# ---- bands, specs and fingerprints

#: Packs of the regions; that of region 0 has the built-in bands.
_PACK = """concat('{"meta": {"region": "', r_name, '"}, "temperature_bands": {"chilled_fresh_seafood": {"range_c": [', CAST(-(r_regionkey % 2) AS string), ', 4.0], "basis": "B-', CAST(r_regionkey AS string),
 '"}, "note": "see annex", "chilled_general": {"range_c": [0, ', CAST(5 + r_regionkey AS string), ']}, "limits": [1, 2], "frozen": {"max_c": ', CAST(-18 - r_regionkey % 3 AS string),
 CASE WHEN r_regionkey % 2 = 1 THEN ', "refreeze_flag_c": -11.5' ELSE '' END, '}, "band_', CAST(r_regionkey AS string), '": {"max_c": 25}}}')"""
_PACKS = f"""pk AS (SELECT r_regionkey AS pack, {_PACK} AS j FROM region),
bk AS (SELECT pack, unnest(json_keys(j, '$.temperature_bands')) AS band, json_extract(j, '$.temperature_bands') AS b FROM pk),
bo AS (SELECT pack, band, json_extract(b, '$.' || band) AS s FROM bk),
bands AS (SELECT pack, band, json_extract(s, '$.range_c[0]')::DOUBLE AS min_c, coalesce(json_extract(s, '$.range_c[1]'), json_extract(s, '$.max_c'))::DOUBLE AS max_c,
  json_extract(s, '$.refreeze_flag_c')::DOUBLE AS refreeze_c, coalesce(json_extract_string(s, '$.basis'), '') AS basis FROM bo WHERE json_type(s) = 'OBJECT'),
of_product(product, band, hold_min, reject_min, shelf_days) AS (VALUES ('finfish_seafood', 'chilled_fresh_seafood', 60, 180, 5), ('table_eggs', 'chilled_general', 240, 720, 28), ('chilled_dairy', 'chilled_general', 90, 240, 10), ('frozen_goods', 'frozen', 30, 120, 180)),
pack_specs AS (SELECT pack, product, CASE WHEN band <> 'frozen' THEN min_c END AS min_c, max_c, CASE WHEN band = 'frozen' THEN coalesce(refreeze_c, -12.0) END AS refreeze_c, hold_min, reject_min, shelf_days, basis AS clause FROM of_product JOIN bands USING (band))
"""


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pack"), F.parse_json(F.expr(_PACK)).alias("v"))
    return R.bands_of_packs(packs, "pack")


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension(spark, f"specs:{sf_dir}", lambda: R.specs_of_packs(_bands(spark, sf_dir), "pack"))


@query(f"WITH {_PACKS} SELECT * FROM bands")
def bands_of_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(spark, sf_dir)


@query(f"WITH {_PACKS} SELECT * FROM pack_specs")
def specs_of_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _specs(spark, sf_dir)


@query("SELECT * FROM (VALUES ('finfish_seafood', 0.0::DOUBLE, 4.0::DOUBLE, NULL::DOUBLE, 60, 180, 5), ('table_eggs', 0.0, 5.0, NULL, 240, 720, 28), ('chilled_dairy', 0.0, 5.0, NULL, 90, 240, 10), ('frozen_goods', NULL, -18.0, -12.0, 30, 120, 180)) AS t(product, min_c, max_c, refreeze_c, hold_min, reject_min, shelf_days)")
def product_specs_from_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specs of the pack that has the built-in bands."""
    return _specs(spark, sf_dir).where("pack = 0").drop("pack", "clause")


def _under(pack: str) -> str:
    """The SQL of labels with the bounds of a pack in place of the built-in ones."""
    before, rows = _TELEMETRY.split("r AS (SELECT", 1)
    rows = rows.replace("specs.* EXCLUDE (product)", "pack_specs.* EXCLUDE (product, pack, clause)")
    rows = rows.replace("LEFT JOIN specs USING (product)", f"LEFT JOIN pack_specs ON pack_specs.product = t.product AND pack_specs.pack = {pack}")
    return f"{before}{_PACKS.rstrip()}, r AS (SELECT{rows}{_LABEL.format(keys='series_id')}SELECT series_id, {_COLUMNS} FROM l"


@query(_under("0"))
def label_series_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels under the loaded specs of one pack."""
    return label_series(telemetry(spark, sf_dir), "series_id", specs=F.broadcast(_specs(spark, sf_dir).where("pack = 0").drop("pack")))


@query(_under("t.series_id % 5"))
def label_series_by_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each series under its own pack."""
    rows = telemetry(spark, sf_dir).withColumn("pack", F.expr("series_id % 5"))
    return label_series(rows, "series_id", specs=F.broadcast(_specs(spark, sf_dir)), by=("pack", "product"))


#: An older table of rules: life's end was no reason to hold.
OLDER = tuple(r for r in R.RULES if r[2] != "R042_end_of_life")


@query(_SERIES + f""", e AS (SELECT series_id, CASE WHEN series_id % 3 = 0 AND rule_id = 'R042_end_of_life' THEN 'R060_in_spec' ELSE rule_id END AS rule_id,
 left(sha256(CASE WHEN series_id % 3 = 0 THEN '{R.rule_text(OLDER)}' ELSE '{R.rule_text()}' END), 12) AS engine FROM l)
SELECT series_id, rule_id, engine, engine <> left(sha256('{R.rule_text()}'), 12) AS stale FROM e""")
def labels_of_older_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the series carry labels of an older rule table, and show as stale."""
    rows = telemetry(spark, sf_dir)
    old = R.stamped(label_series(rows.where("series_id % 3 = 0"), "series_id", rules=OLDER), OLDER)
    new = R.stamped(label_series(rows.where("series_id % 3 <> 0"), "series_id"))
    return R.stale(old.unionByName(new)).select("series_id", "rule_id", "engine", "stale")


# ---- results handed in as JSON

_RESULTS = _ITEMS + f""", hc AS (SELECT wave, cell, round(avg(correct::INT), 6) AS f1 FROM j WHERE wave <> 5 GROUP BY ALL),
m AS (SELECT wave, 'malformed_json_rate' AS metric, round(count(*) FILTER (malformed) * 0.05::DOUBLE / count(*), 6) AS value FROM j GROUP BY wave
  UNION ALL SELECT wave, 'holdout_delta', round((wave % 4) / 50.0::DOUBLE, 6) FROM (SELECT DISTINCT wave FROM j) UNION ALL SELECT wave, 'abstention_recall', round(avg(correct::INT), 6) FROM j WHERE wave % 3 <> 0 GROUP BY wave),
{_bounds("b", gates.GATE_B)},
ev AS (SELECT w.wave, b.metric, round(value, 6) AS value, op, bound, CASE op WHEN '>=' THEN value >= lo WHEN '<=' THEN value <= lo ELSE value BETWEEN lo AND hi END AS ok FROM (SELECT DISTINCT wave FROM j) w, b LEFT JOIN m ON m.wave = w.wave AND m.metric = b.metric),
gv AS (SELECT wave, bool_and(coalesce(ok, false)) AS metrics_passed, array_to_string(list_sort(list(metric || ': ' || CASE WHEN value IS NULL THEN 'not measured' ELSE printf('%.6f', value) || ' fails ' || op || ' ' || bound END) FILTER (NOT coalesce(ok, false))), '; ') AS failures FROM ev GROUP BY wave),
sl AS (SELECT w.wave, coalesce(min_by(cell, (f1, cell)), '') AS worst_cell, coalesce(min(f1), 0) AS worst_f1, count(*) FILTER (f1 >= 0.8) AS cells_passing, round(coalesce(avg(f1), 0), 6) AS mean_f1, max(hc.wave) AS has FROM (SELECT DISTINCT wave FROM j) w LEFT JOIN hc USING (wave) GROUP BY w.wave),
tc AS (SELECT wave, string_agg(truth || '>' || predicted, ';' ORDER BY n DESC, truth, predicted) AS top_confusions FROM
  (SELECT *, row_number() OVER (PARTITION BY wave ORDER BY n DESC, truth, predicted) AS rk FROM (SELECT wave, truth, predicted, count(*) AS n FROM i WHERE predicted IS NOT NULL AND truth <> predicted GROUP BY ALL)) WHERE rk <= 5 GROUP BY wave),
pv AS (SELECT sl.*, (SELECT max(x.wave) FROM sl x WHERE x.wave < sl.wave AND x.has IS NOT NULL) AS pw FROM sl),
ls AS (SELECT pv.wave, string_agg(a.cell, ', ' ORDER BY a.cell) AS lost FROM pv JOIN hc a ON a.wave = pv.pw LEFT JOIN hc c ON c.wave = pv.wave AND c.cell = a.cell WHERE a.f1 >= 0.8 AND coalesce(c.f1, 0) < 0.8 GROUP BY pv.wave),
rt AS (SELECT pv.*, o.worst_f1 AS was, ls.lost FROM pv LEFT JOIN sl o ON o.wave = pv.pw LEFT JOIN ls ON ls.wave = pv.wave)
SELECT rt.wave, worst_cell, worst_f1, cells_passing, mean_f1, coalesce(top_confusions, '') AS top_confusions, metrics_passed, failures, (pw IS NULL OR (worst_f1 >= was AND lost IS NULL)) AS ratchet_ok, metrics_passed AND (pw IS NULL OR (worst_f1 >= was AND lost IS NULL)) AS passed,
  CASE WHEN pw IS NULL THEN 'first measured wave' WHEN worst_f1 < was THEN printf('worst_cell_f1 fell %.3f -> %.3f', was, worst_f1) WHEN lost IS NOT NULL THEN 'cells dropped below 0.80: ' || lost ELSE printf('worst_cell_f1 %.3f -> %.3f', was, worst_f1) END AS ratchet_note
FROM rt JOIN gv USING (wave) LEFT JOIN tc USING (wave)"""


def _handed_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(wave, doc): the JSON document of each wave. Some lack a metric, one has no cells."""
    items = item_records(_items(spark, sf_dir))
    right = F.avg(F.col("correct").cast("int"))
    cells = items.where("wave <> 5").groupBy("wave", "cell").agg(F.round(right, 6).alias("f1"))
    cells = cells.groupBy("wave").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cell", "f1")))).alias("cell_f1"))
    wrong = items.where("predicted IS NOT NULL AND truth <> predicted").groupBy("wave", "truth", "predicted").agg(F.count("*").alias("n"))
    pair = F.concat(F.lit('[["'), F.col("truth"), F.lit('", "'), F.col("predicted"), F.lit('"], '), F.col("n").cast("string"), F.lit("]"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("truth", "predicted", pair.alias("t")))), lambda x: x["t"])
    wrong = wrong.groupBy("wave").agg(F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]")).alias("confusions"))
    metrics = items.groupBy("wave").agg(
        F.round(F.count_if("malformed") * 0.05 / F.count("*"), 6).alias("malformed_json_rate"), F.round(F.first(F.col("wave") % 4) / 50, 6).alias("holdout_delta"),
        F.when(F.first("wave") % 3 != 0, F.round(right, 6)).alias("abstention_recall"),
    )
    told = metrics.select("wave", F.to_json(F.struct("malformed_json_rate", "holdout_delta", "abstention_recall")).alias("m"))
    rows = told.join(cells, "wave", "left").join(wrong, "wave", "left")
    body = F.concat(F.lit('{"metrics": '), F.col("m"), F.lit(', "cell_f1": '), F.coalesce(F.to_json("cell_f1"), F.lit("{}")), F.coalesce(F.concat(F.lit(', "confusions": '), F.col("confusions")), F.lit("")), F.lit("}"))
    return rows.select("wave", body.alias("doc"))


@query(_RESULTS)
def human_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all waves through Gate B, slices and the ratchet."""
    out = H.gate_b(_handed_in(spark, sf_dir))
    pairs = F.array_join(F.transform("top_confusions", lambda p: F.array_join(p, ">")), ";")
    return out.select("wave", "worst_cell", "worst_f1", "cells_passing", F.round("mean_f1", 6).alias("mean_f1"), pairs.alias("top_confusions"), "metrics_passed", F.array_join("failures", "; ").alias("failures"), "ratchet_ok", "passed", "ratchet_note")
