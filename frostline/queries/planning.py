"""Planning queries over the generation log: coverage, deficits, allocations, splits, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.catalog import _LOG, _funnel
from frostline.operators import planning as P
from frostline.registry import query
from frostline.sources.store import written

WAVE, TARGET = 9, 12

_CELLS = """cells AS (SELECT p || '|' || f AS cell, p AS product, f AS fault, (pp * 5 + fp)::INT AS place FROM
    (SELECT unnest(['finfish_seafood', 'table_eggs', 'chilled_dairy', 'frozen_goods']) AS p, unnest([0, 1, 2, 3]) AS pp),
    (SELECT unnest(['in_spec', 'door_open', 'compressor_fail', 'setpoint_drift', 'sensor_artifact']) AS f, unnest([0, 1, 2, 3, 4]) AS fp))"""
_COVERAGE = _LOG + f""", {_CELLS},
seen AS (SELECT cell, count(*) AS requested, count(*) FILTER (outcome = 'kept') AS kept, max(wave) AS last_wave FROM f GROUP BY cell),
cov AS (SELECT cell, product, fault, place, coalesce(requested, 0) AS requested, coalesce(kept, 0) AS kept, coalesce(last_wave, 0) AS last_wave FROM cells LEFT JOIN seen USING (cell))
"""
_LEDGER = """, led AS (SELECT wave, cell, round(avg((outcome = 'kept')::INT), 6) AS f1 FROM f GROUP BY ALL),
f1 AS (SELECT cell, f1 FROM led WHERE wave = (SELECT max(wave) FROM led))
"""


def _scored(wave: int, faults: str = "true") -> str:
    return _COVERAGE + _LEDGER + f""", sc AS (SELECT cell, product, fault, place, kept, f1, 0.45::DOUBLE * greatest(0.0::DOUBLE, ({TARGET} - kept) / {TARGET}.0::DOUBLE) + 0.4::DOUBLE * (1.0::DOUBLE - coalesce(f1, 0.5::DOUBLE))
    + 0.15::DOUBLE * (CASE WHEN last_wave = 0 THEN 1.0::DOUBLE ELSE least({wave} - last_wave, 4) / 4.0::DOUBLE END) AS score FROM cov LEFT JOIN f1 USING (cell) WHERE kept < {TARGET} * 1.05::DOUBLE AND {faults})
"""


_ALLOCATED = """, raw AS (SELECT *, 663 * score / sum(score) OVER () AS v FROM sc),
n0 AS (SELECT *, least(132, round_even(v, 0)::INT) AS n0 FROM raw), sp AS (SELECT *, 663 - sum(n0) OVER () AS spare, 132 - n0 AS room FROM n0),
ah AS (SELECT *, coalesce(sum(room) OVER (ORDER BY score DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM sp),
al AS (SELECT cell, product, fault, place, score, (n0 + greatest(0, least(room, spare - ahead)))::INT AS n FROM ah),
pl AS (SELECT * FROM al WHERE n > 0)
"""
_PLAN = _scored(WAVE) + _ALLOCATED


def _ledger(log: DataFrame) -> DataFrame:
    per = log.groupBy("wave", "cell").agg(F.round(F.avg((F.col("outcome") == "kept").cast("int")), 6).alias("f1"))
    return per.groupBy("wave").agg(F.map_from_entries(F.collect_list(F.struct("cell", "f1"))).alias("cell_f1"))


def _scores(spark: SparkSession, sf_dir: str, wave: int = WAVE) -> DataFrame:
    log = _funnel(spark, sf_dir)
    return P.deficits(P.coverage_of_cells(log), P.latest_cell_f1(_ledger(log)), wave, TARGET)


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan, written: requests read it several times and shouldn't scan the log for each."""
    return written(P.plan(P.require_rows(_scores(spark, sf_dir), "no eligible cells"), WAVE), "plan")


@query(_COVERAGE + "SELECT cell, product, fault, place, requested FROM cov")
def all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell with what the log has of it."""
    seen = P.coverage_of_cells(_funnel(spark, sf_dir)).select("cell", "requested")
    return P.all_cells(spark).join(seen, "cell").select("cell", "product", "fault", "place", "requested")


@query(_COVERAGE + "SELECT cell, requested, kept, last_wave FROM cov")
def zero_filled_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.coverage_of_cells(_funnel(spark, sf_dir)).select("cell", "requested", "kept", "last_wave")


@query(_COVERAGE + f"SELECT cell, CASE WHEN last_wave = 0 THEN 1.0::DOUBLE ELSE least({WAVE} - last_wave, 4) / 4.0::DOUBLE END AS stale FROM cov")
def cell_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.coverage_of_cells(_funnel(spark, sf_dir)).select("cell", P.staleness(F.col("last_wave"), WAVE).alias("stale"))


@query(_COVERAGE + _LEDGER + "SELECT cell, coalesce(f1, 0.5::DOUBLE) AS f1 FROM cov LEFT JOIN f1 USING (cell)")
def latest_cell_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _funnel(spark, sf_dir)
    return P.all_cells(spark).join(F.broadcast(P.latest_cell_f1(_ledger(log))), "cell", "left").select("cell", F.coalesce("f1", F.lit(P.UNKNOWN_F1)).alias("f1"))


@query(_scored(WAVE) + "SELECT cell, kept, round(score, 9) AS score FROM sc")
def deficit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("cell", "kept", F.round("score", 9).alias("score"))


@query(_scored(2, "fault IN ('compressor_fail', 'setpoint_drift', 'sensor_artifact')") + "SELECT cell, round(score, 9) AS score FROM sc")
def deficit_scores_in_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second wave is restricted to three fault modes."""
    return _scores(spark, sf_dir, 2).select("cell", F.round("score", 9).alias("score"))


@query(_PLAN + "SELECT cell, n FROM pl")
def proportional_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.allocate(_scores(spark, sf_dir)).select("cell", "n")


@query(_PLAN + "SELECT cell, n, row_number() OVER (ORDER BY n DESC, place) AS rank, round_even(n * 0.15::DOUBLE, 0)::INT AS adversarial, round_even(n * 0.08::DOUBLE, 0)::INT AS abstention, false AS holdout FROM pl ORDER BY n DESC, place")
def wave_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("n"), "place"))
    return _plan(spark, sf_dir).withColumn("rank", rank).orderBy(F.desc("n"), "place").select("cell", "n", "rank", "adversarial", "abstention", "holdout")


_SPLIT = """, ax AS (SELECT 'artifact' AS axis, unnest(['logger_csv', 'chat_message', 'qc_form_ocr', 'voice_note']) AS key, unnest([0, 1, 2, 3]) AS i, 4 AS k
  UNION ALL SELECT 'jurisdiction', unnest(['AE', 'SA', 'QA', 'KW', 'OM', 'BH']), unnest([0, 1, 2, 3, 4, 5]), 6),
split AS (SELECT cell, axis, key, i, (pl.n // k + (i < pl.n % k)::INT)::INT AS n FROM pl, ax)
"""


@query(_PLAN + _SPLIT + "SELECT cell, axis, key, n FROM split")
def balanced_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = _plan(spark, sf_dir)
    each = lambda axis: planned.select("cell", F.lit(axis).alias("axis"), F.explode(f"{axis}_split").alias("s")).select("cell", "axis", "s.key", "s.n")
    return each("artifact").unionByName(each("jurisdiction"))


_TURNS = """, turns AS (SELECT cell, axis, key, row_number() OVER (PARTITION BY cell, axis ORDER BY turn, i) - 1 AS i FROM (SELECT cell, axis, key, i, unnest(range(1, n + 1)) AS turn FROM split))
"""


@query(_PLAN + _SPLIT + _TURNS + "SELECT cell, key, i FROM turns WHERE axis = 'jurisdiction'")
def interleaved_jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.round_robin(_plan(spark, sf_dir), "jurisdiction_split")


_REQUESTS = _PLAN + _SPLIT + _TURNS + f""", base AS (SELECT cell, place, n, unnest(range(n)) AS i FROM pl),
rq AS (SELECT b.*, '{WAVE}:' || b.cell || ':' || b.i AS nm, a.key AS artifact_type, j.key AS jurisdiction FROM base b JOIN turns a ON a.cell = b.cell AND a.i = b.i AND a.axis = 'artifact' JOIN turns j ON j.cell = b.cell AND j.i = b.i AND j.axis = 'jurisdiction'),
rk AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY sha256('overlay:' || nm)) AS rk, round_even(n * 0.15::DOUBLE, 0) AS adv, round_even(n * 0.08::DOUBLE, 0) AS abst FROM rq),
req AS (SELECT cell, place, i, artifact_type, jurisdiction, 'en' AS language, rk <= adv AS is_adversarial, rk > adv AND rk <= adv + abst AS is_abstention, ('0x' || left(sha256(nm), 12))::BIGINT AS rng_seed FROM rk)
"""


@query(_REQUESTS + "SELECT * EXCLUDE (place) FROM req")
def generation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.requests(_plan(spark, sf_dir), WAVE).drop("product", "fault", "place")


@query(_REQUESTS + "SELECT cell, i, rng_seed FROM req ORDER BY place, i LIMIT 50")
def capped_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first records of a plan: a limit on records is the feature."""
    return P.requests(_plan(spark, sf_dir), WAVE).orderBy("place", "i").limit(50).select("cell", "i", "rng_seed")


_FOCUS = """w(wave, faults, artifacts, adversarial_share, abstention_share, holdout) AS (VALUES (1, ['in_spec', 'door_open'], NULL, 0.15::DOUBLE, 0.08::DOUBLE, false), (2, ['compressor_fail', 'setpoint_drift', 'sensor_artifact'], NULL, 0.15, 0.08, false),
  (3, NULL, {artifacts}, 0.15, 0.08, false), (4, NULL, NULL, 0.15, 0.08, false), (5, NULL, NULL, 0.6, 0.08, false), (6, NULL, NULL, 0.15, 0.55, false), (7, NULL, NULL, 0.15, 0.08, false), (8, NULL, NULL, 0.15, 0.08, true), (9, NULL, NULL, 0.15, 0.08, false))"""
_WAVE_3 = "[" + ", ".join(f"'{a}'" for a in next(x for x in P.WAVE_FOCUS if x[0] == 3)[2]) + "]"


@query(_LOG + ", " + _FOCUS.format(artifacts=_WAVE_3) + """ SELECT w.wave, adversarial_share, abstention_share, holdout, count(f.doc_id) AS records,
  count(f.doc_id) FILTER ((faults IS NULL OR list_contains(faults, split_part(cell, '|', 2))) AND (artifacts IS NULL OR list_contains(artifacts, artifact_type))) AS in_focus FROM w LEFT JOIN f ON f.wave = w.wave GROUP BY ALL""")
def wave_focus_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each wave's focus, and how many of its records keep to it."""
    focus = P.wave_focus(spark, 1)
    for wave in range(2, 10):
        focus = focus.unionByName(P.wave_focus(spark, wave))
    log = _funnel(spark, sf_dir).select("wave", "artifact_type", F.split("cell", r"\|")[1].alias("fault")).groupBy("wave", "artifact_type", "fault").agg(F.count("*").alias("n"))
    of = lambda allowed, c: F.col(allowed).isNull() | F.array_contains(allowed, F.col(c))
    n = F.coalesce("n", F.lit(0))
    keeps = F.when(of("faults", "fault") & of("artifacts", "artifact_type"), n).otherwise(0)
    return focus.join(log, "wave", "left").groupBy("wave", "adversarial_share", "abstention_share", "holdout").agg(F.sum(n).alias("records"), F.sum(F.coalesce(keeps, F.lit(0))).alias("in_focus"))


@query(_LOG + ", r AS (SELECT cell, round(avg((outcome = 'kept')::INT), 3) AS rate FROM f WHERE wave = 8 GROUP BY cell) SELECT cell, rate, cell || ': survival ' || printf('%.2f', rate) || ', rendering suspected' AS message FROM r WHERE rate < 0.75")
def low_survival_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _funnel(spark, sf_dir).where("wave = 8").groupBy("cell").agg(F.round(F.avg((F.col("outcome") == "kept").cast("int")), 3).alias("rate"))
    return P.low_survival(rates)


@query("SELECT doc_id, array_to_string(list_distinct_in_order, ',') AS merged FROM (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_in_order FROM (SELECT doc_id, [source, lang, source] || [lang, 'x'] AS l FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL))")
def merged_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frostline.sources.adapters import table

    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    both = P.merged_escalations(F.array("source", "lang", "source"), F.array("lang", F.lit("x")))
    return rows.select("doc_id", F.array_join(both, ",").alias("merged"))


@query("SELECT doc_id, left(sha256(coalesce(lang, '') || source), 12) AS template_hash FROM documents")
def template_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frostline.sources.adapters import table

    return table(spark, sf_dir, "documents").select("doc_id", P.short_hash(F.concat(F.coalesce("lang", F.lit("")), "source")).alias("template_hash"))
