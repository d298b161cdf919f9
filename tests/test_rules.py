"""Hand cases of the rule engine, the guardrails, gates and the streaming replay."""

import pytest
from pyspark.sql import functions as F

from frostline.functions.guardrails import screener_verdict, violations
from frostline.functions.rules import ALL_SENTINELS, PRODUCT_BANDS, PRODUCTS, SENTINELS, bands_from_json, clean_readings, specs_from_bands, temperature_sentinels
from frostline.operators.disposition import LABEL_COLUMNS, label_series, label_states
from frostline.plans.gates import evaluate, ratchet
from frostline.streaming.replay import screen, windowed_hits

SCHEMA = "series_id long, product string, reading_c double, missing boolean, sensor_fault boolean, peak_season boolean, days_since_production int"


def series(spark, product, readings, days=0, missing=False, fault=False, peak=False):
    return spark.createDataFrame([(1, product, x, missing, fault, peak, days) for x in readings], SCHEMA)


CASES = [
    ("unobtanium", [1.0], {}, "R000_unknown_product"),
    ("finfish_seafood", [1.0], {"missing": True}, "R001_missing_fields"),
    ("finfish_seafood", [-99.9, 999.0], {}, "R002_all_readings_sentinel"),
    ("finfish_seafood", [1.0], {"days": 999}, "R010_expired"),
    ("frozen_goods", [-20.0] * 90 + [-10.0], {"days": 1}, "R011_partial_thaw"),
    ("finfish_seafood", [1.0, 2.0], {"fault": True}, "R020_sensor_artifact"),
    ("finfish_seafood", [1.0, 2.0, -99.9], {}, "R021_sentinel_threshold_exceeded"),
    ("chilled_dairy", [3.0] + [7.0] * 7, {"days": 3}, "R031_excursion_over_hold"),
    ("finfish_seafood", [9.0] * 12, {}, "R030_excursion_over_reject"),
    ("finfish_seafood", [0.0, 1.0, 2.0], {}, "R060_in_spec"),
    ("finfish_seafood", [0.0, 1.0, 2.0], {"days": None}, "R060_in_spec"),
    ("finfish_seafood", [1.0, 5.0], {"days": 3}, "R040_minor_excursion_short_life"),
    ("finfish_seafood", [1.0, 5.0], {"days": 1, "peak": True}, "R041_peak_season_short_life"),
    ("finfish_seafood", [1.0, 5.0], {"days": 1}, "R050_minor_excursion_in_tolerance"),
    ("finfish_seafood", [1.0], {"days": 4}, "R042_end_of_life"),
    ("frozen_goods", [-20.0] * 20, {"days": 5}, "R060_in_spec"),
]


@pytest.mark.parametrize(("product", "readings", "options", "rule"), CASES)
def test_rules(spark, product, readings, options, rule):
    """Long form and array form agree, and rules that read no temperatures report none."""
    row = label_series(series(spark, product, readings, **options), "series_id").first()
    assert row["rule_id"] == rule
    states = spark.createDataFrame(
        [(product, readings, ["readings_c"] if options.get("missing") else [], 15, options.get("days", 0), options.get("fault", False), options.get("peak", False))],
        "product string, readings_c array<double>, missing_fields array<string>, interval_min int, days_since_production int, sensor_fault boolean, peak_season boolean",
    )
    state = label_states(states).first()
    assert all(row[c] == state[c] for c in LABEL_COLUMNS)
    if rule[:4] in ("R000", "R001", "R002"):
        assert (row["peak_c"], row["excursion_min"], row["remaining_days"]) == (None, 0, None)


def test_no_expedite(spark):
    """Products, ages, seasons and faults: never an expedited sale."""
    grid = spark.sql(
        "SELECT product, array(CAST(peak AS double)) AS readings_c, CAST(array() AS array<string>) AS missing_fields, 15 AS interval_min, days AS days_since_production, fault AS sensor_fault, season AS peak_season"
        " FROM VALUES ('finfish_seafood'), ('table_eggs'), ('chilled_dairy'), ('frozen_goods') AS a(product), VALUES (0), (3), (30) AS b(peak), VALUES (0), (1), (2), (4), (10) AS c(days), VALUES (true), (false) AS d(fault), VALUES (true), (false) AS e(season)"
    )
    found = {r[0] for r in label_states(grid).select("disposition").collect()}
    assert grid.count() == 240 and found <= {"accept", "hold_for_qa", "reject", "insufficient_data"}


def test_specs_from_bands(spark):
    raw = spark.createDataFrame(
        [("chilled_fresh_seafood", '{"range_c": [0, 4]}'), ("chilled_general", '{"range_c": [0, 5], "basis": "x"}'), ("frozen", '{"max_c": -18}'), ("note", '"no band"')], "name string, spec string"
    )
    bands = bands_from_json(raw)
    assert bands.count() == 3
    products = spark.createDataFrame(PRODUCT_BANDS, "product string, band string, hold_min int, reject_min int, shelf_days int")
    assert sorted(tuple(r) for r in specs_from_bands(bands, products).collect()) == sorted(PRODUCTS)


def test_sentinels(spark):
    one = spark.range(1).select(temperature_sentinels(F.array(*(F.lit(float(x)) for x in ALL_SENTINELS))).alias("a"), clean_readings(F.array(*(F.lit(x) for x in (1.0, -99.9, 0.0, 90.0)))).alias("b"))
    assert one.first() == (list(SENTINELS), [1.0, 0.0])


@pytest.mark.parametrize(
    ("text", "kind", "rules"),
    [
        ("unit 7, Product_Code = eggs, all quiet", None, ["GCC-EDGE-018"]),
        ("Please expedite the pallet for sale before noon.", None, ["GCC-EDGE-015"]),
        ("t,c\n2026-03-04 11:  ", "logger_csv", ["GCC-EDGE-002"]),
        ("2026-03-04 11:", "chat_message", []),
        ("Cooler stayed near two degrees all night.", "chat_message", []),
    ],
)
def test_guardrails(spark, text, kind, rules):
    df = spark.createDataFrame([(text, kind)], "t string, k string")
    assert df.select(violations(F.col("t"), F.col("k")).alias("v")).first()["v"] == rules


def test_verdict(spark):
    df = spark.createDataFrame([(" consistent ",), ("x",), (None,)], "r string")
    assert [r[0] for r in df.select(screener_verdict(F.col("r"))).collect()] == ["CONSISTENT", "UNPARSEABLE", "UNPARSEABLE"]


def test_missing_metric_fails(spark):
    rows = evaluate(spark, spark.createDataFrame([], "metric string, value double")).collect()
    assert len(rows) == 10 and not any(r["passed"] for r in rows) and {r["reason"] for r in rows} == {"not measured"}


def test_ratchet(spark):
    frame = lambda **cells: spark.createDataFrame(list(cells.items()), "cell string, f1 double")
    assert not ratchet(frame(A=0.8, B=0.9), frame(A=0.7, B=0.95)).first()["passed"]
    assert not ratchet(frame(A=0.6, B=0.85), frame(A=0.65, B=0.79)).first()["passed"]
    assert ratchet(frame(A=0.6, B=0.85), frame(A=0.65, B=0.85)).first()["passed"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("2026-01-01 00:10:00", "product_code=1", "logger_csv"), ("2026-01-01 00:20:00", "fine", "logger_csv"), ("2026-01-01 02:20:00", "cell: x", "chat_message")]
    df = spark.createDataFrame(rows, "ts string, rendered_text string, artifact_type string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = windowed_hits(screen(stream)).writeStream.outputMode("complete").format("memory").queryName("hits").trigger(availableNow=True)
    run.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination(60)
    key = lambda frame: sorted(tuple(r) for r in frame.collect())
    assert key(spark.table("hits")) == key(windowed_hits(screen(df)))


def test_fingerprint():
    """Changes with any rule, their order and any bound; equal tables have equal ones."""
    from frostline.functions import rules as R

    base = R.fingerprint()
    assert len(base) == 12 and base == R.fingerprint(tuple(R.RULES), tuple(R.PRODUCTS))
    others = {R.fingerprint(R.RULES[:i] + R.RULES[i + 1 :]) for i in range(len(R.RULES))}
    others |= {R.fingerprint((R.RULES[1], R.RULES[0], *R.RULES[2:])), R.fingerprint(products=(*R.PRODUCTS[:3], (*R.PRODUCTS[3][:-1], 181)))}
    assert len(others) == len(R.RULES) + 2 and base not in others


def test_pack_without_a_band(spark):
    from pyspark.sql import functions as F

    from frostline.functions import rules as R

    packs = spark.createDataFrame([(1, '{"temperature_bands": {"frozen": {"max_c": -18}, "note": "x"}}'), (2, "{}")], "pack int, j string").select("pack", F.parse_json("j").alias("v"))
    bands = R.bands_of_packs(packs, "pack")
    assert [tuple(r) for r in bands.collect()] == [(1, "frozen", None, -18.0, None, "")]
    with pytest.raises(Exception, match="no temperature band chilled"):
        R.specs_of_packs(bands, "pack").collect()
