"""Planning, funnel, judging, packs, store, synthesis, similarity and streams on hand cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from frostline.operators import extraction, judging, leakage, planning, similarity, synthesis, voting
from frostline.plans import gates, results
from frostline.sources import packs, store
from frostline.streaming import arrival, live


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def log_of(spark, rows):
    return spark.createDataFrame(rows, "cell string, wave int, outcome string")


def test_first_wave_from_nothing(spark):
    """No coverage at all: eight equal cells of two faults, none over the cap."""
    empty = log_of(spark, [])
    f1 = spark.createDataFrame([], "cell string, f1 double")
    scores = planning.deficits(planning.coverage_of_cells(empty), f1, 1)
    found = planning.allocate(scores).collect()
    assert len(found) == 8 and {r["fault"] for r in found} == {"in_spec", "door_open"}
    assert [r["n"] for r in found] == [83] * 8 and max(r["n"] for r in found) <= 132
    assert planning.wave_focus(spark, 8).first()["holdout"]


def test_allocation_cap_and_spare(spark):
    """A cell over the cap gives its rest to the best scores first."""
    scores = spark.createDataFrame([("a", 0, 10.0), ("b", 1, 1.0), ("c", 2, 1.0), ("d", 3, 1.0), ("e", 4, 1.0)], "cell string, place int, score double")
    got = {r["cell"]: r["n"] for r in planning.allocate(scores, 100).collect()}
    # shares 71 and 7 each; 71 is cut to 20, and the spare fills b, c, d and e up to 20
    assert got == {"a": 20, "b": 20, "c": 20, "d": 20, "e": 20}


@pytest.mark.parametrize("total", [0, 1, 4, 265, 663])
def test_balanced_split(spark, total):
    for keys in (1, 2, 4, 6):
        got = [r[0] for r in spark.range(keys).select(planning.balanced(F.lit(total), keys, F.col("id")).alias("n")).collect()]
        assert sum(got) == total and max(got) - min(got) <= 1


def test_seed_and_round_robin(spark):
    import hashlib

    name = "3:a|b:17"
    got = spark.range(1).select(planning.stable_seed(F.lit(name)).alias("s"), planning.short_hash(F.lit(name)).alias("h")).first()
    digest = hashlib.sha256(name.encode()).hexdigest()
    assert (got["s"], got["h"]) == (int(digest[:12], 16), digest[:12])
    df = spark.sql("SELECT 'c' AS cell, array(named_struct('key', 'x', 'n', 3), named_struct('key', 'y', 'n', 1), named_struct('key', 'z', 'n', 2)) AS s")
    assert [k for _, _, k in rows_of(planning.round_robin(df, "s"))] == ["x", "y", "z", "x", "z", "x"]


def test_empty_plan(spark):
    with pytest.raises(ValueError):
        planning.require_rows(spark.range(0), "nothing")


def test_nearest_rank(spark):
    values = [(k, float((x * 37) % 101)) for k, n in (("a", 100), ("b", 1), ("c", 1000)) for x in range(n)]
    got = {r["k"]: (r["mean"], r["p99"]) for r in planning.nearest_rank(spark.createDataFrame(values, "k string, v double"), "k", "v").collect()}
    for key in "abc":
        mine = sorted(v for k, v in values if k == key)
        assert got[key] == (pytest.approx(sum(mine) / len(mine), abs=1e-6), mine[int(len(mine) * 0.99) - 1])


@pytest.mark.parametrize(
    ("reply", "valid"),
    [
        ('so {"product": "table_eggs", "readings_c": [1, 2.5], "interval_min": 15}', True), ('{"product": null, "readings_c": [], "interval_min": null}', True), ('{"product": "ham", "readings_c": [], "interval_min": 1}', False),
        ('{"product": null, "readings_c": [null], "interval_min": 1}', False), ('{"product": null, "readings_c": [1, "x"], "interval_min": 1}', False), ('{"product": null, "readings_c": null}', False), ("[1]", False), ("{broken", False), (None, False),
        ('{"product": null, "readings_c": null, "interval_min": 1, "missing_fields": ["a"], "peak_season": false, "ambient_c": 2}', True), ('{"product": null, "readings_c": null, "interval_min": 1, "missing_fields": [1]}', False),
        ('{"product": null, "readings_c": null, "interval_min": 1, "days_since_production": 1.5}', False),
    ],
)
def test_schema(spark, reply, valid):
    df = spark.createDataFrame([(reply,)], "reply string")
    assert extraction.with_schema_check(df).first()["schema_valid"] is valid


def test_round_trip(spark):
    def trip(src, got, missing=(), other="p"):
        df = spark.createDataFrame([(src, got, list(missing), other)], "s array<double>, g array<double>, m array<string>, o string")
        return tuple(df.select(extraction.round_trip(F.lit("p"), F.col("s"), F.col("m"), F.col("o"), F.col("g")).alias("t")).first()["t"])

    assert trip([1.0, 3.0], [1.5, 3.0]) == (True, pytest.approx(1 - 0.5 / 3))
    assert trip([1.0, 3.0], [2.5, 3.0]) == (False, 0.5)
    assert trip([1.0], [1.0], other="q") == (False, 0.0) and trip([1.0], [1.0], other=None) == (False, 0.0)
    assert trip([1.0], [], missing=["readings_c"]) == (True, 1.0) and trip([1.0], [2.0], missing=["readings_c"]) == (False, 0.0)
    assert trip([], None) == (True, 1.0) and trip([1.0], None) == (False, 0.0)


def test_metrics_of_nothing(spark):
    log = spark.createDataFrame([], "outcome string, cell string, disposition string, verdict string, rules array<string>, schema_valid boolean, round_trip_ok boolean")
    got = dict(rows_of(judging.generation_metrics(log, spark.createDataFrame([], "cell string, n int"))))
    assert got == {"schema_validity": 0.0, "round_trip_recovery": 0.0, "screener_flag_rate": 0.0, "guardrail_violation_rate": 0.0, "max_class_share": 1.0, "cell_fill_deviation": 0.0}


def test_gates(spark):
    metrics = spark.createDataFrame([("a", 0.99), ("b", 0.01), ("c", 0.5)], "metric string, value double")
    bounds = (("a", ">=", 0.9, None), ("b", "<=", 0.05, None), ("c", "between", 0.0, 1.0))
    gates.halt_unless_passed(gates.evaluate(spark, metrics, bounds))
    with pytest.raises(gates.GateFailure, match="d: not measured"):
        gates.halt_unless_passed(gates.evaluate(spark, metrics, (*bounds, ("d", ">=", 1.0, None))))
    with pytest.raises(ValueError):
        gates.evaluate(spark, metrics, (("a", "~", 0.9, None),))
    with pytest.raises(gates.GateFailure):
        gates.require_passed(spark.createDataFrame([(1, False)], "wave int, passed boolean"), 1)
    gates.require_passed(spark.createDataFrame([(1, True)], "wave int, passed boolean"), 1)


def test_override_needs_both(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "metric string, value double")
    judged = frame(("annotator_kappa", 0.1), ("x", 1.0))
    assert rows_of(judging.with_override(judged, frame(("annotator_kappa", 0.9)))) == [("annotator_kappa", 0.1), ("x", 1.0)]
    both = judging.with_override(judged, frame(("annotator_kappa", 0.9), ("language_authenticity", 4.0)))
    assert rows_of(both) == [("annotator_kappa", 0.9), ("language_authenticity", 4.0), ("x", 1.0)]


def test_reviews(spark):
    rows = [(None, True, None), (None, False, ["cold"]), ("timeout", None, None), (None, True, ["none"])]
    got = judging.review_summary(spark.createDataFrame(rows, "error string, agrees boolean, concerns array<string>")).first()
    assert tuple(got) == (2, 1, 1, 1, 0.5)


def test_kappa(spark):
    df = spark.createDataFrame([(0.9, 1.0), (0.9, 3.0), (0.9, None), (0.9, 0.0)], "a double, k double")
    assert [r[0] for r in df.select(judging.board_kappa(F.col("a"), F.col("k"))).collect()] == [0.9, 0.5, 0.0, 0.0]


def test_packs(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"meta": {}, "rules": [{"rule_id": "G-1", "class": "edge"}, {"class": "edge"}]}')
    (tmp_path / "b.json").write_text('{"meta": {"iso_3166_1_alpha_2": "AE"}, "rules": [{"rule_id": "G-1"}, {"rule_id": "A-1"}]}')
    rules = packs.rules_of(packs.load_json(spark, str(tmp_path)))
    assert rows_of(packs.pack_problems(rules)) == [("duplicate rule_id", "G-1"), ("missing rule_id", "GCC")]
    assert packs.rules_for(rules, "AE").count() == 4
    with pytest.raises(packs.PackError):
        packs.rules_for(rules, "XX")
    with pytest.raises(packs.PackError):
        packs.load_json(spark, str(tmp_path / "none"))
    (tmp_path / "c.json").write_text("{broken")
    with pytest.raises(packs.PackError, match="c.json"):
        packs.load_json(spark, str(tmp_path))


def test_unknown_jurisdiction_fails(spark):
    with pytest.raises(Exception, match="unknown jurisdiction"):
        spark.createDataFrame([("ZZ",)], "j string").select(packs.known_jurisdiction(F.col("j"), ("AE",))).collect()


def test_expired_days_are_removed(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "root"))
    rows = spark.sql("SELECT id, if(id = 0, null, timestamp '2024-02-27 12:00:00' + make_dt_interval(cast(id as int))) AS ts FROM range(6)")
    for name in ("events", "access_audit"):
        s.append_by_day(name, rows)
    first_day = datetime.date(2024, 3, 1)
    assert s.remove_expired("events", first_day) == 2 and s.remove_expired("access_audit", first_day) == 0
    # 28 and 29 February are gone; the row without a day stays
    assert rows_of(s.scan("events").select("id")) == [(0,), (3,), (4,), (5,)]
    assert s.remove_expired("events", first_day) == 0
    assert s.scan("access_audit").count() == 6


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "root"))
    log = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], "id int, wave int, _id string")
    s.append("log", log, by="wave")
    s.append("access_audit", log, by="wave")
    assert s.delete_wave("log", 1, dry_run=True) == 2 and s.scan("log").count() == 3
    s.replace_waves("log", log.where("wave = 2").withColumn("id", F.lit(9)))
    assert rows_of(s.scan("log").select("id", "wave")) == [(1, 1), (2, 1), (9, 2)]
    assert s.delete_wave("log", 1) == 2 and s.delete_wave("access_audit", 1) == 0
    assert rows_of(s.scan("log").select("id", "wave")) == [(9, 2)] and s.scan("access_audit").count() == 3
    assert s.export(str(tmp_path / "out")) == ["access_audit", "log"]
    assert spark.read.json(str(tmp_path / "out" / "log")).columns == ["id", "wave"]
    assert s.point("log", id=9).count() == 1 and s.point("log", id=7).count() == 0
    plan = s.scan("access_audit", 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(wave" in plan


def test_lines_and_reports(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "outcome": "kept"}\n\n{"id": 2}\n{"id": 3, "outcome": "dropped_error"}\n')
    assert rows_of(store.jsonl_kept(spark, str(tmp_path / "x.jsonl"), "id int, outcome string").select("id")) == [(1,), (2,)]
    assert store.markdown("T", spark.createDataFrame([(1, "a")], "n int, s string")) == "# T\n\n| n | s |\n| - | - |\n| 1 | a |\n"
    with pytest.raises(ValueError):
        store.markdown("T", spark.range(5), most=4)
    assert store.use_database(spark) == "default" and store.use_database(spark, "nowhere") == "default"


def test_synthesis(spark):
    """All modes: lengths, bounds, folds and overlays, row by row against what their draws allow."""
    rows = [(p, f, bool(i % 3 == 0), bool(i % 4 == 0), 1000 + i * 20 + 5 * j + k) for i in range(12) for j, p in enumerate(planning.PRODUCTS) for k, f in enumerate(planning.FAULTS)]
    df = spark.createDataFrame(rows, "product string, fault string, is_adversarial boolean, is_abstention boolean, rng_seed long")
    plain = {(r["product"], r["rng_seed"]): r for r in synthesis.synthesize(df.withColumn("is_adversarial", F.lit(False)).withColumn("is_abstention", F.lit(False))).collect()}
    bands = {"finfish_seafood": (0, 4), "table_eggs": (0, 5), "chilled_dairy": (0, 5), "frozen_goods": (-25, -18)}
    for (product, _), r in plain.items():
        low, high = bands[product]
        x = r["readings_c"]
        assert len(x) == 96 and r["missing_fields"] == [] and r["sensor_fault"] == (r["fault"] == "sensor_artifact")
        if r["fault"] == "in_spec":
            assert all(low <= v <= high for v in x)
        if r["fault"] == "compressor_fail":
            steps = [round(b - a, 2) for a, b in zip(x, x[1:], strict=False)]
            assert len(set(steps[-40:])) <= 2 and 0.29 <= steps[-1] <= 0.91
        if r["fault"] == "sensor_artifact":
            assert min(x) == -99.9 or max(x) - min(x) >= 10 or max(x.count(v) for v in x) >= 1
        assert 24 <= r["ambient_c"] <= 42 and r["days_since_production"] is not None
    for r in synthesis.synthesize(df).collect():
        if r["is_abstention"]:
            assert len(r["missing_fields"]) == 1
            assert r["missing_fields"] != ["readings_c"] or r["readings_c"] == []
            assert (r["missing_fields"] == ["days_since_production"]) == (r["days_since_production"] is None)
        elif r["is_adversarial"] and r["fault"] == "in_spec":
            assert r["readings_c"][0] == pytest.approx(bands[r["product"]][1] + 0.1)
    with pytest.raises(Exception, match="unknown artifact type"):
        df.select(synthesis.token_budget(F.lit("poem"), synthesis.RENDER_TOKENS)).collect()


def test_series_are_made_by_rows_at_a_time(spark):
    """Points equal the draws of their names; no point is an expression of its own, and names of fields need no series."""
    rows = [(i, "chilled_dairy", fault, "voice_note", False, i % 3 == 0) for i in range(40) for fault in ("in_spec", "setpoint_drift", "poem")]
    df = spark.createDataFrame(rows, "rng_seed long, product string, fault string, artifact_type string, is_adversarial boolean, is_abstention boolean")
    made = synthesis.with_series(df.withColumns({"min_c": F.lit(0.0), "max_c": F.lit(5.0)}))
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = [2.5 + synthesis.draw(f"base{i}", -1.5, 1.5) for i in (0, 95)]
    drift = [F.when(F.col("fault") == "setpoint_drift", n * synthesis.draw("drift", 0.02, 0.08)).otherwise(0.0) for n in (1, 96)]
    for r in made.select("readings_c", *(F.round(F.round(w, 2) + d, 2).alias(f"w{n}") for n, (w, d) in enumerate(zip(want, drift, strict=True)))).collect():
        assert len(r["readings_c"]) == 96 and (r["readings_c"][0], r["readings_c"][-1]) == (r["w0"], r["w1"])
    states = synthesis.synthesize(df)
    names = states.select(synthesis.visible_names(states).alias("names"))
    assert "EvalPython" not in names._jdf.queryExecution().optimizedPlan().toString()
    told = states.select(F.map_keys(synthesis.visible_fields(states)).alias("names"))
    assert rows_of(names) == rows_of(told)


@pytest.mark.parametrize(("block", "pivots"), [(2048, 4096), (7, 4096), (5, 3)])
def test_near_duplicates(spark, block, pivots):
    """One block, cells that meet by the triangle inequality, and cells of several blocks."""
    import numpy as np

    dice = np.random.default_rng(3)
    centres = dice.normal(size=(4, 16))
    base = np.concatenate([dice.normal(size=(30, 16)), centres[dice.integers(0, 4, 30)] + 0.1 * dice.normal(size=(30, 16))])
    vectors = [*base, *(base[:10] + 0.05 * dice.normal(size=(10, 16))), base[0], np.zeros(16), np.zeros(16)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0, 2.0]), (902, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = np.array(vectors) / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, 0)
    want = {i: bool(x) for i, x in enumerate(cosine.max(axis=1) > 0.95)} | {900: False, 901: False, 902: False}
    assert dict(rows_of(similarity.near_duplicates(df, block=block, most_pivots=pivots))) == want
    assert similarity.near_duplicate_rate(df.limit(1)).first()[0] == 0.0
    assert similarity.near_duplicates(df.where("false")).count() == 0


def test_vectors_are_sent_to_few_tiles(spark):
    """However small blocks are, a vector goes to as many tasks as there are tiles at most; planted pairs are found across tiles."""
    import numpy as np

    x = np.random.default_rng(5).normal(size=(3000, 48))
    x[2950:] = x[:50] + 0.02
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    counts = {}
    near = {r["vec_id"] for r in similarity.near_duplicates(df, block=40, counts=counts).collect() if r["near"]}
    assert near == {*range(50), *range(2950, 3000)}
    assert counts["sent"] <= (similarity.TILES + 2) * len(x)


def test_few_pairs_are_multiplied():
    """Scattered vectors: remaining lengths rule out nearly all pairs after some coordinates; copies all meet."""
    import numpy as np

    x = np.random.default_rng(1).normal(size=(1500, 64))
    x[700:710] = x[:10] + 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit, _, whole = similarity.near_flags(x, x, 0.95, same=True)
    cosine = x @ x.T - 2 * np.eye(len(x))
    assert (hit == (cosine.max(axis=1) > 0.95)).all() and hit.sum() == 20
    assert whole < 0.01 * len(x) ** 2 / 2
    left, right, _ = similarity.near_flags(x[:700], x[700:], 0.95)
    assert left[:10].all() and left.sum() == 10 and right.sum() == 10
    same = np.repeat(x[:2], 600, axis=0)
    assert similarity.near_flags(same, same, 0.95, same=True)[0].all()


def test_leakage_probe(spark):
    schema = "rendered_text string, disposition string"
    leak = [(f"shipment {i} went {'well' if i % 2 else 'badly'} today", "accept" if i % 2 else "reject") for i in range(80)]
    assert leakage.leakage_probe(spark.createDataFrame(leak, schema)) > 0.9
    assert leakage.leakage_probe(spark.createDataFrame(leak[:40], schema)) == 0.0
    assert leakage.leakage_probe(spark.createDataFrame([(t, "accept") for t, _ in leak], schema)) == 0.0
    plain = [(f"shipment {i * 7919 % 97} arrived at dock {i % 7}", ("accept", "reject")[i // 3 % 2]) for i in range(90)] + [(None, None)]
    assert leakage.leakage_probe(spark.createDataFrame(plain, schema)) < 0.7


def test_probe_holds_few_entries_at_a_time():
    """Batches are added up in runs of rows of bounded size, also where a batch is itself a slice; texts come out some at a time."""
    import pyarrow as pa

    sizes = [3, 0, 5, 40, 1, 1, 0, 9, 2, 0]
    index = pa.array([list(range(n)) for n in sizes], type=pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([index, index], names=["index", "count"]).slice(1)
    parts = list(leakage._slices(batch, 10))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    held = [(len(p), len(p.column("index").flatten())) for p in parts]
    assert all(rows and (n <= 10 or rows == 1) for rows, n in held) and len(held) < len(batch)


def test_folds_are_stratified(spark):
    rows = [("t", "abc"[min(i % 11, 2)]) for i in range(500)]
    data = spark.createDataFrame(rows, "rendered_text string, disposition string").repartition(7)
    features = store.written(data.mapInArrow(leakage._features(64), "label string, part int, place long, index array<int>, count array<int>"), "folds")
    n = {tuple(r)[:2]: r["count"] for r in leakage.with_folds(features).groupBy("label", "fold").count().collect()}
    for label in "abc":
        of = [n[label, f] for f in range(4)]
        assert max(of) - min(of) <= 1 and sum(of) == sum(x == label for _, x in rows)


def test_minimize():
    import numpy as np

    scale = np.array([1.0, 10.0, 100.0])
    calls = []
    got = leakage.minimize(lambda x: calls.append(1) or (float((scale * (x - 3) ** 2).sum()), 2 * scale * (x - 3)), np.zeros(3), 60)
    assert np.allclose(got, 3, atol=1e-4) and len(calls) <= 60


def test_streams(spark, tmp_path):
    schema = "event_id long, ts timestamp, rendered_text string, artifact_type string, disposition string"
    rows = spark.range(30).selectExpr("id AS event_id", "timestamp'2026-01-01 00:00:00' AS ts", "CASE WHEN id % 5 = 0 THEN 'product_code=1' ELSE 'fine' END AS rendered_text", "'chat_message' AS artifact_type", "'accept' AS disposition")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: live.arriving(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    assert rows_of(live.run_to_end(live.running_totals(stream()), str(tmp_path / "a"), "complete")) == rows_of(live.running_totals(rows))
    assert live.run_to_end(live.flagged(stream()), str(tmp_path / "b")).count() == 6
    query = live.log_sink(stream(), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    logged = spark.read.parquet(str(tmp_path / "c" / "rows"))
    assert logged.where("date = '2026-01-01'").count() == 30 and logged.select("batch").distinct().count() == 3
    assert live.drop_expired(spark, str(tmp_path / "c"), datetime.date(2026, 1, 31)) == []
    assert live.drop_expired(spark, str(tmp_path / "c"), datetime.date(2026, 2, 1)) == ["date=2026-01-01"]


def test_replayed_batches_add_nothing(spark, tmp_path):
    """The sink dies after it has written a batch and before that is noted; the next start writes it again."""
    spark.range(30).selectExpr("id", "timestamp'2026-01-01 00:00:00' + make_dt_interval(id % 3) AS ts").repartition(5).write.parquet(str(tmp_path / "in"))
    stream, out = live.arriving(spark, str(tmp_path / "in"), "id long, ts timestamp", files_per_batch=1), str(tmp_path / "out")
    write = live.batch_writer(out)

    def dying(batch, batch_id):
        write(batch, batch_id)
        if batch_id == 2:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        stream.writeStream.foreachBatch(dying).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{out}/rows").select("batch").distinct().count() == 3
    live.log_sink(stream, out, delay=0).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{out}/rows").collect()) == list(range(30))


def test_progress_of_many_batches(spark, tmp_path):
    """The listener's sums are whole over 150 batches, of which a query itself remembers 100."""
    rows = spark.range(450).selectExpr("id AS event_id", "CASE WHEN id % 9 = 0 THEN 'product_code=1' ELSE 'fine' END AS rendered_text", "'chat_message' AS artifact_type", "CASE WHEN id % 3 = 0 THEN 'accept' WHEN id % 3 = 1 THEN 'reject' ELSE 'hold_for_qa' END AS disposition")
    rows.repartition(150).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, rendered_text string, artifact_type string, disposition string"
    seen = live.Progress()
    spark.streams.addListener(seen)
    try:
        stream = live.observed(live.arriving(spark, str(tmp_path / "in"), schema, files_per_batch=1))
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        said = live.settled(seen, query)
    finally:
        spark.streams.removeListener(seen)
    assert said["batches"] == 150 and len(query.recentProgress) <= 100
    assert said["rows"] == 450 and said["violations"] == 50 and said["top"] == [("accept", 150), ("hold_for_qa", 150), ("reject", 150)]
    assert seen.line(query).startswith("450 records") and "50 violations (11.1 %)" in seen.line(query)


def test_arrival_order(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(5)
    order = lambda df: [r["id"] for r in df.orderBy("place").collect()]
    one, two, other = (order(arrival.in_order(df, "id", seed)) for df, seed in ((rows, 1), (rows.repartition(3), 1), (rows, 2)))
    assert one == two != other and sorted(one) == list(range(1000)) and one != sorted(one)
    assert order(arrival.in_order(rows, "id", 1, limit=37)) == one[:37]
    # equal keys, and all rows in one bucket
    tied = arrival.in_order(rows.withColumn("k", F.lit(1)), "k", 1, limit=10, buckets=3).collect()
    assert sorted(r["place"] for r in tied) == list(range(1, 11)) and sorted(r["id"] for r in tied) == list(range(10))
    assert arrival.in_order(rows.where("false"), "id", 1).count() == 0
    rows.sortWithinPartitions("id").write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    assert sorted(r["place"] for r in arrival.in_order(stored, "id", limit=400).collect()) == list(range(1, 401))
    assert order(arrival.in_order(stored, "id")) == [r["id"] for r in stored.collect()]


def test_staged_files_arrive_in_order(spark, tmp_path):
    folder = str(tmp_path / "staged")
    assert arrival.stage(arrival.in_order(spark.range(50), "id", 3), folder, 8) == 7
    stream = arrival.arriving_files(spark, folder, "id long, place long").withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    query = live.log_sink(stream, str(tmp_path / "out"), delay=0.2)
    query.processAllAvailable()
    query.stop()
    found = spark.read.parquet(str(tmp_path / "out" / "rows")).collect()
    assert len(found) == 50 and all(r["batch"] == (r["place"] - 1) // 8 == r["file"] for r in found)


def test_quantile_sketch(spark):
    """Quantiles within the stated error of nearest rank; sketches of parts add up to that of the whole."""
    values = [(k, float(x * 37 % 1009) ** 2 / 10) for k, n in (("a", 100), ("b", 1), ("c", 3000)) for x in range(n)]
    rows = spark.createDataFrame(values, "k string, v double")
    exact = {r["k"]: r for r in planning.nearest_rank(rows, "k", "v").collect()}
    for error in (0.01, 0.1):
        for r in live.summary_of(live.sketched(rows, "k", "v", error), "k", error=error).collect():
            assert r["mean"] == pytest.approx(exact[r["k"]]["mean"], rel=1e-9, abs=1e-6)
            assert abs(r["quantile"] - exact[r["k"]]["p99"]) <= error * exact[r["k"]]["p99"] * (1 + 1e-9)
    parts = live.sketched(rows.where("v < 500"), "k", "v").unionByName(live.sketched(rows.where("v >= 500"), "k", "v"))
    merged = parts.groupBy("k", "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    assert [tuple(r)[:2] + (r["quantile"],) for r in live.summary_of(merged, "k").orderBy("k").collect()] == [tuple(r)[:2] + (r["quantile"],) for r in live.summary_of(live.sketched(rows, "k", "v"), "k").orderBy("k").collect()]


def test_votes_of_mixed_types(spark):
    say = lambda v, why="": '{"verdict": %s, "rationale": "%s"}' % (v, why)
    replies = [("n", i, say(v, f"r{i}")) for i, v in enumerate([1, 3, 3])] + [("m", i, say(v)) for i, v in enumerate(['"x"', "3", '"3"'])] + [("t", i, say(v)) for i, v in enumerate(['"b"', '"a"', '"a"', '"b"'])]
    replies += [("u", 0, "nothing"), ("u", 1, "{broken}"), ("u", 2, say("null")), ("b", 0, say("true")), ("b", 1, say("false")), ("l", 0, say('"z"', "y" * 1500)), ("l", 1, say('"z"', "w" * 1500)), ("o", 0, None)]
    replies += [("h", i, say(2)) for i in range(2000)]
    df = spark.createDataFrame(replies, "item string, position int, reply string")
    got = {r["item"]: r for r in voting.consensus(df).collect()}
    brief = {k: (r["n_votes"], r["number"], r["said"], round(r["agreement"], 6), r["escalated"]) for k, r in got.items()}
    assert brief == {"n": (3, 3.0, None, 0.666667, False), "m": (3, None, "3", 0.666667, False), "t": (4, None, "b", 0.5, True), "u": (0, None, None, 0.0, True), "b": (2, 0.5, None, 0.0, True), "l": (2, None, "z", 1.0, False), "o": (0, None, None, 0.0, True), "h": (2000, 2.0, None, 1.0, False)}
    assert got["n"]["rationale"] == "r0; r1; r2" and got["u"]["rationale"] == "all judge votes unparseable"
    assert got["l"]["rationale"] == "y" * 1500 + "; " + "w" * 498 and got["h"]["rationale"] == "; " * 1000
    strict = spark.createDataFrame([("t", say('"c"', "why")), ("u", say("1")), ("n", say("9")), ("b", say("null"))], "item string, reply string")
    after = {r["item"]: tuple(r)[2:] for r in voting.with_strict(voting.consensus(df), strict).collect()}
    assert after["t"] == (None, "c", 1.0, True, "why") and after["u"][:4] == (None, None, 0.0, True) and after["n"][0] == 3.0 and after["b"][0] == 0.5


def test_results_and_ratchet(spark):
    docs = [(1, '{"metrics": {"holdout_delta": 0.01}, "cell_f1": {"b": 0.5, "a": 0.5, "c": 0.9}, "confusions": [[["x", "y"], 3], [["y", "x"], 3], [["x", "z"], 9]]}'), (2, '{"metrics": {}, "cell_f1": {"a": 0.6, "b": 0.7, "c": 0.7}}'), (3, '{"metrics": {}, "cell_f1": {}}'), (4, '{"metrics": {}, "cell_f1": {"a": 0.4}}'), (5, '{"metrics": {}, "cell_f1": {"a": 0.45}}')]
    df = spark.createDataFrame(docs, "wave int, doc string")
    got = {r["wave"]: r for r in results.gate_b(df).collect()}
    assert got[1]["worst_cell"] == "b" and got[1]["top_confusions"] == [["x", "z"], ["x", "y"], ["y", "x"]] and got[1]["ratchet_note"] == "first measured wave"
    assert "malformed_json_rate: not measured" in got[1]["failures"] and not got[1]["passed"]
    assert got[2]["ratchet_note"] == "cells dropped below 0.80: c" and not got[2]["ratchet_ok"]
    assert (got[3]["worst_cell"], got[3]["worst_f1"], got[3]["mean_f1"]) == ("", 0.0, 0.0)
    assert got[4]["ratchet_note"] == "worst_cell_f1 fell 0.600 -> 0.400" and got[5]["ratchet_note"] == "worst_cell_f1 0.400 -> 0.450" and got[5]["ratchet_ok"]


def test_gate_reasons_and_empty_kept(spark):
    metrics = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "metric string, value double")
    told = gates.verdict(gates.evaluate(spark, metrics, (("a", ">=", 0.995, None), ("b", "between", 0.02, 0.08), ("c", "<=", 1.0, None)))).first()
    assert told["failures"] == ["a: 0.500000 fails >= 0.995", "b: 0.900000 fails between (0.02, 0.08)", "c: not measured"]
    log = spark.createDataFrame([(1, "dropped_screener", "x", "accept", "MAYBE", [], False, False, "t")], "doc_id long, outcome string, cell string, disposition string, verdict string, rules array<string>, schema_valid boolean, round_trip_ok boolean, rendered_text string")
    vectors = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    got = dict(rows_of(judging.gate_a_metrics(log, log.groupBy("cell").agg(F.count("*").alias("n")), vectors)))
    assert len(got) == 8 and got["near_duplicate_rate"] == got["leakage_probe_acc"] == 1.0


def test_loading_and_dimensions(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": null}\n\n{oops\n[1]\n{"id": 2}\n{"id": "no", "x": 3}\n')
    good, bad = packs.load_lines(spark, str(tmp_path / "a.jsonl"), "id int, x int", str(tmp_path / "bad"), ("id", "x"))
    assert sorted((r["id"] or 0, r["x"]) for r in good.collect()) == [(0, 3), (1, None)]
    assert sorted((r["line"], r["reason"]) for r in bad.collect()) == [("[1]", "not an object"), ('{"id": 2}', "lacks x"), ("{oops", "not JSON")]
    with pytest.raises(packs.PackError):
        packs.load_lines(spark, str(tmp_path / "none"), "id int", str(tmp_path / "bad"))
    calls = []
    load = lambda: calls.append(1) or spark.range(3)
    assert packs.dimension(spark, "three", load).count() == 3 == packs.dimension(spark, "three", load).count() and len(calls) == 1
    packs.forget(spark)
    assert packs.dimension(spark, "three", load).count() == 3 and len(calls) == 2
    with pytest.raises(packs.PackError):
        packs.dimension(spark, "large", lambda: spark.range(packs.SMALL_ROWS + 1))


def test_reports(spark):
    told = store.report("Audit", {"records": 3}, {"By cell": spark.createDataFrame([("a", 2)], "cell string, n int"), "Flagged": spark.createDataFrame([], "id int")})
    assert told == "# Audit\n\nrecords: **3**\n\n## By cell\n\n| cell | n |\n| - | - |\n| a | 2 |\n\n## Flagged\n\nNone.\n"
