"""Wave planning: which cells lack records, how many each gets next, and the requests of a plan.

A plan has at most one row a cell of the bounded axes, so its windows without partition keys see no more rows than
there are cells. What comes before (coverage of the log) and after (requests) is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The axes of the corpus, in order.
PRODUCTS = ("finfish_seafood", "table_eggs", "chilled_dairy", "frozen_goods")
FAULTS = ("in_spec", "door_open", "compressor_fail", "setpoint_drift", "sensor_artifact")
ARTIFACTS = ("logger_csv", "chat_message", "qc_form_ocr", "voice_note")
JURISDICTIONS = ("AE", "SA", "QA", "KW", "OM", "BH")
LANGUAGES = ("en",)
# Records of a wave and of a cell, slack over the cell's target, a cell's largest share of a wave,
# shares of adversarial and abstaining records, weights of the deficit score, F1 of a cell without one.
WAVE_SIZE, CELL_TARGET, OVERSHOOT, CELL_SHARE = 663, 265, 1.05, 0.20
ADVERSARIAL_SHARE, ABSTENTION_SHARE = 0.15, 0.08
W_COUNT, W_F1, W_STALE, UNKNOWN_F1 = 0.45, 0.40, 0.15, 0.5
#: Survival under which a cell is escalated.
LOW_SURVIVAL = 0.75
# Wave, faults, artifacts (null: all), adversarial and abstention shares (null: the usual), holdout.
WAVE_FOCUS = (
    (1, ["in_spec", "door_open"], None, None, None, False),
    (2, ["compressor_fail", "setpoint_drift", "sensor_artifact"], None, None, None, False),
    (3, None, ["voice_note", "qc_form_ocr"], None, None, False),
    (4, None, None, None, None, False),
    (5, None, None, 0.60, None, False),
    (6, None, None, None, 0.55, False),
    (7, None, None, None, None, False),
    (8, None, None, None, None, True),
)


def _axis(spark: SparkSession, name: str, values: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"{name}_place int, {name} string")


def all_cells(spark: SparkSession) -> DataFrame:
    """(cell, product, fault, place): the product of two axes of fixed length."""
    both = _axis(spark, "product", PRODUCTS).crossJoin(_axis(spark, "fault", FAULTS))
    return both.select(F.concat_ws("|", "product", "fault").alias("cell"), "product", "fault", (F.col("product_place") * len(FAULTS) + F.col("fault_place")).alias("place"))


def wave_focus(spark: SparkSession, wave: int) -> DataFrame:
    """The one row of a wave; a wave without one has no restrictions."""
    found = [x for x in WAVE_FOCUS if x[0] == wave] or [(wave, None, None, None, None, False)]
    rows = spark.createDataFrame(found, "wave int, faults array<string>, artifacts array<string>, adversarial_share double, abstention_share double, holdout boolean")
    return rows.withColumns({"adversarial_share": F.coalesce("adversarial_share", F.lit(ADVERSARIAL_SHARE)), "abstention_share": F.coalesce("abstention_share", F.lit(ABSTENTION_SHARE))})


def staleness(last_wave: Column, wave: int) -> Column:
    """0 for the last wave's cells up to 1 for those of four waves ago or never seen (null or 0)."""
    return F.when(F.coalesce(last_wave, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.least(wave - last_wave, F.lit(4)) / 4.0)


def coverage_of_cells(log: DataFrame) -> DataFrame:
    """(cell, requested, kept, last_wave) of every cell, zeros where the log has none."""
    seen = log.groupBy("cell").agg(F.count("*").alias("requested"), F.count_if(F.col("outcome") == "kept").alias("kept"), F.max("wave").alias("last_wave"))
    return all_cells(log.sparkSession).join(seen, "cell", "left").select(
        "cell", "product", "fault", "place", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("requested", "kept", "last_wave"))
    )


def latest_cell_f1(ledger: DataFrame) -> DataFrame:
    """(cell, f1) of the last wave of a ledger (wave, cell_f1 map)."""
    return ledger.agg(F.max_by("cell_f1", "wave").alias("m")).select(F.explode("m").alias("cell", "f1"))


def deficits(coverage: DataFrame, f1: DataFrame, wave: int, target: int = CELL_TARGET) -> DataFrame:
    """Eligible cells (fault in the wave's focus, kept under the target with slack) with their score."""
    focus = wave_focus(coverage.sparkSession, wave)
    rows = coverage.join(F.broadcast(f1), "cell", "left").join(F.broadcast(focus.select("faults")), F.lit(True))
    rows = rows.where(F.col("faults").isNull() | F.array_contains("faults", F.col("fault"))).where(F.col("kept") < target * OVERSHOOT)
    gap = F.greatest(F.lit(0.0), (target - F.col("kept")) / F.lit(float(target)))
    score = W_COUNT * gap + W_F1 * (1.0 - F.coalesce("f1", F.lit(UNKNOWN_F1))) + W_STALE * staleness(F.col("last_wave"), wave)
    return rows.select("cell", "product", "fault", "place", "kept", "f1", score.alias("score"))


def allocate(scores: DataFrame, size: int = WAVE_SIZE, share: float = CELL_SHARE) -> DataFrame:
    """Adds n: records by score, half-even rounded and at most a share of the wave; what is spare goes to the best scores first."""
    cap = max(1, int(size * share))
    whole = Window.partitionBy()
    first = scores.withColumn("n0", F.least(F.lit(cap), F.bround(size * F.col("score") / F.sum("score").over(whole)).cast("int")))
    first = first.withColumn("spare", F.lit(size) - F.sum("n0").over(whole)).withColumn("room", cap - F.col("n0"))
    ahead = F.coalesce(F.sum("room").over(Window.orderBy(F.desc("score"), "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.lit(0), F.least("room", F.col("spare") - ahead))
    return first.withColumn("n", (F.col("n0") + taken).cast("int")).drop("n0", "spare", "room").where("n > 0")


def balanced(n: Column, keys: int, place: Column) -> Column:
    """The share of the key at a place when n is split over keys: the first ones get one more."""
    return F.floor(n / keys).cast("int") + (place < n % keys).cast("int")


def plan(scores: DataFrame, wave: int, size: int = WAVE_SIZE) -> DataFrame:
    """Allocations in order: counts, overlays and the splits over artifacts and jurisdictions as arrays of (key, n)."""
    focus = wave_focus(scores.sparkSession, wave).select("artifacts", "adversarial_share", "abstention_share", "holdout")
    rows = allocate(scores, size).join(F.broadcast(focus), F.lit(True))
    literal = lambda values: F.array(*map(F.lit, values))
    split = lambda keys: F.transform(keys, lambda k, i: F.struct(k.alias("key"), balanced(F.col("n"), F.size(keys), i).alias("n")))
    return rows.select(
        "cell", "product", "fault", "place", "score", "n", "holdout",
        F.bround(F.col("n") * F.col("adversarial_share")).cast("int").alias("adversarial"), F.bround(F.col("n") * F.col("abstention_share")).cast("int").alias("abstention"),
        split(F.coalesce("artifacts", literal(ARTIFACTS))).alias("artifact_split"), split(literal(JURISDICTIONS)).alias("jurisdiction_split"), split(literal(LANGUAGES)).alias("language_split"),
    )


def require_rows(rows: DataFrame, message: str) -> DataFrame:
    """The frame itself; an error where it is empty (a plan without eligible cells)."""
    if rows.isEmpty():
        raise ValueError(message)
    return rows


def round_robin(splits: DataFrame, split: str) -> DataFrame:
    """(cell, i, key): the keys of a split interleaved, each as often as it has records."""
    one = splits.select("cell", F.posexplode(split).alias("key_place", "s")).where("s.n > 0")
    each = one.select("cell", "key_place", F.col("s.key").alias("key"), F.explode(F.sequence(F.lit(1), F.col("s.n"))).alias("turn"))
    order = Window.partitionBy("cell").orderBy("turn", "key_place")
    return each.select("cell", (F.row_number().over(order) - 1).alias("i"), "key")


def stable_seed(name: Column) -> Column:
    """48 bits of a digest as a number."""
    return F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 12), 16, 10).cast("long")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def requests(planned: DataFrame, wave: int) -> DataFrame:
    """One row for each record of a plan: its axes, overlay flags and seed. Overlays fall on the records of the least digests."""
    each = planned.select("cell", "product", "fault", "place", "n", "adversarial", "abstention", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    for split, name in (("artifact_split", "artifact_type"), ("jurisdiction_split", "jurisdiction"), ("language_split", "language")):
        each = each.join(round_robin(planned, split).withColumnRenamed("key", name), ["cell", "i"])
    named = F.concat_ws(":", F.lit(str(wave)), "cell", F.col("i").cast("string"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.sha2(F.concat(F.lit("overlay:"), named).cast("binary"), 256)))
    each = each.withColumn("rng_seed", stable_seed(named)).withColumn("rank", rank)
    flags = {"is_adversarial": F.col("rank") <= F.col("adversarial"), "is_abstention": (F.col("rank") > F.col("adversarial")) & (F.col("rank") <= F.col("adversarial") + F.col("abstention"))}
    return each.withColumns(flags).select("cell", "product", "fault", "place", "i", "artifact_type", "jurisdiction", "language", "is_adversarial", "is_abstention", "rng_seed")


def low_survival(rates: DataFrame, floor: float = LOW_SURVIVAL) -> DataFrame:
    """(cell, rate, message) of cells whose records survive too rarely."""
    return rates.where(F.col("rate") < floor).select("cell", "rate", F.format_string("%s: survival %.2f, rendering suspected", "cell", "rate").alias("message"))


def merged_escalations(first: Column, second: Column) -> Column:
    """Both lists without repeats, in order of first sight."""
    return F.array_distinct(F.concat(first, second))


def nearest_rank(rows: DataFrame, key: str, value: str, share: float = 0.99) -> DataFrame:
    """Mean and the value at place floor(n * share) - 1 (from 0) of each key in ascending order, the last one where that is under 0.

    Rows fold into counts of values first. Values then fall into ``RANGES`` ranges a key, cut at approximate quantiles;
    counts of whole ranges tell in which one the place lies, and only that range is ordered. So no task orders a key.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    cuts = rows.groupBy(key).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 20 * RANGES).alias("cuts"))
    dealt = counts.join(F.broadcast(cuts), key).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(value))))
    ranges = dealt.groupBy(key, "range").agg(F.sum("c").alias("n_range"), F.sum(F.col("c") * F.col(value)).alias("s"))
    by_key = Window.partitionBy(key)
    told = ranges.select(
        key, "range", "n_range", F.sum("n_range").over(by_key).alias("n"), F.sum("s").over(by_key).alias("s"),
        (F.sum("n_range").over(by_key.orderBy("range")) - F.col("n_range")).alias("before"),
    )
    place = F.floor(F.col("n") * share)
    told = told.withColumn("place", F.when(place < 1, F.col("n")).otherwise(place)).where("before < place AND place <= before + n_range")
    within = dealt.join(F.broadcast(told), [key, "range"])
    reached = F.sum("c").over(Window.partitionBy(key, "range").orderBy(value)) + F.col("before")
    found = within.withColumn("reached", reached).where("reached >= place").groupBy(key).agg(F.min(value).alias("p99"), F.first("s").alias("s"), F.first("n").alias("n"))
    return found.select(key, F.round(F.col("s") / F.col("n"), 6).alias("mean"), "p99")


#: Ranges of values that a key's rows are dealt into.
RANGES = 64


def slice_summary(scores: DataFrame, passing: float = 0.8) -> DataFrame:
    """One row: the worst cell (the first of equal ones), how many pass, and the mean."""
    return scores.agg(
        F.min_by("cell", F.struct("f1", "cell")).alias("worst_cell"), F.min("f1").alias("worst_f1"), F.count_if(F.col("f1") >= passing).alias("n_passing"), F.round(F.avg("f1"), 6).alias("mean_f1")
    )


def top_confusions(rows: DataFrame, k: int = 5) -> DataFrame:
    """(truth, predicted, n) of the k most frequent errors, ties in order of name."""
    wrong = rows.where(~F.col("truth").eqNullSafe(F.col("predicted"))).groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), "truth", "predicted").limit(k)
