"""Judgements of models and reviewers: item records, holdout metrics, F1 gaps, review boards, gate metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import macro_f1, vote_numeric
from .leakage import leakage_probe
from .similarity import near_duplicate_rate

# Percent of records held out, least items of a group whose F1 counts.
HOLDOUT_PERCENT, LEAST_SLICE = 5, 5


def is_holdout(record_id: Column) -> Column:
    digest = F.sha2(record_id.cast("string").cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < HOLDOUT_PERCENT


def holdout_items(log: DataFrame, predictions: DataFrame, last_wave: int, key: str = "doc_id") -> DataFrame:
    """Kept, held-out records of waves up to the last one with their predictions (null where there is none)."""
    held = log.where((F.col("outcome") == "kept") & is_holdout(F.col(key)) & F.col("wave").between(1, last_wave))
    return held.join(predictions, key, "left")


def parsed_vote(reply: Column) -> Column:
    """The verdict of a judge's JSON reply as text; null where the reply has none."""
    return F.try_variant_get(F.try_parse_json(F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))), "$.verdict", "string")


def self_consistency(votes: DataFrame, strict: DataFrame, floor: float = 0.6) -> DataFrame:
    """Median votes; where agreement is too small a strict vote (item, strict), if there is one, decides with agreement 1."""
    out = vote_numeric(votes, floor).join(strict, "item", "left")
    taken = F.col("escalated") & F.col("strict").isNotNull()
    return out.select("item", F.when(taken, F.col("strict")).otherwise(F.col("median")).alias("consensus"), F.when(taken, F.lit(1.0)).otherwise(F.col("agreement")).alias("agreement"), "escalated")


def board_kappa(agreement: Column, leakage: Column) -> Column:
    """Agreement of reviewers, lowered by the leakage they see (1 to 5; null or 0: 5)."""
    seen = F.coalesce(F.nullif(leakage.cast("double"), F.lit(0.0)), F.lit(5.0))
    return F.least(agreement, 1.0 - (seen - 1.0) / 4.0)


def item_records(items: DataFrame) -> DataFrame:
    """Judgement of each item over columns cell, truth, predicted (null: malformed), is_abstention, hallucination, abstention_correct.

    What a malformed item was not judged on is null, and so is abstention where the item is none.
    """
    malformed = F.col("predicted").isNull()
    return items.withColumns(
        {
            "malformed": malformed,
            "correct": F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False)),
            "hallucination": F.when(~malformed, F.col("hallucination")),
            "abstention_correct": F.when(~malformed & F.col("is_abstention"), F.col("abstention_correct")),
        }
    )


def holdout_metrics(records: DataFrame) -> DataFrame:
    """(metric, value) of judged items; no items: nothing malformed or invented, and abstention is perfect."""
    right = F.coalesce(F.avg(F.col("abstention_correct").cast("int")), F.lit(1.0))
    one = records.agg(
        (F.count_if("malformed") / F.greatest(F.count("*"), F.lit(1))).alias("malformed_json_rate"), F.coalesce(F.avg("hallucination"), F.lit(0.0)).alias("hallucinated_field_rate"),
        right.alias("abstention_precision"), right.alias("abstention_recall"),
    )
    return one.unpivot([], list(one.columns), "metric", "value")


def cell_accuracy(records: DataFrame) -> DataFrame:
    return records.groupBy("cell").agg(F.avg(F.col("correct").cast("int")).alias("f1"), F.count("*").alias("n"))


def _f1_by(items: DataFrame, group: Column) -> DataFrame:
    rows = items.select(group.alias("grp"), "truth", F.coalesce("predicted", F.lit("")).alias("predicted"))
    return macro_f1(rows, "grp", digits=None)


def f1_gap(items: DataFrame, group: Column, metric: str) -> DataFrame:
    """(metric, value): the distance of the F1 of a group from that of the rest; 0 if either is empty."""
    f1 = _f1_by(items, group)
    gap = F.when(F.count("*") == 2, F.max("macro_f1") - F.min("macro_f1")).otherwise(0.0)
    return f1.agg(gap.alias("value")).select(F.lit(metric).alias("metric"), "value")


def group_delta(items: DataFrame, group: Column, metric: str, least: int = LEAST_SLICE) -> DataFrame:
    """(metric, value): the largest distance between F1 of groups of enough items; 0 for fewer than two groups."""
    f1 = _f1_by(items, group).where(F.col("n") >= least)
    return f1.agg(F.when(F.count("*") >= 2, F.max("macro_f1") - F.min("macro_f1")).otherwise(0.0).alias("value")).select(F.lit(metric).alias("metric"), "value")


def generation_metrics(log: DataFrame, targets: DataFrame) -> DataFrame:
    """(metric, value) of a wave's records. targets: (cell, n) of its plan.

    Log columns: outcome, cell, disposition, verdict, rules, schema_valid, round_trip_ok. No rows or no kept ones give the
    worst share and zeros elsewhere.
    """
    kept = F.col("outcome") == "kept"
    share = lambda c: F.coalesce(F.avg(F.when(kept, c.cast("int"))), F.lit(0.0))
    n = F.greatest(F.count("*"), F.lit(1))
    one = log.agg(
        (F.count_if(F.coalesce("schema_valid", F.lit(False))) / n).alias("schema_validity"), share(F.coalesce("round_trip_ok", F.lit(False))).alias("round_trip_recovery"),
        (F.count_if(F.col("verdict").isNotNull() & (F.col("verdict") != "CONSISTENT")) / n).alias("screener_flag_rate"), share(F.size("rules") > 0).alias("guardrail_violation_rate"),
    )
    of_class = log.where(kept).groupBy("disposition").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c") / F.sum("c"), F.lit(1.0)).alias("max_class_share"))
    of_cell = targets.join(log.where(kept).groupBy("cell").agg(F.count("*").alias("kept")), "cell", "left")
    off = F.abs(F.coalesce("kept", F.lit(0)) - F.col("n")) / F.greatest(F.col("n"), F.lit(1))
    of_cell = of_cell.agg(F.coalesce(F.avg(off), F.lit(0.0)).alias("cell_fill_deviation"))
    long = lambda df: df.unpivot([], list(df.columns), "metric", "value")
    return long(one).unionByName(long(of_class)).unionByName(long(of_cell))


def text_metrics(kept: DataFrame, vectors: DataFrame) -> DataFrame:
    """(metric, value) of the kept records' texts (rendered_text, disposition) and of their vectors: the share of near
    duplicates and the accuracy of the leakage probe. Without kept records both are at their worst, 1."""
    spark = kept.sparkSession
    if kept.isEmpty():
        return spark.createDataFrame([("near_duplicate_rate", 1.0), ("leakage_probe_acc", 1.0)], "metric string, value double")
    rate = near_duplicate_rate(vectors).select(F.lit("near_duplicate_rate").alias("metric"), F.col("near_duplicate_rate").alias("value"))
    return rate.unionByName(spark.createDataFrame([("leakage_probe_acc", leakage_probe(kept))], "metric string, value double"))


def gate_a_metrics(log: DataFrame, targets: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """(metric, value): all eight computed metrics of a wave. vectors: (vec_id, embedding), vec_id being the record's key."""
    kept = log.where("outcome = 'kept'")
    own = vectors.join(kept.select(F.col(key).alias("vec_id")), "vec_id", "left_semi")
    return generation_metrics(log, targets).unionByName(text_metrics(kept, own))


def with_override(metrics: DataFrame, human: DataFrame, needed: tuple[str, ...] = ("language_authenticity", "annotator_kappa")) -> DataFrame:
    """Metrics with those of human reviewers in place of the judges', if the reviewers gave all of them."""
    whole = human.where(F.col("metric").isin(*needed)).agg((F.countDistinct("metric") == len(needed)).alias("whole"))
    theirs = human.where(F.col("metric").isin(*needed)).withColumnRenamed("value", "theirs")
    joined = metrics.join(theirs, "metric", "full").join(F.broadcast(whole), F.lit(True))
    return joined.select("metric", F.when(F.col("whole") & F.col("theirs").isNotNull(), F.col("theirs")).otherwise(F.col("value")).alias("value")).where("value IS NOT NULL")


def ledger_row(scores: DataFrame, log: DataFrame) -> DataFrame:
    """One row for each wave: requested, kept, worst cell, F1 by cell (scores: wave, cell, f1), survival."""
    counts = log.groupBy("wave").agg(F.count("*").alias("requested"), F.count_if(F.col("outcome") == "kept").alias("kept"))
    f1 = scores.groupBy("wave").agg(
        F.min_by("cell", F.struct("f1", "cell")).alias("worst_cell"), F.min("f1").alias("worst_f1"), F.avg("f1").alias("mean_f1"),
        F.count_if(F.col("f1") >= 0.8).alias("cells_passing"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("cell", "f1")))).alias("cell_f1"),
    )
    return counts.join(f1, "wave", "left")


def flagged_concerns(error: Column, concerns: Column) -> Column:
    """A review that came through and names concerns other than none."""
    none = concerns.isNull() | (F.size(concerns) == 0) | (concerns == F.array(F.lit("none")))
    return error.isNull() & ~F.coalesce(none, F.lit(True))


def review_summary(reviews: DataFrame) -> DataFrame:
    """One row over reviews (error, agrees, concerns): agree, disagree, errored, flagged, rate of agreement."""
    came = F.col("error").isNull()
    return reviews.agg(
        F.count_if(came & F.col("agrees")).alias("agree"), F.count_if(came & ~F.coalesce("agrees", F.lit(False))).alias("disagree"), F.count_if(~came).alias("errored"),
        F.count_if(flagged_concerns(F.col("error"), F.col("concerns"))).alias("flagged"), F.round(F.count_if(came & F.col("agrees")) / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"),
    )
