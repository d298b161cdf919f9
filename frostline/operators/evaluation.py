"""Model evaluation: F1 over classes, group gaps and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def macro_f1(rows: DataFrame, *groups: str, truth: str = "truth", predicted: str = "predicted", digits: int | None = 6) -> DataFrame:
    """Mean F1 over all classes of truth or prediction, for each group: two aggregations, no pass per class."""
    cells = rows.groupBy(*groups, truth, predicted).agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col(truth).alias("label"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("both")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("both")),
    )
    classes = cells.select(*groups, "n", F.explode(sides).alias("s")).groupBy(*groups, "s.label").agg((2 * F.sum("s.tp") / F.sum("s.both")).alias("f1"), F.sum("s.both").alias("both"))
    return classes.groupBy(*groups).agg((F.avg("f1") if digits is None else F.round(F.avg("f1"), digits)).alias("macro_f1"), (F.sum("both") / 2).cast("long").alias("n"))


def vote_numeric(votes: DataFrame, floor: float = 0.6) -> DataFrame:
    """Median vote of each item, the share of votes at the median, and whether that is too small."""
    median = votes.groupBy("item").agg(F.percentile("vote", 0.5).alias("median"))
    near = F.abs(F.col("vote") - F.col("median")) <= 1e-6
    out = votes.join(median, "item").groupBy("item", "median").agg(F.round(F.avg(near.cast("int")), 6).alias("agreement"))
    return out.withColumn("escalated", F.col("agreement") < floor)


def vote_categorical(votes: DataFrame, floor: float = 0.6) -> DataFrame:
    """Most common vote of each item, the first seen on ties."""
    counted = votes.groupBy("item", "vote").agg(F.count("*").alias("n"), F.min("position").alias("seen"))
    best = counted.groupBy("item").agg(F.max_by("vote", F.struct("n", -F.col("seen"))).alias("vote"), F.round(F.max("n") / F.sum("n"), 6).alias("agreement"))
    return best.withColumn("escalated", F.col("agreement") < floor)


def latest_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: an upsert where no table format merges."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
