"""Results that reviewers hand in as JSON documents: metrics, F1 by cell and confusions, through Gate B and the ratchet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gates

#: How many confusions a result names.
CONFUSIONS = 5
#: Maps keep the documents' order, which a variant's keys would lose.
_SCHEMA = "metrics map<string,double>, cell_f1 map<string,double>, confusions array<array<string>>"


def metrics_of(results: DataFrame) -> DataFrame:
    """(wave, metric, value) of documents (wave, doc)."""
    return results.select("wave", F.explode(F.from_json("doc", _SCHEMA)["metrics"]).alias("metric", "value"))


def cells_of(results: DataFrame) -> DataFrame:
    """(wave, place, cell, f1), in the documents' order."""
    return results.select("wave", F.posexplode(F.from_json("doc", _SCHEMA)["cell_f1"]).alias("place", "cell", "f1"))


def confusions_of(results: DataFrame) -> DataFrame:
    """(wave, place, truth, predicted, n) of lists [[truth, predicted], n]; documents may have none."""
    each = results.select("wave", F.posexplode(F.from_json("doc", _SCHEMA)["confusions"]).alias("place", "c"))
    pair = F.from_json(F.get("c", F.lit(0)), "array<string>")
    return each.select("wave", "place", F.get(pair, F.lit(0)).alias("truth"), F.get(pair, F.lit(1)).alias("predicted"), F.get("c", F.lit(1)).cast("long").alias("n"))


def slices(results: DataFrame, most: int = CONFUSIONS) -> DataFrame:
    """One row a document: worst cell (the first of equal ones) and its F1, cells that pass, mean, F1 by cell, top confusions.

    A document without cells has none of these: worst cell '', zeros, an empty map.
    """
    f1 = cells_of(results).groupBy("wave").agg(
        F.min_by("cell", F.struct("f1", "place")).alias("worst_cell"), F.min("f1").alias("worst_f1"), F.count_if(F.col("f1") >= gates.PASSING_F1).alias("cells_passing"),
        F.avg("f1").alias("mean_f1"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("cell", "f1")))).alias("cell_f1"),
    )
    rank = Window.partitionBy("wave").orderBy(F.col("n").desc(), "place")
    top = confusions_of(results).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "truth", "predicted"))), lambda x: F.array(x["truth"], x["predicted"]))
    out = results.select("wave").join(f1, "wave", "left").join(top.groupBy("wave").agg(pairs.alias("top_confusions")), "wave", "left")
    empty = {"worst_cell": F.lit(""), "worst_f1": F.lit(0.0), "cells_passing": F.lit(0).cast("long"), "mean_f1": F.lit(0.0), "cell_f1": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")), "top_confusions": F.array().cast("array<array<string>>")}
    return out.select("wave", *(F.coalesce(c, e).alias(c) for c, e in empty.items()))


def ratcheted(rows: DataFrame) -> DataFrame:
    """Slices with ratchet_ok and ratchet_note against the last wave before that has cells.

    The worst cell must not fall, and no cell that passed may cease to. The window sees one row a wave.
    """
    earlier = Window.orderBy("wave").rowsBetween(Window.unboundedPreceding, -1)
    told = F.when(F.size("cell_f1") > 0, F.struct("worst_f1", "cell_f1"))
    r = rows.withColumn("before", F.last(told, ignorenulls=True).over(earlier))
    b = F.col("before")
    fell = F.col("worst_f1") < b["worst_f1"]
    lost = F.filter(F.map_keys(b["cell_f1"]), lambda c: (F.element_at(b["cell_f1"], c) >= gates.PASSING_F1) & (F.coalesce(F.element_at(F.col("cell_f1"), c), F.lit(0.0)) < gates.PASSING_F1))
    moved = lambda form: F.format_string(form, b["worst_f1"], F.col("worst_f1"))
    note = (
        F.when(b.isNull(), "first measured wave")
        .when(fell, moved("worst_cell_f1 fell %.3f -> %.3f"))
        .when(F.size(lost) > 0, F.concat(F.lit(f"cells dropped below {gates.PASSING_F1:.2f}: "), F.array_join(lost, ", ")))
        .otherwise(moved("worst_cell_f1 %.3f -> %.3f"))
    )
    return r.withColumn("ratchet_ok", b.isNull() | (~fell & (F.size(lost) == 0))).withColumn("ratchet_note", note).drop("before")


def gate_b(results: DataFrame) -> DataFrame:
    """One row for each wave's document (wave, doc as JSON text): passed (Gate B and the ratchet), failures, slices and ratchet."""
    waves = results.select("wave", F.explode(F.array(*(F.lit(m) for m, *_ in gates.GATE_B))).alias("metric"))
    known = waves.join(metrics_of(results), ["wave", "metric"], "left")
    judged = gates.verdict(gates.evaluate(results.sparkSession, known, gates.GATE_B, ("wave",)), "wave")
    out = ratcheted(slices(results)).join(judged.withColumnRenamed("passed", "metrics_passed"), "wave")
    return out.withColumn("passed", F.col("metrics_passed") & F.col("ratchet_ok"))
