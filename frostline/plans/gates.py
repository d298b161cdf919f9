"""Gates: metrics against bounds, and the ratchet between two rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Metric, operator, low bound, high bound.
GATE_A = (
    ("schema_validity", ">=", 0.995, None),
    ("round_trip_recovery", ">=", 0.95, None),
    ("screener_flag_rate", "between", 0.02, 0.08),
    ("near_duplicate_rate", "<=", 0.03, None),
    ("cell_fill_deviation", "<=", 0.10, None),
    ("max_class_share", "<=", 0.45, None),
    ("leakage_probe_acc", "<=", 0.70, None),
    ("language_authenticity", ">=", 3.5, None),
    ("annotator_kappa", ">=", 0.75, None),
    ("guardrail_violation_rate", "<=", 0.01, None),
)
GATE_B = (
    ("malformed_json_rate", "<=", 0.005, None),
    ("hallucinated_field_rate", "<=", 0.01, None),
    ("abstention_precision", ">=", 0.85, None),
    ("abstention_recall", ">=", 0.75, None),
    ("cross_jurisdiction_delta", "<=", 0.05, None),
    ("adversarial_gap", "<=", 0.10, None),
    ("holdout_delta", "<=", 0.05, None),
)
# Fixed value: F1 from which a cell passes.
PASSING_F1 = 0.80


def bound_text(lo: float, hi: float | None) -> str:
    return str(lo) if hi is None else f"({lo}, {hi})"


def evaluate(spark: SparkSession, metrics: DataFrame, bounds=GATE_A, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every bound with its metric: (keys, metric, value, passed, reason). A metric that is missing fails.

    A reason tells the value, the operator and the bound. keys: columns of metrics whose values are judged apart, such as waves.
    """
    for _, op, lo, hi in bounds:
        check_bound(op, lo, lo, hi)
    columns = "metric string, op string, lo double, hi double, bound string"
    rows = [(*b, bound_text(*b[2:])) for b in bounds]
    if keys:
        told = F.array(*(F.struct(*(F.lit(x).cast(c.split()[1]).alias(c.split()[0]) for x, c in zip(r, columns.split(", "), strict=True))) for r in rows))
        table = metrics.select(*keys).distinct().select(*keys, F.explode(told).alias("b")).select(*keys, "b.*")
    else:
        table = spark.createDataFrame(rows, columns)
    joined = table.join(metrics, [*keys, "metric"], "left")
    holds = F.expr("CASE op WHEN '>=' THEN value >= lo WHEN '<=' THEN value <= lo ELSE value BETWEEN lo AND hi END")
    said = F.format_string("%.6f fails %s %s", F.round("value", 6), "op", "bound")
    reason = F.when(F.col("value").isNull(), "not measured").when(~holds, said).otherwise("")
    return joined.select(*keys, "metric", "value", F.coalesce(holds, F.lit(False)).alias("passed"), reason.alias("reason"))


class GateFailure(RuntimeError):
    """A wave may not go on."""


def check_bound(op: str, value: float, lo: float, hi: float | None = None) -> bool:
    """Whether a value keeps a bound; an unknown operator is an error."""
    if op == ">=":
        return value >= lo
    if op == "<=":
        return value <= lo
    if op == "between":
        return lo <= value <= hi
    raise ValueError(f"unknown bound: {op}")


def verdict(evaluated: DataFrame, *keys: str) -> DataFrame:
    """One row (for each value of the keys): whether all checks passed, and the failures as text in order of name."""
    said = F.when(~F.col("passed"), F.concat_ws(": ", "metric", "reason"))
    return evaluated.groupBy(*keys).agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"), F.array_sort(F.collect_list(said)).alias("failures"))


def halt_unless_passed(evaluated: DataFrame) -> None:
    """Raises with the failures of a gate; results should be written before."""
    row = verdict(evaluated).first()
    if not row["passed"]:
        raise GateFailure("; ".join(row["failures"]))


def require_passed(verdicts: DataFrame, wave: int) -> None:
    """Training on a wave needs a passed gate of it (verdicts: wave, passed)."""
    if verdicts.where((F.col("wave") == wave) & F.col("passed")).isEmpty():
        raise GateFailure(f"wave {wave} has not passed its gate")


def ratchet(before: DataFrame, now: DataFrame) -> DataFrame:
    """One row: whether the worst cell fell, how many passing cells no longer pass, and the verdict."""
    b, n = before.select("cell", F.col("f1").alias("b")), now.select("cell", F.col("f1").alias("n"))
    return ratchet_rows(b.join(n, "cell", "full"))


def ratchet_rows(both: DataFrame) -> DataFrame:
    """The same for rows (cell, b, n) that hold the F1 of both rounds."""
    out = both.agg(
        F.coalesce(F.min("n") < F.min("b"), F.lit(False)).alias("worst_fell"),
        F.count_if((F.col("b") >= PASSING_F1) & (F.coalesce("n", F.lit(0.0)) < PASSING_F1)).alias("cells_lost"),
    )
    return out.withColumn("passed", ~F.col("worst_fell") & (F.col("cells_lost") == 0))
