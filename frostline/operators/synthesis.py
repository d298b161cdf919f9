"""Synthetic temperature series: one row a request, all draws are functions of the request's seed.

A draw is 48 bits of a digest of seed and name, so a series is the same wherever and however often it is made.
Points of series are drawn and rounded with Arrow and Numpy, some rows at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.rules import INTERVAL_MIN, product_specs

# Points of a series, operating span in degrees of products without a lower bound.
POINTS, FROZEN_SPAN_C = 96, 7.0
#: Rows whose points are held at a time.
ROWS = 512
# Most tokens of rendered and of extracted texts by artifact type.
RENDER_TOKENS = (("logger_csv", 2400), ("chat_message", 500), ("qc_form_ocr", 900), ("voice_note", 500))
EXTRACT_TOKENS = (("logger_csv", 1200), ("chat_message", 400), ("qc_form_ocr", 700), ("voice_note", 400))
FIELDS = ("product", "readings_c", "interval_min", "ambient_c", "days_since_production", "peak_season")


def draw(name: Column | str, low: Column | float = 0.0, high: Column | float = 1.0) -> Column:
    """A uniform number of [low, high) for the row's rng_seed and a name."""
    name = F.lit(name) if isinstance(name, str) else name
    digest = F.sha2(F.concat_ws(":", F.col("rng_seed").cast("string"), name).cast("binary"), 256)
    part = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)
    low, high = (F.lit(x) if isinstance(x, (int, float)) else x for x in (low, high))
    return low + (high - low) * part


def pick(name: str, low: int, high: int | Column) -> Column:
    """A whole number of [low, high]."""
    return F.floor(draw(name, low, (high + 1) if isinstance(high, Column) else F.lit(high + 1))).cast("int")


def operating_floor(low: Column, high: Column) -> Column:
    return F.coalesce(low, high - FROZEN_SPAN_C)


def _parts(prefixes: list[bytes], names: list[bytes]) -> np.ndarray:
    """The uniform numbers of [0, 1) behind ``draw``: a row for each prefix (the seed and a colon), a column for each name."""
    digests = b"".join([hashlib.sha256(p + n).digest() for p in prefixes for n in names])
    bits = np.frombuffer(digests, dtype=">u8")[::4].astype(np.uint64) >> np.uint64(16)
    return bits.astype(np.float64).reshape(len(prefixes), len(names)) / float(1 << 48)


def _hundredths(x: np.ndarray) -> np.ndarray:
    """Rounded to two digits, halves away from zero; never a negative zero."""
    return np.copysign(np.floor(np.abs(x) * 100 + 0.5), x) / 100 + 0.0


def _base(prefixes: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    middle, half = ((low + high) / 2)[:, None], ((high - low) / 2)[:, None]
    least, most = -half * 0.6, half * 0.6
    return _hundredths(middle + (least + (most - least) * _parts(prefixes, [b"base%d" % i for i in range(POINTS)])))


def _faulty(prefixes: list[bytes], fault: str, base: np.ndarray) -> np.ndarray:
    """The rows of base, all of one fault mode, with that fault."""
    x, i = base.copy(), np.arange(POINTS)
    part = lambda *names: _parts(prefixes, [n.encode() for n in names]).T
    whole = lambda u, low, high: np.floor(low + (high + 1 - low) * u).astype(np.int64)
    if fault == "door_open":
        u = part("at", "long", "warm")
        at, warm = whole(u[0], 0, POINTS - 9)[:, None], 22.0 + (38.0 - 22.0) * u[2]
        row, k = np.nonzero((i >= at) & (i < at + whole(u[1], 2, 8)[:, None]))
        pull = np.concatenate([np.zeros(0), *(_parts([prefixes[r]], [b"pull%d" % p for p in k[row == r]])[0] for r in range(len(base)))])
        x[row, k] = _hundredths(x[row, k] + (warm[row] - x[row, k]) * (0.4 + (0.9 - 0.4) * pull))
    elif fault == "compressor_fail":
        u = part("half", "rise")
        half, rise = whole(u[0], 0, POINTS // 2 - 1), 0.3 + (0.9 - 0.3) * u[1]
        # each warmer point is rounded before the next one builds on it
        for k in range(1, POINTS):
            x[:, k] = np.where(k > half, _hundredths(x[:, k - 1] + rise), x[:, k])
    elif fault == "setpoint_drift":
        x = _hundredths(x + (i + 1) * (0.02 + (0.08 - 0.02) * part("drift")[0])[:, None])
    elif fault == "sensor_artifact":
        u = part("kind", "where", "stuck", "sign", "jump")
        kind, where, stuck = whole(u[0], 0, 2)[:, None], whole(u[1], 0, POINTS - 1)[:, None], whole(u[2], 8, 20)[:, None]
        jump = np.where(u[3] < 0.5, -1.0, 1.0) * (15.0 + (40.0 - 15.0) * u[4])
        x = np.where((kind == 0) & (i >= where) & (i < where + stuck), np.take_along_axis(base, where, axis=1), x)
        x = np.where((kind == 1) & (i == where), _hundredths(base + jump[:, None]), x)
        x = np.where((kind == 2) & (i == where), -99.9, x)
    return x


def _points(seed: pa.Array, fault: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    prefixes = [b"" if s is None else s.encode() + b":" for s in seed.to_pylist()]
    faults = np.array([f or "" for f in fault.to_pylist()], dtype=object)
    low, high = (x.to_numpy(zero_copy_only=False).astype(np.float64) for x in (low, high))
    made = [pa.array([], type=pa.float64())]
    for at in range(0, len(prefixes), ROWS):
        own, kinds = prefixes[at : at + ROWS], faults[at : at + ROWS]
        x = _base(own, low[at : at + ROWS], high[at : at + ROWS])
        for kind in set(kinds):
            rows = np.flatnonzero(kinds == kind)
            x[rows] = _faulty([own[r] for r in rows], kind, x[rows])
        # points without bounds are null
        made.append(pa.array(x.ravel(), from_pandas=True))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(prefixes) + 1, dtype=np.int32) * POINTS), pa.concat_arrays(made))


def in_spec() -> Column:
    """Around the middle of the band, up to 0.6 of its half."""
    return _series(F.lit("in_spec"))


def _series(fault: Column) -> Column:
    return F.arrow_udf(_points, "array<double>")(F.col("rng_seed").cast("string"), fault.cast("string"), operating_floor(F.col("min_c"), F.col("max_c")).cast("double"), F.col("max_c").cast("double"))


def with_series(rows: DataFrame) -> DataFrame:
    """Adds readings_c by fault mode, and sensor_fault."""
    return rows.withColumn("readings_c", _series(F.col("fault"))).withColumn("sensor_fault", F.col("fault") == "sensor_artifact")


def synthesize(requests: DataFrame) -> DataFrame:
    """World states of requests (product, fault, is_adversarial, is_abstention, rng_seed and what else they carry).

    An abstaining record lacks one field at random. An adversarial one, unless its sensor is at fault, is nudged just
    over the band at as many leading points as the hold limit has, where they were within it.
    """
    specs = F.broadcast(product_specs(requests.sparkSession))
    rows = with_series(requests.join(specs, "product"))
    hidden = F.element_at(F.array(*map(F.lit, ("readings_c", "days_since_production", "interval_min"))), pick("hidden", 1, 3))
    missing = F.when(F.col("is_abstention"), F.array(hidden)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("missing_fields", missing)
    gone = lambda name: F.array_contains("missing_fields", name)
    readings = F.when(gone("readings_c"), F.array().cast("array<double>")).otherwise(F.col("readings_c"))
    leading = F.floor(F.col("hold_min") / INTERVAL_MIN)
    nudged = F.transform(readings, lambda x, i: F.when((i < leading) & (x <= F.col("max_c")), F.round(F.col("max_c") + 0.1, 2)).otherwise(x))
    rows = rows.withColumns(
        {
            "readings_c": F.when(F.col("is_adversarial") & (F.col("fault") != "sensor_artifact"), nudged).otherwise(readings),
            "days_since_production": F.when(~gone("days_since_production"), pick("days", 0, F.col("shelf_days") + 2)),
            "interval_min": F.lit(INTERVAL_MIN), "ambient_c": F.round(draw("ambient", 24.0, 42.0), 1), "peak_season": draw("season") < 0.2,
        }
    )
    return rows.drop("min_c", "max_c", "refreeze_c", "hold_min", "reject_min", "shelf_days")


def visible_names(states: DataFrame) -> Column:
    """The names of a state's fields without those it lacks, for which no series has to be made."""
    return F.filter(F.array(*map(F.lit, FIELDS)), lambda k: ~F.array_contains("missing_fields", k))


def visible_fields(states: DataFrame) -> Column:
    """The fields of a state as a map of JSON texts, without those it lacks."""
    told = F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*(F.to_json(F.struct(F.col(c).alias("x"))) for c in FIELDS)))
    return F.map_filter(told, lambda k, v: ~F.array_contains("missing_fields", k))


def token_budget(artifact_type: Column, table: tuple[tuple[str, int], ...]) -> Column:
    """The budget of an artifact type; an unknown one fails the task."""
    found = F.element_at(F.create_map(*(F.lit(x) for pair in table for x in pair)), artifact_type)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown artifact type: "), F.coalesce(artifact_type, F.lit("null")))).cast("int"))


def render_prompt(fields: Column, artifact_type: Column, jurisdiction: Column) -> Column:
    """The text that asks for an artifact of the visible fields; no label is in it."""
    facts = F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return F.format_string("Write one %s in English for a consignment in %s. Facts: %s", artifact_type, F.coalesce(jurisdiction, F.lit("the region")), facts)
