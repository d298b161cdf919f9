"""The leakage probe: how well a linear classifier guesses the disposition of a record from its text alone."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.sources.store import written

# Least texts and folds of the probe.
LEAST_TEXTS, FOLDS = 50, 4
#: Buckets that words and word pairs are hashed into, most passes of the fit, most classes.
BUCKETS, PASSES, MOST_CLASSES = 4096, 30, 64
#: Parts that a task's sums are sent in, and how many are added together.
_PARTS, _FAN = 8, 64
#: Texts whose words, and entries of texts whose products, a task holds at a time.
TEXTS, ENTRIES = 64, 1 << 17

_FEATURES = pa.schema([("label", pa.string()), ("part", pa.int32()), ("place", pa.int64()), ("index", pa.list_(pa.int32())), ("count", pa.list_(pa.int32()))])
_SUM_DDL = "task int, part int, value binary"


def _features(buckets: int):
    """Hashed counts of words and word pairs, and each row's place among the rows of its class in its task."""
    import re
    import zlib

    word = re.compile(r"(?u)\b\w\w+\b")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = defaultdict(int)
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, len(b), TEXTS)):
            rows = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = word.findall((text or "").lower())
                grams = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]
                index, count = np.unique(np.fromiter((zlib.crc32(g.encode()) % buckets for g in grams), dtype=np.int32, count=len(grams)), return_counts=True)
                rows.append((label, TaskContext.get().partitionId(), seen[label], index, count.astype(np.int32)))
                seen[label] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), _FEATURES, strict=True)], schema=_FEATURES)

    return scan


def with_folds(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Features with their fold: rows of a class go to the folds in turn, so folds hold the same number of each class, give or take one.

    The tasks that wrote the rows numbered them by class; the counts of earlier tasks are added. No class is sorted.
    """
    counts = rows.groupBy("label", "part").agg(F.count("*").alias("n"))
    # one row a class and task
    before = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select("label", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "probe-offsets")
    offsets = F.broadcast(offsets) if offsets.count() <= 200_000 else offsets
    return rows.join(offsets, ["label", "part"]).select("label", F.pmod(F.col("place") + F.col("before"), F.lit(folds)).cast("int").alias("fold"), "index", "count")


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, dtype=np.float64) for x in rows["value"]], axis=0)
    return pd.DataFrame({"task": rows["task"][:1] // _FAN, "part": rows["part"][:1], "value": [total.tobytes()]})


def _summed(rows: DataFrame, tasks: int, shape: tuple[int, ...], add: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of add(batch), an array of fixed shape: added in each task, then as a tree in parts."""
    size = int(np.prod(shape))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for part in _slices(batch):
                total += add(part)
        parts = np.array_split(total.ravel(), _PARTS)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * _PARTS, type=pa.int32()), pa.array(range(_PARTS), type=pa.int32()), pa.array([x.tobytes() for x in parts], type=pa.binary())], names=["task", "part", "value"])

    sent = rows.mapInArrow(scan, _SUM_DDL)
    while tasks > _FAN:
        sent = sent.groupBy("part", F.floor(F.col("task") / _FAN).alias("g")).applyInPandas(_added, _SUM_DDL)
        tasks = -(-tasks // _FAN)
    parts = [np.zeros(len(x)) for x in np.array_split(np.zeros(size), _PARTS)]
    for r in sent.select("part", "value").collect():
        parts[r["part"]] = parts[r["part"]] + np.frombuffer(r["value"], dtype=np.float64)
    return np.concatenate(parts).reshape(shape)


def _slices(batch: pa.RecordBatch, most: int = ENTRIES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most so many entries together; a row of more is a run of its own."""
    ends, at = batch.column("index").offsets.to_numpy(), 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fold, row of each entry, index, count) of a batch."""
    index = batch.column("index")
    sizes = np.diff(index.offsets.to_numpy())
    return batch.column("fold").to_numpy(), np.repeat(np.arange(len(batch)), sizes), index.flatten().to_numpy(), batch.column("count").flatten().to_numpy().astype(np.float64)


def _weighted(row: np.ndarray, index: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """tf-idf of unit length by row."""
    x = count * idf[index]
    norm = np.sqrt(np.bincount(row, x * x, minlength=n))
    return x / np.maximum(norm[row], 1e-300)


def _chances(row: np.ndarray, index: np.ndarray, x: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """(n, classes) probabilities under weights (classes, buckets + 1), the last column being the intercept."""
    scores = np.stack([np.bincount(row, x * w[index], minlength=n) + w[-1] for w in weights], axis=1)
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def minimize(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, passes: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving; every evaluation is one pass over the data."""
    x, steps, changes = start, [], []
    value, slope = evaluate(x)
    passes -= 1
    while passes > 0 and np.abs(slope).max() > 1e-5:
        q, factors = slope.copy(), []
        for s, y in zip(reversed(steps), reversed(changes), strict=True):
            factors.append((s @ q) / (s @ y))
            q -= factors[-1] * y
        if steps:
            q *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
        for s, y, f in zip(steps, changes, reversed(factors), strict=True):
            q += (f - (y @ q) / (s @ y)) * s
        rate, fall = 1.0, slope @ q
        while passes > 0:
            tried = x - rate * q
            after, new = evaluate(tried)
            passes -= 1
            if after <= value - 1e-4 * rate * fall:
                break
            rate /= 2
        else:
            return x
        if (tried - x) @ (new - slope) > 1e-12:
            steps, changes = [*steps, tried - x][-memory:], [*changes, new - slope][-memory:]
        x, value, slope = tried, after, new
    return x


def leakage_probe(rows: DataFrame, buckets: int = BUCKETS, folds: int = FOLDS, passes: int = PASSES) -> float:
    """Mean accuracy over stratified folds of multinomial logistic regression on tf-idf of words and word pairs.

    rendered_text is read once, into hashed counts. Document frequencies of all folds come from one pass, and all folds' models
    are fitted together: each pass adds up the gradients of all of them, and so does the last pass with their hits.
    0 for fewer than two classes or LEAST_TEXTS texts. Null texts count as empty; rows without a disposition are left out.
    """
    told = rows.where("disposition IS NOT NULL").select("rendered_text", F.col("disposition").cast("string"))
    data = written(told.mapInArrow(_features(buckets), "label string, part int, place long, index array<int>, count array<int>"), "probe-features")
    counts = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_CLASSES + 1).collect()}
    n, classes = sum(counts.values()), sorted(counts)
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} dispositions")
    if len(classes) < 2 or n < LEAST_TEXTS:
        return 0.0
    data = written(with_folds(data, folds), "probe-folds")
    tasks = max(1, data.rdd.getNumPartitions())
    place = {c: i for i, c in enumerate(classes)}

    def document_counts(batch: pa.RecordBatch) -> np.ndarray:
        fold, row, index, _ = _rows_of(batch)
        out = np.zeros((folds, buckets + 1))
        np.add.at(out, (fold[row], index), 1)
        out[:, -1] = np.bincount(fold, minlength=folds)
        return out

    found = _summed(data, tasks, (folds, buckets + 1), document_counts)
    train = found.sum(axis=0) - found
    idf = np.log((1 + train[:, -1:]) / (1 + train[:, :-1])) + 1
    shape = (folds, len(classes), buckets + 1)

    def evaluate(flat: np.ndarray) -> tuple[float, np.ndarray]:
        weights = flat.reshape(shape)

        def add(batch: pa.RecordBatch) -> np.ndarray:
            fold, row, index, count = _rows_of(batch)
            truth = np.array([place[x] for x in batch.column("label").to_pylist()], dtype=np.int64)
            out = np.zeros((folds * len(classes) * (buckets + 1) + 1,))
            slopes = out[:-1].reshape(shape)
            for f in range(folds):
                x = _weighted(row, index, count, idf[f], len(batch))
                chance = _chances(row, index, x, weights[f], len(batch))
                used = (fold != f).astype(np.float64)
                out[-1] -= used @ np.log(np.maximum(chance[np.arange(len(batch)), truth], 1e-300))
                chance[np.arange(len(batch)), truth] -= 1
                chance *= used[:, None]
                for c in range(len(classes)):
                    slopes[f, c, :-1] += np.bincount(index, x * chance[row, c], minlength=buckets)
                    slopes[f, c, -1] += chance[:, c].sum()
            return out

        total = _summed(data, tasks, (int(np.prod(shape)) + 1,), add)
        # a ridge of weight 1, but for intercepts
        inner = weights.copy()
        inner[:, :, -1] = 0
        return (total[-1] + (inner**2).sum() / 2) / n, (total[:-1] + inner.ravel()) / n

    weights = minimize(evaluate, np.zeros(int(np.prod(shape))), passes).reshape(shape)

    def hits(batch: pa.RecordBatch) -> np.ndarray:
        fold, row, index, count = _rows_of(batch)
        truth = np.array([place[x] for x in batch.column("label").to_pylist()], dtype=np.int64)
        out = np.zeros((folds, 2))
        for f in range(folds):
            guess = _chances(row, index, _weighted(row, index, count, idf[f], len(batch)), weights[f], len(batch)).argmax(axis=1)
            out[f] = ((guess == truth) & (fold == f)).sum(), (fold == f).sum()
        return out

    right = _summed(data, tasks, (folds, 2), hits)
    return float(np.mean(right[:, 0] / right[:, 1]))
