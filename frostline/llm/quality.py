"""Quality classifier: support vectors on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators are a text's lower-cased words and pairs of words, hashed. Besides, each word has a shape (classes of its
first, second and last byte, its length, whether it repeats the word before); shape n-grams up to three words
are indicators too, and for single shapes also how large a share of the text they have. Each indicator is scaled by the log ratio of its smoothed counts in
good and bad texts; a linear hinge-loss model is then fitted by dual coordinate descent.

Learning uses the labelled rows outside the held-out fold, at most about ``max_labels`` of them (a hash of
the id picks). One task fits the one model to them, in order of id: that bound is also the bound of its memory. What reaches
the driver is one number a feature.

Null and empty texts have no shape and get the score of the bias. With no labels every score is 0.5. Null
ids are scored and never learnt from. Repeated rows are scored alike. ``score_quality`` drops other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, arrow_batch, binary, chunks, materialize, mix64, read

FEATURE_BITS = 18
MAX_LABELS = 20_000
THRESHOLD = 0.3
_COST, _EPOCHS = 1.0, 12

_CLASS = np.full(256, 1, dtype=np.uint64)  # other bytes, such as those of accented letters
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[33:48] = np.arange(5, 20)
_CLASS[58:65] = np.arange(20, 27)
_CLASS[91:97] = np.arange(27, 33)
_CLASS[123:127] = np.arange(33, 37)

_FEATURES = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.list_(pa.int32()))])
_FEATURES_DDL = "doc_id long, label int, features array<int>"


def features(texts: list[bytes], bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indicators of some texts: (index of the text, feature), sorted."""
    w = Words(texts)
    n = len(w.doc)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    size = np.minimum(w.end - w.start, 31).astype(np.uint64)
    kind = _CLASS[w.raw]
    second = kind[np.minimum(w.start + 1, w.end - 1)]
    h = w.hashes()
    same = np.zeros(n, dtype=np.uint64)
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    plain = kind[w.start] | second << np.uint64(6) | kind[w.end - 1] << np.uint64(12) | same << np.uint64(18)
    shape = mix64(plain + np.uint64(1))
    mask = np.uint64((1 << bits) - 1)
    at, found = [w.doc], [shape & mask]
    at.append(w.doc)
    found.append(mix64(plain | (size // np.uint64(3)) << np.uint64(20) | np.uint64(1 << 40)) & mask)
    # the words themselves and their pairs
    word = Words(texts, lower=True).hashes()
    at.append(w.doc)
    found.append(mix64(word + np.uint64(1 << 41)) & mask)
    if n > 1:
        pair = w.doc[1:] == w.doc[:-1]
        at.append(w.doc[1:][pair])
        found.append(mix64(word[:-1][pair] * np.uint64(31) + word[1:][pair]) & mask)
    gram = shape
    for k in (1, 2):
        if n > k:
            gram = mix64(gram[: n - k] * np.uint64(31) + shape[k:])
            whole = w.doc[k:] == w.doc[: n - k]
            at.append(w.doc[k:][whole])
            found.append(gram[whole] & mask)
    # shares of single shapes: at least 1/64, 1/32, ... 1/2 of the words
    key, count = np.unique(w.doc.astype(np.uint64) << np.uint64(32) | shape & np.uint64(0xFFFFFFFF), return_counts=True)
    doc = (key >> np.uint64(32)).astype(np.int64)
    share = count / w.counts()[doc]
    for level in range(1, 7):
        much = share >= 0.5**level
        at.append(doc[much])
        found.append(mix64((key[much] & np.uint64(0xFFFFFFFF)) + np.uint64(level << 50)) & mask)
    both = np.unique(np.concatenate(at).astype(np.int64) << bits | np.concatenate(found).astype(np.int64))
    return both >> bits, both & int(mask)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def _labelled(bits: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(binary(batch.column("text"))):
                doc, found = features(texts, bits)
                edge = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(found.astype(np.int32)))
                yield arrow_batch(_FEATURES, [batch.column("doc_id").slice(at, len(texts)), batch.column("label").slice(at, len(texts)), lists])

    return scan


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = _COST, epochs: int = _EPOCHS) -> np.ndarray:
    """Weights (the last one for the bias) of min |w|^2 / 2 + sum c max(0, 1 - y w x) for scaled unit-length rows."""
    w = np.zeros(len(scale) + 1)
    sizes = np.array([np.sqrt((scale[x] ** 2).sum()) for x in rows])
    squares = 1 + (sizes > 0)
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([(y < 0).sum(), (y > 0).sum()]) / max(len(y), 1)
    bound = np.where(y > 0, *(cost / np.maximum(2 * s, 1e-9) for s in (share[1], share[0])))
    alpha = np.zeros(len(rows))
    random = np.random.default_rng(7)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            x = rows[i]
            v = scale[x] / sizes[i] if sizes[i] > 0 else scale[x]
            gradient = y[i] * (w[x] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), bound[i])
            if new != alpha[i]:
                w[x] += (new - alpha[i]) * y[i] * v
                w[-1] += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, bits: int = FEATURE_BITS) -> np.ndarray | None:
    """Weights of all features and the bias; None where no row is labelled."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    n = known.count()
    if n > max_labels:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(n)) < max_labels)
    # at most about max_labels rows of 20 bytes, so the small side may be broadcast
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")
    rows = materialize(rows.mapInArrow(_labelled(bits), _FEATURES_DDL), "quality-rows")
    sums = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not sums[0] and not sums[1]:
        return None
    counts = rows.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).collect()
    p, q = np.ones(1 << bits), np.ones(1 << bits)
    for f, a, b in counts:
        p[f] += a
        q[f] += b
    scale = np.log(p / (sums[0] + 1)) - np.log(q / (sums[1] + 1))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, sets = [], [], []
        for batch in batches:
            lists = batch.column("features")
            offsets, found = lists.offsets.to_numpy(), lists.values.to_numpy().copy()
            sets += [found[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
            ids += batch.column("doc_id").to_pylist()
            labels += batch.column("label").to_pylist()
        order = np.lexsort(([len(x) for x in sets], ids))
        w = dual_coordinate_descent([sets[i] for i in order], np.array(labels)[order], scale)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["f", "w"])

    weights = np.zeros((1 << bits) + 1)
    spark, most = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    # rows are long: few of them at a time go to the task that fits
    spark.conf.set(most, "256")
    try:
        for f, w in rows.coalesce(1).mapInArrow(fit, "f long, w double").collect():
            weights[f] = w
    finally:
        spark.conf.set(most, before)
    return np.stack([np.append(scale, 1.0), weights])


def scores(texts: list[bytes], model: np.ndarray | None, bits: int = FEATURE_BITS) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    doc, found = features(texts, bits)
    scale, weight = model
    v = scale[found]
    margin = np.bincount(doc, v * weight[found], minlength=len(texts))
    size = np.sqrt(np.bincount(doc, v**2, minlength=len(texts)))
    return 1 / (1 + np.exp(-2 * (margin / np.where(size > 0, size, 1.0) + weight[-1])))


def _score(shared, bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(binary(batch.column(1))):
                yield arrow_batch(schema, [batch.column(0).slice(at, len(texts)), scores(texts, shared.value, bits)])

    return scan


def _keep(shared, least: float, bits: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column("text"))
            kept = np.concatenate([scores(part, shared.value, bits) >= least for _, part in chunks(texts)] or [np.zeros(0, dtype=bool)])
            yield batch.filter(pa.array(kept))

    return scan


def score_quality(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, score): score is from 0 to 1, higher for likelier good text."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, max_labels))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(model, FEATURE_BITS), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = THRESHOLD, max_labels: int = MAX_LABELS) -> DataFrame:
    """The same columns; documents that score under ``least`` go."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, max_labels))
    return docs.mapInArrow(_keep(model, least, FEATURE_BITS), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
