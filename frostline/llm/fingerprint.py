"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, these into longer phrases, and so on. At each level runs of one symbol
become one symbol; deterministic coin tossing then labels every symbol by the lowest bit in which it differs
from the one before, until few labels remain, and phrases begin at local maxima of the labels. A phrase's
borders depend on a few symbols around them alone, so equal substrings get equal interior phrases wherever they
stand. A phrase is named by a hash of its symbols. The fingerprint is the ``SIZE`` least 32-bit names of
phrases of levels 2 and 3 (level 1, too, for texts of under 16 such phrases), as hexadecimal text.

For comparison with edited texts and neighbours, documents are cut into ranges of ids at quantiles; the first
document of each range travels to the range before it as well, so that no single task orders all.

Null text counts as empty: its fingerprint is the empty string. Two empty fingerprints have likeness 1. A null
id comes before all others; rows of one id are ordered by text. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _QINV, _QW, CHUNK_BYTES, arrow_batch, binary, chunks, mix64, read

SIZE = 64
LEVELS = 3
#: Bytes of text in a range of ids, and the most ranges.
RANGE_BYTES, MOST_RANGES = 6 << 20, 10_000
#: Bytes of text parsed together: arrays of this size stay in a core's cache. It has no bearing on the result.
PARSED_BYTES = 1 << 17


def _toss(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels from the lowest bit in which a symbol differs from the one before it: twice its place, plus its value."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[starts] = x[starts] ^ x.dtype.type(1)
    differs = x ^ before
    low = differs & (~differs + x.dtype.type(1))
    place = (np.frexp(low.astype(np.float64))[1] - 1).astype(np.uint8)
    place[differs == 0] = 0
    return place * np.uint8(2) + ((x >> place.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)


def _small_toss() -> np.ndarray:
    """The same for labels of up to 8 bits, as a table of (label, label before)."""
    out = np.zeros((256, 256), dtype=np.uint8)
    values = np.arange(256, dtype=np.uint8)
    for before in range(256):
        differs = values ^ np.uint8(before)
        place = np.array([(int(d) & -int(d)).bit_length() - 1 if d else 0 for d in differs], dtype=np.uint8)
        out[:, before] = place * 2 + ((values >> place) & 1)
    return out


_TABLE = _small_toss().reshape(-1)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))


def _toss_small(label: np.ndarray, starts: np.ndarray) -> np.ndarray:
    index = label.astype(np.uint16) << np.uint16(8)
    index[1:] |= label[:-1]
    index[starts] = label[starts].astype(np.uint16) << np.uint16(8) | label[starts] ^ np.uint8(1)
    return _TABLE[index]


def _phrases(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the names of phrases and the text each is of. Nothing looks beyond the ends of a text."""
    first = np.empty(len(symbols), dtype=bool)
    first[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=first[1:])
    first[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(first)
    run = np.diff(np.append(at, len(symbols)))
    symbols, doc = symbols[at], doc[at]
    longer = np.flatnonzero(run > 1)
    new = np.append(True, doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    # runs are named by symbol and length; of bytes, single ones by a table
    wide = symbols[longer].astype(np.uint64) + np.uint64(1)
    wide = mix64(wide ^ mix64(run[longer].astype(np.uint64)))
    if symbols.dtype == np.uint8:
        # runs differ from single symbols by the top bit or another low bit of their label
        small = symbols.copy()
        small[longer] ^= (np.minimum(run[longer], 127) & 0x7F).astype(np.uint8) ^ np.uint8(128)
        label = _toss_small(small, starts)
        name = _BYTES[symbols]
        name[longer] = mix64(wide)
    else:
        name = symbols + np.uint64(1)
        name[longer] = wide
        label = _toss(name, starts)
        name = mix64(name)
    for _ in range(3):
        label = _toss_small(label, starts)
    top = np.empty(len(label), dtype=bool)
    top[0] = True
    np.greater(label[1:], label[:-1], out=top[1:])
    top[:-1] &= label[:-1] >= label[1:]
    # the last symbol of a text begins no phrase, the first one always does
    top[starts - 1] = False
    top[starts] = True
    begin = np.flatnonzero(top)
    end = np.append(begin[1:], len(name))
    total = np.zeros(len(name) + 1, dtype=np.uint64)
    np.cumsum(name * _QW.upto(len(name)), out=total[1:])
    return mix64((total[end] - total[begin]) * _QINV.upto(len(name))[begin] + (end - begin).astype(np.uint64)), doc[begin]


def phrase_levels(texts: list[bytes], levels: int = LEVELS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level: the names of all phrases in order and the text each is of."""
    symbols = np.frombuffer(b"".join(texts), dtype=np.uint8)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    out = []
    for _ in range(levels):
        if len(symbols):
            symbols, doc = _phrases(symbols, doc)
        else:
            symbols, doc = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        out.append((symbols, doc))
    return out


def fingerprints(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """The least distinct 32-bit phrase names of each text, ascending."""
    out: list[np.ndarray] = []
    for _, part in chunks(texts, PARSED_BYTES):
        rows = phrase_levels(part)[1:]
        key = np.sort(np.concatenate([d.astype(np.uint64) << np.uint64(32) | x >> np.uint64(32) for x, d in rows]))
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        edge = np.searchsorted(key, np.arange(len(part) + 1, dtype=np.uint64) << np.uint64(32))
        low = (key & np.uint64(0xFFFFFFFF)).astype(">u4")
        out += [low[a : min(b, a + size)] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The share of names common to both among the least names of both together: an estimate of their sets' Jaccard similarity."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, np.intersect1d(a, b)).mean())


def fingerprint_documents(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield arrow_batch(schema, [batch.column(0), [x.tobytes().hex() for x in fingerprints(binary(batch.column(1)), size)]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, fingerprint string")


_COMPARED = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_COMPARED_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _compare(size: int):
    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows but for the last, each with the one after it in its range."""
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[2] and a[3] == b[3]]
        if not pairs:
            return
        prints = fingerprints([r[1].encode() for r in rows], size)
        of = {id(r): p for r, p in zip(rows, prints, strict=True)}
        edited = [edited_text(a[1], b[1]).encode() for a, b in pairs]
        changed = fingerprints(edited, size)
        own, after = [of[id(a)] for a, _ in pairs], [of[id(b)] for _, b in pairs]
        yield arrow_batch(
            _COMPARED,
            [
                [a[0] for a, _ in pairs],
                [len(a[1]) for a, _ in pairs],
                [hashlib.sha256(e).hexdigest() for e in edited],
                [x.tobytes().hex() for x in own],
                [x.tobytes().hex() for x in changed],
                [likeness(x, y, size) for x, y in zip(own, changed, strict=True)],
                [likeness(x, y, size) for x, y in zip(own, after, strict=True)],
            ],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        weight = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "extra", "bucket")), strict=True):
                rows.append(row)
                weight += len(row[1])
                if weight > CHUNK_BYTES:
                    yield from flush(rows)
                    rows, weight = rows[-1:], 0
        yield from flush(rows)

    return scan


def compare_with_edits(docs: DataFrame, size: int = SIZE, ranges: int | None = None) -> DataFrame:
    """Every row's fingerprint beside those of its edited text and of the next document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    n, total = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    ranges = ranges or min(MOST_RANGES, max(4, (total or 0) // RANGE_BYTES))
    # a long text counts as often as it has the mean length
    weight = F.ceil((F.octet_length("text") + 1) * F.lit((n or 1) / ((total or 0) + (n or 1)))).cast("int")
    weighed = rows.select("key", F.explode(F.array_repeat(F.lit(0), weight)))
    cuts = sorted(set(weighed.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges)).first()[0] or []))

    @F.pandas_udf("int")
    def bucket(key):
        import pandas as pd

        return pd.Series(np.searchsorted(np.array(cuts, dtype=np.int64), key.to_numpy(), side="left").astype(np.int32))

    # the least key of each range: as many rows as ranges
    heads = sorted((r["bucket"], r["key"]) for r in rows.select("key", bucket("key").alias("bucket")).groupBy("bucket").agg(F.min("key").alias("key")).collect())
    before = [(key, heads[i - 1][0]) for i, (_, key) in enumerate(heads)]
    spark = docs.sparkSession
    moved = spark.createDataFrame(before or [(0, 0)], "key long, to int").where(F.lit(bool(before)))
    own = rows.withColumn("bucket", bucket("key")).withColumn("extra", F.lit(False))
    extra = rows.join(F.broadcast(moved), "key").select("doc_id", "text", "key", F.col("to").alias("bucket"), F.lit(True).alias("extra"))
    dealt = own.unionByName(extra).repartition(ranges, "bucket").sortWithinPartitions("bucket", "extra", "key", "text")
    return dealt.select("doc_id", "text", "extra", "bucket").mapInArrow(_compare(size), _COMPARED_DDL)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(read(spark, sf_dir, "documents"))
