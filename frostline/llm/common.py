"""Shared pieces of the corpus operators: reading, scratch tables, vectorised words, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of the text bytes that a vectorised step looks at together (a longer text stands alone).
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. Where none is set, a temporary one in local mode; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='checkpoints-')}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/frostline/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of up to so many narrow rows (some tens of MB) may be broadcast; beyond it joins shuffle both sides.
BROADCAST_ROWS = 300_000


def small(df: DataFrame) -> DataFrame:
    """Marks a written table of a few narrow columns for a broadcast, if a count of its rows allows that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def scan_partitions(df: DataFrame) -> int:
    """How many partitions the plan of ``df`` has; no job runs."""
    return max(1, df.rdd.getNumPartitions())


def binary(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``most`` bytes together: (index of the first, texts)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2**64, as far as they have been asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.known = base & _MASK, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = np.uint64(pow(self.base, len(self.known), 1 << 64))
            self.known = np.concatenate([self.known, self.known * step])
        return self.known[:n]


_PW, _PINV = _Powers(_P), _Powers(pow(_P, -1, 1 << 64))
_QW, _QINV = _Powers(_Q), _Powers(pow(_Q, -1, 1 << 64))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of some bytes."""
    n = len(raw)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _PW.upto(n), out=total[1:])
    plain = (total[end] - total[start]) * _PINV.upto(n)[start] if len(start) else np.zeros(0, dtype=np.uint64)
    return mix64(plain + (end - start).astype(np.uint64) * np.uint64(_Q))


class Words:
    """The words (runs of bytes other than 0x20 and 0x09-0x0D) of some texts, as arrays over all of them.

    doc: index of each word's text; start, end: its bytes in ``joined``; base: where each text begins there.
    """

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        self.joined = b" ".join(texts) + b" "
        raw = np.frombuffer(self.joined, dtype=np.uint8)
        self.raw = _LOWER[raw] if lower else raw
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.base = np.cumsum(lengths) - lengths
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(raw) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.base, self.start, side="right") - 1
        #: index of each text's first word, and one more entry for the end
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.raw, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every k consecutive entries (k may not exceed their number)."""
    n = len(words)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * _QW.upto(n), out=total[1:])
    return mix64((total[k:] - total[:-k]) * _QINV.upto(n)[: n - k + 1] + np.uint64((salt + k) * 0x632BE59BD9B4E019 & _MASK))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node of an edge table (a, b): component is the least node that links reach.

    Alternates large-star and small-star contraction, each a group-by and a join over the edges, until
    nothing changes; each round is written to the shared folder, and only counts reach the driver.
    A node with very many edges is no group of its own: minima are combined before each shuffle.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    now = materialize(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-edges")
    before = None
    while True:
        # large star: neighbours above a node go to the least of its neighbourhood
        out = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = out.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        least = materialize(least, f"{label}-least")
        large = out.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, f"{label}-large")
        # small star: neighbours at or below a node go to the least of them
        lower = materialize(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-lower")
        small = large.join(lower, "a")
        now = materialize(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{label}-small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()


def arrow_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def new_temp_file(prefix: str) -> tempfile._TemporaryFileWrapper:
    return tempfile.NamedTemporaryFile(prefix=prefix, delete=True)
