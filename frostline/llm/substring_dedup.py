"""Substring dedup: suffix automata over reference passages, documents streamed for matching statistics.

A passage is removed from a document when a window of ``length`` consecutive words also starts in a
document with a smaller id. Steps, all joins and group-bys in Spark:

1. Every window of a document picks one of its short word grams, the one of least hash. A pick depends on
   the window's words alone, so equal windows pick equal grams. Consecutive windows with one pick form a
   *run*; only its hash travels (about one row for 22 words).
2. Runs whose pick occurs in two documents or more stay. Runs of equal words fold into their first
   occurrence. Where one pick has runs that differ, their windows are compared singly.
3. Each document thereby gets its *reference shard*: the passages, taken from documents with smaller ids,
   that hold its repeated windows. The whole reference grows with the corpus, so it is not broadcast:
   every shard travels by a join to the one document that needs it and is bounded by that document.
4. A task builds the suffix automaton of the shard and streams the document through it. Each word's
   matching statistic (length of the longest suffix that occurs in the shard) of ``length`` or more marks
   the maximal span to remove. Hash collisions can therefore remove nothing wrongly.

A pick, window or passage that very many documents share is dealt over several tasks of its joins.

Null text: no words. Null id: the row is returned whole and is nobody's reference. Documents under
``length`` words lose nothing. Rows with equal ids do not remove each other's text. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Words, arrow_batch, binary, chunks, gram_hashes, materialize, mix64, read, signed

LENGTH = 50
GRAM = 8
#: A key with more than this part of a join's rows is dealt over several tasks; fewer than so many keys can have it.
SPLIT = 1000

_RUNS = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("cs", pa.int32()), ("ce", pa.int32())])
_WINDOWS = pa.schema([("wh", pa.int64()), ("o", pa.int64()), ("cs", pa.int32()), ("ce", pa.int32())])
_KEPT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_text", pa.large_string()),
        ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)
_KEPT_DDL = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"


class SuffixAutomaton:
    """The automaton of all substrings of some word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0
        self._separators = 0

    def add_sequence(self, words: list[bytes]) -> None:
        for w in words:
            self._extend(w)
        self._separators += 1
        self._extend(self._separators)  # a number is no word, so no match runs across

    def _extend(self, word) -> None:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = clone
                    p = link[p]
                link[q] = link[new] = clone
        self.last = new

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal word spans that windows of ``least`` words found in the automaton cover."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out: list[tuple[int, int]] = []
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            if matched >= least:
                a = i + 1 - least
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((a, i + 1))
        return out


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of values[p : p + width] for each p, the leftmost of equal ones."""
    n = len(values) - width + 1
    index = np.arange(len(values), dtype=np.int64)
    size = 1
    while size * 2 <= width:
        a, b = index[:-size], index[size:]
        index = np.where(values[b] < values[a], b, a)
        size *= 2
    a, b = index[:n], index[width - size : width - size + n]
    return np.where(values[b] < values[a], b, a)


def _code_points(w: Words) -> np.ndarray:
    """For each byte of the joined texts, how many code points begin before it."""
    begins = (w.raw & 0xC0) != 0x80
    out = np.zeros(len(begins) + 1, dtype=np.int64)
    np.cumsum(begins, out=out[1:])
    return out


def _runs(length: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, texts in chunks(binary(batch.column(1))):
                w = Words(texts)
                if len(w.doc) < length:
                    continue
                h = w.hashes()
                g = gram_hashes(h, gram)
                pick = _sliding_argmin(g, length - gram + 1)
                whole = w.doc[: len(pick)] == w.doc[length - 1 :]
                start = np.flatnonzero(whole)
                if not len(start):
                    continue
                p = pick[start]
                new = np.concatenate([[True], (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1) | (w.doc[start[1:]] != w.doc[start[:-1]])])
                lo = start[new]
                n = np.diff(np.concatenate([np.flatnonzero(new), [len(start)]]))
                end = lo + n + length - 1
                content = _content(h, lo, end)
                cp = _code_points(w)
                of = w.doc[lo]
                base = cp[w.base[of]]
                yield arrow_batch(_RUNS, [signed(g[pick[lo]]), signed(content), ids[at + of], (cp[w.start[lo]] - base).astype(np.int32), (cp[w.end[end - 1]] - base).astype(np.int32)])

    return scan


def _content(h: np.ndarray, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
    from .common import _QINV, _QW

    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix64(h) * _QW.upto(len(h)), out=total[1:])
    return mix64((total[end] - total[lo]) * _QINV.upto(len(h))[lo] + (end - lo).astype(np.uint64))


def _single_windows(length: int):
    """Windows of the passages that lie in runs whose pick has other runs, too."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = batch.column("o").to_numpy(zero_copy_only=False)
            begin = batch.column("s").to_numpy(zero_copy_only=False)
            spans = batch.column("mixed").to_pylist()
            for at, texts in chunks(binary(batch.column("seg"))):
                w = Words(texts)
                if len(w.doc) < length:
                    continue
                g = gram_hashes(w.hashes(), length)
                cp = _code_points(w)
                for i in range(len(texts)):
                    a, b = w.first[i], w.first[i + 1] - length + 1
                    mine = sorted((x["cs"], x["ce"]) for x in spans[at + i] or ())
                    if b <= a or not mine:
                        continue
                    cs = cp[w.start[a:b]] - cp[w.base[i]] + begin[at + i]
                    ce = cp[w.end[a + length - 1 : b + length - 1]] - cp[w.base[i]] + begin[at + i]
                    lo, hi = np.array([x[0] for x in mine]), np.array([x[1] for x in mine])
                    k = np.searchsorted(lo, cs, side="right") - 1
                    inside = (k >= 0) & (ce <= hi[k])
                    if inside.any():
                        n = int(inside.sum())
                        yield arrow_batch(_WINDOWS, [signed(g[a:b][inside]), np.full(n, owner[at + i]), cs[inside].astype(np.int32), ce[inside].astype(np.int32)])

    return scan


def _stream(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shards, texts = batch.column(0), batch.column(2), binary(batch.column(1))
            out: list[list] = [[], [], [], [], []]
            size = 0
            for i, text in enumerate(texts):
                words = text.split()
                spans: list[tuple[int, int]] = []
                shard = shards[i].as_py()
                kept = words
                if shard:
                    automaton = SuffixAutomaton()
                    for segment in shard:
                        automaton.add_sequence(segment.encode().split())
                    spans = automaton.spans(words, length)
                    kept, at = [], 0
                    for a, b in spans:
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                joined = b" ".join(kept)
                size += len(joined)
                for column, value in zip(out, (ids[i].as_py(), len(words), len(words) - len(kept), joined.decode(), [{"start": a, "end": b} for a, b in spans]), strict=True):
                    column.append(value)
                if size > 8 * CHUNK_BYTES:
                    yield arrow_batch(_KEPT, out)
                    out, size = [[], [], [], [], []], 0
            if out[0]:
                yield arrow_batch(_KEPT, out)

    return scan


def _merged(df: DataFrame, key: list[str], *extra) -> DataFrame:
    """Intervals (cs, ce) of a key that overlap become one (s, e). A key's intervals are bounded by one text."""
    w = Window.partitionBy(*key).orderBy("cs", "ce")
    before = F.max("ce").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col("cs") > before), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("island", island).groupBy(*key, "island").agg(F.min("cs").alias("s"), F.max("ce").alias("e"), *extra).drop("island")


def _dealt_join(rows: DataFrame, keys: DataFrame, on: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keys``, hot keys dealt over several tasks. counts: written (*on, n), the rows of each key.

    Fewer than ``SPLIT`` keys can be hot, so their list is broadcast at any size; what ``keys`` holds for them is repeated."""
    share = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // SPLIT)
    hot = F.broadcast(counts.where(F.col("n") > share).select(*on, F.ceil(F.col("n") / share).alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    salted = rows.join(hot, on, "left").withColumn("salt", F.pmod(F.xxhash64(*rows.columns), parts)).drop("parts")
    repeated = keys.join(hot, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return salted.join(repeated, [*on, "salt"], how).drop("salt")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed): removed holds the word spans taken out."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    runs = docs.where("doc_id is not null and text is not null").mapInArrow(_runs(length, gram), "h long, c long, doc_id long, cs int, ce int")

    picks = runs.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    picks = materialize(picks.select("h", "n"), "substring-picks")
    runs = materialize(_dealt_join(runs, picks.select("h"), ["h"], picks), "substring-runs")

    first = runs.groupBy("h", "c").agg(F.min(F.struct("doc_id", "cs", "ce")).alias("f"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    first = materialize(first.select("h", "c", F.col("f.doc_id").alias("o"), "f.cs", "f.ce", "last", "n"), "substring-first")
    several = materialize(first.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "substring-several")
    marked = several.select("h", F.lit(True).alias("mixed"))
    reference = _dealt_join(first.drop("n"), marked, ["h"], several, "left").where("mixed or last > o")
    span = F.when(F.col("mixed"), F.struct("cs", "ce"))
    islands = _merged(reference, ["o"], F.collect_list(span).alias("mixed"))
    text = docs.select(F.col("doc_id").alias("o"), "text")
    cut = F.expr("substring(text, s + 1, e - s)")
    passages = materialize(islands.join(text, "o").select("o", "s", "e", "mixed", cut.alias("seg")), "substring-passages")

    windows = passages.where("size(mixed) > 0").mapInArrow(_single_windows(length), "wh long, o long, cs int, ce int")
    windows = materialize(windows, "substring-windows")
    owners = windows.groupBy("wh").agg(F.min(F.struct("o", "cs", "ce")).alias("f"), F.max("o").alias("last"), F.count("*").alias("n")).where("f.o < last")
    owners = materialize(owners.select("wh", F.col("f.o").alias("o"), "f.cs", "f.ce", "n"), "substring-owners")
    repeats = _dealt_join(windows.select("wh", F.col("o").alias("doc_id")), owners.drop("n"), ["wh"], owners.select("wh", "n"))
    single = repeats.where("doc_id > o").select("doc_id", "o", "cs", "ce")
    again = first.where("last > o")
    copies = _dealt_join(runs.select("h", "c", "doc_id"), again.select("h", "c", "o", "cs", "ce"), ["h", "c"], again.select("h", "c", "n"))
    copied = copies.where("doc_id > o").select("doc_id", "o", "cs", "ce")
    wanted = materialize(_merged(single.union(copied), ["doc_id", "o"]), "substring-wanted")

    p = passages.select("o", F.col("s").alias("ps"), F.col("e").alias("pe"), "seg")
    readers = materialize(wanted.groupBy("o").agg(F.count("*").alias("n")), "substring-readers")
    found = _dealt_join(wanted, p, ["o"], readers).where("s >= ps and e <= pe").select("doc_id", F.expr("substring(seg, s - ps + 1, e - s)").alias("seg"))
    shards = materialize(found.groupBy("doc_id").agg(F.collect_set("seg").alias("shard")), "substring-shards")
    return docs.join(shards, "doc_id", "left").select("doc_id", "text", "shard").mapInArrow(_stream(length), _KEPT_DDL)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("removed")
    return kept.select("doc_id", "n_words", "n_removed", digest, spans)
