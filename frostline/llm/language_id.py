"""Language ID with hyperdimensional profiles.

Every letter has a fixed pseudo-random vector of +1 and -1. A letter trigram is the product (binding) of its
letters' vectors, rotated (permuted) by two places, one and none. A text is the sum (bundle) of its trigrams;
a language is the bundle of its texts, each of length one. A text's language is that of the largest cosine.

Letters are lower-cased code points; everything else between words is one symbol. Prototypes are sums over
documents with a language outside the held-out fold, at most about ``max_rows`` (a hash of the id picks), added
up by Spark for each language and dimension; only (languages x dimensions) numbers reach the driver.

A text of more than ``_POINTS`` code points is bundled in parts, with the same sum. Null text, or text without a letter: ``und`` with score 0; so is everything where no language can be learnt.
Equal cosines: the first language in order of name. Null ids are predicted and never learnt from. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, mix64, read
from .quality import held_out

DIMENSIONS = 1024
MAX_ROWS = 50_000
UNKNOWN = "und"
#: Texts bundled by one matrix product, code points looked at together, distinct trigrams multiplied at a time.
_ROWS, _POINTS, _SLICE = 128, 1 << 19, 4096


@cache
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, or 0."""
    out = np.zeros(0x110000, dtype=np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letter_vectors(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """Rows of +1 and -1, the same for a letter wherever it is made."""
    seed = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dimensions // 64, dtype=np.uint64)
    bits = np.unpackbits(mix64(mix64(seed + np.uint64(1))).view(np.uint8), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and (i - first >= _ROWS or size + len(t or "") > _POINTS):
            yield first, [x or "" for x in texts[first:i]]
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, [x or "" for x in texts[first:]]


def _grams(letter: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters, texts) of all trigrams around a letter: rows of three letters, 0 standing for what is between words."""
    whole = (doc[2:] == doc[:-2]) & (letter[1:-1] > 0)
    return np.stack([letter[:-2][whole], letter[1:-1][whole], letter[2:][whole]], axis=1), doc[2:][whole]


def _add_bundles(out: np.ndarray, grams: np.ndarray, doc: np.ndarray) -> None:
    """Adds the vectors of trigrams to the rows of their texts, a bounded number of distinct trigrams at a time."""
    if not len(grams):
        return
    code = grams[:, 0].astype(np.int64) << 42 | grams[:, 1].astype(np.int64) << 21 | grams[:, 2]
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    edge = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    each = np.append(edge, len(code))
    dimensions = out.shape[1]
    for lo in range(0, len(edge), _SLICE):
        hi = min(lo + _SLICE, len(edge))
        a, b = each[lo], each[hi]
        name = code[edge[lo:hi]]
        vector = None
        for place, turn in ((42, 2), (21, 1), (0, 0)):
            letters, at = np.unique(name >> place & 0x1FFFFF, return_inverse=True)
            v = letter_vectors(np.where(letters == 0, 0x20, letters), dimensions)
            v = np.roll(v, turn, axis=1)[at] if turn else v[at]
            vector = v if vector is None else vector * v
        at = np.repeat(np.arange(hi - lo), np.diff(each[lo : hi + 1]))
        counts = np.bincount(doc[a:b] * (hi - lo) + at, minlength=len(out) * (hi - lo)).reshape(len(out), hi - lo)
        some = np.flatnonzero(counts.any(axis=1))
        out[some] += counts[some].astype(np.float32) @ vector.astype(np.float32)


def _long_bundle(text: str, out: np.ndarray) -> bool:
    """Adds up the bundle of one long text in parts, each beginning with the last two letters of the one before."""
    known, carry = False, np.zeros(0, dtype=np.int32)
    for at in range(0, len(text) + 1, _POINTS):
        last = at + _POINTS > len(text)
        part = (" " if not at else "") + text[at : at + _POINTS] + (" " if last else "")
        letter = _letters()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        known |= bool((letter > 0).any())
        before = np.append(carry[-1:] if len(carry) else [1], letter[:-1])
        letter = np.concatenate([carry, letter[(letter > 0) | (before > 0)]])
        _add_bundles(out, *_grams(letter, np.zeros(len(letter), dtype=np.int64)))
        carry = letter[-2:]
        if last:
            break
    return known


def bundles(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """A row of length one for each text (of zeros where it has no letter), and whether it has a letter.

    Memory is bounded by ``_POINTS``, ``_ROWS`` and ``_SLICE``, whatever letters there are and however long a text is.
    """
    out = np.zeros((len(texts), dimensions))
    if len(texts) == 1 and len(texts[0]) > _POINTS:
        known = np.array([_long_bundle(texts[0], out)])
    else:
        sizes = np.array([len(t) + 2 for t in texts])
        points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[points]
        doc = np.repeat(np.arange(len(texts)), sizes)
        known = np.bincount(doc[letter > 0], minlength=len(texts)) > 0
        kept = np.ones(len(letter), dtype=bool)
        kept[1:] = (letter[1:] > 0) | (letter[:-1] > 0) | (doc[1:] != doc[:-1])
        _add_bundles(out, *_grams(letter[kept], doc[kept]))
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return (out / np.where(size > 0, size, 1)).astype(np.float32), known


def _learn(dimensions: int):
    schema = pa.schema([("lang", pa.string()), ("sums", pa.list_(pa.float64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for at, part in _groups(texts):
                rows, _ = bundles(part, dimensions)
                for i, row in enumerate(rows):
                    if (lang := langs[at + i]) in sums:
                        sums[lang] += row
                    else:
                        sums[lang] = row.astype(np.float64)
        yield arrow_batch(schema, [list(sums), [x.tolist() for x in sums.values()]])

    return scan


def learn_languages(docs: DataFrame, max_rows: int = MAX_ROWS, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Names of languages and their prototypes, a row of length one for each."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(n)) < max_rows)
    parts = known.select("lang", "text").mapInArrow(_learn(dimensions), "lang string, sums array<double>")
    sums = parts.select("lang", F.posexplode("sums").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).collect()
    names = sorted({r["lang"] for r in sums})
    table = np.zeros((len(names), dimensions))
    for r in sums:
        table[names.index(r["lang"]), r["at"]] = r["x"]
    size = np.sqrt((table**2).sum(axis=1, keepdims=True))
    return names, (table / np.where(size > 0, size, 1)).astype(np.float32)


def _predict(names: list[str], table: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, part in _groups(texts):
                rows, known = bundles(part, table.shape[1])
                if not names:
                    known[:] = False
                cosine = rows @ table.T if names else np.zeros((len(part), 1))
                best = cosine.argmax(axis=1)
                score = np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0.0)
                yield arrow_batch(schema, [ids.slice(at, len(part)), [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score.astype(np.float64)])

    return scan


def identify_languages(docs: DataFrame, max_rows: int = MAX_ROWS, dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "lang")
    names, table = learn_languages(docs, max_rows, dimensions)
    return docs.select("doc_id", "text").mapInArrow(_predict(names, table), "doc_id long, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(read(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
