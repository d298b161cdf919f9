"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Kinds of spans, in their listed order (offsets are code points, the end is exclusive):

* ``assign``, ``access``, ``hex``: the base patterns below.
* ``random``: a run of 20 or more characters of [A-Za-z0-9+/_=-] that a byte-pair vocabulary can't
  compress: few characters per token. Left out beforehand: numbers, known digests (a hexadecimal run of
  a digest's length, a UUID) and identifiers (parts between separators that are letters and up to four digits,
  or digits, and whose words, split by case, the vocabulary compresses). Runs of letters alone are tested too.

Texts are screened on whole Arrow batches first, and only the few with a hit are matched with patterns.
Null text counts as empty and has no spans. Every row comes back, rows with a null or repeated id
included; other columns are dropped by ``scan_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, binary, chunks, read

KINDS = ("assign", "access", "hex", "random")
#: Characters per token at or under which a run counts as random.
MAX_CHARS_PER_TOKEN = 2.2
MIN_RANDOM = 20
MASK = "[secret]"

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})\Z|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_SEPARATORS = re.compile(r"[+/_=-]+")
_PART = re.compile(r"([A-Za-z]*)[0-9]{0,4}\Z|[0-9]+\Z")
_CASED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Parts of fewer letters are too short to tell words from random letters.
_TELLING = 4

_RUN_BYTES = np.zeros(256, dtype=bool)
_RUN_BYTES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_DIGIT_BYTES = np.zeros(256, dtype=bool)
_DIGIT_BYTES[48:58] = True

_SPANS = "array<struct<kind:string,start:int,end:int>>"
_OUT = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _identifier(run: str, vocabulary: str, most: float) -> bool:
    """Whether all parts look like words of a name: letters that split by case into words of few tokens."""
    parts = [_PART.match(p) for p in _SEPARATORS.split(run)]
    if not all(parts):
        return False
    words = [w for p in parts if len(p[1] or "") >= _TELLING for w in _CASED.findall(p[1])]
    encode = encoding(vocabulary).encode_ordinary
    return sum(map(len, words)) > most * sum(len(encode(w)) for w in words) or not words


def is_random(run: str, vocabulary: str, most: float = MAX_CHARS_PER_TOKEN) -> bool:
    if not any(c.isalpha() for c in run):
        return False
    if _DIGEST.match(run) or _identifier(run, vocabulary, most):
        return False
    return len(run) <= most * len(encoding(vocabulary).encode_ordinary(run))


def _screen(texts: list[bytes]) -> np.ndarray:
    """Which texts can have a span at all: a key word, AKIA, or a long run with a digit or of hex digits."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    base = np.cumsum(lengths) - lengths
    inside = _RUN_BYTES[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    long = end - start >= MIN_RANDOM
    out = np.zeros(len(texts), dtype=bool)
    out[np.searchsorted(base, start[long], side="right") - 1] = True
    for i, t in enumerate(texts):
        if not out[i]:
            low = t.lower()
            out[i] = b"AKIA" in t or any(w in low for w in _WORDS)
    return out


def spans_of(text: str, vocabulary: str, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    found += [("random", m.start(), m.end()) for m in _RUN.finditer(text) if is_random(m[0], vocabulary, most)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(vocabulary: str, most: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(binary(batch.column(1))):
                hit = _screen(texts)
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t.decode(), vocabulary, most)] if x else [] for t, x in zip(texts, hit, strict=True)]
                yield arrow_batch(_OUT, [batch.column(0).slice(at, len(texts)), spans])

    return scan


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """(doc_id, spans) of every row, spans by start and then by kind."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_scan(vocabulary or default_vocabulary(), max_chars_per_token), f"doc_id long, spans {_SPANS}")


def masked(text: str, spans: list[tuple[str, int, int]], mask: str = MASK) -> str:
    out, at = [], 0
    for _, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def _redact(vocabulary: str, most: float, mask: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = batch.column(k).to_pylist()
            changed = False
            for at, part in chunks([(t or "").encode() for t in texts]):
                for i in np.flatnonzero(_screen(part)):
                    t = texts[at + i]
                    if t is not None and (found := spans_of(t, vocabulary, most)):
                        texts[at + i], changed = masked(t, found, mask), True
            if changed:
                batch = batch.set_column(k, batch.schema.field(k), pa.array(texts, type=batch.schema.field(k).type))
            yield batch

    return scan


def redact_secrets(docs: DataFrame, vocabulary: str | None = None, max_chars_per_token: float = MAX_CHARS_PER_TOKEN, mask: str = MASK) -> DataFrame:
    """The same rows and columns, every found span of ``text`` replaced by ``mask``."""
    return docs.mapInArrow(_redact(vocabulary or default_vocabulary(), max_chars_per_token, mask), docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    told = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select(
        "doc_id",
        *(count(k) for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, told), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", told), ",").alias("spans"),
        count("random"),
    )
