"""Best-fit packing of tokenised documents by a configuration linear program over the length histogram.

1. Documents become token ids and one end id. Those over ``capacity`` are cut into full pieces, the first of
   which takes what is left over. Only lengths, checksums and each task's own running numbers are kept.
2. The histogram of lengths (at most ``capacity`` numbers) reaches the driver. Its covering program over
   configurations (multisets of lengths that fit a sequence) is solved by multiplicative weights: a length's price
   is its volume, lessened exponentially with the share of its pieces covered so far; a knapsack by dynamic
   programming finds the configuration of the highest price, no length taken oftener than it has pieces left; the
   configuration is taken in a whole number of copies (half of what its scarcest length allows), which rounds the
   solution as it grows and never beyond the need. What is left after ``rounds`` prices, and configurations that
   fill little, are packed best-fit decreasing.
3. The plan has one row for each (configuration, place) with a range of sequences. Its size depends on the
   capacity and the rounds. The i-th piece of a length takes the i-th slot of it; i is the piece's number within its
   task plus the sum over earlier tasks, so no sort and no group of equal lengths is needed.

Null or empty text: the end id alone. Repeated rows and null ids are packed like others. Empty tables give no
rows. Other columns are dropped by ``pack_documents``.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batch, chunks, materialize, read, span_hashes
from .secret_scan import encoding

CAPACITY = 2048
END_ID = 0
#: The added token of the vocabulary's ``tokenizers`` file, which that emits wherever a text holds the literal.
ADDED, ADDED_ID = "<|endoftext|>", 50256
ROUNDS = 6000
#: Length classes of a knapsack (the best priced length of each is a candidate), steepness of prices, how much longer
#: pieces are worth more than their volume, and the least share of a sequence that a configuration fills.
CLASSES, STEEPNESS, LONGER, LEAST_FILL = 128, 4.0, 0.05, 0.9
#: Distinct chunks whose ids a task remembers; the memory is emptied beyond it.
_REMEMBERED = 400_000

_ADDED_BYTES = ADDED_ID.to_bytes(4, "little")
_OTHER_SPACE = re.compile(r"[^\S \n]")

_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")])
_PIECES_DDL = "doc_id long, piece long, start long, length long, ids_crc32 long, part long, nth long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, remembered for words seen before.

    A word with the blanks before it is encoded alone: the vocabulary's pre-tokeniser never joins a word with
    what follows. Texts with white space other than blank and newline are encoded whole. Texts are split at the
    added token, which stands for itself. ``vocabulary`` holds byte-pair ranks; the tests compare the ids with those
    of the ``tokenizers`` file of the same vocabulary. Words are remembered by a 64-bit hash.
    """

    def __init__(self, vocabulary: str) -> None:
        found = encoding(vocabulary)
        self.encode = found.encode_ordinary
        self.size = np.array([len(x) for x in found.decode_tokens_bytes(range(found.n_vocab))], dtype=np.int64)
        self.known: dict[int, bytes] = {}

    def _fresh(self, text: str) -> bytes:
        return np.asarray(self.encode(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        parts, of = [], []
        out: list[list[bytes]] = [[] for _ in texts]
        for i, text in enumerate(texts):
            for k, part in enumerate(text.split(ADDED) if ADDED in text else (text,)):
                if k:
                    out[i].append(_ADDED_BYTES)
                if _OTHER_SPACE.search(part):
                    out[i].append(self._fresh(part))
                elif part:
                    of.append((i, len(out[i])))
                    out[i].append(b"")
                    parts.append(part.encode())
        for at, some in chunks(parts):
            for (i, k), ids in zip(of[at:], self._plain(some), strict=False):
                out[i][k] = ids
        return [b"".join(x) for x in out]

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        joined = b"".join(texts)
        raw = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.array([len(t) for t in texts])
        blank = (raw == 32) | (raw == 10)
        begins = np.zeros(len(raw), dtype=bool)
        begins[1:] = blank[1:] & ~blank[:-1]
        begins[np.cumsum(sizes) - sizes] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(raw))
        names, first, which = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        keys = names.tolist()
        known = self.known
        if len(known) > _REMEMBERED:
            known.clear()
        new = [k for k, x in enumerate(keys) if x not in known]
        if new:
            self._learn([keys[k] for k in new], joined, start[first[new]], end[first[new]], blank)
        ids = [known[x] for x in keys]
        length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        begin = (np.cumsum(length) - length)[which]
        length = length[which]
        total = np.append(0, np.cumsum(length))
        every = flat[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        edge = total[np.searchsorted(start, np.append(np.cumsum(sizes) - sizes, len(raw)))]
        return [every[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def _learn(self, keys: list[int], joined: bytes, start: np.ndarray, end: np.ndarray, blank: np.ndarray) -> None:
        """Words with blanks before them are encoded as one text, and its ids told apart by their bytes."""
        whole = blank[start] & ~blank[end - 1]
        words = [joined[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        at = np.flatnonzero(whole)
        ids = np.asarray(self.encode(b"".join([words[i] for i in at]).decode()), dtype="<u4")
        edge = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum((end - start)[at]), side="left") + 1
        edge = np.append(0, edge)
        for i, a, b in zip(at.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            self.known[keys[i]] = ids[a:b].tobytes()
        for i in np.flatnonzero(~whole):
            self.known[keys[i]] = self._fresh(words[i].decode())


def _pieces(vocabulary: str, capacity: int, end_id: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        part = TaskContext.get().partitionId()
        number: dict[int, int] = defaultdict(int)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, found in zip(batch.column(0).to_pylist(), encoder.batch(texts), strict=True):
                ids = found + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    to = at + ((n - 1) % capacity + 1 if piece == 0 else capacity)
                    for column, value in zip(out, (doc_id, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to]), number[to - at]), strict=True):
                        column.append(value)
                    number[to - at] += 1
                    at, piece = to, piece + 1
            doc, piece, start, length, crc, nth = out
            yield arrow_batch(_PIECES, [doc, piece, start, length, crc, [part] * len(doc), nth])

    return scan


def tokenized_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_pieces(vocabulary or default_vocabulary(), capacity, end_id), _PIECES_DDL)


def best_configuration(price: np.ndarray, most: np.ndarray, capacity: int, classes: int = CLASSES) -> dict[int, int]:
    """The multiset of lengths of largest total price that fits, no length oftener than ``most``: a bounded knapsack.

    Of each class of neighbouring lengths only the one of the best price a token is a candidate.
    """
    lengths = np.flatnonzero((price > 0) & (most > 0))
    of = lengths * classes // (capacity + 1)
    order = np.lexsort((-price[lengths] / lengths, of))
    lengths, of = lengths[order], of[order]
    lengths = lengths[np.append(True, of[1:] != of[:-1])] if len(lengths) else lengths
    best = np.zeros(capacity + 1)
    taken = []
    for x in lengths.tolist():
        left, size = min(int(most[x]), capacity // x), 1
        while left > 0:  # bundles of 1, 2, 4, ... pieces
            use = min(size, left)
            gain = best[: -use * x] + price[x] * use
            better = gain > best[use * x :]
            np.copyto(best[use * x :], gain, where=better)
            taken.append((x, use, better))
            left, size = left - use, size * 2
    out: dict[int, int] = defaultdict(int)
    c = capacity
    for x, use, better in reversed(taken):
        if c >= use * x and better[c - use * x]:
            out[x] += use
            c -= use * x
    return dict(out)


def multiplicative_weights(need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[tuple, int]], np.ndarray]:
    """Configurations in whole numbers of copies that cover ``need`` (by length) nearly, and what is left of it."""
    left = need.astype(np.int64).copy()
    length = np.arange(capacity + 1)
    volume = length * (1 + LONGER * length / capacity)
    plan = []
    for _ in range(rounds):
        covered = 1 - left / np.maximum(need, 1)
        found = best_configuration(volume * np.exp(-STEEPNESS * covered), left, capacity)
        if sum(x * k for x, k in found.items()) < LEAST_FILL * capacity:
            break
        times = max(1, min(int(left[x]) // k for x, k in found.items()) // 2)
        for x, k in found.items():
            left[x] -= k * times
        plan.append((tuple(x for x in sorted(found, reverse=True) for _ in range(found[x])), times))
    return plan, left


def best_fit_decreasing(left: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing on a histogram: groups of equal sequences (lengths, how many)."""
    room: dict[int, dict[tuple, int]] = defaultdict(dict)
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            gap = next((g for g in range(length, capacity) if room.get(g)), None)
            if gap is None:
                full, rest = divmod(count, capacity // length)
                for k, times in ((capacity // length, full), (rest, 1 if rest else 0)):
                    if times:
                        key = (length,) * k
                        g = capacity - length * k
                        room[g][key] = room[g].get(key, 0) + times
                count = 0
                continue
            key, times = next(iter(room[gap].items()))
            fit = min(gap // length, count)
            used = min(times, count // fit)
            if used == times:
                del room[gap][key]
            else:
                room[gap][key] = times - used
            new = key + (length,) * fit
            g = gap - fit * length
            room[g][new] = room[g].get(new, 0) + used
            count -= used * fit
    return [(key, times) for g in sorted(room) for key, times in room[g].items()]


def packing_plan(need: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple, int]]:
    """Groups of equal sequences that hold every piece: (lengths in their order, how many sequences)."""
    left = need.astype(np.int64).copy()
    plan = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    more, left = multiplicative_weights(left, capacity, rounds)
    return plan + more + best_fit_decreasing(left, capacity)


def _slots(plan: list[tuple[tuple, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: where its slot ranges begin, their first sequences and their offsets."""
    out: dict[int, list] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, times in plan:
        at = 0
        for x in lengths:
            out[x].append((used[x], sequence, at))
            used[x] += times
            at += x
        sequence += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for x, rows in out.items()}


_PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset"))])


def _place(slots):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            nth = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                here = np.flatnonzero(length == x)
                begin, first, at = slots.value[int(x)]
                k = np.searchsorted(begin, nth[here], side="right") - 1
                sequence[here] = first[k] + nth[here] - begin[k]
                offset[here] = at[k]
            yield arrow_batch(_PLACED, [batch.column("doc_id"), batch.column("piece").cast(pa.int32()), batch.column("start"), batch.column("length"), batch.column("ids_crc32"), sequence, offset])

    return scan


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = materialize(tokenized_pieces(docs, vocabulary, capacity, end_id), "packing-pieces")
    tasks = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    need = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in tasks.groupBy("length").agg(F.sum("n")).collect():
        need[length] = n
    slots = docs.sparkSession.sparkContext.broadcast(_slots(packing_plan(need, capacity, rounds)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = tasks.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(before, ["part", "length"])
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "before").mapInArrow(_place(slots), ddl)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
