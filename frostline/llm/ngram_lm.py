"""Language-model scoring over Elias-Fano n-gram tries of three orders.

A trie starts at the word before the one to be scored, the context word. Below it lie its successors, and the words
before it; below each of these, the successors seen after both words. A successor is known there by its place among the
context word's successors, so a node of depth three holds small, ascending numbers, found by a search relative to its
context. Documents are read in chunks; each chunk sends its distinct trigrams, sorted and nested, with how often
training documents have them, to the shards of their context words. A shard adds up all chunks, builds its trie and
answers every chunk for what it asked; the chunk's documents are then scored. So what is gathered grows with the
corpus and is spread over tasks.

A level of the trie is a sequence of ascending keys (place of the parent, id) in Elias-Fano form: low bits packed to
the bit, high bits in unary with counts for each block of 64 bits, so no place is stored. Monotone pointer sequences,
packed alike, tell where a node's children lie; a child is found by a search among these alone. Successors hold their
smoothed probability, nodes of words before the context word the weight they leave to shorter contexts, both quantised
on a logarithmic scale in one byte. All levels lie in one memory-mapped file.

The model, with counts c over training documents: p1(w) = (c(w) + 1) / (N + V + 1);
p2(w|v) = (c(vw) + K p1(w)) / (c(v) + K); p3(w|uv) = (c(uvw) + K p2(w|v)) / (c(uv) + K), K = ``PRIOR``. A trie holds
what is known in its shard, p3 without the part that p1 gives; that part, with its weight, is added when scoring.
Texts begin after two ends. Context words are known by 62 bits, the words beside them by 32 within their node: a
never-seen n-gram passes for a seen one with chance n / 2**32, n the number of children there.

Context words, and pairs of words, that fill more than half a shard are hot: a sample finds them and a pass counts them
exactly, which gives each as many shards as its count needs. A hot word's trigrams are dealt by the word before it, its
successors, and those of a hot pair, by the successor; what is smoothed needs the context's whole count alone. Which
words are called hot decides the layout only, not a score (but for the quantisation).

The documents are read again for scoring rather than kept, which costs less disk than what the first pass would have
to remember for each token.

Null or empty text: the end alone. Rows of equal or null ids are scored each by itself; a null id counts as
training. Empty tables give no rows. Other columns are dropped.
"""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, arrow_batch, binary, chunks, materialize, mix64, new_temp_file, read

PRIOR = 4.0
#: Bytes of text that a chunk holds at least, and text bytes for each shard.
CHUNK, SHARD_BYTES = 4 << 20, 8 << 20
#: A sample of one document in SAMPLE tells the hot contexts: HOT_TOKENS tokens and HOT_SHARE of all (so at most 1 / HOT_SHARE words and as many pairs).
SAMPLE, HOT_TOKENS, HOT_SHARE = 50, SHARD_BYTES // 16, 1e-6
_END = np.uint64(0x656E6400000000)
#: Quantised steps of log10, from 0 down; 255 stands for 'not found'.
_STEP = 10.0 / 254
#: One in so many values of a level is held plainly, to begin a search near its end.
SKIP = 8
_LOW32 = np.uint64(0xFFFFFFFF)
#: Kinds of names, in their two lowest bits: plain words, hot words (dealt by the word before), hot contexts (dealt by the successor).
_KIND, _PLAIN, _HOT, _WHOLE = np.uint64(3), np.uint64(0), np.uint64(1), np.uint64(2)


def _packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, one after the other, as bytes (8 spare ones at the end)."""
    if not width:
        return np.zeros(8, dtype=np.uint8)
    shifts = np.arange(width, dtype=np.uint64)
    parts = [np.packbits(((values[i : i + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little") for i in range(0, len(values), 65536)]
    return np.concatenate([*parts, np.zeros(8, dtype=np.uint8)])


def _select_table() -> np.ndarray:
    """For a byte and a number k: the place of the byte's k-th one."""
    out = np.zeros((256, 8), dtype=np.int64)
    for byte in range(256):
        places = [b for b in range(8) if byte >> b & 1]
        out[byte, : len(places)] = places
    return out.reshape(-1)


_SELECT = _select_table()
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one (from 0) of each 64-bit word."""
    x = word - ((word >> np.uint64(1)) & np.uint64(0x5555555555555555))
    x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
    # ones up to and with each byte
    sums = ((x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES
    # bytes whose sums don't exceed k lie before the one wanted
    byte = np.bitwise_count(((k * _ONES | _TOPS) - sums) & _TOPS).astype(np.uint64) << np.uint64(3)
    before = (sums << np.uint64(8)) >> byte & np.uint64(0xFF)
    inside = (word >> byte) & np.uint64(0xFF)
    return byte.astype(np.int64) + _SELECT[(inside << np.uint64(3) | (k - before)).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence of integers; its arrays may lie in a memory-mapped buffer."""

    def __init__(self, n: int, low_bits: int, base: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> None:
        self.n, self.low_bits, self.base, self.low, self.high, self.rank = n, low_bits, base, low, high, rank
        # eight bytes from every byte on
        self.window = np.ndarray(max(len(low) - 7, 0), dtype="<u8", buffer=low, strides=(1,))
        # every SKIP-th value, once a search asks for them
        self.every: np.ndarray | None = None

    @staticmethod
    def pack(values: np.ndarray) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
        """(length, low bits, least value, packed low bits, 64-bit words of the unary high bits, ones before each word)."""
        n = len(values)
        if not n:
            return 0, 0, 0, np.zeros(8, dtype=np.uint8), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
        base = int(values[0])
        v = values - np.uint64(base)
        low_bits = max(0, ((int(v[-1]) + 1) // n).bit_length() - 1)
        place = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n, dtype=np.int64)
        bits = np.zeros((int(place[-1]) // 64 + 1) * 64, dtype=np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(high).astype(np.uint32)
        return n, low_bits, base, _packed_bits(v, low_bits), high, (np.cumsum(ones) - ones).astype(np.uint32)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.int64) * self.low_bits
        bit = (at & 7).astype(np.uint64)
        out = self.window[at >> 3] >> bit
        if self.low_bits > 57:
            out |= (self.window[(at >> 3) + 1] >> np.uint64(56) << ((np.uint64(64) - bit) & np.uint64(63))) * (bit > 0)
        return out & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at some places."""
        i = np.asarray(i, dtype=np.int64)
        word = np.searchsorted(self.rank, i.astype(np.uint32), side="right") - 1
        place = _select(self.high[word], (i - self.rank[word]).astype(np.uint64))
        high = (word * 64 + place - i).astype(np.uint64) << np.uint64(self.low_bits)
        return high + self._low(i) + np.uint64(self.base)

    def search(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place in [lo, hi) of each value, or -1 where it isn't there: the successor search within a context."""
        out = np.full(len(value), -1, dtype=np.int64)
        some = np.flatnonzero(lo < hi)
        if not len(some):
            return out
        if self.every is None:
            self.every = self.get(np.arange(0, self.n, SKIP))
        wanted = value[some]
        near = (np.searchsorted(self.every, wanted, side="right") - 1) * SKIP
        lo, hi = np.maximum(lo[some].astype(np.int64), near), np.minimum(hi[some].astype(np.int64), near + SKIP)
        open_ = np.flatnonzero(hi - lo > 1)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            over = self.get(middle) > wanted[open_]
            lo[open_] = np.where(over, lo[open_], middle)
            hi[open_] = np.where(over, middle, hi[open_])
            open_ = open_[hi[open_] - lo[open_] > 1]
        left = np.flatnonzero(lo < hi)
        left = left[self.get(lo[left]) == wanted[left]]
        out[some[left]] = lo[left]
        return out

    def find(self, value: np.ndarray) -> np.ndarray:
        """``search`` in the whole sequence."""
        return self.search(value, np.zeros(len(value), dtype=np.int64), np.full(len(value), self.n))


def _children(key: np.ndarray, count: np.ndarray, parents: int, shift: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending keys (parent << shift | id) with repeats: the distinct ones, their counts, where each parent's begin."""
    first = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    total = np.add.reduceat(count, first) if len(first) else np.zeros(0, dtype=np.int64)
    pointers = np.searchsorted(key[first] >> shift, np.arange(parents + 1, dtype=np.uint64))
    return key[first], total, pointers.astype(np.uint64)


def _codes(share: np.ndarray) -> np.ndarray:
    """Shares of 0 to 1 in steps of ``_STEP``; 255 for none."""
    with np.errstate(divide="ignore"):
        return np.where(share > 0, np.minimum(np.round(-np.log10(share) / _STEP), 254), 255).astype(np.uint8)


def _shares(code: np.ndarray) -> np.ndarray:
    return np.append(10.0 ** (-_STEP * np.arange(255)), 0.0)[code]


class Trie:
    """Levels of context words, of their successors, of the words before them, and of the successors after both.

    ``whole`` has the counts of hot contexts; names of the kind ``_WHOLE`` have their number there in place of a word before.
    """

    def __init__(self, name: np.ndarray, before: np.ndarray, word: np.ndarray, count: np.ndarray, whole: np.ndarray) -> None:
        names, of_name = np.unique(name, return_inverse=True)
        kind = names & _KIND
        total = np.bincount(of_name, count, minlength=len(names)).astype(np.int64)
        top = of_name.astype(np.uint64) << np.uint64(32)
        parents = np.arange(len(names) + 1, dtype=np.uint64)
        nexts, of_next = np.unique(top | word.astype(np.uint64), return_inverse=True)
        to_nexts = np.searchsorted(nexts >> np.uint64(32), parents).astype(np.uint64)
        pairs, of_pair = np.unique(top | before.astype(np.uint64), return_inverse=True)
        to_pairs = np.searchsorted(pairs >> np.uint64(32), parents).astype(np.uint64)
        # places need as many bits as the longest list of successors; one more is that of no place
        self.shift = np.uint64(int(np.diff(to_nexts).max(initial=0)).bit_length())
        triple = of_pair.astype(np.uint64) << self.shift | of_next.astype(np.uint64) - to_nexts[of_name]
        order = np.argsort(triple, kind="stable")
        triples, n3, to_triples = _children(triple[order], count[order].astype(np.int64), len(pairs), self.shift)
        # what each context has been seen with, and the weight that it leaves to the next shorter one
        context = (pairs >> np.uint64(32)).astype(np.int64)
        given = np.bincount(of_pair, count, minlength=len(pairs))
        is_whole = kind[context] == _WHOLE
        given[is_whole] = whole[(pairs[is_whole] & _LOW32).astype(np.int64)]
        left = PRIOR / (given + PRIOR)
        of_plain = (nexts >> np.uint64(32)).astype(np.int64)
        p2 = np.where(kind[of_plain] == _PLAIN, np.bincount(of_next, count, minlength=len(nexts)) / (total[of_plain] + PRIOR), 0.0)
        above = (triples >> self.shift).astype(np.int64)
        p3 = n3 / (given[above] + PRIOR) + left[above] * p2[(to_nexts[context[above]] + (triples & self._no_place())).astype(np.int64)]
        self.file = new_temp_file("trie-")
        levels = [EliasFano.pack(x) for x in (names, to_nexts, nexts, to_pairs, pairs, to_triples, triples)]
        places = []
        for _, _, _, *arrays in levels:
            places.append([self._write(x) for x in arrays])
        plain = [self._write(x) for x in (total, _codes(p2), _codes(left), _codes(p3))]
        self.file.write(b"\x00")
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        at = lambda place: np.frombuffer(self.map, dtype=place[0], count=place[1], offset=place[2])
        self.names, self.to_nexts, self.nexts, self.to_pairs, self.pairs, self.to_triples, self.triples = (EliasFano(*level[:3], *map(at, place)) for level, place in zip(levels, places, strict=True))
        self.total, self.q2, self.left, self.q3 = map(at, plain)

    def _write(self, x: np.ndarray) -> tuple[np.dtype, int, int]:
        self.file.write(b"\x00" * (-self.file.tell() % 8))
        place = (x.dtype, len(x), self.file.tell())
        self.file.write(x.tobytes())
        return place

    def _no_place(self) -> np.uint64:
        return (np.uint64(1) << self.shift) - np.uint64(1)

    def _below(self, level: EliasFano, pointers: EliasFano, parent: np.ndarray, children: np.ndarray, name: np.ndarray, shift: np.uint64 = np.uint64(32)) -> np.ndarray:
        """For each parent (-1: none) and so many names of ``shift`` bits in a row: the places of these children, or -1."""
        lo, hi = np.zeros(len(parent), dtype=np.int64), np.zeros(len(parent), dtype=np.int64)
        at = np.flatnonzero(parent >= 0)
        if len(at) and level.n:
            lo[at], hi[at] = pointers.get(parent[at]), pointers.get(parent[at] + 1)
        key = np.repeat(np.maximum(parent, 0).astype(np.uint64) << shift, children) | name.astype(np.uint64)
        return level.search(key, np.repeat(lo, children), np.repeat(hi, children))

    def lookup(self, name: np.ndarray, pairs_of: np.ndarray, before: np.ndarray, triples_of: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of names; quantised, the weights left by the pairs under each, and the probabilities of the words under each pair."""
        at = self.names.find(name)
        name_of = np.repeat(np.arange(len(name)), pairs_of)
        pair_of = np.repeat(np.arange(len(before)), triples_of)
        words_of = np.bincount(name_of, triples_of, minlength=len(name)).astype(np.int64)
        after = self._below(self.nexts, self.to_nexts, at, words_of, word)
        known = np.flatnonzero(after >= 0)
        place = np.full(len(word), self._no_place(), dtype=np.uint64)
        if len(known):
            place[known] = after[known].astype(np.uint64) - self.to_nexts.get(at[name_of[pair_of[known]]])
        pair = self._below(self.pairs, self.to_pairs, at, pairs_of, before)
        triple = self._below(self.triples, self.to_triples, pair, triples_of, place, self.shift)
        picked = lambda values, i, none: np.where(i >= 0, values[np.maximum(i, 0)] if len(values) else none, none)
        total = picked(self.total, at, 0).astype(np.int64)
        left = picked(self.left, pair, 0).astype(np.int64)
        shorter = picked(self.q2, after, 255).astype(np.int64)
        # codes are logarithms: those of weight and probability add up
        backed = np.where(shorter < 255, np.minimum(left[pair_of] + shorter, 254), 255)
        of_name = np.where(name & _KIND == _PLAIN, _codes(PRIOR / (total + PRIOR)), 0).astype(np.int64)
        return total, np.minimum(left + of_name[name_of], 254).astype(np.uint8), np.where(triple >= 0, picked(self.q3, triple, 255), backed).astype(np.uint8)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bool], list[bytes]]]:
    """Chunks of rows: ids, whether held out, texts."""
    ids, held, texts, size = [], [], [], 0
    for batch in batches:
        for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary(batch.column(2)), strict=True):
            ids.append(i)
            held.append(bool(h))
            texts.append(t)
            size += len(t) + 8
            if size >= CHUNK:
                yield ids, held, texts
                ids, held, texts, size = [], [], [], 0
    if ids:
        yield ids, held, texts


def word_names(texts: list[bytes]) -> np.ndarray:
    """The 64-bit names of words; none is that of the end."""
    h = Words(texts, lower=True).hashes()
    h[h == _END] += np.uint64(1)
    return h


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens, the end of each text included, and how many each text has."""
    names, sizes = [], []
    for _, part in chunks(texts):
        w = Words(part, lower=True)
        h = w.hashes()
        h[h == _END] += np.uint64(1)
        names.append(np.insert(h, w.first[1:], _END))
        sizes.append(w.counts() + 1)
    return np.concatenate(names), np.concatenate(sizes)


def _before(word: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one and two before each token; ends before the first of a text."""
    first = np.cumsum(sizes) - sizes
    one = np.append(_END, word[:-1])
    two = np.append([_END, _END], word[:-2])[: len(word)]
    two[first] = _END
    return one, two


_MADE = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("check", pa.int64()), *((c, pa.binary()) for c in ("name", "pairs", "before", "triples", "word", "count")), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), *((c, pa.binary()) for c in ("sizes", "at", "kind", "whole"))])
_ASKED = ("shard", "chunk", "check", "name", "pairs", "before", "triples", "word", "count")
_MADE_DDL = "shard int, chunk long, check long, name binary, pairs binary, before binary, triples binary, word binary, count binary, doc_id array<long>, held_out array<boolean>, sizes binary, at binary, kind binary, whole binary"


def _pair_names(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    return mix64(one ^ mix64(two + np.uint64(0x9E3779B97F4A7C15)))


def _number(names: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The place of each name among the sorted hot ones, or -1."""
    if not len(hot):
        return np.full(len(names), -1, dtype=np.int64)
    place = np.minimum(np.searchsorted(hot, names), len(hot) - 1)
    return np.where(hot[place] == names, place, -1)


def _dealt(names: np.ndarray, by: np.ndarray, buckets: np.ndarray, kind: np.uint64) -> np.ndarray:
    """Names of a kind under which hot contexts are looked up: one for each bucket of the words that deal them."""
    return mix64(names ^ mix64(mix64(by) % buckets.astype(np.uint64) + (kind << np.uint64(40)))) & ~_KIND | kind


def _asked(word: np.ndarray, one: np.ndarray, two: np.ndarray, hot: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, words before, words) to look up: one for each token, then one more for each token after a hot word; and which these are."""
    name, before, after = one & ~_KIND, two >> np.uint64(32), word >> np.uint64(32)
    number = _number(one, hot)
    extra = np.flatnonzero(number >= 0)
    if not len(extra):
        return name, before, after, extra
    number, w, v, u = number[extra], word[extra], one[extra], two[extra]
    name[extra] = _dealt(v, u, buckets[number], _HOT)
    both = _pair_names(u, v)
    pair = _number(both, hot)
    is_pair = np.flatnonzero(pair >= 0)
    name[extra[is_pair]] = _dealt(both[is_pair], w[is_pair], buckets[pair[is_pair]], _WHOLE)
    before[extra[is_pair]] = pair[is_pair]
    return np.append(name, _dealt(v, w, buckets[number], _WHOLE)), np.append(before, number.astype(np.uint64)), np.append(after, after[extra]), extra


def _make(shards: int, hot: np.ndarray, buckets: np.ndarray, ask: bool):
    """For each chunk a row for each shard (what it asks), or one row of shard -1 (how its documents are made of that)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (ids, held, texts) in enumerate(_chunks(batches)):
            chunk = part << 24 | number
            word, sizes = _tokens(texts)
            one, two = _before(word, sizes)
            trained = np.repeat(~np.array(held), sizes)
            name, before, after, extra = _asked(word, one, two, hot, buckets)
            names, of_name = np.unique(name, return_inverse=True)
            # names in order of their shards
            to = (mix64(names ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            rank = np.empty(len(order), dtype=np.uint64)
            rank[order] = np.arange(len(order), dtype=np.uint64)
            names, to = names[order], to[order]
            pairs, of_pair = np.unique(rank[of_name] << np.uint64(32) | before, return_inverse=True)
            triples, at = np.unique(of_pair.astype(np.uint64) << np.uint64(32) | after, return_inverse=True)
            pairs_of = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(names)).astype(np.uint32)
            triples_of = np.bincount((triples >> np.uint64(32)).astype(np.int64), minlength=len(pairs)).astype(np.uint32)
            check = zlib.crc32(names.tobytes())
            if ask:
                count = np.bincount(at, np.append(trained, trained[extra]), minlength=len(triples)).astype(np.uint32)
                yield _asked_rows(chunk, check, to, [names, pairs_of, (pairs & _LOW32).astype(np.uint32), triples_of, (triples & _LOW32).astype(np.uint32), count])
                continue
            kind = (names & _KIND).astype(np.uint8)
            whole = (pairs[np.repeat(kind, pairs_of) == _WHOLE] & _LOW32).astype(np.uint32)
            # bytes of one rank together compress better
            planes = at.astype("<u4").view(np.uint8).reshape(-1, 4).T
            asked = [[None], [pairs_of.tobytes()], [None], [triples_of.tobytes()], [None], [None]]
            yield arrow_batch(_MADE, [[-1], [chunk], [check], *asked, [ids], [held], [sizes.astype(np.uint32).tobytes()], [np.ascontiguousarray(planes).tobytes()], [kind.tobytes()], [whole.tobytes()]])

    return scan


def _asked_rows(chunk: int, check: int, to: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """Names with their pairs and these with their triples, cut at the shards of the names."""
    names, pairs_of, _, triples_of, _, _ = arrays
    edge = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    bounds = [np.append(edge, len(names))]
    bounds.append(np.append(0, np.cumsum(pairs_of, dtype=np.int64))[bounds[0]])
    bounds.append(np.append(0, np.cumsum(triples_of, dtype=np.int64))[bounds[1]])
    columns = [[x[a:b].tobytes() for a, b in zip(bounds[level][:-1], bounds[level][1:], strict=True)] for x, level in zip(arrays, (0, 0, 1, 1, 2, 2), strict=True)]
    none = pa.nulls(len(edge))
    lists = [none.cast(_MADE.field(c).type) for c in ("doc_id", "held_out", "sizes", "at", "kind", "whole")]
    return arrow_batch(_MADE, [to[edge], [chunk] * len(edge), [check] * len(edge), *columns, *lists])


_ANSWER_DDL = "shard int, chunk long, check long, total binary, weight binary, share binary, tokens long, words long"


def _answer(whole: np.ndarray):
    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        u32 = lambda x: np.frombuffer(x, dtype=np.uint32)
        parts = []
        for r in rows.itertuples():
            of_pair = np.repeat(np.arange(len(u32(r.before))), u32(r.triples))
            of_name = np.repeat(np.arange(len(u32(r.pairs))), u32(r.pairs))
            count = u32(r.count)
            use = count > 0
            pair = of_pair[use]
            parts.append((np.frombuffer(r.name, dtype=np.uint64)[of_name[pair]], u32(r.before)[pair], u32(r.word)[use], count[use]))
        trie = Trie(*(np.concatenate(x) for x in zip(*parts, strict=True)), whole)
        del parts
        out: dict[str, list] = {c.split()[0]: [] for c in _ANSWER_DDL.split(", ")}
        shard = int(rows["shard"].iloc[0])

        def add(*values) -> None:
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)

        for r in rows.itertuples():
            found = trie.lookup(np.frombuffer(r.name, dtype=np.uint64), u32(r.pairs), u32(r.before), u32(r.triples), u32(r.word))
            add(shard, r.chunk, r.check, *(x.tobytes() for x in found), None, None)
        names = trie.names.get(np.arange(trie.names.n)) if trie.names.n else np.zeros(0, dtype=np.uint64)
        plain = names & _KIND == _PLAIN
        add(shard, -1, None, None, None, None, int(trie.total[plain].sum()), int(plain.sum()))
        return pd.DataFrame(out)

    return answer


def _score(n_tokens: int, vocabulary: int, whole: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def judged(r: dict) -> pa.RecordBatch:
        answers = sorted(r["answers"] or (), key=lambda a: a["shard"])
        if not answers or any(a["check"] != r["check"] for a in answers):
            raise RuntimeError("the two passes over the documents saw different chunks; write the documents to files first")
        joined = lambda c, dtype: np.concatenate([np.frombuffer(a[c], dtype=dtype) for a in answers])
        total, left, share = joined("total", np.int64).astype(float), _shares(joined("weight", np.uint8)), _shares(joined("share", np.uint8))
        pairs_of, triples_of = (np.frombuffer(r[c], dtype=np.uint32) for c in ("pairs", "triples"))
        name_of = np.repeat(np.arange(len(pairs_of)), pairs_of)
        pair_of = np.repeat(np.arange(len(triples_of)), triples_of)
        kind = np.frombuffer(r["kind"], dtype=np.uint8)[name_of]
        known = np.zeros(len(kind))
        known[kind == _WHOLE] = whole[np.frombuffer(r["whole"], dtype=np.uint32).astype(np.int64)]
        left[kind == _WHOLE] = PRIOR / (known[kind == _WHOLE] + PRIOR)
        sizes = np.frombuffer(r["sizes"], dtype=np.uint32).astype(np.int64)
        at = np.ascontiguousarray(np.frombuffer(r["at"], dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
        n = int(sizes.sum())
        at, at_hot = at[:n], at[n:]
        pair, pair_hot = pair_of[at], pair_of[at_hot]
        after_hot = np.flatnonzero(kind[pair] > 0)
        # how often the word before each token was seen; a token's own count is that of the next one's context
        context = total[name_of[pair]]
        context[after_hot] = known[pair_hot]
        first = np.cumsum(sizes) - sizes
        c1 = np.append(context[1:], 0.0)
        c1[first + sizes - 1] = context[first]
        p1 = (c1 + 1.0) / (n_tokens + vocabulary + 1.0)
        shorter = p1.copy()
        shorter[after_hot] = share[at_hot] + left[pair_hot] * p1[after_hot]
        p3 = np.minimum(share[at] + left[pair] * shorter, 1.0)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums = [np.bincount(doc, x, minlength=len(sizes)) for x in ((c1 > 0).astype(float), np.log10(p1), np.log10(p3))]
        return arrow_batch(schema, [r["doc_id"], r["held_out"], sizes, sums[0].astype(np.int64), sums[1], sums[2]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield judged(batch.slice(i, 1).to_pylist()[0])

    return scan


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words and of the pairs of words of each chunk."""
    for _, _, texts in _chunks(batches):
        word, sizes = _tokens(texts)
        one, two = _before(word, sizes)
        for is_word, names in ((True, one), (False, _pair_names(two, one))):
            found, n = np.unique(names, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array([is_word] * len(found)), pa.array(n.astype(np.int64))], names=["name", "is_word", "n"])


def _hot_words(rows: DataFrame) -> np.ndarray:
    """Sorted names of the words and pairs that, by a sample, need more than half a shard: at most 2 / HOT_SHARE of them."""
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0)
    n = sample.mapInArrow(_sampled, "name long, is_word boolean, n long").groupBy("name", "is_word").agg(F.sum("n").alias("n"))
    n = materialize(n, "lm-sample")
    tokens = n.where("is_word").agg(F.sum("n")).first()[0] or 0
    found = n.where(F.col("n") >= max(HOT_SHARE * tokens, HOT_TOKENS / SAMPLE)).select("name").collect()
    return np.unique(np.append(np.array([r["name"] for r in found], dtype=np.int64).view(np.uint64), _END))


def _counted(hot: np.ndarray):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, every = (np.zeros(len(hot), dtype=np.int64) for _ in range(3))
        size = tokens = 0
        for _, held, texts in _chunks(batches):
            size += sum(map(len, texts))
            word, sizes = _tokens(texts)
            one, two = _before(word, sizes)
            tokens += len(word)
            trained = np.repeat(~np.array(held), sizes)
            number = _number(one, hot)
            after_hot = np.flatnonzero(number >= 0)
            pair = _number(_pair_names(two[after_hot], one[after_hot]), hot)
            for counts, found, use in ((words, number, trained), (pairs, pair, trained[after_hot])):
                counts += np.bincount(found[use & (found >= 0)], minlength=len(hot))
            for found in (number, pair):
                every += np.bincount(found[found >= 0], minlength=len(hot))
        some = np.flatnonzero(every)
        columns = [np.append(some, -1), np.append(words[some], size), np.append(pairs[some], tokens), np.append(every[some], 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["number", "words", "pairs", "every"])

    return scan


def _hot_counts(rows: DataFrame, hot: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Shards to use; of the hot contexts: training counts as words and as pairs, and the shards that each is dealt over."""
    counts = rows.mapInArrow(_counted(hot), "number long, words long, pairs long, every long").groupBy("number").agg(*(F.sum(c).alias(c) for c in ("words", "pairs", "every")))
    found = np.array([tuple(r) for r in counts.collect()], dtype=np.int64).reshape(-1, 4)
    head, found = found[found[:, 0] < 0], found[found[:, 0] >= 0]
    size, tokens = (int(head[:, 1].sum()), int(head[:, 2].sum()))
    shards = max(2, -(-size // SHARD_BYTES))
    out = np.zeros((3, len(hot)), dtype=np.int64)
    out[:, found[:, 0]] = found[:, 1:].T
    return shards, out[0], out[1], 1 + out[2] * 2 * shards // max(tokens, 1)


def score_documents(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows of the fold are not learnt from.

    The documents are read several times and must come in the same partitions and order, as from files; every chunk is
    checked and a difference raises, so a plan with shuffles has to be written first.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string"))
    hot = _hot_words(rows)
    shards, of_words, of_pairs, buckets = _hot_counts(rows, hot)
    whole = of_words + of_pairs
    asked = rows.mapInArrow(_make(shards, hot, buckets, True), _MADE_DDL).select(*_ASKED)
    answered = materialize(asked.groupBy("shard").applyInPandas(_answer(whole), _ANSWER_DDL), "lm-answers")
    stats = answered.where("chunk < 0").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    n_tokens, vocabulary = (stats["tokens"] or 0) + int(of_words.sum()), (stats["words"] or 0) + int((of_words > 0).sum())
    replies = answered.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("shard", "check", "total", "weight", "share")).alias("answers"))
    structure = rows.mapInArrow(_make(shards, hot, buckets, False), _MADE_DDL).select("chunk", "check", "doc_id", "held_out", "sizes", "pairs", "triples", "at", "kind", "whole")
    out = structure.join(replies, "chunk", "left").mapInArrow(_score(n_tokens, vocabulary, whole), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
