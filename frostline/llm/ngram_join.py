"""N-gram Jaccard self-join with prefix filters under several global token orders.

A document's set holds its distinct ``k``-word shingles. Two documents link when
100 * intersection >= percent * union. Steps:

1. Sets become a size and a 128-bit content key; documents of equal sets fold into the one of least id, the
   class. In the same pass every task counts its shingles in a count sketch of fixed size; the sketches are summed
   as a tree. Any fixed order is lossless, so the sketch only steers how few candidates meet.
2. Order 1 puts shingles of low corpus frequency first, orders 2 and 3 are independent hash orders. Two linked
   sets share a token within the first ``n - ceil(t n) + 1`` tokens of *every* order, and ``l`` tokens within
   the first ``n - ceil(t n) + l``.
3. Of order 1 the longer prefixes are taken, l being a tenth of n. A set stays if as many of its prefix tokens are in
   other prefixes as any set of fitting size must share; this is repeated, for what stays, ``PRUNINGS`` times. Sets
   that still share a prefix token must meet. Each set takes as its key the least id it shares such a token with. The sets of a key are dealt into blocks of bounded size, and a task gets two blocks (or one
   with itself); where sets of different keys share a token, those sets alone meet, in the pair of their blocks.
   So a group of m near copies travels about m / ``BLOCK_SETS`` times and no row is a pair of sets.
4. Within a pair of blocks, pairs that share prefix tokens under order 1, under order 2 and under order 3 and fit
   in size are verified by their intersections. First the sets travel with hashes cut to 32 bits, which can only
   raise an intersection (where cutting shrinks a set, its whole group stays); sets with a link then travel whole and
   pass the same steps. What leaves the task is, for each set, how many documents it links with there and one
   edge to the least set that its links reach there. Every pair of sets meets in one pair of blocks only, so the
   counts add up, and the edges give the components.

No link between different texts is lost, while equal copies are not expanded into pairs.

Null or empty text: size 0, linked with nothing, its own component. Null id: component and class null, no links.
Rows of equal ids are one node: each row is judged by its own text, and the component pools their links.
Other columns are dropped by ``link_documents`` and kept by ``keep_first_of_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, arrow_batch, binary, chunks, connected_components, gram_hashes, materialize, mix64, read, signed, small

SHINGLE = 5
PERCENT = 80
#: Counters of the frequency sketch: a fixed 8 MB, whatever the corpus.
SKETCH_BITS = 21
#: Parts that a sketch is sent in, and how many sketches are summed together.
_PARTS, _FAN = 64, 32
#: About how many sets, and how many shingles, a block holds.
BLOCK_SETS, BLOCK_SHINGLES = 768, 300_000
#: Columns of a dense incidence matrix.
_WIDTH = 2048
#: Prefix tokens that a task packs together and about how many a bucket gets; a token of more documents than HOT in such a pack isn't packed.
_PACK, _BUCKET, HOT = 1 << 20, 400_000, 32
PRUNINGS = 2

_KEYS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("task", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
_KEYS_DDL = "doc_id long, n long, s1 long, s2 long, task int, part int, counts binary"
_PREFIX = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("docs", pa.binary()), ("token", pa.int64()), ("doc_id", pa.int64())])
_PREFIX_DDL = "bucket int, tokens binary, docs binary, token long, doc_id long"
_SENT = pa.schema([*((c, pa.int64()) for c in ("ka", "ia", "kb", "ib", "side", "doc_id", "n", "s1", "copies")), ("tokens", pa.binary())])
_SENT_DDL = "ka long, ia long, kb long, ib long, side long, doc_id long, n long, s1 long, copies long, tokens binary"
_STAY = pa.schema([(c, pa.int64()) for c in ("ka", "ia", "kb", "ib", "side", "doc_id")])
_STAY_DDL = "ka long, ia long, kb long, ib long, side long, doc_id long"
_FOUND = pa.schema([("a", pa.int64()), ("s1", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
_FOUND_DDL = "a long, s1 long, b long, links long"
_SALT2, _SALT3 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_PAIR = ["ka", "ia", "kb", "ib"]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    h = w.hashes()
    g = gram_hashes(h, k)
    out = []
    for i in range(len(texts)):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(gram_hashes(h[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def least_shared(n: int) -> int:
    """How many tokens of longer prefixes a set shares with a linked one of its size or more."""
    return max(1, n // 10)


def _content(sets: list[np.ndarray], salt: np.uint64) -> np.ndarray:
    return np.array([np.sum(mix64(x ^ salt), dtype=np.uint64) for x in sets], dtype=np.uint64)


def _keys(k: int, bits: int):
    """Rows of content keys, and at the end of a task its sketch in parts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for at, texts in chunks(binary(batch.column(1))):
                sets = shingle_sets(texts, k)
                n = np.fromiter((len(x) for x in sets), dtype=np.int64, count=len(sets))
                where, how_many = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
                total[where] += how_many
                none = pa.nulls(len(sets))
                yield arrow_batch(_KEYS, [batch.column(0).slice(at, len(texts)), n, signed(_content(sets, _SALT2)), signed(_content(sets, _SALT3)), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())])
        if total.any():
            parts = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(_PARTS, -1)
            none = pa.nulls(_PARTS).cast(pa.int64())
            yield arrow_batch(_KEYS, [none, none, none, none, [TaskContext.get().partitionId()] * _PARTS, list(range(_PARTS)), [x.tobytes() for x in parts]])

    return scan


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in rows["counts"])
    return pd.DataFrame({"task": rows["task"][:1] // _FAN, "part": rows["part"][:1], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})


def frequency_sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """Sums the sketches of all tasks, ``_FAN`` at a time; one sketch of fixed size reaches the driver."""
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        parts = parts.groupBy("part", F.floor(F.col("task") / _FAN).alias("g")).applyInPandas(_added, "task int, part int, counts binary")
        tasks = -(-tasks // _FAN)
    out = np.zeros((_PARTS, (1 << bits) // _PARTS), dtype=np.int32)
    for r in parts.select("part", "counts").collect():
        out[r["part"]] = np.frombuffer(r["counts"], dtype=np.int32)
    return out.reshape(-1)


def prefixes(x: np.ndarray, percent: int, sketch: np.ndarray, bits: int) -> list[np.ndarray]:
    """The prefixes of a set under the three orders."""
    size = prefix_length(len(x), percent)
    orders = np.lexsort((mix64(x), sketch[x >> np.uint64(64 - bits)])), *(np.argsort(mix64(x ^ salt), kind="stable") for salt in (_SALT2, _SALT3))
    return [x[o[:size]] for o in orders]


def _is_own(batch: pa.RecordBatch, at: int, sets: list[np.ndarray]) -> np.ndarray:
    """Which texts have the content that their row of ``own`` names."""
    n, s1 = (batch.column(c).slice(at, len(sets)).to_numpy() for c in ("n", "s1"))
    return (n == [len(x) for x in sets]) & (s1 == signed(_content(sets, _SALT2)))


def _first_prefixes(k: int, percent: int, bits: int, shared, buckets: int):
    """Order-1 prefixes as packed (token, document) lists for each bucket of tokens; documents of a hot token as plain rows."""

    def packed(tokens: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((docs, tokens, tokens % np.uint64(buckets)))
        tokens, docs = tokens[order], docs[order]
        edge = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        size = np.diff(np.append(edge, len(tokens)))
        hot = np.repeat(size > HOT, size)
        # the first and the last document of a hot token tell the bucket that it is shared
        told = ~hot
        told[edge] = told[edge + size - 1] = True
        x, d = tokens[told], docs[told]
        to = (x % np.uint64(buckets)).astype(np.int32)
        edge = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        end = np.append(edge[1:], len(to))
        none = pa.nulls(len(edge)).cast(pa.int64())
        yield arrow_batch(_PREFIX, [to[edge], *([c[a:b].tobytes() for a, b in zip(edge, end, strict=True)] for c in (x, d)), none, none])
        if hot.any():
            none = pa.nulls(int(hot.sum()))
            yield arrow_batch(_PREFIX, [none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary()), signed(tokens[hot]), docs[hot]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        tokens, docs, held = [], [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for at, texts in chunks(binary(batch.column("text"))):
                sets = shingle_sets(texts, k)
                for i in np.flatnonzero(_is_own(batch, at, sets)):
                    x = sets[i]
                    first = x[np.lexsort((mix64(x), sketch[x >> np.uint64(64 - bits)]))[: prefix_length(len(x), percent) + least_shared(len(x)) - 1]]
                    tokens.append(first)
                    docs.append(np.full(len(first), ids[at + i]))
                    held += len(first)
                if held > _PACK:
                    yield from packed(np.concatenate(tokens), np.concatenate(docs))
                    tokens, docs, held = [], [], 0
        if held:
            yield from packed(np.concatenate(tokens), np.concatenate(docs))

    return scan


def _shared_tokens(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket, the (token, document) pairs of tokens that several documents have."""
    tokens = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in rows["tokens"]])
    docs = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows["docs"]])
    order = np.lexsort((docs, tokens))
    tokens, docs = tokens[order], docs[order]
    edge = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    end = np.append(edge[1:], len(tokens))
    several = np.repeat(docs[edge] != docs[end - 1], end - edge)
    return pd.DataFrame({"token": signed(tokens[several]), "doc_id": docs[several]})


def _send(k: int, whole: bool):
    """For each document and pair of blocks where it is: its set, whole or in 32-bit hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            others = [batch.column(c).to_numpy() for c in ("doc_id", "n", "s1", "copies")]
            for at, texts in chunks(binary(batch.column("text"))):
                sets = shingle_sets(texts, k)
                rows, sent = [], []
                for i in np.flatnonzero(_is_own(batch, at, sets)):
                    what = sets[i].tobytes() if whole else np.unique((sets[i] >> np.uint64(32)).astype(np.uint32)).tobytes()
                    for p in places[int(at + i)].as_py():
                        rows.append((*(p[c] for c in _STAY.names[:5]), *(x[at + i] for x in others)))
                        sent.append(what)
                if rows:
                    yield arrow_batch(_SENT, [*zip(*rows, strict=True), sent])

    return scan


def _sharing(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Which lists of a have an entry in common with which of b."""
    names, code, often = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    shared = np.cumsum(often > 1) - 1
    sizes = np.array([len(x) for x in (*a, *b)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    use = often[code] > 1
    row, column = row[use], shared[code[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), dtype=bool)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _WIDTH):
        x, y = np.searchsorted(column, (lo, lo + _WIDTH))
        width = int(column[y - 1]) - lo + 1
        m = np.zeros((len(sizes), width), dtype=np.float32)
        m[row[x:y], column[x:y] - lo] = 1
        out |= (m[: len(a)] @ m[len(a) :].T) > 0
    return out


def links_between(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int, sketch: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All links of sets of a with sets of b (None: of a with each other, each once), as index arrays."""
    other = a if b is None else b
    n, m = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, other))
    near = 100 * np.minimum.outer(n, m) >= percent * np.maximum.outer(n, m)
    if b is None:
        near &= np.tri(len(a), k=-1, dtype=bool).T
    under = [[prefixes(x, percent, sketch, bits) for x in side] for side in ((a,) if b is None else (a, b))]
    for order in range(3):
        if not near.any():
            break
        near &= _sharing([p[order] for p in under[0]], [p[order] for p in under[-1]])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(near.any(axis=1)):
        js = np.flatnonzero(near[i])
        every = np.concatenate([other[j] for j in js])
        hit = a[i][np.minimum(np.searchsorted(a[i], every), n[i] - 1)] == every
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(m[js]) - m[js])
        js = js[100 * common >= percent * (n[i] + m[js] - common)]
        found.append((np.full(len(js), i), js))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)


def _least_reached(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each node the least node that edges (i, j) reach from it."""
    label = np.arange(size)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _by_pair(judge):
    """Rows come sorted by pair of blocks; each pair is judged by itself, repeated rows of a set being one."""

    def judged(pair: tuple, rows: dict[tuple, dict]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1 and (out := judge(pair, [rows[x] for x in sorted(rows)])) is not None:
            yield out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {}
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in _SENT.names}
            for r in zip(*columns.values(), strict=True):
                if r[:4] != now:
                    yield from judged(now, rows)
                    now, rows = r[:4], {}
                row = dict(zip(columns, r, strict=True))
                rows[row["side"], row["doc_id"], row["s1"], row["n"]] = row
        yield from judged(now, rows)

    return scan


def _links(rows: list[dict], sets: list[np.ndarray], percent: int, sketch: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the rows of one side with each other or with those of the other side, rows of one id left out."""
    left = sum(r["side"] == 0 for r in rows)
    i, j = links_between(sets[:left], None if left == len(rows) else sets[left:], percent, sketch, bits)
    j = j if left == len(rows) else j + left
    ids = np.array([r["doc_id"] for r in rows])
    other = ids[i] != ids[j]
    return i[other], j[other]


def _filter(percent: int, bits: int, shared):
    def judge(pair: tuple, rows: list[dict]) -> pa.RecordBatch | None:
        sets = [np.frombuffer(r["tokens"], dtype=np.uint32).astype(np.uint64) << np.uint64(32) for r in rows]
        if any(len(x) < r["n"] for x, r in zip(sets, rows, strict=True)):
            stay = range(len(rows))
        else:
            stay = np.unique(np.concatenate(_links(rows, sets, percent, shared.value, bits)))
        if not len(stay):
            return None
        return arrow_batch(_STAY, [*([x] * len(stay) for x in pair), [rows[i]["side"] for i in stay], [rows[i]["doc_id"] for i in stay]])

    return _by_pair(judge)


def _verify(percent: int, bits: int, shared):
    def judge(pair: tuple, rows: list[dict]) -> pa.RecordBatch | None:
        i, j = _links(rows, [np.frombuffer(r["tokens"], dtype=np.uint64) for r in rows], percent, shared.value, bits)
        if not len(i):
            return None
        copies, ids = (np.array([r[c] for r in rows]) for c in ("copies", "doc_id"))
        links = np.bincount(i, copies[j], minlength=len(rows)) + np.bincount(j, copies[i], minlength=len(rows))
        reached = _least_reached(len(rows), i, j)
        at = np.flatnonzero(links)
        return arrow_batch(_FOUND, [ids[at], [rows[x]["s1"] for x in at], ids[reached[at]], links[at].astype(np.int64)])

    return _by_pair(judge)


def _meetings(posting: DataFrame, sizes: DataFrame) -> DataFrame:
    """(ka, ia, kb, ib, doc_id, side): which sets meet in which pair of blocks, a block being a key and a number."""
    least = posting.groupBy("token").agg(F.min("doc_id").alias("lo"))
    keys = posting.join(least, "token").groupBy("doc_id").agg(F.min("lo").alias("key"))
    keys = materialize(keys.join(sizes, "doc_id"), "join-members")
    blocks = keys.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"), F.count("*").alias("sets"))
    dealt = keys.join(small(materialize(blocks, "join-blocks")), "key").withColumn("i", F.pmod(F.xxhash64("doc_id"), "blocks"))
    dealt = materialize(dealt.select("doc_id", "key", "i", "blocks", "sets"), "join-dealt")

    within = dealt.where("sets > 1").select("key", "i", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    first = F.least("i", "j")
    within = within.select(F.col("key").alias("ka"), first.alias("ia"), F.col("key").alias("kb"), F.greatest("i", "j").alias("ib"), "doc_id", (F.col("i") != first).cast("long").alias("side"))

    # tokens whose sets have several keys, and the blocks that meet there
    mixed = posting.select("token", "doc_id").join(small(dealt.select("doc_id", "key", "i")), "doc_id")
    several = mixed.groupBy("token").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x < y").select("token")
    mixed = materialize(mixed.join(several, "token", "left_semi"), "join-mixed")
    there = mixed.select("token", F.col("key").alias("k2"), F.col("i").alias("i2")).distinct()
    across = mixed.join(there, "token").where("key <> k2").select("key", "i", "k2", "i2", "doc_id").distinct()
    swap = F.col("key") > F.col("k2")
    side = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    across = across.select(side("key", "k2").alias("ka"), side("i", "i2").alias("ia"), side("k2", "key").alias("kb"), side("i2", "i").alias("ib"), "doc_id", swap.cast("long").alias("side"))
    return materialize(within.unionByName(across), "join-meetings")


def _pruned(posting: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The postings of documents that share enough prefix tokens with others to link with any."""
    # the other set may be smaller and so sure to share less: the least size that fits counts
    need = sizes.select("doc_id", F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 10)).alias("need"))
    for _ in range(PRUNINGS):
        enough = posting.groupBy("doc_id").agg(F.count("*").alias("found")).join(need, "doc_id").where("found >= need").select("doc_id")
        posting = posting.join(small(materialize(enough, "join-enough")), "doc_id", "left_semi")
        shared = posting.groupBy("token").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("token")
        posting = materialize(posting.join(shared, "token", "left_semi"), "join-pruned")
    return posting


def _met(texts: DataFrame, meetings: DataFrame, own: DataFrame, send) -> DataFrame:
    """What documents send to the pairs of blocks where they meet, sorted by these."""
    places = meetings.groupBy("doc_id").agg(F.collect_list(F.struct(*_STAY.names[:5])).alias("places"))
    placed = small(materialize(places.join(own, "doc_id"), "join-places"))
    return texts.join(placed, "doc_id").mapInArrow(send, _SENT_DDL).repartition(*_PAIR).sortWithinPartitions(*_PAIR)


def link_documents(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links): class_id is the least id of an equal set, and
    n_links counts the documents of other sets that the document links with."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = docs.where("doc_id is not null and text is not null")
    scanned = materialize(docs.mapInArrow(_keys(k, bits), _KEYS_DDL), "join-keys")
    keys = scanned.where("part is null").select("doc_id", "n", "s1", "s2")
    sketch = spark.sparkContext.broadcast(frequency_sketch(scanned.where("part is not null").select("task", "part", "counts"), bits))
    reps = keys.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = materialize(reps, "join-classes")

    own = reps.select(F.col("rep").alias("doc_id"), "n", "s1", "copies")
    total = reps.agg(F.sum("n")).first()[0] or 0
    buckets = max(2, total * (100 - percent) // 100 // _BUCKET)
    firsts = texts.join(small(own), "doc_id").mapInArrow(_first_prefixes(k, percent, bits, sketch, buckets), _PREFIX_DDL)
    firsts = materialize(firsts, "join-prefixes")
    packed = firsts.where("bucket is not null").select("bucket", "tokens", "docs").groupBy("bucket").applyInPandas(_shared_tokens, "token long, doc_id long")
    posting = materialize(packed.unionByName(firsts.where("bucket is null").select("token", "doc_id")).distinct(), "join-postings")
    posting = _pruned(posting, own.groupBy("doc_id").agg(F.min("n").alias("n")), percent)
    meetings = _meetings(posting, own.groupBy("doc_id").agg(F.sum("n").alias("n")))
    stay = _met(texts, meetings, own, _send(k, False)).mapInArrow(_filter(percent, bits, sketch), _STAY_DDL)
    stay = materialize(stay, "join-stay")
    linked = _met(texts, stay, own, _send(k, True)).mapInArrow(_verify(percent, bits, sketch), _FOUND_DDL)
    linked = materialize(linked, "join-links")

    # an id of several texts joins their classes
    named = keys.where("n > 0 and doc_id is not null")
    several = named.groupBy("doc_id").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x <> y").select("doc_id")
    pooled = named.join(small(materialize(several, "join-several")), "doc_id", "left_semi").join(reps, ["n", "s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    groups = materialize(connected_components(linked.select("a", "b").unionByName(pooled), "join-groups").withColumnRenamed("node", "rep"), "join-components")
    counts = linked.groupBy(F.col("a").alias("rep"), "s1").agg(F.sum("links").alias("n_links"))
    told = reps.join(groups, "rep", "left").join(counts, ["rep", "s1"], "left").select("n", "s1", "s2", "rep", F.coalesce("component", "rep").alias("component"), "n_links")
    of_keys = keys.withColumn("n_shingles", F.col("n")).withColumn("n", F.when(F.col("doc_id").isNotNull(), F.col("n")))
    out = of_keys.join(small(materialize(told, "join-told")), ["n", "s1", "s2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_first_of_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The same columns; of each component only rows of its least id stay. Rows with a null id stay."""
    kept = link_documents(docs, k, percent).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(small(materialize(kept, "join-kept")), "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read(spark, sf_dir, "documents"))
