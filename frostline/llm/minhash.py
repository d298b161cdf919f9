"""MinHash near duplicates with tensored banding.

A document's set holds its distinct ``k``-word shingles; two documents link when 100 * intersection >= percent * union.
Two collections of ``M`` half keys are made, each half key of ``H`` minhashes. The key of table (i, j) is half key i of the
first collection with half key j of the second: M * M tables of 2 H minhashes each come from only 2 M H minhashes. Two sets
of similarity s meet in some table unless all half keys of a collection differ: with probability (1 - (1 - s**H)**M)**2,
that is 0.9999 at s = 0.8 and more above. Every pair that meets is verified on the full sets.

1. One pass makes size, content key and half keys of each set. Equal sets fold into the one of least id, the class.
2. Half keys that one class alone has can make no table key that two have; only the others are combined.
3. The least class of a table entry leads it. Every class is verified against the leader that it shares most entries with, a
   leader's set being sent once to each bounded block of its followers. Linked classes are joined into components.
4. Where an entry still holds several components, its classes meet in pairs of bounded blocks, and all pairs that share an
   entry and lie in different components are verified. So a group of near copies costs about as many verifications as it
   has members, and only what its leaders leave open is compared further. No row is a pair but of a class and its leader.

Null or empty text: size 0, linked with nothing, its own component. Null id: component null, no links, kept. Rows of equal
ids are one node: each row is judged by its own text, and the component pools their links. Copies and ties fold into the
least id. Very long texts are taken whole; other columns are left aside. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, binary, chunks, connected_components, materialize, mix64, read, signed, small
from .ngram_join import _content, _is_own, _least_reached, _meetings, shingle_sets

SHINGLE, PERCENT = 4, 80
#: Half keys of a collection, and minhashes of a half key.
M, H = 14, 3
#: About how many followers, and how many of their shingles, a leader's block holds.
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000

_SALT2, _SALT3 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_ROUNDS = mix64(np.arange(1, 2 * M * H + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_KEYS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("halves", pa.binary())])
_KEYS_DDL = "doc_id long, n long, s1 long, s2 long, halves binary"
_HALF = pa.schema([("doc_id", pa.int64()), ("s1", pa.int64()), ("place", pa.int32()), ("half", pa.int64())])
_ENTRY = pa.schema([("doc_id", pa.int64()), ("token", pa.int64())])
_PLACE = ["ka", "ia", "kb", "ib", "side"]
_SENT = pa.schema([*((c, pa.int64()) for c in (*_PLACE, "doc_id", "n", "s1", "component")), ("halves", pa.binary()), ("tokens", pa.binary())])
_SENT_DDL = "ka long, ia long, kb long, ib long, side long, doc_id long, n long, s1 long, component long, halves binary, tokens binary"
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2 M) half keys; those of empty sets are 0."""
    out = np.zeros((len(sets), 2 * M), dtype=np.uint64)
    there = np.array([i for i, x in enumerate(sets) if len(x)], dtype=np.int64)
    if not len(there):
        return out
    every = np.concatenate([sets[i] for i in there])
    start = np.cumsum([0, *(len(sets[i]) for i in there[:-1])])
    turned = np.empty_like(every)
    for place in range(2 * M):
        key = np.full(len(there), place + 1, dtype=np.uint64)
        for r in _ROUNDS[place * H : (place + 1) * H]:
            np.bitwise_xor(every, r, out=turned)
            np.multiply(turned, r | np.uint64(1), out=turned)
            key = mix64(key * np.uint64(0xD1342543DE82EF95) + np.minimum.reduceat(turned, start))
        out[there, place] = key
    return out


def _keys(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(binary(batch.column(1))):
                sets = shingle_sets(texts, k)
                halves = half_keys(sets)
                yield arrow_batch(_KEYS, [batch.column(0).slice(at, len(texts)), [len(x) for x in sets], signed(_content(sets, _SALT2)), signed(_content(sets, _SALT3)), [x.tobytes() for x in halves]])

    return scan


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each half key."""
    for batch in batches:
        halves = np.frombuffer(b"".join(batch.column("halves").to_pylist()), dtype=np.int64)
        ids, s1 = (batch.column(c).to_numpy() for c in ("doc_id", "s1"))
        yield arrow_batch(_HALF, [np.repeat(ids, 2 * M), np.repeat(s1, 2 * M), np.tile(np.arange(2 * M, dtype=np.int32), len(ids)), halves])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each table key of a class, of (doc_id, first: half keys, second: half keys)."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        a, b = (batch.column(c) for c in ("first", "second"))
        held, docs, size = [], [], 0
        for i, doc in enumerate(ids):
            x, y = (np.array(c[i].as_py(), dtype=np.int64).view(np.uint64) for c in (a, b))
            held.append(mix64(x[:, None] * np.uint64(0x632BE59BD9B4E019) ^ y[None, :]).ravel())
            docs.append(np.full(len(held[-1]), doc))
            size += len(held[-1])
            if size > 1 << 18 or i == len(ids) - 1:
                yield arrow_batch(_ENTRY, [np.concatenate(docs), signed(np.concatenate(held))])
                held, docs, size = [], [], 0


def entries(classes: DataFrame) -> DataFrame:
    """(doc_id, token) of all table entries that several classes may share."""
    halves = materialize(classes.mapInArrow(_apart, "doc_id long, s1 long, place int, half long"), "minhash-halves")
    several = halves.groupBy("place", "half").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("place", "half")
    shared = halves.join(small(materialize(several, "minhash-several")), ["place", "half"], "left_semi")
    # at most 2 M half keys of a class come together
    both = shared.groupBy("doc_id", "s1").agg(F.collect_list(F.when(F.col("place") < M, F.col("half"))).alias("first"), F.collect_list(F.when(F.col("place") >= M, F.col("half"))).alias("second"))
    made = both.where((F.size("first") > 0) & (F.size("second") > 0)).mapInArrow(_combined, "doc_id long, token long")
    made = materialize(made, "minhash-made")
    told = made.groupBy("token").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("y")).where("leader < y").select("token", "leader")
    return materialize(made.join(told, "token"), "minhash-entries")


def _send(k: int):
    """For each class and place where it is compared: its set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            others = [batch.column(c).to_pylist() for c in ("doc_id", "n", "s1", "component", "halves")]
            for at, texts in chunks(binary(batch.column("text"))):
                sets = shingle_sets(texts, k)
                rows, size = [], 0
                for i in np.flatnonzero(_is_own(batch, at, sets)):
                    what = sets[i].tobytes()
                    for p in places[int(at + i)].as_py():
                        rows.append((*(p[c] for c in _PLACE), *(x[at + i] for x in others), what))
                        size += len(what) + 300
                        if size > 1 << 24:
                            yield arrow_batch(_SENT, zip(*rows, strict=True))
                            rows, size = [], 0
                if rows:
                    yield arrow_batch(_SENT, zip(*rows, strict=True))

    return scan


def meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of half keys a share a table entry with which of b."""
    either = [np.zeros((len(a), len(b)), dtype=bool) for _ in range(2)]
    for place in range(2 * M):
        either[place // M] |= np.equal.outer(a[:, place], b[:, place])
    return either[0] & either[1]


def links_between(a: list[np.ndarray], b: list[np.ndarray], near: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The links among the pairs that ``near`` marks, by their whole sets."""
    n, m = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
    near = near & (100 * np.minimum.outer(n, m) >= percent * np.maximum.outer(n, m))
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64),) * 2]
    for i in np.flatnonzero(near.any(axis=1)):
        js = np.flatnonzero(near[i])
        for some in np.array_split(js, -(-int(m[js].sum()) // (1 << 22))):
            every = np.concatenate([b[j] for j in some])
            hit = a[i][np.minimum(np.searchsorted(a[i], every), n[i] - 1)] == every
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(m[some]) - m[some])
            some = some[100 * common >= percent * (n[i] + m[some] - common)]
            found.append((np.full(len(some), i), some))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _judge(percent: int):
    """Rows come sorted by place; each pair of blocks gives edges from its classes to the least that their links reach."""

    def judged(rows: dict[tuple, dict]) -> Iterator[pa.RecordBatch]:
        sides = [[r for x, r in sorted(rows.items()) if x[0] == side] for side in (0, 1)]
        left, right = sides[0], sides[1] or sides[0]
        if len(left) + len(sides[1]) < 2 or not left:
            return
        halves, sets = ([[np.frombuffer(r[c], dtype=np.uint64) for r in side] for side in (left, right)] for c in ("halves", "tokens"))
        near = meeting(*(np.array(x) for x in halves))
        near &= np.not_equal.outer(*([r["component"] for r in side] for side in (left, right)))
        if not sides[1]:
            near &= np.tri(len(left), k=-1, dtype=bool).T
        i, j = links_between(*sets, near, percent)
        if len(i):
            ids = np.array([r["doc_id"] for r in (*left, *sides[1])])
            reached = _least_reached(len(ids), i, j + (len(left) if sides[1] else 0))
            at = np.flatnonzero(reached != np.arange(len(ids)))
            yield arrow_batch(_EDGE, [ids[at], ids[reached[at]]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in _SENT.names]
            for r in zip(*columns, strict=True):
                if r[:4] != now:
                    yield from judged(rows)
                    now, rows = r[:4], {}
                # a class that is sent twice is there once
                rows[r[4], r[5], r[7]] = dict(zip(_SENT.names, r, strict=True))
        yield from judged(rows)

    return scan


def _verified(texts: DataFrame, classes: DataFrame, meetings: DataFrame, k: int, percent: int, label: str) -> DataFrame:
    """(a, b) links that verification confirms at the places of meeting. classes: (doc_id, n, s1, halves, component)."""
    places = materialize(meetings.select(*_PLACE, "doc_id"), f"minhash-{label}-places")
    known = materialize(classes, f"minhash-{label}-classes")
    # the places of a class are some of those of its entries, so at most M * M leaders or pairs of blocks there
    lists = places.groupBy("doc_id").agg(F.collect_list(F.struct(*_PLACE)).alias("places"))
    placed = lists.join(known, "doc_id")
    placed = materialize(placed, f"minhash-{label}-placed")
    bound = small if places.count() <= 100_000 else (lambda df: df)
    sent = texts.join(bound(placed), "doc_id").mapInArrow(_send(k), _SENT_DDL)
    sent = sent.repartition(*_PLACE[:4]).sortWithinPartitions(*_PLACE[:4])
    return materialize(sent.mapInArrow(_judge(percent), "a long, b long"), f"minhash-{label}-links")


def _to_leaders(posting: DataFrame, sizes: DataFrame) -> DataFrame:
    """Places where classes meet the leader of most of their entries: a leader, and a bounded block of its followers."""
    often = posting.where("doc_id <> leader").groupBy("doc_id", "leader").agg(F.count("*").alias("c"))
    follows = often.groupBy("doc_id").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("leader"))
    follows = materialize(follows.join(sizes, "doc_id"), "minhash-follows")
    blocks = follows.groupBy("leader").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    blocks = materialize(blocks, "minhash-blocks")
    dealt = follows.join(small(blocks), "leader").withColumn("i", F.pmod(F.xxhash64("doc_id"), "blocks"))
    dealt = dealt.select(F.col("leader").alias("ka"), F.lit(0).cast("long").alias("ia"), F.col("leader").alias("kb"), F.col("i").alias("ib"), F.lit(1).cast("long").alias("side"), "doc_id")
    dealt = materialize(dealt, "minhash-dealt")
    leads = dealt.select("ka", "ia", "kb", "ib", F.lit(0).cast("long").alias("side"), F.col("ka").alias("doc_id")).distinct()
    return dealt.unionByName(leads)


def link_documents(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, kept): component_id is the least id that links reach, class_id the least
    id of an equal set, kept whether the row's id is its component's (or null)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = docs.where("doc_id is not null and text is not null")
    keys = materialize(docs.mapInArrow(_keys(k), _KEYS_DDL), "minhash-keys")
    named = keys.where("n > 0 and doc_id is not null")
    reps = named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.any_value("halves").alias("halves"))
    reps = materialize(reps, "minhash-reps")
    posting = entries(reps.select("doc_id", "s1", "halves"))
    sizes = materialize(reps.groupBy("doc_id").agg(F.sum("n").alias("n")), "minhash-sizes")
    alone = reps.select("doc_id", "n", "s1", "halves", F.col("doc_id").alias("component"))
    # an id of several texts joins their classes
    several = named.groupBy("doc_id").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x <> y").select("doc_id")
    pooled = named.join(small(materialize(several, "minhash-ids")), "doc_id", "left_semi").join(reps.withColumnRenamed("doc_id", "rep").drop("halves"), ["n", "s1", "s2"])
    pooled = pooled.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")

    led = _verified(texts, alone, _to_leaders(posting, sizes), k, percent, "led")
    first = materialize(connected_components(led.unionByName(pooled), "minhash-first"), "minhash-joined")
    component = F.coalesce("component", "doc_id").alias("component")
    of_first = first.withColumnRenamed("node", "doc_id")
    mixed = posting.select("token", "doc_id").join(small(of_first), "doc_id", "left").select("token", "doc_id", component)
    mixed = materialize(mixed, "minhash-mixed")
    open_ = mixed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
    left = materialize(mixed.join(small(materialize(open_, "minhash-open")), "token", "left_semi").select("token", "doc_id"), "minhash-left")
    known = alone.drop("component").join(of_first, "doc_id", "left").select("doc_id", "n", "s1", "halves", component)
    rest = _verified(texts, known, _meetings(left, sizes), k, percent, "rest")
    final = first
    if not rest.isEmpty():
        edges = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)
        final = materialize(connected_components(edges, "minhash-final"), "minhash-components")

    told = reps.select("n", "s1", "s2", F.col("doc_id").alias("rep")).join(final.withColumnRenamed("node", "rep"), "rep", "left")
    told = materialize(told.select("n", "s1", "s2", "rep", F.coalesce("component", "rep").alias("component")), "minhash-told")
    rows = keys.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("n")).alias("n"), "s1", "s2")
    out = rows.join(small(told), ["n", "s1", "s2"], "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce("rep", "doc_id").alias("class_id"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
