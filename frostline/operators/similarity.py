"""Near-duplicate vectors: an exact cosine self-join in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.sources.store import written

# Fixed value: cosine over which vectors are near duplicates.
THRESHOLD = 0.95
#: About how many vectors a block holds, most pivots, vectors that a task multiplies at a time.
BLOCK, MOST_PIVOTS, ROWS = 2048, 4096, 512
#: Tiles that a table is cut into, and about how many vectors and bytes a tile holds at most (beyond that there are more tiles).
TILES, MOST_TILE, TILE_BYTES = 16, 65_536, 32 << 20
#: Coordinates after which pairs are bounded by what the rest can still add: of 16, 32 and then all.
STEPS = (16, 32)
#: What rounding may add to a product of unit vectors.
SLACK = 1e-9
_UNIT = pa.schema([("vec_id", pa.int64()), ("e", pa.binary()), ("key", pa.binary())])


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector, scaled to length 1, and its content key; null vectors and entries count as zeros."""
    import hashlib

    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = np.array([0.0 if c is None else c for c in v or []], dtype=np.float64)
            out.append((x / (np.linalg.norm(x) + 1e-9)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.binary()), pa.array([hashlib.md5(x).digest() for x in out], type=pa.binary())], schema=_UNIT)


def _matrix(column: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), dims)


def _whole(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """The same of a column without a Python object for each row."""
    chunk = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    first = np.frombuffer(chunk.buffers()[1], dtype=np.int32, count=1, offset=4 * chunk.offset)[0]
    return np.frombuffer(chunk.buffers()[2], dtype=np.float64, count=len(chunk) * dims, offset=int(first)).reshape(len(chunk), dims)


def near_flags(a: np.ndarray, b: np.ndarray, threshold: float, same: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Which rows of a, and of b, have a product over the threshold with one of the other side; how many pairs were multiplied in full.

    A pair goes on only if its product over the leading coordinates and the lengths of what remains of both (the most
    that these can add) reach the threshold. ``same``: a is b, and a row doesn't meet itself.
    """
    rest = [[np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x[:, :k], x[:, :k]))) for k in STEPS] for x in (a, b)]
    hit_a, hit_b, whole = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool), 0
    for lo in range(0, len(a), ROWS):
        part = a[lo : lo + ROWS]
        told = part[:, : STEPS[0]] @ b[:, : STEPS[0]].T
        may = told + np.outer(rest[0][0][lo : lo + ROWS], rest[1][0]) > threshold - SLACK
        if same:
            may &= np.arange(len(b)) > np.arange(lo, lo + len(part))[:, None]
        i, j = np.nonzero(may)
        if 4 * len(i) > may.size:
            # hardly any pair is ruled out: one product of all
            over = may & (part @ b.T > threshold)
            whole += int(may.sum())
            hit_a[lo : lo + ROWS] |= over.any(axis=1)
            hit_b |= over.any(axis=0)
            continue
        for at in range(0, len(i), 1 << 17):
            x, y = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            more = told[x, y] + np.einsum("ij,ij->i", part[x, STEPS[0] : STEPS[1]], b[y, STEPS[0] : STEPS[1]])
            stay = more + rest[0][1][lo + x] * rest[1][1][y] > threshold - SLACK
            x, y = x[stay], y[stay]
            whole += len(x)
            over = np.einsum("ij,ij->i", part[x], b[y]) > threshold
            hit_a[lo + x[over]] = True
            hit_b[y[over]] = True
    if same:
        hit_a |= hit_b
    return hit_a, hit_b, whole


def _cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, e, cell, angle): the nearest pivot of each vector and the angle to it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                cosine = _matrix(part.column("e").to_pylist(), pivots.shape[1]) @ pivots.T
                cell = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("e"), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["vec_id", "e", "cell", "angle"])

    return vectors.mapInArrow(scan, "vec_id long, e binary, cell int, angle double")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, most_pivots: int = MOST_PIVOTS, counts: dict[str, int] | None = None) -> DataFrame:
    """(vec_id, near): whether another vector has a cosine over the threshold (0 < threshold < 1). Exact.

    1. Equal vectors fold into one; those that are no zero vectors are near.
    2. A bounded number of pivots, drawn by hash, part the vectors into cells, and cells into blocks of bounded size. Two cells
       meet unless the angle between their pivots exceeds their radii and the angle of the threshold together, in which case
       no pair of theirs can be near (the triangle inequality of angles).
    3. Neighbouring blocks make up tiles, ``TILES`` of them until a tile would hold more than a task should. Two tiles come
       together in one task, with just the blocks that meet one of the other tile, so a vector is sent ``TILES`` times at most
       while tiles are that few, however many blocks there are.
    4. In a task blocks that meet are multiplied, leading coordinates first: pairs are left as soon as what remains of
       both vectors can't lift the product over the threshold.

    Clustered vectors are pruned by 2, scattered ones by 4. No pair becomes a row. Null vectors and vectors of zeros are near
    nothing; vectors of different lengths aren't compared. vec_id is unique. counts, if given, gets how many rows are sent to pairs of tiles.
    """
    spark = vectors.sparkSession
    unit = written(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_unit, "vec_id long, e binary, key binary"), "near-unit")
    folded = written(unit.groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.any_value("e").alias("e")), "near-folded")
    none = F.expr("e = repeat(x'00', length(e))")
    lengths = [r["n"] for r in folded.where(~none).select(F.octet_length("e").alias("n")).distinct().collect()]
    close = None
    for length in sorted(lengths):
        found = _near_of(folded.where(~none & (F.octet_length("e") == length)), length // 8, threshold, block, most_pivots, counts)
        close = found if close is None else close.unionByName(found)
    alike = folded.where(~none & (F.col("copies") > 1)).select("vec_id")
    close = alike if close is None else close.unionByName(alike)
    near = folded.select("key", "vec_id").join(close.distinct().withColumn("near", F.lit(True)), "vec_id", "left").select("key", "near")
    return unit.select("vec_id", "key").join(near, "key").select("vec_id", F.coalesce("near", F.lit(False)).alias("near"))


def _chain(pivots: np.ndarray) -> list[int]:
    """The pivots in an order in which each is followed by the nearest one that is left."""
    left, order = np.ones(len(pivots), dtype=bool), [0]
    left[0] = False
    while len(order) < len(pivots):
        order.append(int(np.where(left, pivots @ pivots[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return order


def _tiles(order: list[int], sizes: np.ndarray, blocks: np.ndarray, tile: int) -> dict[tuple[int, int], int]:
    """The tile of each block (cell, i): blocks of cells in order, until a tile is full."""
    out, at, held = {}, 0, 0.0
    for c in order:
        for i in range(blocks[c]):
            size = sizes[c] / blocks[c]
            if held and held + size > tile:
                at, held = at + 1, 0.0
            out[c, i] = at
            held += size
    return out


def _near_of(vectors: DataFrame, dims: int, threshold: float, block: int, most_pivots: int, counts: dict[str, int] | None = None) -> DataFrame:
    """vec_id of the distinct unit vectors (vec_id, e) of one length that are near another."""
    n = vectors.count()
    tile = min(MOST_TILE, max(1, TILE_BYTES // (8 * dims)), max(64, -(-n // TILES)))
    # some blocks make up a tile, so that tiles come out alike
    block = min(block, max(64, -(-tile // 4)))
    wanted = min(most_pivots, -(-n // block))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()
    pivots = _matrix([bytes(r["e"]) for r in chosen], dims)
    celled = written(_cells(vectors.select("vec_id", "e"), pivots), "near-cells")
    table = celled.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()
    radius, sizes = np.full(len(pivots), -np.inf), np.zeros(len(pivots), dtype=np.int64)
    for r in table:
        radius[r["cell"]], sizes[r["cell"]] = r["radius"], r["n"]
    blocks = -(-sizes // block)
    tiles = _tiles(_chain(pivots), sizes, blocks, tile)
    apart = np.arccos(threshold) + 1e-7

    def meeting(c: int) -> np.ndarray:
        return np.arccos(np.clip(pivots @ pivots[c], -1.0, 1.0)) <= radius + radius[c] + apart

    of_cell = [sorted({tiles[c, i] for i in range(blocks[c])}) for c in range(len(pivots))]

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors with the tiles a and b whose pair they are sent to, and whether they are of b."""
        sent: dict[int, list[int]] = {}
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            own = batch.column("i").to_numpy()
            at, a, b = [], [], []
            for c in np.unique(cells).tolist():
                if c not in sent:
                    sent[c] = sorted({t for d in np.flatnonzero(meeting(c)) for t in of_cell[d]})
                for i in np.unique(own[cells == c]).tolist():
                    rows, t = np.flatnonzero((cells == c) & (own == i)), tiles[c, i]
                    at += [rows] * len(sent[c])
                    a += [np.full(len(rows), min(t, u)) for u in sent[c]]
                    b += [np.full(len(rows), max(t, u)) for u in sent[c]]
            if not at:
                continue
            at, a, b = np.concatenate(at), np.concatenate(a).astype(np.int32), np.concatenate(b).astype(np.int32)
            # some rows at a time: each one is there as often as it has tiles to meet
            for lo in range(0, len(at), 8 * ROWS):
                part = batch.take(pa.array(at[lo : lo + 8 * ROWS]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(a[lo : lo + 8 * ROWS]), pa.array(b[lo : lo + 8 * ROWS])], names=["vec_id", "e", "cell", "i", "a", "b"])

    count = F.element_at(F.array(*(F.lit(int(x)) for x in np.maximum(blocks, 1))), F.col("cell") + 1)
    dealt = celled.select("vec_id", "e", "cell", F.pmod(F.xxhash64("vec_id"), count).cast("int").alias("i"))
    sent = dealt.mapInArrow(partners, "vec_id long, e binary, cell int, i int, a int, b int")
    if counts is not None:
        counts["sent"] = counts.get("sent", 0) + sent.count()

    def judge(pair: pa.Table) -> pa.Table:
        if not len(pair):
            return pa.table({"vec_id": pa.array([], type=pa.int64())})
        e, ids = _whole(pair.column("e"), dims), pair.column("vec_id").to_numpy()
        cells, own = pair.column("cell").to_numpy(), pair.column("i").to_numpy()
        order = np.lexsort((own, cells))
        starts = np.flatnonzero(np.concatenate([[True], np.diff(cells[order]).astype(bool) | np.diff(own[order]).astype(bool)]))
        held = [(int(cells[rows[0]]), int(own[rows[0]]), rows) for rows in np.split(order, starts[1:])]
        a, b = pair.column("a")[0].as_py(), pair.column("b")[0].as_py()
        hit = np.zeros(len(pair), dtype=bool)
        for at, (c, i, rows) in enumerate(held):
            if tiles[c, i] != a:
                continue
            meets, left = meeting(c), e[rows]
            for x, (d, j, others) in enumerate(held):
                if tiles[d, j] != b or not meets[d] or (a == b and x < at):
                    continue
                if x == at:
                    hit[rows] |= near_flags(left, left, threshold, same=True)[0]
                else:
                    hit_a, hit_b, _ = near_flags(left, e[others], threshold)
                    hit[rows] |= hit_a
                    hit[others] |= hit_b
        return pa.table({"vec_id": pa.array(ids[hit], type=pa.int64())})

    return written(sent.groupBy("a", "b").applyInArrow(judge, "vec_id long").distinct(), "near-found")


def near_duplicate_rate(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: the share of near duplicates; 0 for fewer than two vectors."""
    return near_duplicates(vectors, threshold).agg(F.when(F.count("*") < 2, 0.0).otherwise(F.avg(F.col("near").cast("int"))).alias("near_duplicate_rate"))
