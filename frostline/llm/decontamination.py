"""Benchmark decontamination with SimHash over item-sized windows; DataFrame functions only.

1. Words are runs of other characters than 0x20 and 0x09-0x0D, lower-cased; shingles are ``k`` words.
2. Windows of as many words as an item has are laid at every start where the shingles inside that the item has, too, weigh a
   ``PLACED`` part of the item's. A window as similar as ``least`` shares twice that at least, so no such start is left out;
   whether a window resembles an item is decided by the next two steps.
3. Windows of equal words are one. Each gets a SimHash of ``BITS`` bits of its shingles, weighted by how few items
   have them: whole-number sums of three bits at a time, packed in longs. The bits are cut into ``blocks`` blocks; of two fingerprints within the radius, one block at least
   differs in no more than radius / blocks bits. So the items' blocks with all flips of so few bits, joined with the
   windows' blocks on (window size, block number, block bits), give all fingerprints within the radius.
4. Candidates within the radius are verified by the exact weighted Jaccard similarity of their shingle sets.

Two unrelated fingerprints meet in a block about once in five times and never lie within the radius. A pair right at the threshold lies outside it about once in a thousand; closer ones less.

The item shingles are broadcast only after their number is checked, and are joined by a shuffle beyond it.
Null text has no words. Null ids take no part. Rows with equal ids are one document. Items of under ``k``
words are too short to tell a leak from chance and match nothing; items have a million words at most. Of equally similar
windows the first one is told. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, small

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint (in longs of 64), its blocks (as many in each long), and the radius.
BITS, BLOCKS, RADIUS = 256, 20, 57
#: Share of an item's weight that a window shares to be looked at: half of what it must share to be alike.
PLACED = 0.4
#: Bits of a counter, three of which a long holds.
_COUNTER = 21


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def with_shingles(df: DataFrame, k: int) -> DataFrame:
    """Replaces text by sh, the hashes of all its k-word shingles in order (empty under k words)."""
    # bound as a lambda's variable, the words are split once a row
    hashed = lambda w: lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))
    each = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), hashed(w))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("sh", F.transform(F.array(words(F.col("text"))), each)[0]).drop("text")


def _weighted(df: DataFrame, key: list[str], weights: DataFrame, default: float) -> DataFrame:
    """For each key: fs, its distinct shingles with weights; total, their sum; fp, the SimHash."""
    rows = df.select(*key, F.size("ws").alias("size"), F.explode(F.array_distinct("ws")).alias("h")).join(weights, "h", "left")
    rows = materialize(rows.withColumn("weight", F.coalesce("weight", F.lit(default))), "leaks-shingles")
    # whole weights whose sum fits a counter
    whole = F.greatest(F.lit(1), F.floor(F.col("weight") / default * (1 << (_COUNTER - 1)) / F.col("size"))).cast("long")
    wide = rows.select(*key, whole.alias("u"), *(F.xxhash64("h", F.lit(i)).alias(f"w{i}") for i in range(BITS // 64)))
    bit = lambda i, b: f"shiftleft(shiftrightunsigned(w{i}, {b}) & 1L, {_COUNTER * (b % 3)})"
    packs = [(i, range(b, min(b + 3, 64))) for i in range(BITS // 64) for b in range(0, 64, 3)]
    sums = wide.groupBy(*key).agg(F.sum("u").alias("u"), *(F.sum(F.expr(f"u * ({' + '.join(bit(i, b) for b in bits)})")).alias(f"s{n}") for n, (i, bits) in enumerate(packs)))
    each = len(packs) * 64 // BITS
    sums = sums.select(*key, "u", F.array(*(f"s{n}" for n in range(len(packs)))).alias("s"))
    on = f"2 * (shiftright(s[j * {each} + b div 3], int({_COUNTER} * (b % 3))) & {(1 << _COUNTER) - 1}L) > u"
    # bound as a lambda's variable, the sums are put into an array once a row and not once a bit
    fp = F.expr(f"transform(array(s), s -> transform(sequence(0, {BITS // 64 - 1}), j -> aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if({on}, shiftleft(1L, b), 0L))))[0]")
    sets = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("h", "weight"))).alias("fs"))
    return sets.join(sums.select(*key, fp.alias("fp")), key).withColumn("total", F.expr("aggregate(fs, 0D, (s, x) -> s + x.weight)"))


def _cuts(blocks: int) -> list[tuple[int, int, int]]:
    """(long, first bit, width) of each block; no block crosses two longs."""
    each = blocks // (BITS // 64)
    edges = [64 * i // each for i in range(each + 1)]
    return [(j, a, b - a) for j in range(BITS // 64) for a, b in zip(edges, edges[1:], strict=False)]


def window_blocks(blocks: int) -> Column:
    """The blocks of fp as an array of (number, bits)."""
    return F.array(*(F.struct(F.lit(i).alias("no"), F.expr(f"shiftrightunsigned(fp[{j}], {a}) & {(1 << w) - 1}L").alias("bits")) for i, (j, a, w) in enumerate(_cuts(blocks))))


def item_probes(blocks: int, radius: int) -> Column:
    """The same with every flip of at most radius / blocks bits of a block."""
    each = []
    for i, (j, a, w) in enumerate(_cuts(blocks)):
        masks = [sum(1 << x for x in bits) for n in range(radius // blocks + 1) for bits in itertools.combinations(range(w), n)]
        own = F.expr(f"shiftrightunsigned(fp[{j}], {a}) & {(1 << w) - 1}L")
        each.append(_flipped(i, own, masks))
    return F.flatten(F.array(*each))


def _flipped(number: int, own: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.struct(F.lit(number).alias("no"), own.bitwiseXOR(m).alias("bits")))


def distance(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def find_leaks(docs: DataFrame, items: DataFrame, k: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, counts: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the most similar window of each document and item.

    counts, if given, gets how many pairs of a window and an item each step leaves.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    items = materialize(with_shingles(items, k).where("size(sh) > 0"), "leaks-items").withColumn("n", F.size("sh") + (k - 1))
    of_item = materialize(items.select("item_id", "n", F.posexplode("sh").alias("at", "h")), "leaks-anchors")
    n_items = items.count()
    default = math.log(n_items + 1.0)
    weights = of_item.groupBy("h").agg(F.countDistinct("item_id").alias("df")).where("df > 1")
    weights = small(materialize(weights.select("h", F.log(F.lit(float(n_items)) / F.col("df") + 1.0).alias("weight")), "leaks-weights"))

    # each place of an item's shingle in a document
    weighed = of_item.select("item_id", "n", "h").distinct().join(weights, "h", "left").withColumn("weight", F.coalesce("weight", F.lit(default)))
    weighed = materialize(weighed, "leaks-weighed")
    totals = materialize(weighed.groupBy("item_id").agg((F.sum("weight") * min(PLACED, least) * (1 - 1e-9)).alias("need")), "leaks-needs")
    anchors = small(materialize(weighed.select("h").distinct(), "leaks-places"))
    # the outer form keeps the optimiser from computing the shingles twice, for a filter on empty arrays
    rows = with_shingles(docs, k).select("doc_id", F.size("sh").alias("size"), F.posexplode_outer("sh").alias("p", "h"))
    places = materialize(rows.join(anchors, "h"), "leaks-hits").join(small(weighed), "h")
    enough = materialize(places.select("doc_id", "item_id", "h", "weight").distinct().groupBy("doc_id", "item_id").agg(F.sum("weight").alias("w")).join(totals, "item_id").where("w >= need").select("doc_id", "item_id", "need"), "leaks-pairs")
    found = places.join(small(enough), ["doc_id", "item_id"])
    # a document shorter than the item is one window
    width = F.least(F.col("n") - (k - 1), F.col("size"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("p") - width + 1), F.least(F.col("p"), F.col("size") - width))
    hit = found.select("doc_id", "item_id", "n", "need", "h", "weight", F.explode(starts).alias("start")).distinct()
    laid = hit.groupBy("doc_id", "item_id", "n", "need", "start").agg(F.sum("weight").alias("w")).where("w >= need")
    laid = materialize(laid.select("doc_id", "start", "n").distinct(), "leaks-windows")
    of_doc = laid.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("laid"))
    of_doc = materialize(of_doc, "leaks-laid")
    windows = with_shingles(docs.join(small(of_doc), "doc_id"), k).select("doc_id", F.explode_outer("laid").alias("x"), "sh")
    windows = windows.select("doc_id", "x.start", "x.n", F.expr(f"slice(sh, x.start + 1, x.n - {k - 1})").alias("ws"))
    key = [F.xxhash64("ws").alias("k1"), F.hash(F.reverse("ws")).alias("k2")]
    windows = materialize(windows.where("size(ws) > 0").select("doc_id", "start", "n", "ws", *key), "leaks-contents")

    contents = windows.groupBy("n", "k1", "k2").agg(F.first("ws").alias("ws"))
    prints = materialize(_weighted(contents, ["n", "k1", "k2"], weights, default), "leaks-prints")
    of_items = _weighted(items.select("item_id", "n", F.col("sh").alias("ws")), ["item_id", "n"], weights, default)
    of_items = materialize(of_items, "leaks-itemprints")

    left = prints.select("n", "k1", "k2", "fp", F.explode(window_blocks(blocks)).alias("b")).select("n", "k1", "k2", "fp", "b.no", "b.bits")
    right = of_items.select("item_id", "n", F.col("fp").alias("fp_i"), F.explode(item_probes(blocks, radius)).alias("b")).select("item_id", "n", "fp_i", "b.no", "b.bits")
    met = left.join(right, ["n", "no", "bits"])
    near = met.where(distance("fp", "fp_i") <= radius)
    near = near.select("n", "k1", "k2", "item_id").distinct()
    both = near.join(prints, ["n", "k1", "k2"]).join(of_items.select("item_id", "n", F.col("fs").alias("fs_i"), F.col("total").alias("total_i")), ["item_id", "n"])
    common = F.expr("aggregate(array_intersect(fs, fs_i), 0D, (s, x) -> s + x.weight)")
    alike = both.select("n", "k1", "k2", "item_id", (common / (F.col("total") + F.col("total_i") - common)).alias("similarity")).where(F.col("similarity") >= least)
    alike = materialize(alike, "leaks-alike")
    if counts is not None:
        near = materialize(near, "leaks-near")
        counts |= {"windows": prints.count(), "in a block": met.select("n", "k1", "k2", "item_id").distinct().count(), "within the radius": near.count(), "alike": alike.count()}
    hits = windows.select("doc_id", "start", "n", "k1", "k2").join(alike, ["n", "k1", "k2"])
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.back")).alias("start_word"), F.col("m.n").alias("n_words"), F.round("m.similarity", 6).alias("similarity"))


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The same columns without the documents that hold a leaked item."""
    leaked = find_leaks(docs, items, k, least).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
