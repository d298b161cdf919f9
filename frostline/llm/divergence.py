"""Source divergence audit: how far the sources of a language lie from each other, and which terms set each one apart.

A term is a run of letters A-Z, a-z and code points over 0x7F, with A-Z lower-cased. A language keeps the terms of at least
``LEAST_DOCS`` of its documents; V counts these. Every group (language, source) and every language gives each kept term the
probability p = 1 + floor(SCALE * (count + 1) / (N + V)), N being its sum of counts, in whole numbers. The divergence of p
from q at a term is floor((p - q)**2 / q).

* Sums over all kept terms are sparse: two sources that both lack a term differ by a baseline. To V times the baseline come
  corrections for the terms of one source against the baseline of the other, taken from histograms of counts, and corrections
  for terms that both have, from one pass over the kept terms, in which tasks add up pairs of sources and emit sums alone.
* The first ``k`` terms of each group come by radix selection: histograms over 16 bits of the value at a time, counted
  before the shuffle, find the digits of the kth value; where too many rows tie, histograms over two UTF-8 bytes of the term
  at a time go on. What is then ranked in one place are at most k and ``SETTLED`` rows of a group.

Null text, language and source count as ''. A document is a row: repeated rows and ids count each. Groups without terms and
languages without kept terms have pairs of value 0. Empty texts give no terms, very long texts are taken whole. Other
columns are left aside. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batch, binary, materialize, read, small

LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Rows of a group that selection may leave undecided: the last sort ranks them.
SETTLED = 1024
#: Bytes of text that a task counts together.
_FLUSH_BYTES = 32 << 20
#: Pairs of entries that a task expands at a time, and pairs of sources that it holds.
_PAIRS, _HELD = 1 << 21, 1 << 20
#: Low bits of a value; sums of both parts stay exact.
_LOW = 30

#: Bytes of terms, A-Z lower-cased; a blank for all others.
_LETTERS = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("docs", pa.int64())])
_COUNTS_DDL = "lang string, source string, term string, c long, docs long"
_BOTH = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("hi", pa.int64()), ("lo", pa.int64())])
_BOTH_DDL = "lang string, source string, item string, hi long, lo long"
_GROUP = ["lang", "source"]


def _counted(keys: list[tuple[bytes, bytes]], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Counts of terms, and of documents that have them, in each group of some texts; each group also has a row without a term."""
    groups: dict[tuple[bytes, bytes], int] = {}
    of_doc = np.array([groups.setdefault(x, len(groups)) for x in keys], dtype=np.int64)
    langs, sources = (pa.array([x[i] for x in groups], type=pa.binary()).cast(pa.string()) for i in (0, 1))
    zeros = [0] * len(groups)
    yield arrow_batch(_COUNTS, [langs, sources, pa.nulls(len(groups), pa.string()), zeros, zeros])
    lists = pc.ascii_split_whitespace(pa.array(texts, type=pa.large_binary()).cast(pa.large_string()))
    found = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    pair, often = np.unique(doc << 32 | found.indices.to_numpy().astype(np.int64), return_counts=True)
    code = of_doc[pair >> 32] << 32 | pair & 0xFFFFFFFF
    code = code[order := np.argsort(code, kind="stable")]
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else code
    if len(start):
        group, terms = code[start] >> 32, found.dictionary.cast(pa.string()).take(pa.array(code[start] & 0xFFFFFFFF))
        batch = arrow_batch(_COUNTS, [langs.take(pa.array(group)), sources.take(pa.array(group)), terms, np.add.reduceat(often[order], start), np.diff(np.append(start, len(code)))])
        yield batch.filter(pc.not_equal(terms, ""))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``_counted`` tells of texts of about ``_FLUSH_BYTES`` together."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for lang, source, text in zip(*(binary(batch.column(c)) for c in ("lang", "source", "text")), strict=True):
            keys.append((lang, source))
            texts.append(text.translate(_LETTERS))
            size += len(text)
            if size > _FLUSH_BYTES:
                yield from _counted(keys, texts)
                keys, texts, size = [], [], 0
    if keys:
        yield from _counted(keys, texts)


def probability(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total) without overflow; null for a total of 0."""
    return (F.call_function("div", F.lit(SCALE).cast("decimal(18,0)") * (count + 1), F.nullif(total, F.lit(0)).cast("decimal(18,0)")) + 1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, by: its sources with p there and p of count 0): for pairs of sources, what the terms that both have
    add to the sum that holds one-sided corrections, in high and low parts."""
    names: dict[tuple[str, str], int] = {}
    codes, hi, lo = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def told() -> pa.RecordBatch:
        every = list(names)
        a, b = codes >> 32, codes & 0xFFFFFFFF
        return arrow_batch(_BOTH, [[every[x][0] for x in a], [every[x][1] for x in a], [every[x][1] for x in b], hi, lo])

    for batch in batches:
        by = batch.column("by")
        offsets = by.offsets.to_numpy()
        size = np.diff(offsets)
        flat = by.values.slice(offsets[0], offsets[-1] - offsets[0])
        start = np.repeat(offsets[:-1] - offsets[0], size)
        size = np.repeat(size, size)
        langs = np.repeat(np.array(batch.column("lang").to_pylist(), dtype=object), np.diff(offsets))
        me = np.fromiter((names.setdefault((x, y), len(names)) for x, y in zip(langs, flat.field("source").to_pylist(), strict=True)), dtype=np.int64, count=len(langs))
        p, p0 = (flat.field(c).to_numpy() for c in ("p", "p0"))
        ends = np.cumsum(size)
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
            i = np.repeat(np.arange(at, to), size[at:to])
            j = np.arange(len(i)) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to]) + start[i]
            i, j = i[i != j], j[i != j]
            more = _divergence(p[i], p[j]) - _divergence(p[i], p0[j]) - _divergence(p0[i], p[j]) + _divergence(p0[i], p0[j])
            codes, back = np.unique(np.concatenate([codes, me[i] << 32 | me[j]]), return_inverse=True)
            sums = [np.zeros(len(codes), dtype=np.int64) for _ in range(2)]
            for total, before, part in zip(sums, (hi, lo), (more >> _LOW, more & (1 << _LOW) - 1), strict=True):
                np.add.at(total, back, np.concatenate([before, part]))
            hi, lo = sums
            at = to
            if len(codes) > _HELD:
                yield told()
                codes, hi, lo = (np.zeros(0, dtype=np.int64) for _ in range(3))
    if len(codes):
        yield told()


def top_ranked(rows: DataFrame, keys: list[str], k: int, settled: int = SETTLED) -> DataFrame:
    """The first k rows (keys, item, value >= 0) of each group by falling value, then by UTF-8 bytes of item, with their rank.

    ``rows`` should be a written table: each digit is one pass over it. Items of a group are distinct.
    """
    raw = F.col("item").cast("binary")
    found = None  # (keys, shift, prefix, tied, need[, bytes, lead])

    def narrowed(alive: DataFrame, digit: Column, falling: bool, need: Column) -> DataFrame:
        """The digit in which the kth row of each group lies, how many rows share it, and how many of these are needed."""
        hist = alive.groupBy(*keys, digit.alias("digit")).agg(F.count("*").alias("tied"), F.first(need).alias("need"))
        # at most 65536 digits of a group
        before = Window.partitionBy(*keys).orderBy(F.col("digit").desc() if falling else F.col("digit")).rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("tied").over(before), F.lit(0)))
        return hist.where("before < need AND before + tied >= need").select(*keys, "digit", "tied", (F.col("need") - F.col("before")).alias("need"))

    for shift in (48, 32, 16, 0):
        if found is None:
            cut = narrowed(rows, F.shiftright("value", shift), True, F.lit(k).cast("long"))
        else:
            open_ = found.where((F.col("tied") > settled) & (F.col("tied") > F.col("need")))
            alive = rows.join(small(open_.select(*keys, "shift", "prefix", "need")), keys).where(F.expr("shiftright(value, shift) = prefix"))
            cut = narrowed(alive, F.shiftright("value", shift), True, F.col("need"))
        cut = cut.select(*keys, F.lit(shift).alias("shift"), F.col("digit").alias("prefix"), "tied", "need", F.lit(0).alias("bytes"), F.lit(None).cast("binary").alias("lead"))
        cut = materialize(cut, "rank-values")
        found = cut if found is None else materialize(found.join(cut.select(*keys), keys, "left_anti").unionByName(cut), "rank-found")
    n = 0
    while not (open_ := found.where((F.col("tied") > settled) & (F.col("tied") > F.col("need")))).isEmpty():
        head = lambda size: F.substring(raw, 1, size)
        alive = rows.join(small(open_.select(*keys, "prefix", "need", "lead")), keys).where("value = prefix")
        alive = alive.where(F.col("lead").isNull() | (head(n) == F.col("lead")))
        n += 2
        cut = narrowed(alive, head(n), False, F.col("need")).withColumnRenamed("digit", "lead").join(open_.select(*keys, "shift", "prefix"), keys)
        cut = materialize(cut.withColumn("bytes", F.lit(n)).select(found.columns), "rank-bytes")
        found = materialize(found.join(cut.select(*keys), keys, "left_anti").unionByName(cut), "rank-found")

    # groups of fewer than k rows have no cut
    near = rows.join(small(found.select(*keys, "shift", "prefix", "bytes", "lead")), keys, "left")
    ahead = F.expr("shiftright(value, shift)")
    level = (ahead == F.col("prefix")) & (F.col("lead").isNull() | F.expr("substring(CAST(item AS binary), 1, bytes) <= lead"))
    near = near.where(F.col("prefix").isNull() | (ahead > F.col("prefix")) | level)
    order = Window.partitionBy(*keys).orderBy(F.col("value").desc(), "item")
    return near.select(*rows.columns, F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def audit_sources(docs: DataFrame, k: int = TOP, least_docs: int = LEAST_DOCS, settled: int = SETTLED) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of each source with the others of its language, and its first k terms."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = docs.mapInArrow(_count, _COUNTS_DDL).groupBy(*_GROUP, "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))
    counted = materialize(counted, "audit-counts")
    # a window over the sources of one term
    of_term = Window.partitionBy("lang", "term")
    kept = counted.where("term IS NOT NULL").withColumns({"docs": F.sum("docs").over(of_term), "all": F.sum("c").over(of_term), "is_first": F.min("source").over(of_term) == F.col("source")})
    kept = materialize(kept.where(F.col("docs") >= least_docs).drop("docs"), "audit-kept")

    langs = kept.groupBy("lang").agg(F.count_if("is_first").alias("v"), F.sum("c").alias("lang_n"))
    own = kept.groupBy(*_GROUP).agg(F.sum("c").alias("n"))
    groups = counted.where("term IS NULL").select(*_GROUP).join(own, _GROUP, "left").join(langs, "lang", "left")
    groups = groups.select(*_GROUP, F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("d"), (F.col("lang_n") + F.col("v")).alias("lang_d"))
    groups = materialize(groups.withColumn("p0", probability(F.lit(0), F.col("d"))), "audit-groups")
    placed = kept.join(small(groups), _GROUP)
    scored = placed.select(*_GROUP, "term", "c", "p0", probability(F.col("c"), F.col("d")).alias("p"), probability(F.col("all"), F.col("lang_d")).alias("q"))
    scored = materialize(scored, "audit-scored")

    over = scored.where("p > q").select(*_GROUP, F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    terms = top_ranked(materialize(over, "audit-over"), _GROUP, k, settled)

    # terms that one source has, against the baseline of the other: by histograms of p
    of_p = materialize(scored.groupBy(*_GROUP, "p").agg(F.count("*").alias("m")), "audit-histogram")
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    others = groups.where("v > 0").select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    sided = of_p.join(groups.select(*_GROUP, "p0"), _GROUP).join(others, "lang").where("source <> item")
    here, there, base = divergence(F.col("p"), F.col("q0")), divergence(F.col("q0"), F.col("p")), divergence(F.col("p0"), F.col("q0"))
    count = F.col("m").cast("decimal(18,0)")
    one = sided.groupBy("lang", "source", "item").agg(wide(count * (here - base)).alias("a"), wide(count * (there - divergence(F.col("q0"), F.col("p0")))).alias("b"))
    one = materialize(one, "audit-sided")
    turned = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("b").alias("value"))
    by = scored.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("by"))
    both = by.where(F.size("by") > 1).select("lang", "by").mapInArrow(_both, _BOTH_DDL)
    high = F.col("hi").cast("decimal(18,0)") * F.lit(1 << _LOW).cast("decimal(18,0)") + F.col("lo")
    left = groups.select(*_GROUP, "v", "p0").join(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang").where("source <> item")
    whole = left.select("lang", "source", "item", F.coalesce(F.col("v").cast("decimal(18,0)") * base, F.lit(0)).alias("value"))
    parts = [whole, one.select("lang", "source", "item", F.col("a").alias("value")), turned, both.select("lang", "source", "item", high.alias("value"))]
    total = None
    for part in parts:
        part = part.withColumn("value", F.col("value").cast("decimal(38,0)"))
        total = part if total is None else total.unionByName(part)
    pairs = total.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = materialize(pairs, "audit-pairs").withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")))

    columns = lambda df, part: df.select(*_GROUP, F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(terms, "term"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(read(spark, sf_dir, "documents"))


#: The same by dense sums in whole numbers.
OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT r) AS docs FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL HAVING sum(docs) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, k.c AS all_c, coalesce(c.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
n AS (SELECT lang, source, sum(c) + count(*) AS d, sum(all_c) + count(*) AS all_d FROM x GROUP BY ALL),
p AS (SELECT x.*, 1 + (1000000000::HUGEINT * (x.c + 1)::HUGEINT) // n.d::HUGEINT AS p, 1 + (1000000000::HUGEINT * (x.all_c + 1)::HUGEINT) // n.all_d::HUGEINT AS q FROM x JOIN n USING (lang, source)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""
