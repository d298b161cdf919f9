"""HTML main text with removal of site templates.

1. A page is split into blocks of text in one forward pass; block-level elements but html, body, article and main span
   ranges of blocks. Each such subtree is hashed twice: by its tag and words (the words of its blocks, in order), and as a
   skeleton by its tag, its class and id words and the skeletons of its children, runs of equal children counting as one.
   Text between blocks is a subtree by itself. Skeletons count only outside an article or main element, and, on pages
   without one, only where half of the characters are links: so a menu whose links rotate recurs, and main text doesn't.
2. Spark counts for each host on how many pages a subtree occurs, over whole pages: nothing is left out before.
   Copies of a page count once, and near copies about once: pages are told apart by minimal hashes of three-word
   shingles of their bodies (the article; without one, the blocks that are not on half of the host's pages),
   and the mean number of distinct minima under ``MINIMA`` hash functions is counted. Subtrees on ``least_pages`` pages and on
   ``least_share`` of the host's pages (``inside_share`` for those inside an article or main element) are the host's template,
   and blocks inside them go.
3. Of what is left, if a page has an article or a main element, only blocks inside it stay. Menus, headers, footers, asides,
   forms and the like go by their element, and adverts, sidebars, notices and reader comments by words of class, id and role, on
   hosts of any size. Inside an article only words that name no part of a text count, and not for sections and headings.

Scripts and styles are never text. Null or empty html gives an empty text. A page without a host counts to the host ''.
Long and deep pages are read in time that grows with their length: a tag ends at the first > outside quotes; after a quote that
never ends, at the first >; and where no > follows, < is text. Rows of equal ids are pages of their own. n_blocks
counts the blocks of the whole page, n_template_blocks those found by recurrence. Other columns are dropped. An empty
table gives no rows.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Words, arrow_batch, gram_hashes, materialize, mix64, read, small

LEAST_PAGES = 3
LEAST_SHARE = 0.1
#: Share for subtrees inside an article or main element, where short paragraphs recur by chance.
INSIDE_SHARE = 0.5
MINIMA = 4

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_HINT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SKIPPED = frozenset("script style noscript template iframe svg object select textarea title".split())
_CHROME = frozenset("nav header footer aside form button head dialog menu".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_CONTAINER = frozenset("div section ul ol dl table figure details fieldset center".split())
_SECTIONS = frozenset("section h1 h2 h3 h4 h5 h6 hgroup header".split())
_ROOT = frozenset("html body article main".split())
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words that name boilerplate anywhere, and those that may name a part of an article.
_ANYWHERE = r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|cookies?|consent|gdpr|newsletter|subscribe|signup|popup|modal|overlay|share|sharing|social|related|recommend\w*|widget|comments?|replies|disqus|toolbar|pagination|pager"
_OUTSIDE = r"side|header|footer|masthead|notice|contentinfo|complementary|search"
_WORDS = re.compile(rf"(?:^|[\s_-])(?:{_ANYWHERE}|{_OUTSIDE})(?:$|[\s_-])", re.I)
_WORDS_INSIDE = re.compile(rf"(?:^|[\s_-])(?:{_ANYWHERE})(?:$|[\s_-])", re.I)
_BLANKS = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
#: Share of link characters from which a subtree outside any article counts as links.
_LINKS = 0.5


class Block(NamedTuple):
    text: str
    named: bool
    inside: bool


class Subtree(NamedTuple):
    """Blocks start to end (exclusive); the lowest bit of the hash tells whether it lies inside an article."""

    hash: int
    start: int
    end: int


class _Open(NamedTuple):
    tag: str
    named: bool
    inside: bool  # its blocks are
    links: bool
    counted: bool
    outer: bool  # it lies inside an article itself
    start: int
    block: int  # place in the stack of the innermost block-level element, itself or around it; -1: none
    words: str
    children: list  # [skeleton hash of the children so far, that of the last one]
    own: list  # blocks right in it


_hash = xxhash.xxh64_intdigest


def _named(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is boilerplate by its name or by words of class, id or role."""
    if tag in _CHROME and not (tag == "header" and inside):
        return True
    if tag in _ROOT or (inside and tag in _SECTIONS) or "=" not in attributes:
        return False
    words = _WORDS_INSIDE if inside else _WORDS
    return any(words.search(a or b or c) for a, b, c in _HINT.findall(attributes))


def _class_words(attributes: str) -> str:
    if "=" not in attributes:
        return ""
    return " ".join(sorted({_DIGITS.sub("#", w) for found in _HINT.findall(attributes) for x in found for w in x.lower().split()}))


class _Tags:
    """Tags of a page in order; every character is looked at a bounded number of times."""

    def __init__(self, html: str) -> None:
        self.html, self.quoted, self.last = html, True, html.rfind(">")

    def end(self, at: int) -> int:
        """Where a tag that begins before ``at`` ends (its >); there is one."""
        html, i = self.html, at
        while self.quoted:
            m = _STOP.search(html, i)
            if m is None:
                self.quoted = False
            elif m[0] == ">":
                return m.start()
            elif (i := html.find(m[0], m.end()) + 1) == 0:
                # from here on quotes mean nothing
                self.quoted = False
        return html.find(">", at)

    def __iter__(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, slash, tag in lower case, attributes); comments and declarations have no tag."""
        html, at = self.html, 0
        while (i := html.find("<", at)) >= 0:
            at = i + 1
            if html.startswith("<!--", i):
                close = html.find("-->", i + 4)
                at = len(html) if close < 0 else close + 3
                yield i, at, "", "", ""
            elif i > self.last:
                return
            elif html.startswith(("<!", "<?"), i):
                at = html.find(">", i) + 1
                yield i, at, "", "", ""
            elif m := _NAME.match(html, i + 1):
                end = self.end(m.end())
                at = end + 1
                went = yield i, at, m[1], m[2].lower(), html[m.end() : end]
                at = max(at, went or 0)


class _Page:
    """Blocks and subtrees of a page."""

    def __init__(self, html: str) -> None:
        self.blocks: list[Block] = []
        self.subtrees: list[Subtree] = []
        self.skeletons: list[tuple[int, int, int, bool]] = []
        self._stack: list[_Open] = []
        self._open_names: dict[str, int] = {}
        self._text: list[str] = []
        self._linked = 0
        self._hashes: list[int] = []
        #: sums over blocks: hashes, characters, characters in links
        self._prefix, self._power, self._size, self._links = [0], [1], [0], [0]
        self._read(html)
        article = any(b.inside for b in self.blocks)
        self.subtrees += [Subtree(h, a, b) for h, a, b, links in self.skeletons if article or links]

    def _say(self, text: str) -> None:
        if text:
            self._text.append(text)
            if self._stack and self._stack[-1].links:
                self._linked += len(text.strip())

    def _close_block(self) -> None:
        if not self._text:
            return
        joined = _BLANKS.sub(" ", html_entities.unescape("".join(self._text))).strip()
        self._text.clear()
        linked, self._linked = self._linked, 0
        if not joined:
            return
        top = self._stack[-1] if self._stack else None
        n = len(self.blocks)
        self.blocks.append(Block(joined, bool(top and top.named), bool(top and top.inside)))
        own = _hash(joined)
        self._hashes.append(own)
        self._prefix.append((self._prefix[-1] * _BASE + own) & _MASK)
        self._power.append(self._power[-1] * _BASE & _MASK)
        self._size.append(self._size[-1] + len(joined))
        self._links.append(self._links[-1] + min(linked, len(joined)))
        if top and top.block >= 0:
            self._stack[top.block].own.append(n)
        else:
            self._alone("", [n], False)

    def _alone(self, tag: str, blocks: list[int], inside: bool) -> None:
        for n in blocks:
            self.subtrees.append(self._subtree(_hash(f"alone {tag} {self._hashes[n]}"), n, n + 1, inside))

    @staticmethod
    def _subtree(h: int, start: int, end: int, inside: bool) -> Subtree:
        return Subtree((h & ~1 | inside) - (1 << 63), start, end)

    def _pop(self, to: int) -> None:
        while len(self._stack) > to:
            s = self._stack[-1]
            if s.tag not in _INLINE:
                self._close_block()
            self._stack.pop()
            self._open_names[s.tag] -= 1
            if s.tag in _INLINE:
                continue
            skeleton = _hash(f"skeleton {s.tag} {s.children[0]} {s.words}")
            above = self._stack[self._stack[-1].block] if self._stack and self._stack[-1].block >= 0 else None
            if above and above.children[1] != skeleton:
                above.children[:] = _hash(f"{above.children[0]} {skeleton}"), skeleton
            end = len(self.blocks)
            if not s.counted or end - s.start > 1:
                self._alone(s.tag, s.own, s.inside)
            if s.counted and end > s.start:
                words = (self._prefix[end] - self._prefix[s.start] * self._power[end - s.start]) & _MASK
                self.subtrees.append(self._subtree(_hash(f"{s.tag} {words}"), s.start, end, s.outer))
                # a bare leaf says nothing that its parent doesn't
                if not s.inside and (s.words or s.children[1] or above is None or not above.counted):
                    links = self._links[end] - self._links[s.start] >= _LINKS * (self._size[end] - self._size[s.start])
                    self.skeletons.append((*self._subtree(skeleton, s.start, end, False), links))

    def _pop_named(self, tag: str, bounds: frozenset[str] = frozenset()) -> None:
        """Closes the innermost open element of a name, if one is open and none of the bounds lies between."""
        if not self._open_names.get(tag):
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i].tag == tag:
                self._pop(i)
                return
            if self._stack[i].tag in bounds:
                return

    def _read(self, html: str) -> None:
        at, tags = 0, iter(_Tags(html))
        found = next(tags, None)
        while found:
            start, end, slash, tag, attributes = found
            self._say(html[at:start])
            at = end
            if not tag:
                pass
            elif slash:
                self._pop_named(tag)
            elif tag in _SKIPPED:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = close.end() if close else len(html)
                self._say(" ")
            elif tag in _VOID:
                self._say(" ")
            else:
                self._element(tag, attributes)
            try:
                found = tags.send(at)
            except StopIteration:
                break
        self._say(html[at:])
        self._pop(0)
        self._close_block()

    def _element(self, tag: str, attributes: str) -> None:
        if tag not in _INLINE:
            self._close_block()
            if tag in _CLOSES_P:
                self._pop_named("p", _CONTAINER | {"article", "main", "body"})
        if attributes.rstrip().endswith("/"):
            return
        top = self._stack[-1] if self._stack else None
        outer, named, links = (top.inside, top.named, top.links) if top else (False, False, False)
        named, inside, links, inline = named or _named(tag, attributes, outer), outer or tag in ("article", "main"), links or tag == "a", tag in _INLINE
        block = (top.block if top else -1) if inline else len(self._stack)
        self._stack.append(_Open(tag, named, inside, links, not inline and tag not in _ROOT, outer, len(self.blocks), block, "" if inline else _class_words(attributes), [0, 0], []))
        self._open_names[tag] = self._open_names.get(tag, 0) + 1


def parsed_page(html: str) -> tuple[list[Block], list[Subtree]]:
    """Blocks in page order, and subtrees that count."""
    page = _Page(html)
    return page.blocks, page.subtrees


def covered(n: int, hashes: list[int], starts: list[int], ends: list[int], hits: list[int] | None) -> list[bool]:
    """Which of n blocks lie in a subtree whose hash is one of the hits."""
    out = [False] * n
    if hits:
        hits = set(hits)
        upto = 0
        for start, end in sorted((a, b) for h, a, b in zip(hashes, starts, ends, strict=True) if h in hits):
            for i in range(max(start, upto), end):
                out[i] = True
            upto = max(upto, end)
    return out


#: flags: 1 for boilerplate by name, 2 for inside an article; minima: of the article, or without one of each block.
_PARSED = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("page", pa.int64()), ("article", pa.bool_()), ("texts", pa.list_(pa.string())), ("flags", pa.list_(pa.int32()))]
    + [("hashes", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("minima", pa.list_(pa.int64()))]
)
_PARSED_DDL = "page_id long, url string, host string, page long, article boolean, texts array<string>, flags array<int>, hashes array<long>, starts array<int>, ends array<int>, minima array<long>"
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_blocks", pa.int64()), ("n_template_blocks", pa.int64())])
_OUT_DDL = "page_id long, url string, text string, n_blocks long, n_template_blocks long"
_BODY = pa.schema([("host", pa.string()), ("hashes", pa.list_(pa.int64())), ("minima", pa.list_(pa.int64()))])
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)")
#: Pages that a task holds as Python objects at a time.
_PAGES = 64


def minima_of(texts: list[str]) -> np.ndarray:
    """(texts, MINIMA): the least hash of each text's three-word shingles (of all its words, if fewer) under each of MINIMA functions."""
    w = Words([t.encode("utf-8", "surrogatepass") for t in texts])
    h = w.hashes()
    out = np.zeros((len(texts), MINIMA), dtype=np.int64)
    grams = gram_hashes(h, 3)
    size = np.maximum(w.counts() - 2, 0)
    long = np.flatnonzero(size)
    at = np.concatenate([np.arange(w.first[i], w.first[i] + size[i]) for i in long]) if len(long) else np.zeros(0, dtype=np.int64)
    start = np.cumsum(size[long]) - size[long]
    rest = [(i, np.concatenate([h[w.first[i] : w.first[i + 1]], np.zeros(1, dtype=np.uint64)])) for i in np.flatnonzero(size == 0)]
    for k in range(MINIMA):
        turn = np.uint64((2 * k + 1) * 0x632BE59BD9B4E019 & _MASK)
        if len(long):
            out[long, k] = (np.minimum.reduceat(mix64(grams[at] ^ turn), start) >> np.uint64(1)).astype(np.int64)
        for i, x in rest:
            out[i, k] = int(mix64(np.bitwise_xor.reduce(x, keepdims=True) ^ turn)[0] >> np.uint64(1))
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, _PAGES):
            part = batch.slice(first, _PAGES)
            rows, bodies, sizes = [], [], []
            for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                blocks, subtrees = parsed_page(page or "")
                texts = [b.text for b in blocks]
                article = any(b.inside for b in blocks)
                host = m[1].lower() if (m := _HOST.match(url or "")) else ""
                rows.append((host, xxhash.xxh64_intdigest("\n".join(texts)) - (1 << 63), article, texts, [b.named + 2 * b.inside for b in blocks], *(list(x) for x in (zip(*subtrees, strict=True) if subtrees else ((), (), ())))))
                own = ["\n".join(b.text for b in blocks if b.inside)] if article else texts
                bodies += own
                sizes.append(len(own))
            flat = minima_of(bodies).ravel()
            ends = np.concatenate([[0], np.cumsum(sizes) * MINIMA]).astype(np.int32)
            yield arrow_batch(_PARSED, [part.column("page_id"), part.column("url"), *zip(*rows, strict=True), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's subtrees, and the minimal hashes of its body: the article, else what isn't on most pages of the host, else all."""
    names = ("article", "hashes", "starts", "ends", "minima", "hits")
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            part, out = batch.slice(first, 1024), []
            for article, hashes, starts, ends, minima, hits in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                if not article:
                    m = np.array(minima, dtype=np.int64).reshape(-1, MINIMA)
                    rare = ~np.array(covered(len(m), hashes, starts, ends, hits))
                    minima = (m[rare] if rare.any() else m).min(axis=0).tolist()
                out.append(minima)
            yield arrow_batch(_BODY, [part.column("host"), part.column("around"), out])


def _hosts(parsed: DataFrame, least_pages: int, least_share: float, inside_share: float) -> DataFrame:
    """(host, template) of every host with a template. Each template subtree is on a share of the pages, which bounds their number."""
    # copies of a page count once
    places = [F.when(~F.col("article"), F.col(c)).alias(c) for c in ("starts", "ends")]
    once = parsed.where("size(texts) > 0").select("host", "page", "article", F.array_distinct("hashes").alias("around"), F.when(~F.col("article"), F.col("hashes")).alias("hashes"), *places, "minima")
    once = materialize(once.dropDuplicates(["host", "page"]), "html-pages")
    raw = once.groupBy("host").agg(F.count("*").alias("pages"))
    often = once.select("host", F.explode("around").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    often = materialize(often, "html-often")
    most = often.join(raw, "host").where("n >= 0.5 * pages").groupBy("host").agg(F.collect_list("subtree").alias("most"))
    # near copies have mostly the same minima of their bodies
    hits = F.when(~F.col("article"), F.array_intersect("around", "most"))
    out = once.join(_arrays_broadcast(materialize(most, "html-most"), "most"), "host", "left").withColumn("hits", hits)
    minima = F.transform("minima", lambda m, k: F.struct(k.alias("k"), m.alias("m")))
    bodies = out.select("host", "around", "article", "hashes", "starts", "ends", "minima", "hits").mapInArrow(_bodies, "host string, hashes array<long>, minima array<long>")
    out = materialize(bodies.select("host", F.col("hashes").alias("around"), minima.alias("minima")), "html-bodies")
    pages = out.select("host", F.explode("minima").alias("m")).distinct().groupBy("host").agg((F.count("*") / MINIMA).alias("pages"))
    seen = out.select("host", "minima", F.explode("around").alias("subtree")).join(small(often), ["host", "subtree"])
    often = seen.select("host", "subtree", F.explode("minima").alias("m")).distinct().groupBy("host", "subtree").agg((F.count("*") / MINIMA).alias("n")).where(F.col("n") >= least_pages)
    share = F.when(F.col("subtree").bitwiseAND(1) == 1, inside_share).otherwise(least_share)
    found = often.join(pages, "host").where(F.col("n") >= share * F.col("pages")).groupBy("host").agg(F.collect_list("subtree").alias("template"))
    return materialize(found, "html-hosts")


def _arrays_broadcast(rows: DataFrame, column: str) -> DataFrame:
    """Marks a written table of arrays of longs for a broadcast if they are few in all."""
    return F.broadcast(rows) if (rows.agg(F.sum(F.size(column) + 1)).first()[0] or 0) <= BROADCAST_ROWS else rows


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("texts", "flags", "hashes", "starts", "ends", "hits")
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part, out = batch.slice(first, 256), []
            for texts, flags, hashes, starts, ends, hits in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                template = covered(len(texts), hashes, starts, ends, hits)
                kept = [(t, f) for t, f, gone in zip(texts, flags, template, strict=True) if not gone and not f & 1]
                inside = [t for t, f in kept if f & 2]
                out.append((" ".join(inside or [t for t, _ in kept]), len(texts), sum(template)))
            yield arrow_batch(_OUT, [part.column("page_id"), part.column("url"), *zip(*out, strict=True)])


def extract_main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, inside_share: float = INSIDE_SHARE) -> DataFrame:
    """(page_id, url, text, n_blocks, n_template_blocks) of every page."""
    parsed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_parse, _PARSED_DDL)
    parsed = materialize(parsed, "html-parsed")
    hosts = _arrays_broadcast(_hosts(parsed, least_pages, least_share, inside_share), "template")
    both = parsed.join(hosts, "host", "left").withColumn("hits", F.array_intersect("hashes", "template"))
    return both.select("page_id", "url", "texts", "flags", "hashes", "starts", "ends", "hits").mapInArrow(_texts, _OUT_DDL)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_template_blocks")
