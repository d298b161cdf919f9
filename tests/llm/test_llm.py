"""Brute-force versions of the corpus operators on small tables with odd rows."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.llm import decontamination, fingerprint, html_text, language_id, ngram_join, ngram_lm, packing, quality, secret_scan, substring_dedup

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n long, h long"


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    """Some real documents, and nulls, empty and repeated texts, copies, one long text, columns of clashing names."""
    real = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    base = real[0][1]
    odd = [(1000, None, None), (1001, "", "en"), (1002, "one two", "en"), (1003, base, "fr"), (1004, base + " tail", "fr"), (1005, "123 456", None), (1006, " ".join(f"w{i % 977}" for i in range(30_000)), "en"), (1007, "one two", "en")]
    odd += [(1008, "password = hunter2345 AKIA" + "A1" * 10 + " " + "0f" * 14 + " q7Xk29Lm0PzR4vT8wYb3N", "en")]
    rows = [(i, t, lang, "s", len(t or ""), 1, 2) for i, t, lang in real + odd]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_substring_dedup(docs, texts, empty):
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs, 50).collect()}
    first = {}
    for i in sorted(texts):
        w = words(texts[i])
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a : a + 50]), i)
    for i, text in texts.items():
        w = words(text)
        gone = set()
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < i:
                gone.update(range(a, a + 50))
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].kept_text == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_decontamination(spark, docs, texts, empty):
    item = " ".join(words(texts[1006])[100:140])
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "nobody has these words in a row at all today")], "item_id long, text string")
    extra = spark.createDataFrame([(2000, f"before {item.upper()}\nafter", "en", "s", 1, 1, 1)], COLUMNS)
    got = {(r.doc_id, r.item_id, r.similarity) for r in decontamination.find_leaks(docs.unionByName(extra), items).collect()}
    assert got == {(1006, 1, 1.0), (2000, 1, 1.0)}
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert decontamination.find_leaks(empty, items).count() == 0
    assert decontamination.find_leaks(docs, items.where("false")).count() == 0


def test_secret_scan(docs, texts, empty):
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.scan_secrets(docs).collect()}
    text = texts[1008]
    assert [k for k, *_ in got[1008]] == ["assign", "access", "hex", "random"] or {"assign", "access", "hex"} <= {k for k, *_ in got[1008]}
    for kind, pattern, group, least in (("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        for i, t in texts.items():
            assert [s for s in got[i] if s[0] == kind] == [(kind, m.start(), m.end()) for m in re.finditer(pattern, t or "") if len(m[group]) >= least]
    assert "hunter2345" in text
    masked = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs).collect()}
    assert "hunter2345" not in masked[1008] and masked[1000] is None and masked[1003] == texts[1003]
    assert secret_scan.scan_secrets(empty).count() == 0


def test_decontamination_every_start(spark):
    """Swapped and edited items against brute force over every start."""
    def shingles(w):
        return {tuple(w[a : a + 5]) for a in range(len(w) - 4)}

    item = [f"i{j}" for j in range(50)]
    around = [f"x{j}" for j in range(60)]
    cases = [item[25:] + item[:25], item[:30] + ["new"] + item[30:], item[12:] + item[:12], item[:20] + item[30:], item[:5] + around[:50] + item[5:9], item[1:]]
    docs = {i: around[:40] + w + around[40:] for i, w in enumerate(cases)} | {50: item[2:], 51: item[:30]}
    want = {}
    for i, w in docs.items():
        best = max(len(shingles(w[a : a + 50]) & shingles(item)) / len(shingles(w[a : a + 50]) | shingles(item)) for a in range(max(1, len(w) - 49)))
        if best >= 0.8:
            want[i] = round(best, 6)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id: r.similarity for r in decontamination.find_leaks(rows, items).collect()} == want and 0 in want


def test_random_letters():
    import random
    import string
    import time

    vocabulary = secret_scan.default_vocabulary()
    kinds = lambda text: [k for k, *_ in secret_scan.spans_of(text, vocabulary)]
    for text in ("qzxkvjwpqmzxbvnkrtlpqwyd", "QzXkVjWpQmZxBvNkRtLpQwYd12", "QZXKVJWPQMZXBVNKRTLPQWYD"):
        assert kinds(text) == ["random"], text
    for text in ("getUserAccountBalanceHistory2", "max_number_of_open_files", "internationalisation", "2024-01-01_10-22-33_run", "=" * 30, "A" * 40):
        assert kinds(text) == [], text
    dice = random.Random(5)
    keys = ["".join(dice.choices(string.ascii_letters + string.digits, k=24)) for _ in range(2000)]
    assert sum(secret_scan.is_random(x, vocabulary) for x in keys) >= 1990
    began = time.time()
    kinds("qwertzuiop" * 4 + "12345")
    assert time.time() - began < 1


def test_ngram_join(docs, texts, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs).collect()}
    sets = {}
    for i, t in texts.items():
        w = words(lowered(t))
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and 100 * common >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {i: x if r == y else r for i, r in root.items()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    kept = ngram_join.keep_first_of_groups(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in root if root[i] == i)
    assert ngram_join.link_documents(empty).count() == 0


def test_decontamination_recall(spark):
    """All windows of real documents against all items, by sets: what is found is right, and nearly all is found."""
    texts, items = ([tuple(r) for r in spark.read.parquet(f"{DATA}/../sf0.01/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    shingles = lambda t: (lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)])(words(lowered(t)))
    of_item = {i: shingles(t) for i, t in items}
    having = collections.defaultdict(set)
    for i, s in of_item.items():
        for x in s:
            having[x].add(i)
    weight = lambda x: math.log(len([s for s in of_item.values() if s]) / len(having[x]) + 1) if len(having.get(x, ())) > 1 else math.log(len([s for s in of_item.values() if s]) + 1)
    want = {}
    for doc, t in texts:
        s = shingles(t)
        if not (near := {i for x in s for i in having.get(x, ())}):
            continue
        of = [weight(x) for x in s]
        for i in near:
            n, other = len(of_item[i]), set(of_item[i])
            whole = sum(map(weight, other))
            for a in range(max(1, len(s) - n + 1)):
                own = dict(zip(s[a : a + n], of[a : a + n], strict=True))
                both = sum(w for x, w in own.items() if x in other)
                if both >= 0.5 * whole:
                    want[doc, i] = max(want.get((doc, i), 0), both / (sum(own.values()) + whole - both))
    want = {k: x for k, x in want.items() if x >= 0.8}
    counts = {}
    docs, bench = (spark.createDataFrame(rows, f"{c} long, text string") for rows, c in ((texts, "doc_id"), (items, "item_id")))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_leaks(docs, bench, counts=counts).collect()}
    assert len(want) > 10 and set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert sum(abs(got[k] - want[k]) < 1e-5 for k in got) >= 0.97 * len(got)
    assert counts["windows"] > counts["alike"] and counts["in a block"] > counts["within the radius"] >= counts["alike"] > 0


def test_html_text(spark):
    article = "<article><header><h1>T</h1></header><p>a &amp; b<br>c<p>d <b>e</b>f<div class='comments'><p>no</p></div></article>"
    pages = [(1, "https://h/1", f"<nav>x</nav>{article}<footer>z</footer><script>var a='<p>'</script>"), (2, None, None), (3, "https://h/2", "")]
    pages += [(10 + i, f"https://t/{i}", f"<body><div><p>every page has this</p></div><div><p>text number {i}</p></div></body>") for i in range(4)]
    got = {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "T a & b c d ef", 2: "", 3: ""} | {10 + i: f"text number {i}" for i in range(4)}


def test_ngram_join_counts_every_link(spark, monkeypatch):
    """A group of distinct near copies: each links with all others, copies weighted, hot tokens in several blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    base = [f"w{i}" for i in range(200)]
    texts = {i: " ".join([*base[:190], f"own{i}", *base[191:]]) for i in range(30)}
    texts |= {100: texts[7], 101: "nothing like the others at all here"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.class_id, r.n_links) for r in ngram_join.link_documents(rows).collect()}
    assert got == {i: (0, i, 29 if i == 7 else 30) for i in range(30)} | {100: (0, 7, 29), 101: (101, 101, 0)}


def main_texts(spark, pages):
    return {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_html_text_recurrence(spark):
    """Recurring p, li, aside and bare text goes without any telling name."""
    own = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(12)]
    bare = [(i, f"https://b/{i}", f"<body>call us today<p>we value you</p><ul><li>home<li>own {i}</ul><p class='lead'>{own[i]}</p></body>") for i in range(12)]
    article = [(100 + i, f"https://a/{i}", f"<article><p>{own[i]}</p><p>read our letter</p></article>") for i in range(12)]
    assert main_texts(spark, bare + article) == {i: f"own {i} {own[i]}" for i in range(12)} | {100 + i: own[i] for i in range(12)}


def test_html_text_keeps_articles(spark):
    """Near copies make no template, a few pages of many make none, and words in ids of sections inside articles decide nothing."""
    body = " ".join(f"long{i}" for i in range(300))
    own = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(40)]
    near = [(i, f"https://n/{i}", f"<article><h1>title {i}</h1><div><p>{body}</p></div></article>") for i in range(3)]
    many = [(100 + i, f"https://m/{i}", f"<article><p>{own[i]}</p>{'<div><p>rare passage</p></div>' if i < 3 else ''}</article>") for i in range(40)]
    many += [(150, "https://m/150", "<article>" + "".join(f"<p>{o}</p>" for o in own[:6]) + "</article>")]
    named = [(200, "https://o/1", "<article><h2 id='header-files'>Header files</h2><p>a</p><section id='related-work'><p>b</p></section></article>")]
    expected = {150: " ".join(own[:6])} | {i: f"title {i} {body}" for i in range(3)} | {100 + i: own[i] + (" rare passage" if i < 3 else "") for i in range(40)} | {200: "Header files a b"}
    assert main_texts(spark, near + many + named) == expected


@pytest.mark.parametrize("n", [1, 9, 12, 40])
def test_html_text_comments_on_hosts_of_any_size(spark, n):
    own = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(n)]
    said = [" ".join(f"c{i}y{j}" for j in range(9)) for i in range(n)]
    pages = [(i, f"https://c/{i}", f"<div class='site-menu'>m{i}</div><article><p>{own[i]}</p><div class='reader comments'><p>{said[i]}</p></div><section class='notice'><p>part {i}</p></section></article>") for i in range(n)]
    assert main_texts(spark, pages) == {i: f"{own[i]} part {i}" for i in range(n)}


def test_html_text_rotating_menus(spark):
    """Menus of links that rotate recur as skeletons, with and without an article; paragraphs of the same build don't go."""
    own = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(30)]
    links = lambda i: "".join(f"<li><a href='/{i}/{j}'>{own[(i * 7 + j) % 30][:9]}{i}{j}</a></li>" for j in range(2 + i % 4))
    bare = [(i, f"https://b/{i}", f"<div class='top'><ul>{links(i)}</ul></div><div class='text'><p>{own[i]}</p></div>") for i in range(30)]
    framed = [(100 + i, f"https://f/{i}", f"<div class='top'><ul>{links(i)}</ul></div><article><div class='text'><p>{own[i]}</p></div></article><div class='end'>{own[29 - i]} end</div>") for i in range(30)]
    df = spark.createDataFrame(bare + framed, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract_main_text(df).collect()}
    assert {k: r.text for k, r in got.items()} == {i: own[i] for i in range(30)} | {100 + i: own[i] for i in range(30)}
    assert all(r.n_template_blocks == r.n_blocks - 1 for r in got.values())


def test_html_template_counts(spark):
    """Templates against a count of every subtree on every page of real hosts; pages there are no near copies."""
    real = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    parsed = spark.createDataFrame(real, "page_id long, url string, html string").mapInArrow(html_text._parse, html_text._PARSED_DDL)
    got = {r.host: set(r.template) for r in html_text._hosts(parsed, 3, 0.1, 0.5).collect()}
    seen, pages = collections.defaultdict(collections.Counter), collections.Counter()
    for host, _ in {(html_text._HOST.match(u)[1].lower(), h): 0 for _, u, h in real}:
        pages[host] += 1
    for host, h in {(html_text._HOST.match(u)[1].lower(), h) for _, u, h in real}:
        seen[host].update({s.hash for s in html_text.parsed_page(h)[1]})
    want = {host: {h for h, n in c.items() if n >= 3 and n >= (0.5 if h & 1 else 0.1) * pages[host]} for host, c in seen.items()}
    sure = [host for host in want if want[host]]
    assert len(sure) > 20
    same = sum(got.get(host, set()) == want[host] for host in want)
    assert same >= 0.9 * len(want)  # near copies among the pages count once there


def test_html_parser_is_linear():
    import time

    def took(page):
        began = time.process_time()
        html_text.parsed_page(page)
        return time.process_time() - began

    for page in ("<a " * 100_000, "<a '\"" * 60_000 + ">", "<a href=\"x>" * 60_000, "<div>" * 20_000 + "deep", "<div>x" * 20_000, "<p>x" * 50_000, "</p>" * 100_000, "<!--" * 100_000, "<b>" * 20_000 + "<p>x" * 20_000, "<script" * 50_000, "<" * 200_000):
        assert took(page) < 2.5, page[:12]
    assert html_text.parsed_page("a < b <c d")[0][0].text == "a < b <c d"
    assert [b.text for b in html_text.parsed_page("<p title='a > b'>x<p title=\"c>y")[0]] == ["x", "y"]
    assert html_text.parsed_page("<!-- open <p>x")[0] == []


def test_quality(spark, docs, empty):
    all_docs, labels = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet"), spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    joined = quality.score_quality(all_docs, labels).join(labels, "doc_id").where(quality.held_out(F.col("doc_id")))
    right = [(r.score >= 0.3) == bool(r.quality) for r in joined.collect()]
    assert np.mean(right) > 0.95
    assert {r.score for r in quality.score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0


def test_quality_words(spark):
    """Good and bad texts of the same word shapes: only the words tell them apart."""
    random = np.random.default_rng(3)
    shared, good, bad = ([f"{c}{a}{b}ore" for a in "aeiou" for b in "klmnprst"] for c in "tbv")
    rows = []
    for i in range(300):
        own = list(random.choice(bad if i % 2 else good, 5)) + list(random.choice(shared, 25))
        rows.append((i, " ".join(random.permutation(own)), 1 - i % 2))
    both = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    scored = quality.score_quality(both.select("doc_id", "text"), both.select("doc_id", "quality")).join(both, "doc_id").where(quality.held_out(F.col("doc_id")))
    right = [(r.score >= 0.5) == bool(r.quality) for r in scored.collect()]
    assert len(right) > 30 and np.mean(right) > 0.9


def test_quality_fits_one_model(spark):
    """Weights equal those of one fit to all labelled rows, by a plain version of counts, ratios and descent."""
    docs, labels = (spark.read.parquet(f"{DATA}/../sf0.1/{t}.parquet").where("doc_id < 9000") for t in ("documents", "labels"))
    rows = sorted((r.doc_id, r.text or "", r.quality) for r in docs.join(labels, "doc_id").collect())
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert len(rows) > 2000
    sets = [quality.features([t.encode()])[1] for _, t, _ in rows]
    y = np.array([q for *_, q in rows])
    p, q = np.ones(1 << quality.FEATURE_BITS), np.ones(1 << quality.FEATURE_BITS)
    for x, label in zip(sets, y, strict=True):
        (p if label else q)[x] += 1
    scale = np.log(p / ((y == 1).sum() + 1)) - np.log(q / ((y == 0).sum() + 1))
    got = quality.fit_quality(docs, labels)
    assert np.allclose(got[0][:-1], scale) and np.allclose(got[1], quality.dual_coordinate_descent(sets, y, scale), atol=1e-9)


def test_language_bundles(monkeypatch):
    """Bundles against a sum trigram by trigram; slices and parts of long texts change nothing."""
    texts = ["The cat  sat, the CAT!", "", "12 3", "ça été l'été", "x", "  a b-c  ", "漢字かな交じり文" * 5]

    def brute(text, dimensions=256):
        out = np.zeros(dimensions)
        vector = lambda c: language_id.letter_vectors(np.array([ord(c)]), dimensions)[0].astype(int)
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            for a, b, c in zip(" " + word, word, word[1:] + " ", strict=False):
                out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        size = np.sqrt((out**2).sum())
        return out / (size or 1)

    want = np.stack([brute(t) for t in texts])
    got, known = language_id.bundles(texts, 256)
    assert np.allclose(got, want, atol=1e-6) and known.tolist() == [True, False, False, True, True, True, True]
    monkeypatch.setattr(language_id, "_SLICE", 3)
    assert np.allclose(language_id.bundles(texts, 256)[0], want, atol=1e-6)
    for points in (4, 5, 7, 11):
        monkeypatch.setattr(language_id, "_POINTS", points)
        for t, w in zip(texts, want, strict=True):
            assert np.allclose(language_id.bundles([t], 256)[0][0], w, atol=1e-6)


def test_language_memory():
    """A long text of very many letters: memory stays bounded."""
    import tracemalloc

    random = np.random.default_rng(2)
    text = "".join(map(chr, random.integers(0x4E00, 0x9FFF, 700_000)))
    language_id.bundles(["warm"])
    tracemalloc.start()
    language_id.bundles([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def test_language_id(spark, docs, empty):
    got = {r.doc_id: r for r in language_id.identify_languages(docs).collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1005)] == ["und"] * 3 and got[1000].score == 0
    whole = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    both = language_id.identify_languages(whole).join(whole, "doc_id").where(quality.held_out(F.col("doc_id"))).where("n_chars > 50")
    assert np.mean([r.lang == r.lang_pred for r in both.collect()]) > 0.97
    assert language_id.identify_languages(empty).count() == 0


def test_packing(docs, texts, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = collections.defaultdict(list)
    places = collections.defaultdict(list)
    for r in packing.pack_documents(docs).collect():
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids = [*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), 0]
        at = 0
        for k, r in enumerate(sorted(got[i], key=lambda r: r.piece)):
            size = (len(ids) - 1) % 2048 + 1 if k == 0 else 2048
            assert (r.piece, r.start, r.length) == (k, at, size)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + size], dtype="<u4").tobytes())
            at += size
        assert at == len(ids)
    for rows in places.values():
        ends = list(itertools.accumulate(n for _, n in sorted(rows)))
        assert [o for o, _ in sorted(rows)] == [0, *ends[:-1]] and ends[-1] <= 2048
    total = sum(n for rows in places.values() for _, n in rows)
    assert len(places) <= -(-total // 2048) + 1
    assert packing.pack_documents(empty).count() == 0


def test_packing_added_token():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Encoder(packing.default_vocabulary())
    odd = ["", " ", "\n", " a", "a  \n b", "nb\u00a0sp", "don't we'll", "日本語 テキスト", "   lead", "trail   ", "a\r\nb", "😀 😀😀 a", "x\ty", "a \n\n b  "]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.batch(odd * 2)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in odd * 2]
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ty  ", "one\n <|endoftext|>\n two <|endoftext|", "plain words"):
        assert np.frombuffer(encoder(text), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_by_configurations():
    """Configurations place nearly all pieces, in few more sequences than their tokens need."""
    need = np.bincount(np.random.default_rng(2).integers(1, 1500, 3000), minlength=2049)
    plan, left = packing.multiplicative_weights(need, 2048)
    assert left.sum() < 0.02 * need.sum() and all(sum(c) <= 2048 for c, _ in plan)
    placed = np.zeros(2049, dtype=np.int64)
    for lengths, times in packing.packing_plan(need):
        np.add.at(placed, list(lengths), times)
    assert (placed == need).all()
    assert sum(n for _, n in packing.packing_plan(need)) <= 1.01 * (need * np.arange(2049)).sum() / 2048 + 1


@pytest.mark.parametrize("hot", [(), ("one", "w5", "the")])
def test_lm_score(docs, texts, empty, monkeypatch, hot):
    names = [ngram_lm.word_names([w.encode()])[0] for w in hot]
    monkeypatch.setattr(ngram_lm, "_hot_words", lambda rows: np.unique(np.array([*names, ngram_lm._END] if hot else [], dtype=np.uint64)))
    got = {r.doc_id: r for r in ngram_lm.score_documents(docs).collect()}
    tokens = {i: [*words(lowered(t)), "\0"] for i, t in texts.items()}
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(w)
            two.update(zip(["\0", *w], w, strict=False))
            three.update(zip(["\0", "\0", *w], ["\0", *w], w, strict=False))
    n, v, k = sum(one.values()), len(one), ngram_lm.PRIOR
    for i, w in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(one[x] > 0 for x in w), n)
        # the contract's denominator, N+1*(V+1)
        assert math.isclose(got[i].base_score, sum(math.log10((one[x] + 1) / (n + 1 * (v + 1))) for x in w), rel_tol=1e-9)
        score = 0.0
        for c, b, a in zip(["\0", "\0", *w], ["\0", *w], w, strict=False):
            p1 = (one[a] + 1) / (n + v + 1)
            p2 = (two[b, a] + k * p1) / (one[b] + k)
            before = one["\0"] if c == b == "\0" else two[c, b]
            score += math.log10((three[c, b, a] + k * p2) / (before + k))
        assert abs(got[i].score - score) <= 0.03 * len(w)
    assert ngram_lm.score_documents(empty).count() == 0


def test_lm_score_of_hot_pairs(docs, texts, monkeypatch):
    """Every other word hot, and every other pair: the same counts and, within the quantisation, scores."""
    word, sizes = ngram_lm._tokens([(t or "").encode() for t in texts.values()])
    one, two = ngram_lm._before(word, sizes)
    pairs = ngram_lm._pair_names(two, one)
    hot = np.unique(np.concatenate([np.unique(one)[::2], np.unique(pairs)[::2]]))
    monkeypatch.setattr(ngram_lm, "_hot_words", lambda rows: hot)
    got = {r.doc_id: r for r in ngram_lm.score_documents(docs).collect()}
    monkeypatch.setattr(ngram_lm, "_hot_words", lambda rows: hot[:0])
    for r in ngram_lm.score_documents(docs).collect():
        same = got[r.doc_id]
        assert (same.n_tokens, same.n_known, same.train_tokens) == (r.n_tokens, r.n_known, r.train_tokens)
        assert math.isclose(same.base_score, r.base_score, rel_tol=1e-12)
        assert abs(same.score - r.score) <= 0.03 * r.n_tokens


def test_lm_trie_smooths_within_its_shard():
    draw = np.random.default_rng(3)
    v, u, w = draw.integers(1, 6, 4000, dtype=np.uint64) << np.uint64(2), draw.integers(0, 9, 4000, dtype=np.uint32), draw.zipf(1.5, 4000).clip(max=50).astype(np.uint32)
    count, k = draw.integers(1, 4, 4000, dtype=np.uint32), ngram_lm.PRIOR
    trie = ngram_lm.Trie(v, u, w, count, np.zeros(0))
    # successors are named by their place below the context word
    assert int((trie.triples.get(np.arange(trie.triples.n)) & trie._no_place()).max()) < len(np.unique(w))
    assert int(trie.shift) == len(np.unique(w)).bit_length()
    asked = [(a, b, c) for a in range(0, 7) for b in range(0, 10, 3) for c in (1, 2, 7, 60)]
    total, weight, share = trie.lookup(np.arange(7, dtype=np.uint64) << np.uint64(2), np.full(7, 4), np.array([b for _ in range(7) for b in range(0, 10, 3)], dtype=np.uint32), np.full(28, 4), np.array([c for _, _, c in asked], dtype=np.uint32))
    for i, (a, b, c) in enumerate(asked):
        is_v, is_u, is_w = v == a << 2, u == b, w == c
        of_v, of_uv = count[is_v].sum(), count[is_v & is_u].sum()
        p2 = count[is_v & is_w].sum() / (of_v + k)
        p3 = (count[is_v & is_u & is_w].sum() + k * p2) / (of_uv + k)
        left = k / (of_uv + k) * k / (of_v + k)
        assert total[a] == of_v
        assert abs(math.log10(ngram_lm._shares(weight[i // 4]) / left)) <= 1.01 * ngram_lm._STEP
        assert (share[i] == 255) == (p3 == 0) and (p3 == 0 or abs(math.log10(ngram_lm._shares(share[i]) / p3)) <= 1.01 * ngram_lm._STEP)


def test_elias_fano():
    draw = np.random.default_rng(1)
    for values in (draw.integers(0, 2**63, 5000), np.arange(300), draw.integers(0, 50, 1000), draw.integers(0, 2**64 - 1, 300, dtype=np.uint64), np.array([7])):
        values = np.sort(values.astype(np.uint64))
        packed, n = ngram_lm.EliasFano(*ngram_lm.EliasFano.pack(values)), len(values)
        assert (packed.get(np.arange(n)) == values).all()
        for found in (packed.search(values, np.zeros(n, dtype=np.int64), np.full(n, n)), packed.find(values)):
            assert (values[found] == values).all()
        absent = np.setdiff1d(values + np.uint64(1), values)
        assert (packed.find(absent) == -1).all()
        # two bits and the low bits a value, no places
        assert packed.high.nbytes + packed.low.nbytes <= n * (3 + packed.low_bits) / 8 + 40


def _print_of(text):
    return fingerprint.fingerprints([text.encode()])[0]


def test_fingerprint(docs, texts, empty):
    """Against every text and edited text parsed alone."""
    got = {r.doc_id: r for r in fingerprint.compare_with_edits(docs, ranges=4).collect()}
    order = sorted(texts)
    for k, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        own, changed, after = map(_print_of, (text, edited, following))
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own.tobytes().hex(), changed.tobytes().hex())
        for found, other in ((got[i].near_edited, changed), (got[i].near_next, after)):
            both = sorted(set(own.tolist()) | set(other.tolist()))[: fingerprint.SIZE]
            assert found == (len(set(both) & set(own.tolist()) & set(other.tolist())) / len(both) if both else 1.0)
    assert got[1002].fingerprint == got[1007].fingerprint and got[1000].fingerprint == ""
    near = fingerprint.fingerprints([texts[1006].encode(), ("shift " + texts[1006]).encode()])
    assert fingerprint.likeness(*near) > 0.9
    assert fingerprint.compare_with_edits(empty).count() == 0


def test_fingerprint_one_row_and_locality(spark):
    """A table of one row is its own next document, and neighbours have no bearing on a text's fingerprint."""
    row = spark.createDataFrame([(5, "some words of a text that stands alone, aaaa")], "doc_id long, text string")
    got = fingerprint.compare_with_edits(row).first()
    assert got.near_next == 1.0
    dice = np.random.default_rng(4)
    texts = ["".join(dice.choice(list("ab c\n"), int(n))).encode() for n in dice.integers(0, 300, 200)]
    together = fingerprint.fingerprints(texts)
    assert all(np.array_equal(x, fingerprint.fingerprints([t])[0]) for x, t in zip(together, texts, strict=True))


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    frame = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, DATA)
        assert after.columns == documents.columns, name
        assert after.count() <= frame.count()
        frame = after.cache()
    packed = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in frame.collect()}


def test_hamming_blocks(spark):
    """Every pair within the radius meets in a block; unrelated ones meet seldom."""
    dice = np.random.default_rng(8)
    items = dice.integers(-(2**63), 2**63 - 1, (40, 4), dtype=np.int64)
    near = []
    for i in range(40):
        flips = dice.choice(256, decontamination.RADIUS, replace=False)
        fp = items[i].copy().view(np.uint64)
        for b in flips:
            fp[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        near.append(fp.view(np.int64))
    frame = lambda rows: spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(rows)], "id int, fp array<long>")
    left = frame(near).select("id", F.col("fp").alias("f"), F.explode(decontamination.window_blocks(decontamination.BLOCKS)).alias("b"))
    right = frame(items).select(F.col("id").alias("item"), F.col("fp").alias("g"), F.explode(decontamination.item_probes(decontamination.BLOCKS, decontamination.RADIUS)).alias("b"))
    met = left.join(right, "b").select("id", "item", decontamination.distance("f", "g").alias("d")).distinct().collect()
    assert {(r["id"], r["item"]) for r in met if r["d"] <= decontamination.RADIUS} == {(i, i) for i in range(40)}
    assert len(met) < 0.35 * 40 * 40
