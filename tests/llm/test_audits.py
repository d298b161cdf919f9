"""Brute-force versions of whitening, the divergence audit and the MinHash join, on real rows and odd ones."""

import collections
import itertools
import math
import re

import duckdb
import numpy as np
import pytest

from frostline.llm import divergence, minhash, whitening
from frostline.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, n long, x string"


def eigen(rows):
    """x, n, sums and the covariance's pairs, falling."""
    x = np.floor(1024 * np.array(rows, dtype=np.float64)).astype(np.int64) + 100_000
    mean = x.mean(axis=0)
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / len(x))
    return x, mean, values[::-1], vectors[:, ::-1]


def test_whitening_query(spark):
    given = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    x, mean, values, vectors = eigen(list(given.values()))
    at = dict(zip(given, range(len(given)), strict=True))
    got = QUERIES["op11_whitening"](spark, DATA).collect()
    assert len(got) == 8 * len(given) and {r.component for r in got} == set(range(1, 9))
    sums = x.sum(axis=0)
    whitened = np.zeros((len(given), 8))
    for r in got:
        i = at[r.vec_id]
        assert r.n == len(given) and r.deviation == sum((r.n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-12)
        assert r.identity_error < 1e-9
        whitened[i, r.component - 1] = r.whitened
    want = (x - mean) @ vectors[:, :8] / np.sqrt(values[:8])
    want *= np.sign((want * whitened).sum(axis=0))
    assert np.abs(whitened - want).max() < 1e-9


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [math.sin(i * j + j) for j in range(1, 6)]) for i in range(30)] + [(3, [0.5] * 5), (None, [0.25] * 5), (31, [1e30, 0.0, 0.0, 0.0, 0.0])]
    bad = [(100, None), (101, [nan] * 5), (102, [0.0, None, 0.0, 0.0, 0.0]), (103, [inf, 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    rows = spark.createDataFrame([(i, e, 0, 1, "x") for i, e in good + bad], VECTORS).repartition(3)
    got = whitening.whiten(rows).collect()
    assert {r.vec_id for r in got} == {i for i, _ in good} and {r.n for r in got} == {len(good)}
    assert len(got) == 5 * len(good) or len(got) == len(good)  # the others may vanish beside 1e12 times larger ones
    tame = whitening.whiten(spark.createDataFrame([(i, e, 0, 1, "x") for i, e in good[:-1] + bad], VECTORS)).collect()
    assert len(tame) == 5 * (len(good) - 1) and max(r.identity_error for r in tame) < 1e-9
    assert sum(r.explained for r in tame if r.vec_id == 7) == pytest.approx(1)
    # equal vectors have no spread, no rows no result, and a plane two components
    assert whitening.whiten(spark.createDataFrame([(i, [0.5] * 5, 0, 1, "x") for i in range(4)], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    plane = [(i, [float(i % 5), 0.0, float(i % 3), 0.0], 0, 1, "x") for i in range(40)]
    assert {r.component for r in whitening.whiten(spark.createDataFrame(plane, VECTORS)).collect()} == {1, 2}


@pytest.mark.parametrize("most", [512, 40])
def test_block_lanczos(most):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((150, 150)))[0]
    spread = np.concatenate([[9.0, 9.0, 9.0, 7.0], 5 * 0.93 ** np.arange(146)])
    matrix = turn * spread @ turn.T
    steps = []
    values, vectors = whitening.block_lanczos(lambda q: steps.append(q.shape) or matrix @ q, 150, 8, most)
    assert np.allclose(values, spread[:8], rtol=1e-12) and np.abs(matrix @ vectors - vectors * values).max() < 1e-9
    assert len(steps) * 10 < 150 or most == 40
    # an invariant space at once: restarts find the rest
    values, _ = whitening.block_lanczos(lambda q: np.diag([4.0] * 12 + [1.0] * 28) @ q, 40, 8)
    assert np.allclose(values, 4)
    assert np.allclose(whitening.block_lanczos(lambda q: 0 * q, 3, 8)[0], 0)


def test_deviations_beyond_longs():
    x = np.array([[1 << 40, 5], [-(1 << 40), 7]])
    got = whitening.deviations(x, 2, np.array([0, 12], dtype=object))
    assert got == [(2 << 40) ** 2 + 4, (2 << 40) ** 2 + 4]


def audit(rows, k=200, least=3):
    """The contract in whole numbers, term by term."""
    own, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        own[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted((s for x, s in groups if x == lang), key=str.encode)

        def chance(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        p = {s: chance(own[lang, s]) for s in sources}
        q = chance(sum((own[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            f = {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in sources if o != s}
            g = {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept if own[lang, s][t] and p[s][t] > q[t]}
            for part, values, most in (("pair", f, None), ("term", g, k)):
                for rank, (item, value) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


ODD = [(None, None, "Äpfel Äpfel äpfel x"), (None, "b", "ÄPFEL x"), ("", "b", "äpfel y_z X9x"), ("zz", "a", None), ("zz", "b", ""), ("yy", "only", "one one one"), ("zz", "a", "1 2 3")]
ODD += [("tie", f"s{i % 4}", " ".join(f"word{'abcdefgh'[j]}{'pq'[j % 2]}" for j in range(i % 5, 8))) for i in range(20)] * 2 + [("tie", "s1", "語" * 300), ("tie", "s1", "語" * 299 + "ab"), ("tie", "s2", "語" * 300)] * 3


def audited(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, lang, s, 1, 2, "x") for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, value long, item string")
    got = divergence.audit_sources(docs.repartition(3), **options).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_audit_odd_rows(spark):
    assert audited(spark, ODD) == audit(ODD)
    assert audited(spark, []) == set()


def test_audit_selects_by_digits(spark):
    """With nothing left to the last sort every digit of values and terms decides."""
    real = [(r.lang, r.source[:4], r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for k in (1, 5):
        assert audited(spark, real + ODD, k=k, settled=0) == audit(real + ODD, k)
    assert audited(spark, real + ODD, k=200, settled=7) == audit(real + ODD)


def test_audit_matches_sql(spark):
    """The registered query against its SQL on a table where no group is empty."""
    got = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in QUERIES["op12_source_divergence"](spark, SMALL).collect()}
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    assert got == set(db.sql(f"select lang, source, part, item, value, rank from ({ORACLE_SQL['op12_source_divergence']})").fetchall())


def test_audit_flushes(spark, monkeypatch):
    """Whatever is counted together, sums are the same."""
    real = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()]
    keys, texts = [(x.encode(), y.encode()) for x, y, _ in real], [(t or "").encode().translate(divergence._LETTERS) for *_, t in real]

    def sums(step):
        out = collections.Counter()
        for at in range(0, len(real), step):
            for batch in divergence._counted(keys[at : at + step], texts[at : at + step]):
                for r in batch.to_pylist():
                    out[r["lang"], r["source"], r["term"], "c"] += r["c"]
                    out[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return out

    assert sums(1) == sums(7) == sums(40)
    assert all(re.fullmatch(r"[a-z\u0080-\U0010ffff]+", x[2]) for x in sums(40) if x[2] is not None)


def components(texts, k=4, percent=80):
    """(size, component) of each id by comparing all pairs of its texts' sets."""
    def words(t):
        return [w for w in re.split(r"[\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if w]

    sets = []
    for i, t in texts:
        w = words(t)
        sets.append((i, frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    have = [(i, s) for i, s in sets if i is not None and s]
    for (i, a), (j, b) in itertools.combinations(have, 2):
        if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return collections.Counter((i, len(s), find(i)) for i, s in sets)


def near(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, n long, component long, token long")
    got = minhash.link_documents(docs.repartition(3)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)


def test_minhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op13_minhash"](spark, DATA).collect())
    assert got == components(rows)


def test_minhash_odd_rows(spark):
    base = [f"w{i}" for i in range(300)]
    chain = [(500 + s, " ".join(base[s * 12 : s * 12 + 110])) for s in range(10)]  # neighbours link, ends don't
    odd = [(None, "a b c d e"), (None, None), (1, None), (2, ""), (3, "  \t"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two three"), (8, " ".join(f"L{i % 1009}" for i in range(20_000))), (9, " ".join(f"l{i % 1009}" for i in range(20_001)))]
    repeated = [(20, " ".join(base[:100])), (20, " ".join(base[100:200])), (21, " ".join(base[:99])), (22, " ".join(base[101:200])), (21, " ".join(base[:99]))]
    same = [(600 + i, "q r s t u v w x y z " + " ".join(base[:40] + [f"z{i}"])) for i in range(60)]
    assert near(spark, chain + odd + repeated + same) == components(chain + odd + repeated + same)
    assert near(spark, []) == collections.Counter()


def test_minhash_recall_at_the_threshold():
    """All pairs of a similarity of exactly 0.8 meet but for about one in ten thousand."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(300):
        x = rng.integers(0, 2**64, 900, dtype=np.uint64)
        a, b = np.sort(x[:810]), np.sort(np.concatenate([x[90:]]))
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) == 0.8
        missed += not minhash.meeting(*(minhash.half_keys([s]) for s in (a, b)))[0, 0]
    assert missed <= 1


def test_minhash_blocks(spark, monkeypatch):
    """Small blocks: followers are split, and what leaders leave open meets in pairs of blocks."""
    monkeypatch.setattr(minhash, "BLOCK_SETS", 4)
    from frostline.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 5))):
            w[at] = f"x{rng.integers(0, 4)}"
        rows.append((i, " ".join(w)))
    assert near(spark, rows) == components(rows)


def test_simhash_sums_are_gathered_once_a_row(spark):
    """No array of all sums is built anew for each bit of a fingerprint."""
    import re

    from frostline.llm import decontamination

    rows = spark.createDataFrame([(1, [5, 6, 7]), (2, [6, 8])], "id long, ws array<long>")
    weights = spark.createDataFrame([(6, 0.5)], "h long, weight double")
    got = decontamination._weighted(rows, ["id"], weights, 1.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"shiftright\(lambda s#\d+\[", plan)
    assert {r["id"]: len(r["fp"]) for r in got.collect()} == {1: 4, 2: 4}
