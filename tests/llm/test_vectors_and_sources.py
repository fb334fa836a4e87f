"""Centroid clustering and the divergence audit against brute force and against SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lodestone.llm import centroids, divergence, queries

SF = "/root/testdata/sf0.001"


def plain_clusters(rows, number=16, rounds=3, dim=64):
    """Every vector against every centroid in plain integers."""
    kept = [(i, [int(np.floor(64.0 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [list(v) for _, v in sorted(kept, key=key)[:number]]

    def assign():
        found = []
        for _, v in kept:
            d = [sum((x - y) ** 2 for x, y in zip(v, w, strict=True)) for w in c]
            found.append((d.index(min(d)), min(d)))
        return found

    for _ in range(rounds):
        at = assign()
        for k in range(len(c)):
            mine = [v for (_, v), (j, _) in zip(kept, at, strict=True) if j == k]
            if mine:
                c[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assign()
    each = Counter()
    for j, d in at:
        each[j] += d
    digest = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(((i, j, d, each[j], sum(each.values()), digest[j]) for (i, _), (j, d) in zip(kept, at, strict=True)), key=repr)


def odd_vectors(seed=2):
    """Crowds of copies, near copies, ties, odd components and lengths, null and repeated ids."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, 64)) * 2
    rows = [(i, (base[i % 12] + rng.standard_normal(64) * rng.choice([0, 0.02, 0.5])).astype(float).tolist()) for i in range(260)]
    rows += [(1000 + i, base[0].tolist()) for i in range(120)]  # one vector many times
    rows += [(2000, [0.0] * 64), (2001, [-0.0] * 64), (2002, [1e-300] * 64), (2003, [-1e-300] * 64)]
    rows += [(None, base[1].tolist()), (None, base[2].tolist()), (5, base[3].tolist()), (5, base[3].tolist())]
    rows += [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [1.0] * 65), (3004, [float("nan")] + [1.0] * 63), (3005, [None] + [1.0] * 63), (3006, [float("-inf")] + [1.0] * 63)]
    return rows


@pytest.mark.parametrize("block", [8192, 50])
def test_clusters(spark, block):
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, id string")
    got = centroids.cluster_vectors(df.repartition(3), block=block)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_clusters(rows)


def test_few_or_no_vectors(spark):
    rows = odd_vectors()[:5]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in centroids.cluster_vectors(df).collect()), key=repr) == plain_clusters(rows)
    assert centroids.cluster_vectors(df.limit(0)).count() == 0
    assert centroids.cluster_vectors(df.selectExpr("vec_id", "CAST(NULL AS array<double>) AS embedding")).count() == 0
    with pytest.raises(Exception, match="64-bit"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64), (2, [0.0] * 64)], "vec_id long, embedding array<double>")).collect()


def test_balls():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-40, 40, (700, 8)), np.repeat(rng.integers(-40, 40, (1, 8)), 300, axis=0)])
    tree = centroids.Tree.build(x)
    assert (x[tree.order] == tree.x).all() and sorted(tree.order.tolist()) == list(range(1000))
    for b in np.nonzero(tree.low >= 0)[0]:
        mine = tree.x[tree.low[b] : tree.high[b]]
        assert (mine.sum(axis=0) == tree.total[b]).all()
        assert (np.sqrt(((mine - tree.centre[b]) ** 2).sum(axis=1)) <= tree.radius[b] + 1e-9).all()
    for c in (rng.integers(-40, 40, (5, 8)), x[:16], np.zeros((3, 8), np.int64)):  # the last: ties everywhere
        sure, rows, near = tree.assign(c)
        found = np.full(1000, -1)
        for b, k in sure:
            found[tree.low[b] : tree.high[b]] = k
        assert (found[rows] == -1).all()
        found[rows] = near
        assert (found == centroids.squared(tree.x, c).argmin(axis=1)).all()
    tight = centroids.Tree.build(np.concatenate([k * 1000 + rng.integers(0, 3, (200, 8)) for k in range(4)]))
    assert not len(tight.assign(np.array([[k * 1000] * 8 for k in range(4)]))[1])  # whole balls only


def plain_audit(rows, least=10, top=10):
    """All terms of all groups, in plain integers."""
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        n[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, k in df[lang].items() if k >= least]
        peers = [g for g in groups if g[0] == lang]
        part = lambda c, size: {t: 1 + 10**9 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p = {g[1]: part(n[g], sum(n[g][t] for t in kept)) for g in peers}
        whole = {t: sum(n[g][t] for g in peers) for t in kept}
        q = part(whole, sum(whole.values()))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(sum(gap(p[source][t], p[o][t]) for t in kept), o) for _, o in peers if o != source]
        terms = [(gap(p[source][t], q[t]), t) for t in kept if n[lang, source][t] and p[source][t] > q[t]]
        for name, found, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, name, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def odd_documents(seed=4, sources=9):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["Äther", "ÄTHER", "naïve", "日本", "don't", "x1y"]
    rows = []
    for i in range(700):
        lang = rnd.choice(["en", "de", None, "en"])
        source = rnd.choice([f"s{k}" for k in range(sources)] + [None, ""])
        some = rnd.choices(words, weights=[1 / (1 + k) for k in range(len(words))], k=rnd.randrange(60)) + [f"own{source}"] * rnd.randrange(4)
        rows.append((rnd.choice([" ", "\n", ", 7 "]).join(some), lang, source))
    rows += [(None, "en", "empty"), ("", "xx", "one"), ("... 123", "xx", "two"), ("rare words only", "yy", "one"), ("long " * 400_000, "en", "s1"), (None, None, None)]
    return rows + rows[:20]


def test_audit(spark):
    rows = odd_documents()
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "text string, lang string, source string, value long, term string").repartition(3)
    want = plain_audit(rows)
    assert sorted(tuple(r) for r in divergence.audit_sources(df).collect()) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[4] == 0 for r in want)
    postings, groups = divergence._prepare(df, "text", "lang", "source", 10)
    blocks = divergence.pairs(postings, groups, width=4, slice_rows=100)  # several blocks of sources and slices of terms
    assert sorted((r.lang, r.source, "pair", r["item"], r.value, r.rank) for r in blocks.collect()) == [r for r in want if r[2] == "pair"]
    counts = divergence.count_terms(df, "text", "lang", "source")
    early = divergence.count_terms(df, "text", "lang", "source", most=200)  # counts are passed on again and again
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, counts.collect()))


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    got = divergence.audit_sources(df)
    assert got.count() == 0 and got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 10)
    text = "alpha BETA gamma-delta ÉCOLE " * 20
    assert [t for some in divergence.terms(text.encode()) for t in some] == [x.encode() for x in "alpha beta gamma delta École".replace("É", "É").split()] * 20


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    cursor = duck.execute(queries.oracle_sql()[name])
    assert [d[0] for d in cursor.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())
