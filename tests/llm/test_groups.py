"""Linking operators and the pipeline against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import common, embedding_dedup, simhash
from lodestone.llm import components as components_
from lodestone.llm.components import connected_components


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 60)] + [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(120)] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = components({x for e in links if e[0] != e[1] for x in e}, [e for e in links if e[0] != e[1]])
    assert got == want
    assert connected_components(df.limit(0)).count() == 0


def test_links_between_fingerprints(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rnd.sample(range(64), rnd.randrange(1, 7)):
                x ^= 1 << bit
            fps.add(x)
    fps |= {0, 1 << 63, (1 << 64) - 1, 0b11110}
    rows = [(simhash._signed(f), i) for i, f in enumerate(sorted(fps))]
    by = {i: f for f, i in rows}
    got = sorted(tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame(rows, "fp long, rep long")).collect())
    want = sorted((i, j) for i in by for j in by if i < j and bin((by[i] ^ by[j]) & (2**64 - 1)).count("1") <= 4)
    assert got == want  # every link, once


def test_simhash_dedup(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(None, "a b c d e", "x"), (100_001, None, "x"), (100_002, "", "x"), (100_003, "Zz y x w v", "x"), (100_003, "Zz y x w v", "x"), (100_004, "zz  y\nx w v", "x")], docs.schema)
    df = docs.unionByName(more).withColumnRenamed("lang", "component_id")
    rows = simhash.simhash_dedup(df).collect()
    assert len(rows) == df.count()
    fps = [(r.doc_id, int(r.fingerprint, 16)) for r in rows if r.doc_id is not None]
    links = [(a, b) for a, x in fps for b, y in fps if a < b and bin(x ^ y).count("1") <= 4]
    want = components({i for i, _ in fps}, links)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert want[100_004] == 100_003 and want[100_002] == 100_001
    assert simhash.simhash_dedup(df.limit(0)).count() == 0


def test_one_id_with_two_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "q r s t u v"), (5, "a b c d e f"), (9, "q r s t u v")], "doc_id long, text string")
    assert {r.component_id for r in simhash.simhash_dedup(df).collect()} == {1}


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base, out = rng.standard_normal((30, 64)), []
    for i in range(300):
        out.append((base[i % 30] + rng.standard_normal(64) * rng.choice([0, 0.1, 0.3, 0.45])).astype(np.float32).tolist())
    return [*out, None, [0.0] * 64, [float("nan")] * 64, [float("inf"), *[1.0] * 63], [None, *[1.0] * 63], [1.0, 2.0], [2.0, 4.0], []]


def brute(ids, rows):
    unit = []
    for v in rows:
        ok = v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    n = dict.fromkeys(ids, 0)
    for i, j in pairs:
        n[ids[i]] += 1
        n[ids[j]] += 1
    return n, components(ids, [(ids[i], ids[j]) for i, j in pairs])


def test_embedding_dedup(spark):
    rows = vectors()
    ids = [int(x) for x in np.random.default_rng(1).permutation(4000)[: len(rows)]]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<float>, rep string, n int")
    n, comp = brute(ids, rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(df).collect()}
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in ids}
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_crowds_of_near_copies(spark, monkeypatch):
    """Balls that link wholly, at the border and not at all, against all pairs."""
    monkeypatch.setattr(embedding_dedup, "CROWD", 5)
    rng = np.random.default_rng(5)
    base = np.linalg.qr(rng.standard_normal((32, 6)))[0].T
    rows = []
    for k, wide in enumerate((0.02, 0.12, 0.3)):
        for angle in (0.0, 0.2, 0.38, 0.45, 0.5, 0.9):  # centres at and around the linking angle from the first
            centre = np.cos(angle) * base[2 * k] + np.sin(angle) * base[2 * k + 1]
            rows += [(centre + wide * rng.standard_normal(32) / 32**0.5).tolist() for _ in range(16)]
    rows += rng.standard_normal((40, 32)).tolist()
    rows += [[3 * x for x in rows[0]], [-x for x in rows[0]]]
    ids = [int(x) for x in rng.permutation(len(rows))]
    df = spark.createDataFrame(list(zip(ids, rows, strict=True)), "vec_id long, embedding array<double>")
    n, comp = brute(ids, rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(df, miss=1e-9).collect()}
    assert got == {i: (n[i], comp[i]) for i in ids}


def test_crowds_make_few_pairs(spark):
    rng = np.random.default_rng(6)
    one = rng.standard_normal(64)
    rows = [(i, (one + 0.05 * rng.standard_normal(64)).tolist()) for i in range(2000)]
    rows += [(i, rng.standard_normal(64).tolist()) for i in range(2000, 2500)]
    classes = spark.createDataFrame([(i, 1, v) for i, v in rows], "rep long, n long, v array<double>")
    more, edges = embedding_dedup.links(classes)
    assert {r.more for r in more.where("rep < 2000").collect()} == {1999} and {r.more for r in more.where("rep >= 2000").collect()} == {0}
    assert 1999 <= edges.count() < 4000


def test_neighbouring_crowds_write_few_rows(spark):
    """Two crowds whose centres lie just within the linking angle: right counts, edges that grow with the vectors."""
    rng = np.random.default_rng(9)
    base = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    wide = 0.02 * rng.standard_normal((3000, 64))
    x = np.concatenate([base[0] + wide[:1500], np.cos(0.44) * base[0] + np.sin(0.44) * base[1] + wide[1500:], 0.9 * base[0] + 0.3 * rng.standard_normal((60, 64))])
    ids = rng.permutation(len(x)) - 1000  # some below zero
    classes = spark.createDataFrame([(int(i), 1, v.tolist()) for i, v in zip(ids, x, strict=True)], "rep long, n long, v array<double>")
    more, edges = embedding_dedup.links(classes, miss=1e-9)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    want = dict(zip(ids.tolist(), (linked.sum(axis=1) - 1).tolist(), strict=True))
    assert {r.rep: r.more for r in more.collect()} == want
    assert 100_000 < linked[:1500, 1500:3000].sum() < 2_200_000 and edges.count() < 12_000
    got = {r.node: r.component for r in connected_components(edges).collect()}
    i, j = np.nonzero(np.triu(linked, 1))
    plain = components(ids.tolist(), list(zip(ids[i].tolist(), ids[j].tolist(), strict=True)))
    assert {k: got.get(k, k) for k in plain} == plain


def test_lengths_that_vanish_or_overflow(spark):
    v = [1.0, 2.0, -3.0]
    rows = [(1, [x * 1e-170 for x in v]), (2, [x * 1e300 for x in v]), (3, v), (4, [x * 2.0 for x in v]), (5, [4.9e-324, 0.0, 0.0]), (6, [1.7e308, 0.0, 0.0]), (7, [1.0, 1e-200, 0.0]), (8, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (2, 5), 6: (2, 5), 7: (2, 5), 8: (0, 8)}


def test_repeated_vector_rows(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(4, v), (4, v), (7, v), (4, w), (9, w), (None, w), (-(1 << 62) - 1, [0.0, 0.0, 1.0]), (-5, [0.0, 0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id if r.component_id is not None else -1) for r in embedding_dedup.embedding_dedup(df).collect())
    low = -(1 << 62) - 1
    assert got == [(False, low, 1, low), (False, -5, 1, low), (False, 4, 1, 4), (False, 4, 2, 4), (False, 4, 2, 4), (False, 7, 2, 4), (False, 9, 1, 4), (True, 0, 0, -1)]


def test_table_shape_meets_its_recall():
    for n in (100, 50_000, 10**9):
        bits, tables = embedding_dedup.shape(n)
        meet = (1 - np.arccos(0.9) / np.pi) ** bits
        assert (1 - meet) ** tables <= embedding_dedup.MISS


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = dict(docs.select("doc_id", "text").collect())
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == corpus_pipeline.COLUMNS
        if name == "quality":
            before = {r.doc_id for r in kept.collect()}
    left = {r.doc_id for r in kept.collect()}
    fps = [(i, simhash.fingerprint(text[i].encode()) & (2**64 - 1)) for i in before]
    comp = components(before, [(a, b) for a, x in fps for b, y in fps if a < b and bin(x ^ y).count("1") <= 4])
    assert left == {i for i in before if comp[i] == i}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == left
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, bad = ({i for i, q in labels.items() if q == k} for k in (1, 0))
    assert len(good & before) >= 0.97 * len(good) and len(bad & before) < 0.7 * len(bad)


def test_pipeline_stages_take_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", "s", 0), (900_002, "the of and " * 9, None, None, None), (900_002, "the of and " * 9, None, None, None)], docs.schema)
    df = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
    assert df.where("doc_id = 900002").count() <= 1
    with pytest.raises(Exception, match="doc_id"):
        corpus_pipeline.language(spark, docs.drop("doc_id"), sf)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_marks_cover_all_dropped_ids(spark, monkeypatch):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(i if i % 50 else None, i) for i in range(3000)] + [(7, -1), (-9, -2), (2**62, -3)], "doc_id long, n int")
    ids = spark.createDataFrame([(i,) for i in range(0, 3000, 7) if i % 50] + [(-9,), (2**62,)], "doc_id long")
    wanted = {r.doc_id for r in ids.collect()}
    for bits in (pipeline.MARK_BITS, 1 << 15, 8):  # the last two mark many or all others too
        monkeypatch.setattr(pipeline, "MARK_BITS", bits)
        rows = pipeline._marked(docs, ids).collect()
        assert len(rows) == docs.count()
        assert wanted <= {r.doc_id for r in rows if r.marked}
        if bits > 1 << 20:
            assert len({r.doc_id for r in rows if r.marked} - wanted) < 5
    assert not any(r.marked for r in pipeline._marked(docs, ids.limit(0)).collect())


def test_exploded_indexes_are_not_broadcast(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ids = spark.range(200)
    found = plan(simhash.links(ids.select(F.xxhash64("id").alias("fp"), F.col("id").alias("rep"))))
    assert "SortMergeJoin" in found and "Broadcast" not in found

    plans = {}
    settle = embedding_dedup.materialize
    monkeypatch.setattr(embedding_dedup, "materialize", lambda df, label: (plans.setdefault(label, plan(df)), settle(df, label))[1])
    spread = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.cos(F.col("id") * k))
    embedding_dedup.links(embedding_dedup.materialize(ids.select(F.col("id").alias("rep"), F.lit(1).cast("long").alias("n"), spread.alias("v")), "classes"))
    meets = [x for x in plans["pairs"].splitlines() if "bit_count" in x and "Join" in x]
    assert meets and all("SortMergeJoin" in x for x in meets)


def test_near_duplicates_broadcasts_no_exploded_table(spark, monkeypatch):
    sf, plans = "/root/testdata/sf0.001", []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: re.search(r"\w|$", line).start()
    for module in (components_, corpus_pipeline, simhash):
        monkeypatch.setattr(module, "materialize", lambda df, label, settle=module.materialize: (plans.append(plan(df)), settle(df, label))[1])
    corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    exploded = [p for p in plans if any("Generate explode" in x for x in p)]
    assert exploded
    for p in exploded:
        for k, line in enumerate(p):
            if "BroadcastExchange" in line:
                below = itertools.takewhile(lambda x, top=depth(line): depth(x) > top, p[k + 1 :])
                assert not any("Generate explode" in x for x in below)


def test_near_duplicates_broadcasts_nothing_that_grows(spark, monkeypatch):
    sf, plans = "/root/testdata/sf0.001", []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("one more "), "text"))
    docs = docs.unionByName(twice).unionByName(docs.where("doc_id % 5 = 0"))  # ids of two texts, and repeated rows
    found = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0, raising=False)
    for module in (components_, corpus_pipeline, simhash):
        monkeypatch.setattr(module, "materialize", lambda df, label, settle=module.materialize: (plans.append(plan(df)), settle(df, label))[1])
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert plans and not any("Broadcast" in p for p in plans)
    joins = [x for x in plan(kept).splitlines() if "BroadcastHashJoin" in x]
    assert joins and all("__at" in x for x in joins)  # the bitmaps, whose number has a bound
    assert sorted(r.doc_id for r in kept.collect()) == found == sorted(set(found))
