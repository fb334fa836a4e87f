import numpy as np
import pytest

from lodestone.operators import intelligence, vector_index


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    x = base[rng.integers(0, 40, 3000)] + 0.25 * rng.standard_normal((3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, []), (9003, [1.0] * 5), (9004, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    path = str(tmp_path_factory.mktemp("index"))
    return df.where("id < 9000"), vector_index.build(df, path, cell_rows=100), x


def test_exact_search_equals_the_scan(spark, data):
    df, index, x = data
    assert index.bits == 5 and index.rows.count() == 3000
    again = vector_index.load(spark, index.path)
    for q in (x[7], x[1500], -x[3], np.zeros(16)):
        got = [(r.id, round(r.score, 9)) for r in again.search(q.tolist(), 10, exact=True).collect() if r.score == r.score]
        want = [(r.id, round(r.score, 9)) for r in intelligence.top_k(df, q.tolist(), 10).collect() if r.score == r.score]
        assert got == want
    with pytest.raises(ValueError):
        index.search([1.0])


def test_bounds_hold(data):
    _, index, x = data
    q = x[5]
    number, bound = index.cells(q)
    cells = (x @ vector_index.planes(index.bits, 16).T > 0) @ (1 << np.arange(index.bits))
    cos = (x @ q) / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    most = dict(zip(number.tolist(), bound.tolist(), strict=True))
    assert all(cos[i] <= most[int(c)] + 1e-9 for i, c in enumerate(cells))


def test_recall_and_pruning(spark, data):
    df, index, x = data
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 3000, 100)], "query long, embedding array<double>")
    got = {}
    for r in index.search_many(queries, 10).collect():
        got.setdefault(r["query"], set()).add(r.id)
    hits = 0
    for i in range(0, 3000, 100):
        cos = (x @ x[i]) / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i])
        hits += len(got[i] & set(np.lexsort((np.arange(3000), -cos))[:10].tolist()))
    assert hits / 300 >= 0.9
    plan = index.rows.where("cell IN (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_index_of_nothing(spark, tmp_path):
    index = vector_index.build(spark.createDataFrame([(1, None)], "id long, embedding array<double>"), str(tmp_path))
    assert (index.bits, index.dim) == (0, 0)
