import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import vector_search


def product(v, w):
    s = 0.0
    for a, b in zip(v, w):
        s += a * b
    return s


def brute(rows, k, is_query):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[(i, tuple(v))] = None
    out = {}
    for q, v in good:
        if is_query(q):
            s = sorted((-product(v, w), i) for i, w in good if i != q)
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("i", F.lit("clash")).withColumn("ids", F.lit(2))
    got = {}
    for r in vector_search.nearest(df, is_query=lambda i: i % 2 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_all_probed_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(120)]
    rows += [(i, [0.5, 0.5, -0.5, 0.5]) for i in range(200, 260)]
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0, None, 0.0, 0.0]), (304, [math.nan, 1.0, 0.0, 0.0]), (306, [math.inf, 0.0, 0.0, 0.0]), (308, [1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (2, rows[2][1])]
    got = run(spark, rows, k=7, cells=5, probe=1.0, block=10, query_block=9)
    want = brute(rows, 7, lambda q: q % 2 == 0)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q in want:
        np.testing.assert_allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_few_rows(spark):
    assert run(spark, [(2, [1.0, 0.0, 0.0, 0.0])]) == {}
    assert run(spark, []) == {}
    got = run(spark, [(2, [1.0, 0.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0, 0.0])])
    assert got == {2: [(3, 1.0)]}


def test_heap_pops_cells_by_summed_distance():
    rng = np.random.default_rng(2)
    index = vector_search.MultiIndex(rng.normal(size=(6, 2)), rng.normal(size=(5, 2)), np.ones((6, 5), int))
    q = rng.normal(size=4)
    order = index.visit(q, 30)
    d = [((index.first[i] - q[:2]) ** 2).sum() + ((index.second[j] - q[2:]) ** 2).sum() for i, j in order]
    assert len(set(order)) == 30 and np.all(np.diff(d) >= -1e-12)
    assert index.visit(q, 7) == order[:7]


def test_each_length_is_searched(spark):
    rows = [(i, [float(i)]) for i in range(1, 6)] + [(i, [float(i % 7), 1.0, 2.0]) for i in range(10, 16)] + [(20, []), (22, [0.0])]
    got = run(spark, rows, k=3, probe=1.0)
    assert set(got) == {2, 4, 10, 12, 14}
    assert got[2] == [(5, 10.0), (4, 8.0), (3, 6.0)] and {i for i, _ in got[12]} <= set(range(10, 16))


def test_a_vector_that_many_share(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(3000)] + [(5000 + i, [0.1 * i, 1.0, 0.0, 0.0]) for i in range(10)]
    got = run(spark, rows, k=4)
    assert len(got) == 1505 and [i for i, _ in got[0]] == [1, 2, 3, 4] and [i for i, _ in got[2000]] == [0, 1, 2, 3] and [i for i, _ in got[2]] == [0, 1, 3, 4]


def many_near_vectors():
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(300, 1, 16)) + 0.3 * rng.normal(size=(300, 30, 16))).reshape(-1, 16)
    return [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1", "made"])
def test_recall_with_the_defaults(spark, name):
    if name == "made":
        df = spark.createDataFrame(many_near_vectors(), "vec_id long, embedding array<float>")
    else:
        df = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in vector_search.nearest(df, is_query=lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(got[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    print(name, np.mean(hits))
    assert np.mean(hits) >= 0.9


def test_near_neighbours_need_few_cells():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(200, 1, 16)) + 0.05 * rng.normal(size=(200, 40, 16))).reshape(-1, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    share = vector_search.probe_for(x, vector_search.kmeans(x[:, :8], 64), vector_search.kmeans(x[:, 8:], 64), 20, 0.94)
    assert share < 0.1
    y = rng.normal(size=(4000, 16))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert vector_search.probe_for(y, vector_search.kmeans(y[:, :8], 64), vector_search.kmeans(y[:, 8:], 64), 20, 0.94) > 0.1
