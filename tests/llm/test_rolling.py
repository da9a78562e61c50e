import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import queries, rolling, twins

from ..oracle import rows_of_query, rows_of_sql

SCHEMA = "doc_id long, source string, event long, text string, lang string, k string"


def brute(rows, widths):
    out = []
    for doc, source, t, *_ in rows:
        for w in widths:
            near = [r for r in rows if t is not None and r[2] is not None and r[1] == source and t - w <= r[2] < t]
            lens = sorted(len(r[3]) for r in near if r[3] is not None)
            m = len(lens)
            out.append((doc, w, t, len(near), sum(lens), len({r[4] for r in near if r[4] is not None}), lens[(m + 1) // 2 - 1] if m else None, lens[-(-75 * m // 100) - 1] if m else None))
    return sorted(out, key=repr)


def found(spark, rows, widths, **limits):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = rolling.document_features(df, F.col("event"), widths=widths, **limits)
    return sorted((tuple(r) for r in got.select("doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars").collect()), key=repr)


def cases(seed, n, spread, sources=("a", "b", None)):
    rng = np.random.default_rng(seed)
    text = lambda: None if rng.random() < 0.1 else "ä" * int(rng.choice([0, 1, 2, 3, rng.integers(0, 300)]))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    return [(int(i) if rng.random() > 0.05 else None, pick(sources), int(rng.integers(-spread, spread)) if rng.random() > 0.05 else None, text(), pick(["de", "en", "fr", None]), "clash") for i in range(n)]


@pytest.mark.parametrize("seed,n,spread", [(1, 150, 40), (2, 250, 300), (3, 60, 5)])
def test_equals_brute_force(spark, seed, n, spread):
    rows = cases(seed, n, spread)
    rows += rows[:20]  # repeated rows
    assert found(spark, rows, (7, 30)) == brute(rows, (7, 30))


@pytest.mark.parametrize("group_rows", [1, 9, 40])
def test_blocks_cut_by_value_are_the_same(spark, group_rows):
    rows = cases(4, 220, 60, sources=("hot", "hot", "hot", "b", None))
    assert found(spark, rows, (11, 25), group_rows=group_rows, batch_rows=64) == brute(rows, (11, 25))


def test_one_time_and_no_rows(spark):
    rows = [(i, "s", 5, "x" * i, "en", "k") for i in range(9)] + [(9, "s", 6, None, None, "k"), (None, None, None, None, None, None)]
    assert found(spark, rows, (1, 4)) == brute(rows, (1, 4))
    assert found(spark, [], (3,)) == []


def test_the_query_equals_its_sql(spark, sf_dir):
    got = rows_of_query(queries.op12_rolling_features(spark, sf_dir))
    assert got == rows_of_sql(twins.ROLLING, sf_dir)


def test_trees_select_from_two_versions():
    rng = np.random.default_rng(7)
    tree = np.sort(rng.integers(0, 4, 300))
    rank, n = rng.integers(0, 37, 300), rng.integers(1, 4, 300)
    trees = rolling.Trees(tree, rank, n)
    for _ in range(200):
        x, y = (int(rng.integers(-1, 300)) for _ in range(2))
        held = np.sort(np.concatenate([np.repeat(rank[: i + 1], n[: i + 1] * (tree[: i + 1] == tree[i])) for i in (x, y) if i >= 0] or [np.zeros(0, int)]))
        if len(held):
            r = int(rng.integers(1, len(held) + 1))
            row = trees.select(np.array([x]), np.array([y]), np.array([r]))[0]
            assert rank[row] == held[r - 1]
            assert trees.sizes(np.array([x]))[0] + trees.sizes(np.array([y]))[0] == len(held)
