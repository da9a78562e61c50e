import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.llm import components as components_module
from loomspan.llm import jaccard
from loomspan.llm.components import components


def sets_of(docs, k):
    out = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return out


def brute(docs, percent, k):
    sets = sets_of(docs, k)
    ids = sorted(sets)
    up = {d: d for d in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for d in ids:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    seen = set()
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= percent * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def run(spark, docs, percent, k):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("cls", F.lit(0))
    rows = jaccard.jaccard_components(df, percent=percent, k=k).collect()
    assert len(rows) == len(docs)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def near_copies(n, words, seed, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            w[rng.integers(0, words)] = f"e{rng.integers(0, 10**9)}"
        out.append(" ".join(w))
    return out


def corpus():
    texts = [None, "", " \t\n", "one", "One", "one two", "a b c d", "A  B\nc d", "x " * 4000, "x " * 3000 + "y"]
    for i, (n, words, edits) in enumerate([(30, 60, 4), (25, 200, 9), (3, 1500, 30), (40, 30, 1), (12, 8, 1)]):
        texts += near_copies(n, words, i, edits)
    texts += ["shared passage of some words that all of these documents hold " + t for t in near_copies(30, 40, 9, 40)]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent,k", [(85, 4), (80, 5)])
def test_like_brute_force(spark, percent, k):
    docs = corpus()
    assert run(spark, docs, percent, k) == brute(docs, percent, k)


def test_large_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    docs = corpus()
    assert run(spark, docs, 85, 4) == brute(docs, 85, 4)


def test_sample_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = run(spark, docs, 85, 4)
    assert got == brute(docs, 85, 4)
    assert any(c != d for d, (_, c) in got.items())


def test_nothing_and_stage(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    kept = {r.doc_id for r in jaccard.one_of_each(df).collect()}
    want = {d for d, (_, c) in brute(corpus(), 80, 5).items() if c == d}
    assert kept == want


def test_repeated_rows_with_one_id(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "z")], "doc_id long, text string")
    rows = jaccard.jaccard_components(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (1, 1), (2, 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.integers(0, 10**6)), min_size=2, max_size=40), st.sampled_from([80, 85, 100]))
def test_trees_keep_every_link(specs, percent):
    sets = []
    for n, seed in specs:
        base = np.random.default_rng(seed % 5).integers(0, 1 << 63, 500, dtype=np.uint64)
        sets.append(np.unique(base[:n]))
    sizes = np.array([len(s) for s in sets])
    maps = [jaccard.bitmap(s, jaccard._bits_for(len(s))) for s in sets]
    got = {frozenset(p) for a, b in jaccard.candidate_pairs(sizes, maps, percent) for p in zip(a.tolist(), b.tolist())}
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= percent * (sizes[i] + sizes[j] - n):
                assert frozenset((i, j)) in got


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components_module, "ONE_TASK", one_task)
    rows = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7), (None, 3), (200, 201)]
    got = {r.node: r.label for r in components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}


def test_one_row_of_each_document_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "b"), (3, "only this", "c"), (3, "only this", "c"), (4, None, "d"), (4, None, "d"), (None, text, "e"), (5, "", "f"), (6, "first text of six", "g"), (6, "second text of six", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string").withColumn("gone", F.lit(1)).withColumn("id", F.lit(2))
    out = jaccard.one_of_each(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert got == sorted([("1", text), ("3", "only this"), ("4", "None"), ("None", text), ("5", ""), ("6", "first text of six"), ("6", "second text of six")])
