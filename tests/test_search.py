import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from loomspan import api
from loomspan.operators import search


def bm25(docs, query, k):
    counts = {d: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for d, t in docs}
    n, mean = len(docs), sum(sum(c.values()) for c in counts.values()) / len(docs)
    out = []
    for d, c in counts.items():
        score = 0.0
        for w in dict.fromkeys(re.findall(r"[^\W_]+", query.lower())):
            df = sum(w in x for x in counts.values())
            if c[w]:
                score += math.log1p((n - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        if score:
            out.append((-round(score, 9), d))
    return [(d, -s) for s, d in sorted(out)[:k]]


def corpus():
    rng = random.Random(9)
    vocabulary = ["Apfel", "straße", "été", "tree", "42", "sun", "moon", "Ωμέγα"] + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(150)]
    return docs + [(900, None), (901, ""), (902, "?! ..."), (903, "tree, tree; TREE")]


def test_equals_brute_force(spark, tmp_path):
    docs = corpus()
    index = search.Index.write(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "index"), buckets=8)
    assert index.n_docs == len(docs)
    again = search.Index.open(spark, str(tmp_path / "index"))
    for q in ("tree", "Sun MOON été", "straße straße w3", "nothing here w29", "", "absent"):
        want = bm25(docs, q, 7)
        got = [(r.id, r.score) for r in again.search(q, 7).orderBy("rank").collect()]
        assert [d for d, _ in got] == [d for d, _ in want] and all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(got, want))
    queries = spark.createDataFrame([(1, "tree sun"), (2, "moon"), (3, None), (4, "absent")], "query_id int, text string")
    many = sorted((r.query_id, r["rank"], r.id) for r in index.search_many(queries, max_results=4).collect())
    assert many == [(q, i + 1, d) for q, t in ((1, "tree sun"), (2, "moon")) for i, (d, _) in enumerate(bm25(docs, t, 4))]


def test_a_common_term_is_dealt_over_parts(spark, tmp_path):
    """The same ranks for any number of parts, and no task joins a common term alone."""
    docs = [(i, "the " * (i % 7 + 1) + f"w{i % 50}") for i in range(2000)]
    index = search.Index.write(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "index"), buckets=4)
    queries = spark.createDataFrame([(q, f"the w{q}") for q in range(20)], "query_id int, text string")
    got = {n: sorted(map(tuple, index.search_many(queries, salts=n).collect())) for n in (1, 3, 32)}
    assert got[1] == got[3] == got[32] and len(got[1]) == 20 * 8
    assert sorted(d for q, d, _, _ in got[1] if q == 5) == sorted(d for d, _ in bm25(docs, "the w5", 8))
    plan = index.search_many(queries)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*term#\d+ = term#\d+.* = salt#\d+", plan)


def test_tasks_grow_with_the_corpus(spark, tmp_path, monkeypatch):
    """No task sorts or adds up more rows in a larger corpus, and the ranks stay the same, by a broadcast or a shuffle."""
    docs = [(i, "the " * (i % 7 + 1) + f"w{i % 50}") for i in range(2000)]
    frame, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(q, f"the w{q}") for q in range(20)], "query_id int, text string")
    want = sorted(map(tuple, search.Index.write(frame, str(tmp_path / "whole"), buckets=4).search_many(queries).collect()))
    monkeypatch.setattr(search, "TASK_ROWS", 500)
    index = search.Index.write(frame, str(tmp_path / "slices"), buckets=4)
    files = index.postings().where("term = 'the'").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 3 and max(r["count"] for r in files) < 2000
    for sent in (search.SENT, 0):
        monkeypatch.setattr(search, "SENT", sent)
        ranked = index.search_many(queries)
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        tasks = [int(n) for n in re.findall(r"RepartitionByExpression \[query_id#\d+, id#\d+L?\], (\d+)", plan)]
        assert tasks and tasks[0] >= 20 * 2000 // 500
        assert sorted(map(tuple, ranked.collect())) == want


def test_a_query_reads_its_terms_alone(spark, tmp_path):
    index = search.Index.write(spark.createDataFrame(corpus(), "doc_id long, text string"), str(tmp_path / "index"), buckets=16)
    rows = index.postings(["tree"])
    assert {r.term for r in rows.collect()} == {"tree"} and len(rows.inputFiles()) >= 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,tree)]" in plan


def test_the_verb(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple apple"), (3, "pear")], "doc_id int, text string")
    assert [(r.id, r.line.split("\n")[1].strip()) for r in api.search(docs, "Apple").orderBy("rank").collect()] == [(2, "apple apple"), (1, "apple pie")]


def test_an_empty_corpus(spark):
    assert search.Index.write(spark.createDataFrame([], "doc_id long, text string")).search("x").count() == 0
