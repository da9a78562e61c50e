import hashlib
import pickle
import random
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [(re.sub("[A-Z]", lambda m: m[0].lower(), m[0]), m.start(), m.end()) for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def brute(docs, items, window=10):
    phrases = {}
    for i, t in items:
        w = [x for x, _, _ in words(t)]
        for j in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[j : j + window]), set()).add(i)
    lengths = {len(p) for p in phrases}
    out = []
    for d, t in docs:
        w = [x for x, _, _ in words(t)]
        hit, found = set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                got = phrases.get(tuple(w[j : j + n]))
                if got:
                    found |= got
                    hit |= set(range(j, j + n))
        names = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(d, b, **options)
    return sorted((tuple(r) for r in decontaminate.digest(found).collect()), key=str)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then the lazy dog sleeps"), (2, "short Item"), (22, "a a a a a a a a a a a a"), (3, ""), (None, "quick brown"), (4, "é ß"), (1, "The quick brown fox jumps over the lazy dog and then the lazy dog sleeps")]
DOCS = [(1, "x THE quick, brown fox jumps over the lazy dog and then; the lazy y"), (2, None), (3, ""), (4, "a " * 40 + "b " + "a " * 9), (5, "an short item é ß"), (5, "an short item é ß"), (6, "quick brown fox"), (7, "é short item short item"), (None, "short item")]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 30}])
def test_small_cases(spark, options):
    items = [x for x in ITEMS if x[0] is not None]
    assert run(spark, DOCS, ITEMS, **options) == brute(DOCS, items)


@pytest.mark.parametrize("options", [{"block_items": 1}, {"block_items": 2}, {"block_bytes": 40}, {"block_words": 1}, {"block_words": 14}])
def test_blocks_of_items(spark, options):
    """Repeated rows, equal ids and null ids and texts, whatever the blocks."""
    items = [x for x in ITEMS if x[0] is not None]
    assert run(spark, DOCS, ITEMS, **options) == brute(DOCS, items)


@pytest.mark.parametrize("options", [{}, {"block_items": 1}, {"block_items": 2}, {"block_bytes": 1}, {"block_words": 12}])
def test_removal_is_the_same_for_any_blocks(spark, options):
    letters = [chr(97 + i) for i in range(18)]
    items = [(1, " ".join(letters[2:12])), (2, " ".join(letters[6:16])), (3, "zz yy")]
    text = "é " + " ".join(letters) + ". zz yy é"
    docs = spark.createDataFrame([(1, text, 3), (1, text, 3), (None, text, 3), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long").withColumn("spans", F.lit("a")).withColumn("key", F.lit("b")).withColumn("c0", F.lit("c"))
    out = decontaminate.remove(docs, spark.createDataFrame(items, "item_id long, text string"), **options)
    want = "é a b  q r.  é"
    assert out.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text), str(r.n_chars), r.spans, r.key, r.c0) for r in out.collect())
    assert got == sorted((i, t, n, "a", "b", "c") for i, t, n in [("1", want, str(len(want))), ("1", want, str(len(want))), ("None", want, str(len(want))), ("2", "None", "None"), ("3", "clean", "5")])


def test_whole_table(spark, sf_dir):
    d, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted((tuple(r) for r in decontaminate.digest(decontaminate.find(d, b)).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    assert any(r[-1] for r in got)


def test_spans_and_removal(spark):
    docs = spark.createDataFrame([(1, "é — THE quick, brown fox jumps over the lazy dog; end", "k", 3), (2, None, "k", None), (3, "clean text", "z", 10)], "doc_id long, text string, source string, n_chars long")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    r = decontaminate.find(docs, b, window=5).where("doc_id = 1").first()
    assert [(s.start, s.end) for s in r.spans] == [(4, 48)]
    out = {r.doc_id: r for r in decontaminate.remove(docs, b, window=5).collect()}
    assert out[1].text == "é — ; end" and out[1].n_chars == 9 and out[2].text is None and out[3].text == "clean text"
    assert decontaminate.find(docs.limit(0), b).count() == 0
    assert decontaminate.find(docs, b.limit(0)).where("n_hit > 0").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_suffix_array_and_index(symbols):
    text = np.array([*symbols, 0], np.int64)
    rank = np.where(text == 0, np.cumsum(text == 0), text + len(text))
    assert decontaminate.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: rank[i:].tolist())
    index = decontaminate.FMIndex(text, 3)
    rows = np.array([[0, a, b] for a in (0, 1, 2, 3) for b in (1, 2, 3)], np.int64)
    who, lo, hi = index.search(rows)
    got = {k: set() for k in range(len(rows))}
    for k, i, j in zip(who, lo, hi):
        got[int(k)] = set(index.locate(np.arange(i, j)).tolist())
    for k, row in enumerate(rows):
        p = row[row > 0].tolist()
        assert got[k] == {i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p}


def test_blocks_change_nothing(spark):
    w = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(w[5:17])), (2, " ".join(w[12:24])), (3, " ".join(w[30:40]))], "item_id long, text string")
    text = " ".join(w)
    rows = [(1, text), (1, text), (1, "other"), (None, text), (None, None), (2, ""), (3, " ".join(w[:12]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: repr(r)
    one = sorted(map(key, decontaminate.find(docs, items).collect()))
    assert len(one) == len(rows)
    assert sorted(map(key, decontaminate.find(docs, items, block_items=1).collect())) == one
    cut = sorted(map(key, decontaminate.remove(docs, items, length_col=None).collect()))
    assert sorted(map(key, decontaminate.remove(docs, items, length_col=None, block_items=1).collect())) == cut
    assert any(" ".join(w[:5]) in x and "w17" not in x and "w23" not in x for x in cut)


def test_phrases_of_a_block_are_small():
    """A block of 32 MB at this rate: under 300 MB in the driver, under 100 MB to send."""
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(50_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=100))) for i in range(6_400)]
    size = sum(len(t) for _, t in items) / (32 << 20)
    tracemalloc.start()
    phrases = decontaminate.Phrases(items, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    fixed = 12 * decontaminate.SLICE * 8 * 3  # slices of rows, whatever the block
    assert peak < size * (300 << 20) + fixed
    assert len(pickle.dumps(phrases, 5)) < size * (100 << 20)
    assert len(phrases) > 500_000


@pytest.mark.parametrize("window", [1, 3, 10, 127, 128, 300])
@pytest.mark.parametrize("same_hash", [False, True])
def test_phrases_and_their_items(monkeypatch, window, same_hash):
    """Each distinct window once or, where hashes collide, more often; never two taken for one."""
    if same_hash:
        monkeypatch.setattr(decontaminate.Phrases, "_hashes", lambda self, ends, lengths: np.zeros(len(ends), np.uint64))
    rng = random.Random(window)
    items = [(rng.randint(0, 9), " ".join(rng.choices("abc", k=rng.choice([0, 1, 2, 9, 12, 150, 310])))) for _ in range(30)]
    phrases = decontaminate.Phrases(items, window)
    want = {}
    for i, t in items:
        w = t.split()
        for j in range(max(1, len(w) - window + 1) if w else 0):
            want.setdefault(tuple(w[j : j + window]), set()).add(i)
    word = {int(s): c for c in "abc" for s in phrases.symbols(decontaminate.word_hashes(np.frombuffer(c.encode(), np.uint8), np.array([0, 1]), decontaminate.ALNUM_WORDS)[0])}
    got = {}
    rows = phrases.rows(0, len(phrases))
    k, ids = phrases.items(np.arange(len(phrases)))
    for row, n, own in zip(rows, phrases.lengths, np.split(ids, np.cumsum(k)[:-1])):
        assert (row > 0).sum() == n and len(set(own.tolist())) == len(own)
        got.setdefault(tuple(word[int(s)] for s in row if s), set()).update(own.tolist())
    assert got == want
    assert same_hash or len(phrases) == len(want)
