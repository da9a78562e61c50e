import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.llm import toxicity


def edits(a, b):
    """Letters added, left out, changed, or in each other's place (none of them twice); ``a`` may have digits for letters."""
    same = lambda x, y: x == y or y in toxicity.LOOKS_LIKE.get(x, "")
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (not same(a[i], b[j])))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


TERM = st.text(alphabet="abcéиэ漢", min_size=2, max_size=6)


@settings(max_examples=120, deadline=None)
@given(st.lists(TERM, min_size=1, max_size=4, unique=True), st.lists(st.text(alphabet="abcéи漢z48", min_size=1, max_size=7), max_size=12))
def test_automata_accept_what_is_within_one_edit(terms, texts):
    fuzzy = toxicity.Fuzzy(terms)
    words = toxicity.Words(pa.array(texts or [""]))
    for _ in range(2):  # the second time from what is kept
        at, term = fuzzy.matches(words)
        got = {int(words.row[i]): int(t) for i, t in zip(at, term)}
        least = {i: min((edits(w, t), k) for k, t in enumerate(terms)) for i, w in enumerate(texts)}
        assert got == {i: k for i, (e, k) in least.items() if e <= 1}


def test_a_lexicon_of_any_size_and_script():
    rng = np.random.default_rng(3)
    terms = ["".join(rng.choice(list("abcdefgh"), 8)) for _ in range(6000)] + ["идиоты", "pathetic"]
    words = toxicity.Words(pa.array(["идиот идиоты идитоы", "pahtetic p4th3tic pathetic pathetc", "пустота empty"]))
    at, _ = toxicity.Fuzzy(terms).matches(words)
    assert np.bincount(words.row[at], minlength=3).tolist() == [3, 4, 0]


def plain_features(lexicon, text):
    """The features of a document, from its words one by one."""
    folded = text.lower()
    for a, b in toxicity.QUOTES.items():
        folded = folded.replace(a, b)
    x, n = np.zeros(toxicity.N_FEATURES), 0
    for m in re.finditer("[0-9a-z\u0080-\U0010ffff]+", folded):
        n += 1
        w = m[0]
        near = [(edits(w, t), i, t) for i, t in enumerate(lexicon.fuzzy)]
        near = min((e for e in near if e[0] <= 1), default=None)
        if w in lexicon.words:
            kind, weight = 0, lexicon.words[w]
        elif len(w) > toxicity.STEM and w[: toxicity.STEM] in lexicon.stems:
            kind, weight = 1, lexicon.stems[w[: toxicity.STEM]]
        else:
            kind = None
        hits = [(kind, weight)] if kind is not None else []
        if w not in lexicon.words and near and w not in lexicon.clean:
            hits.append((2, lexicon.words.get(near[2], 0.0)))
        said = toxicity.quoted(folded[max(0, m.start() - toxicity.WINDOW) : m.start()], folded[m.end() : m.end() + toxicity.WINDOW])
        for kind, weight in hits:
            if said:
                x[6] += weight
            else:
                x[kind] += weight
                x[3 + kind] = max(x[3 + kind], weight)
    x[7] = x[:3].sum() / np.sqrt(max(n, 1))
    x[[0, 1, 2, 6]] = np.log1p(np.maximum(x[[0, 1, 2, 6]], 0))
    return x


def test_scores_against_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.limit(3).selectExpr("doc_id + 100000000 as doc_id", "'you idoit, he said \"moron\" and 1d10t' as text", "lang", "source", "n_chars"))
    model = toxicity.fit(docs, labels, learnable=lambda c: toxicity.fold(c) != 2)
    got = {(r.doc_id): r.score for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        if (r.text or "").isascii():  # windows are bytes
            want = float(model.score(plain_features(model.lexicon, r.text or "")[None])[0])
            assert got[r.doc_id] == pytest.approx(want, abs=1e-9)


def test_string_ids(spark):
    rows = [(f"d{i}", "you idiot" if i % 2 else "good day", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.drop("text"), learnable=lambda c: c.isNotNull())
    assert {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()} == {d: t for d, _, t in rows}


@pytest.mark.parametrize("before,after,want", [('she "you ', ' one" left', True), ("you ", "!", False), ("he said ", " to", True), ("don't be ", " it's", False), ("called 'a ", "' there", True), ("", "", False)])
def test_quotation(before, after, want):
    assert toxicity.quoted(before, after) is want


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels, learnable=lambda c: toxicity.fold(c) != 2)
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    toxic = [r for r in held if r.toxic]
    clean = [r for r in held if not r.toxic]
    print(np.mean([r.predicted for r in toxic]), np.mean([r.predicted for r in clean]))
    assert np.mean([r.predicted for r in toxic]) > 0.6
    assert np.mean([r.predicted for r in clean]) < 0.03


def test_misspellings_quotations_and_odd_rows(spark):
    clean = ["the weather is fine over the hills today", "we went to market and bought bread", "a clear morning with birds"]
    rows = [(i, clean[i % 3] + (" you idiot" if i % 2 else " my friend") + f" n{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, 1)], "doc_id long, toxic int")
    odd = [(900, None), (901, ""), (902, "such a mooron, you idoit, what a pathetc stupld person"), (903, 'the paper said "idiot" twice'), (904, "oh IDIOT"), (None, "you idiot"), (905, "fine weather")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("label", F.lit(1))
    model = toxicity.fit(docs, labels, learnable=lambda c: c.isNotNull())
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 207
    assert got[902].predicted == got[904].predicted == got[None].predicted == 1
    assert got[900].predicted == got[901].predicted == got[905].predicted == 0 and got[900].score == got[901].score
    assert got[903].score < got[904].score
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {k for k, r in got.items() if not r.predicted}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you stupid idiot"), (2, "good day"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, learnable=lambda c: c.isNotNull())
    assert {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()} == {1: 1, 2: 0, 3: 0}
    assert toxicity.score(docs.limit(0), model).count() == 0
