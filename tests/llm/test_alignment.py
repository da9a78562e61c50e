import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomspan.llm import alignment, queries
from loomspan.llm.subwords import tokenizer_path


@pytest.fixture(scope="module")
def own():
    return alignment.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def by_hand(own, text):
    """Groups of a whole text as lists of ids, by common ends alone."""
    if not text:
        return []
    raw = (" " + text).encode()
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    if b"".join(own.bytes_a[x] for x in a) != raw or b"".join(own.bytes_b[x] for x in b) != raw:
        return []
    groups, i, j, end_a, end_b, one = [], 0, 0, 0, 0, ([], [])
    while i < len(a) or j < len(b):
        if end_a <= end_b:
            one[0].append(a[i])
            end_a += len(own.bytes_a[a[i]])
            i += 1
        else:
            one[1].append(b[j])
            end_b += len(own.bytes_b[b[j]])
            j += 1
        if end_a == end_b:
            groups.append(one)
            one = ([], [])
    return groups


def links_by_hand(own, groups):
    out = []
    for ids_a, ids_b in groups:
        spans = []
        for ids, table in ((ids_a, own.bytes_a), (ids_b, own.bytes_b)):
            ends = np.cumsum([len(table[x]) for x in ids]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, ids)))
        out += [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
    return out


def expected(own, rows):
    found = [(d, by_hand(own, t)) for d, t in rows]
    links = [links_by_hand(own, g) for _, g in found]
    count = Counter(x for l in links for x in l)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for (d, g), l in zip(found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(l), hashlib.sha256(text.encode()).hexdigest() if g else "", sum(count[x] == most[x[1]] for x in l), sum(count[x] for x in l)))
    return sorted(out, key=repr)


def odd_texts():
    rng = random.Random(11)
    parts = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", "▁", "a", "the", "don't", "'s", "1234", "ß", "ǅ", "日本語", "🙂", "é", "‍", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "\x00", "ﬁ", "…", "http://x.y/z?q=1", "ABC"]
    return ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 25))) for _ in range(250)]


ODD = [None, "", " ", "  ", "a", "▁", "one▁two", "x" * 3000, "no spaces here", "\n\n", "<|endoftext|>", "</s> <s>", "end ", " begin"]


def test_digest_equals_brute_force(spark, own):
    rows = [*enumerate([*ODD, *odd_texts()]), (None, "twice the same"), (None, "twice the same"), ((1 << 62) + 1, "far")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, block string").repartition(3)
    want = expected(own, rows)
    for size in (200, 1 << 20):
        got = alignment.digest(df, block_bytes=size).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_the_query_on_a_whole_table(spark, sf_dir, own):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_token_alignment(spark, sf_dir).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(own, rows)


def test_groups_cover_the_text(spark, own):
    texts = [*ODD, *odd_texts()[:60]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in alignment.groups(df).orderBy("doc_id", "number").collect():
        found.setdefault(r.doc_id, []).append(r)
    for d, t in enumerate(texts):
        want = by_hand(own, t)
        assert [(r.ids_a, r.ids_b) for r in found.get(d, [])] == want
        for r in found.get(d, []):
            raw = (" " + t).encode()[r.start : r.end]
            assert raw == b"".join(own.bytes_a[x] for x in r.ids_a) == b"".join(own.bytes_b[x] for x in r.ids_b)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.digest(df).count() == 0 and alignment.groups(df).count() == 0


def test_components_are_those_of_a_walk():
    rng = np.random.default_rng(5)
    for n, m in ((50, 40), (200, 150), (300, 900), (1000, 999)):
        u, v = (np.arange(n - 1), np.arange(1, n)) if m == n - 1 else rng.integers(0, n, (2, m))
        root = alignment.components(u, v, n)
        near = [[] for _ in range(n)]
        for x, y in zip(u.tolist(), v.tolist()):
            near[x].append(y)
            near[y].append(x)
        least = [-1] * n
        for x in range(n):
            if least[x] < 0:
                todo = [x]
                while todo:
                    y = todo.pop()
                    if least[y] < 0:
                        least[y] = x
                        todo += near[y]
        assert root.tolist() == least


def test_the_cache_starts_anew(spark, own, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_UNITS", 5)
    aligner = alignment.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    for text in [t for t in odd_texts() if "▁" not in t][:60]:
        if aligner.full:
            aligner.reset()
        at, _ = aligner.numbers(pa.array([text]))
        assert ";".join(aligner.texts[k] for k in at) == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in by_hand(own, text))


def words_and_marks():
    rng = random.Random(12)
    parts = ["word", "don't", "we're", "é", "Où", "×", "e\u0301", "x", "7", "ß", ".", ",", "'", "!!", "_", ").", "\n", "\n\n", "\r", "\t", " ", "  ", "|", "</s>", "▁", "日", "\xa0", "ſ", "Ā", "'s", "\n "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]


def test_words_are_units_whatever_follows_them(own):
    aligner = alignment.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    _, counts = aligner.numbers(pa.array(["word word, word. word! être? word", "word\nword (word\nword) être"]))
    assert counts.tolist() == [10, 6] and sorted(aligner.known) == sorted([" word", ",", ".", "!", " être", "?", "\nword", " (word", ")"])
    texts = words_and_marks()
    at, counts = aligner.numbers(pa.array(texts))
    for text, units in zip(texts, np.split(at, np.cumsum(counts)[:-1])):
        bad = (aligner.sizes[units, 3] < 0).any()
        got = "" if bad else ";".join(aligner.texts[k] for k in units)
        assert got == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in by_hand(own, text)), text


def test_a_full_cache_keeps_what_was_met_again(own, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_UNITS", 40)
    aligner = alignment.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    learnt, learn = [], aligner.learn
    monkeypatch.setattr(aligner, "learn", lambda units: (learnt.extend(units), learn(units)))
    rng = random.Random(13)
    for _ in range(60):
        if aligner.full:
            aligner.shrink()
        text = " ".join(["often", "common", "usual", *("".join(rng.choices("abcdefgh", k=6)) for _ in range(5))])
        at, _ = aligner.numbers(pa.array([text]))
        assert len(aligner.known) <= 50
        assert ";".join(aligner.texts[k] for k in at) == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in by_hand(own, text))
        for p, k in enumerate(at.tolist()):
            assert aligner.sizes[k, 0] == len(own.a.encode(" " + text.split(" ")[p]).ids) and aligner.first[k + 1] - aligner.first[k] == aligner.sizes[k, 3]
    assert all(learnt.count(u) == 1 for u in (" often", " common", " usual"))


def test_a_large_row_is_a_row_group_of_its_own(spark):
    rows = spark.createDataFrame([(i, f"text {i}" + " of some words" * 40_000) for i in range(6)], "doc_id long, text string").coalesce(1)
    blocks = alignment.align_blocks(rows, block_bytes=1)
    files = [f.removeprefix("file://") for f in blocks.inputFiles()]
    sizes = [m.row_group(g).num_rows for f in files for m in [pq.read_metadata(f)] for g in range(m.num_row_groups)]
    assert sum(sizes) == blocks.count() > 1 and set(sizes) == {1}
