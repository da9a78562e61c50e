import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.llm import packing, subwords, token_output

TEXT = st.lists(st.sampled_from([*"abzéÉçßñ̀́ \n\t.,;'!?#$%&*<|>0129Σσİ中\u2028\u00a0", "<|endoftext|>", "'s", " the ", "<|StartOfText|>"]), max_size=40).map("".join)


def reference_ids(text, end_id):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(subwords.tokenizer_path())
    return [*tok.encode(text or "", add_special_tokens=False).ids, end_id]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_cached_encoder_equals_the_library(texts):
    import pyarrow as pa

    enc = subwords.encoder(subwords.tokenizer_path())
    ids, at = enc.encode(pa.array([*texts, None]))
    for i, t in enumerate([*texts, ""]):
        assert list(ids[at[i] : at[i + 1]]) == reference_ids(t, 0)[:-1]


def test_small_cache_is_begun_anew():
    import pyarrow as pa

    enc = subwords.Encoder(subwords.tokenizer_path(), cache_pieces=3)
    for _ in range(2):
        ids, at = enc.encode(pa.array(["one two three four", "five one", ""]))
        assert list(ids[at[1] : at[2]]) == reference_ids("five one", 0)[:-1]
        assert at[3] == at[2]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(5, "Hello, world"), (1, None), (7, ""), (5, "Hello, world"), (3, "x " * 5000), (9, "a\nb\tc"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("length", F.lit(1))


def test_token_files_round_trip(spark, odd_docs):
    got = token_output.read_token_files(token_output.write_token_files(odd_docs)).collect()
    want = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    got.sort(key=lambda r: r.start)
    start = 0
    for g, (doc, text) in zip(got, want, strict=True):
        ids = reference_ids(text, 2)
        assert (g.doc_id, g.start, g.n_tokens) == (doc, start, len(ids))
        assert np.frombuffer(g.ids, "<u4").tolist() == ids
        start += len(ids)


def test_token_files_of_nothing(spark, odd_docs):
    assert token_output.read_token_files(token_output.write_token_files(odd_docs.limit(0))).count() == 0


def check_packing(rows, texts, seq_len):
    sequences = {}
    by_doc = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= seq_len
    assert sorted(sequences) == list(range(len(sequences)))
    for doc, copies in texts.items():
        ids = reference_ids(copies[0], 1)
        n = -(-len(ids) // seq_len)
        assert len(by_doc[doc]) == n * len(copies)
        for r in by_doc[doc]:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert len(part) == r.length and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part.tobytes())


@pytest.mark.parametrize("seq_len", [16, 2048])
def test_packing_keeps_every_id(spark, odd_docs, seq_len):
    rows = packing.packed_documents(odd_docs, seq_len=seq_len).collect()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    check_packing(rows, texts, seq_len)


def test_packing_wastes_little(spark, sf_dir):
    rows = packing.packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    total = sum(r.length for r in rows)
    n = len({r.sequence_id for r in rows})
    assert n * 2048 < 1.05 * total


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 9), max_size=20))
def test_slots_cover_every_rank_once(histogram):
    slots = packing.plan_slots(histogram, 50)
    seen = {}
    used = {}
    for length, rank, n, first, offset in slots:
        for i in range(n):
            seen.setdefault(length, []).append(rank + i)
            assert used.get(first + i, 0) == offset
            used[first + i] = offset + length
            assert used[first + i] <= 50
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(c)) for k, c in histogram.items() if c}


def test_packing_of_nothing(spark, odd_docs):
    assert packing.packed_documents(odd_docs.limit(0)).count() == 0


def test_small_shards_give_the_same_rows(spark, odd_docs):
    whole = token_output.write_token_files(odd_docs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        small = token_output.write_token_files(odd_docs, shard_tokens=1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small.count() > whole.count()
    assert sorted(map(str, token_output.read_token_files(small).collect())) == sorted(map(str, token_output.read_token_files(whole).collect()))


def test_width_follows_the_vocabulary(tmp_path):
    assert token_output.largest_id(subwords.tokenizer_path()) < 1 << 16
    shard = token_output._Shard(f"file://{tmp_path}", 0, 0, 2)
    with pytest.raises(ValueError):
        shard.add(np.array([1]), np.array([1 << 16], np.uint32), np.array([0, 1]))


def test_numbering_over_many_tasks(spark):
    pieces = spark.range(0, 4000, 1, 13).selectExpr("id as doc_id", "pmod(xxhash64(id), 7) + 1 as length", "'x' as rank", "id as _chunk")
    rows = packing.pack(pieces, seq_len=16).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == 4000 and sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 16
    with pytest.raises(ValueError):
        packing.pack(pieces.withColumn("offset", pieces.doc_id))
