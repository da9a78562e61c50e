import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import queries, sharding

SCHEMA = "doc_id long, text string, _h string, shard string, row int"


def shards_of(spark, rows, **limits):
    df = spark.createDataFrame([(i, t, "clash", "old", 1) for i, t in rows], SCHEMA).repartition(4)
    got = sharding.shard_rows(df, **limits)
    assert got.columns == ["doc_id", "text", "_h", "row", "shard", "slot"]
    found = defaultdict(list)
    for r in got.collect():
        found[r.shard].append((r.slot, r.doc_id, r.text))
    return found


def held(found, rows, shards, tolerance):
    """Every row once, slots gapless, and each splitter as near to its share as it can be."""
    key = lambda x: tuple((y is None, y) for y in x)
    assert sorted(((d, t) for s in found.values() for _, d, t in s), key=key) == sorted(rows, key=key)
    size = lambda t: len((t or "").encode()) + 16
    total, largest = sum(size(t) for _, t in rows), max((size(t) for _, t in rows), default=0)
    below = 0
    for s in range(shards):
        assert sorted(x[0] for x in found[s]) == list(range(len(found[s])))
        below += sum(size(t) for _, _, t in found[s])
        assert abs(below - total * (s + 1) / shards) <= max(tolerance * total / shards, largest / 2) + 1


def some(seed, n):
    rng = np.random.default_rng(seed)
    return [(i, "é" * int(rng.integers(0, 200))) for i in range(n)]


@pytest.mark.parametrize("shards", [1, 3, 7, 40])
def test_shards_are_near_equal(spark, shards):
    rows = some(shards, 400) + [(None, None), (None, "x"), (900, None)]
    held(shards_of(spark, rows, shards=shards, tolerance=0.01), rows, shards, 0.01)


def test_a_third_are_copies_and_some_equal_rows(spark):
    rows = some(5, 200) + [(i, "copy " * 9) for i in range(1000, 1150)] + [(7777, "same")] * 120
    found = shards_of(spark, rows, shards=9, tolerance=0.02)
    held(found, rows, 9, 0.02)
    spread = [s for s in found if any(t == "copy " * 9 for *_, t in found[s])]
    assert spread == list(range(min(spread), max(spread) + 1)) and len(spread) > 1


def test_small_groups_of_copies_stay_together(spark):
    rows = [(i, f"text {i // 3} " + "y" * 50) for i in range(900)]
    found = shards_of(spark, rows, shards=4, tolerance=0.02)
    held(found, rows, 4, 0.02)
    homes = defaultdict(set)
    for s, group in found.items():
        for _, _, t in group:
            homes[t].add(s)
    assert all(len(x) == 1 for x in homes.values())


def test_parts_and_probes_change_no_bound(spark):
    rows = some(6, 300)
    for limits in ({"part_bytes": 700, "probes": 2}, {"part_bytes": 2000, "probes": 60}):
        held(shards_of(spark, rows, shards=5, tolerance=0, **limits), rows, 5, 0)


def test_few_rows_and_none(spark):
    rows = [(1, "a"), (2, ""), (3, None)]
    held(shards_of(spark, rows, shards=8), rows, 8, 0)
    assert not shards_of(spark, [], shards=8)


def test_only_equal_rows(spark):
    rows = [(None, None)] * 41
    held(shards_of(spark, rows, shards=4, tolerance=0), rows, 4, 0)


def test_keys_compare_part_by_part():
    rng = np.random.default_rng(3)
    rows, probes = rng.integers(0, 4, (200, 3)), np.array(sorted(map(tuple, rng.integers(0, 4, (30, 3)))))
    got = sharding.below(tuple(rows.T), tuple(probes.T))
    assert got.tolist() == [sum(tuple(p) <= tuple(r) for p in probes.tolist()) for r in rows.tolist()]


def test_the_query(spark, sf_dir, tmp_path):
    got = queries.op13_sharding(spark, sf_dir)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = defaultdict(list)
    for r in got.collect():
        text = docs[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 16, zlib.crc32(text.encode()), "bytes", None)
        found[r.shard].append((r.slot, r.doc_id, text))
    held(found, list(docs.items()), 40, sharding.TOLERANCE)


def test_shards_as_files(spark, tmp_path):
    df = spark.createDataFrame(some(8, 60), "doc_id long, text string")
    sharding.write_shards(sharding.shard_rows(df, shards=3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60 and back.select("shard").distinct().count() == 3
    assert back.agg(F.countDistinct("shard", "slot")).first()[0] == 60
