"""N-gram Jaccard join with signature trees.

A document's set is its distinct ``k``-word shingles as 64-bit hashes; documents
with one set are a class, known by a 64-bit fingerprint. Two classes link when
100 * intersection >= percent * union. The steps:

1. *Profile*: every document's class and set size, and a count sketch of the
   shingles of each task, of which the heavy cells go to the driver (at most
   ``2 * CELLS`` numbers). The sketch only orders shingles: heavy ones last.
2. *Buckets*: two sets that link share a shingle among the first
   n - ceil(percent * n / 100) + 1 of either in this order. Classes meet in
   buckets by these shingles; buckets of one class, members without a partner of
   fitting size, and buckets with the members of another go; a bucket larger
   than a block is taken apart by bands of size.
3. *Signature trees*: each bucket's members, sorted by size, are leaves of a tree
   whose nodes hold OR-combined bitmaps of shingles and a size range. Two nodes
   are taken apart while the largest overlap that their bitmaps allow could
   still reach the link limit; pairs of leaves left over join their members to a
   candidate group. Members of a larger bucket meet in the trees of step 5 alone.
4. *Groups* that share members are united; each class then lies in one group, and
   its exact set is computed once more and sent there.
5. *Links*: within a group the trees of exact sets are traversed in the same
   manner, pairs that are already connected are passed over, and what is left is
   intersected. A group larger than a block is dealt over blocks by hash, each
   with the group's first members; then only members outside the group's largest
   component meet all other blocks. So a group of near copies costs about as many
   comparisons as it has members, and no link that matters is lost.

Defined cases: null texts, empty texts and texts without words have an empty set,
link with nothing and are a component of their own; repeated rows are exact
copies and share a component; a null id is left out; other columns are ignored. An id
with several texts is one node: its rows share a component and are kept or go together
(``one_of_each``), and of rows with one id and text one is kept. A text is read whole
in one task, with about 60 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import materialise
from .textbuf import SPACE_WORDS, chunks, mix, ragged, release, shingles, utf8, word_hashes

CELLS = 1 << 20
#: Members of one tree, and of one block of a large group.
BLOCK = 768
ANCHORS = 4
LEAF = 8
FILTER_BITS = 24
U1 = np.uint64(1)


def _sets(batch: pa.RecordBatch, k: int, column: int = 1):
    """For parts of a batch: first row, and each row's set as (flat, offsets); rows' sets are sorted."""
    data, offsets = utf8(batch.column(column))
    for i, j in chunks(offsets):
        part = data[offsets[i] : offsets[j]]
        h, _, _, first = word_hashes(part, offsets[i : j + 1] - offsets[i], SPACE_WORDS)
        s, at = shingles(h, first, k)
        row = np.searchsorted(first, at, side="right") - 1
        s, row = _sorted_rows(s, row)
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
        s, row = s[new], row[new]
        yield i, s, np.searchsorted(row, np.arange(j - i + 1))


def _sorted_rows(s: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by row, then hash: by one key of the row and the hash's high bits, wherever that tells hashes apart."""
    if len(s) and row[-1] < 1 << 14:
        key = (row.astype(np.uint64) << np.uint64(50)) | (s >> np.uint64(14))
        order = np.argsort(key)
        key, high = key[order], s[order]
        same = key[1:] == key[:-1]
        if not (same & (high[1:] != high[:-1])).any():
            return high, row[order]
    order = np.lexsort((s, row))
    return s[order], row[order]


def _fingerprints(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)), out=total[1:])
    n = np.diff(at).astype(np.uint64)
    return mix((total[at[1:]] - total[at[:-1]]) ^ mix(n)).view(np.int64)


def _cells(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (s & np.uint64(CELLS - 1)).astype(np.int64), ((s >> np.uint64(32)) & np.uint64(CELLS - 1)).astype(np.int64) + CELLS


def _profiler(k: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sketch = np.zeros(2 * CELLS, np.int32)
        for batch in batches:
            for i, s, at in _sets(batch, k):
                a, b = _cells(s)
                np.add.at(sketch, a, 1)
                np.add.at(sketch, b, 1)
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(np.diff(at)), pa.array(_fingerprints(s, at)), pa.nulls(n, pa.int32())], names=["doc", "n", "cls", "cell"])
        mean = sketch.sum(dtype=np.int64) / (2 * CELLS)
        heavy = np.flatnonzero(sketch > 2 * mean + 8)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(heavy), pa.int64()), pa.array(sketch[heavy].astype(np.int64)), pa.nulls(len(heavy), pa.int64()), pa.array(heavy.astype(np.int32))], names=["doc", "n", "cls", "cell"])

    return profile


def _levels(profile: DataFrame) -> np.ndarray:
    """A level for each cell: 0, or the logarithm of its count where that is heavy."""
    level = np.zeros(2 * CELLS, np.int8)
    got = profile.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2 * CELLS rows at most
    level[got.column("cell").to_numpy()] = np.floor(np.log2(np.maximum(1, got.column("n").to_numpy()))).astype(np.int8) + 1
    return level


def _prefix(percent: int, k: int, level: np.ndarray):
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[int] = set()
        for batch in batches:
            for _, s, at in _sets(batch, k):
                n, cls = np.diff(at), _fingerprints(s, at)
                row = np.repeat(np.arange(len(n)), n)
                a, b = _cells(s)
                weight = np.minimum(level[a], level[b])
                order = np.argsort(row * 128 + weight, kind="stable")  # hashes are sorted within rows
                keep = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                for r in range(len(n)):  # a copy's rows are those of its class
                    c = int(cls[r])
                    if c in seen:
                        keep[r] = 0
                    elif len(seen) < 300_000:
                        seen.add(c)
                pick = order[ragged(at[:-1], keep)]
                yield pa.RecordBatch.from_arrays([pa.array(s[pick].view(np.int64)), pa.array(np.repeat(cls, keep)), pa.array(np.repeat(n, keep).astype(np.int32))], names=["bucket", "cls", "n"])

    return prefix


def _buckets(docs: DataFrame, percent: int, k: int, level: np.ndarray) -> DataFrame:
    """``bucket, cls, n``: classes that share a bucket with a class of fitting size."""
    rows = docs.mapInArrow(_prefix(percent, k, level), "bucket long, cls long, n int")
    # Most shingles belong to one class: those go with a grouped minimum and maximum before members are dealt out.
    shared = rows.groupBy("bucket").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("bucket")
    rows = rows.join(shared, "bucket", "left_semi").distinct()
    rows = materialise(rows, "members")
    # Sizes that can link lie in one band or in two next to each other: a member without another there goes.
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent))).cast("int")
    counts = rows.groupBy("bucket", band.alias("band")).agg(F.count(F.lit(1)).alias("c"))
    near = counts.select("bucket", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "c")
    near = near.groupBy("bucket", "band").agg(F.sum("c").alias("s")).where("s > 1").select("bucket", "band")
    rows = materialise(rows.withColumn("band", band).join(near, ["bucket", "band"], "left_semi").drop("band"), "members")
    marks = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("s"), F.sum(F.xxhash64("cls", F.lit(7)).cast("decimal(20,0)")).alias("t"))
    kept = marks.where("c > 1").groupBy("c", "s", "t").agg(F.min("bucket").alias("bucket")).select("bucket", "c")
    rows = rows.join(kept, "bucket")
    # A large bucket is taken apart by bands.
    large = rows.where(F.col("c") > BLOCK).withColumn("band", F.explode(F.array(band, band - 1)))
    large = large.select(F.xxhash64("bucket", "band").alias("bucket"), "cls", "n")
    sizes = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return materialise(rows.where(F.col("c") <= BLOCK).select("bucket", "cls", "n", "c").unionByName(large.join(sizes, "bucket").select("bucket", "cls", "n", "c")), "members")


def _filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each key, in a table of fixed size: a test that errs on one side only."""
    cell = F.pmod(F.xxhash64(column), F.lit(1 << (FILTER_BITS - 6))).cast("int").alias("cell")
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(3, {column}), 64) as int))")
    words = keys.select(cell, bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("w"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    got = words.toArrow()  # as many rows as the table has words, at most
    out[got.column("cell").to_numpy()] = got.column("w").to_numpy()
    return out


def _in_filter(table: np.ndarray, spark_cell: np.ndarray, spark_bit: np.ndarray) -> np.ndarray:
    return (table[spark_cell] >> spark_bit) & 1 == 1


def _bits_for(n: int) -> int:
    """Bits of a bitmap for a set of n: a power of two, at least 64."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    h = (s >> np.uint64(8)) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (h >> np.uint64(3)).astype(np.int64), (U1 << (h & np.uint64(7))).astype(np.uint8))
    return out


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmaps, folded to ``size`` bytes; as if they had been made so."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).sum(axis=1, dtype=np.int64)


class SignatureTree:
    """Levels of nodes over leaves sorted by size; a node has an OR-combined
    bitmap, a size range, and the largest number by which a member's size
    exceeds its bitmap's bits."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        spare = sizes - _popcount(bits)
        self.levels = [(bits, sizes, sizes, spare)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, x = self.levels[-1]
            cut = np.arange(0, len(b), LEAF)
            self.levels.append((np.bitwise_or.reduceat(b, cut, axis=0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(x, cut)))


def _may_link(one, other, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether some members of nodes a and b could link, by size range and largest overlap."""
    (bits1, lo1, hi1, x1), (bits2, lo2, hi2, x2) = one, other
    ok = (hi1[a] * 100 >= lo2[b] * percent) & (hi2[b] * 100 >= lo1[a] * percent)
    at = np.flatnonzero(ok)
    for i in range(0, len(at), 1 << 14):
        p = at[i : i + (1 << 14)]
        common = _popcount(bits1[a[p]] & bits2[b[p]])
        # A member's shingles in the common bits are at most these bits and its spare.
        most = np.minimum(np.minimum(common + x1[a[p]], common + x2[b[p]]), np.minimum(hi1[a[p]], hi2[b[p]]))
        least = lo1[a[p]] + lo2[b[p]]
        ok[p] = most * (100 + percent) >= percent * least
    return ok


def traverse(one: SignatureTree, other: SignatureTree | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may link: of two trees, or (``other`` None) of one tree with itself, each once."""
    self_join = other is None
    other = one if self_join else other
    d1, d2 = len(one.levels) - 1, len(other.levels) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        ok = _may_link(one.levels[d1], other.levels[d2], a, b, percent)
        a, b = a[ok], b[ok]
        if not d1 and not d2:
            break
        if d1 and d1 >= d2:
            d1 -= 1
            k = np.minimum(LEAF, len(one.levels[d1][0]) - a * LEAF)
            a, b = ragged(a * LEAF, k), np.repeat(b, k)
            if not self_join:
                continue
        if d2 and (self_join or d2 > d1):
            d2 -= 1
            k = np.minimum(LEAF, len(other.levels[d2][0]) - b * LEAF)
            a, b = np.repeat(a, k), ragged(b * LEAF, k)
        if self_join:
            a, b = a[a <= b], b[a <= b]
    return (a[a < b], b[a < b]) if self_join else (a, b)


class Links:
    """Union-find over the members of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _classes(sizes: np.ndarray) -> np.ndarray:
    return np.array([_bits_for(int(n)) for n in sizes], np.int64)


def candidate_pairs(sizes: np.ndarray, bitmaps: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members that may link, by a tree for each width of bitmaps and its neighbour's, folded."""
    width = _classes(sizes)
    trees = {}
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        own = own[np.argsort(sizes[own], kind="stable")]
        trees[w] = (own, sizes[own], np.stack([bitmaps[i] for i in own]))
        a, b = traverse(SignatureTree(sizes[own], trees[w][2]), None, percent)
        yield own[a], own[b]
    for w in trees:
        if w // 2 in trees:
            (own, n, bits), (less, m, small) = trees[w], trees[w // 2]
            a, b = traverse(SignatureTree(n, fold(bits, w // 16)), SignatureTree(m, small), percent)
            yield own[a], less[b]


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pd.DataFrame]:
    """Whole runs of equal keys from sorted batches; many short runs at once."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        keys = t.column(key).to_numpy()
        cut = int(np.searchsorted(np.arange(len(keys)), np.flatnonzero(keys != keys[-1])[-1] + 1)) if (keys != keys[-1]).any() else 0
        if cut:
            yield t.slice(0, cut).to_pandas()
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.to_pandas()


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return list(zip(at.tolist(), [*at[1:].tolist(), len(keys)]))


def _grouper(percent: int):
    """Members of buckets, with bitmaps -> (cls, group): the members that may link to another."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in _by_key(batches, "bucket"):
            sizes, cls = f["n"].to_numpy().astype(np.int64), f["cls"].to_numpy()
            maps = [np.frombuffer(x, np.uint8) for x in f["bits"]]
            out, to = [], []
            for i, j in _runs(f["bucket"].to_numpy()):
                links = Links(j - i)
                touched = np.zeros(j - i, bool)
                for a, b in candidate_pairs(sizes[i:j], maps[i:j], percent):
                    touched[a] = touched[b] = True
                    for x, y in zip(a.tolist(), b.tolist()):
                        links.join(x, y)
                for x in np.flatnonzero(touched):
                    out.append(cls[i + x])
                    to.append(cls[i + links.find(int(x))])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(to, pa.int64())], names=["cls", "to"])

    return group


def _linker(percent: int):
    """Members of blocks with exact sets -> links (a, b) that connect what links.

    ``side`` 1 members meet all others, ``side`` 0 members only those of side 1;
    where a block has no side 1 all meet all. ``label`` is what is connected already.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in _by_key(batches, "block"):
            out_a, out_b = [], []
            for i, j in _runs(f["block"].to_numpy()):
                g = f.iloc[i:j].drop_duplicates("cls")
                sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
                sizes, cls, side = np.array([len(s) for s in sets], np.int64), g["cls"].to_numpy(), g["side"].to_numpy()
                maps = [bitmap(s, _bits_for(len(s))) for s in sets]
                links = Links(len(g))
                for label in g.groupby("label").indices.values():
                    for x in label[1:]:
                        links.join(int(label[0]), int(x))
                both = not side.any()
                for a, b in candidate_pairs(sizes, maps, percent):
                    if not both:
                        a, b = a[(side[a] == 1) | (side[b] == 1)], b[(side[a] == 1) | (side[b] == 1)]
                    for x, y in zip(a.tolist(), b.tolist()):
                        if links.find(x) == links.find(y):
                            continue
                        common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                            links.join(x, y)
                            out_a.append(cls[x])
                            out_b.append(cls[y])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return link


def _again(table: np.ndarray, k: int, whole: bool):
    """Sets, or bitmaps, of the documents that may be in a filter."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = _in_filter(table, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            batch = batch.filter(pa.array(may))
            for i, s, at in _sets(batch, k):
                cls, out = _fingerprints(s, at), []
                for r in range(len(cls)):
                    own = s[at[r] : at[r + 1]]
                    out.append(own.tobytes() if whole else bitmap(own, _bits_for(len(own))).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(cls)), pa.array(cls, pa.int64()), pa.array(out, pa.binary())], names=["doc", "cls", "payload"])

    return again


def _with_payload(rows: DataFrame, docs: DataFrame, k: int, whole: bool) -> DataFrame:
    """``rows`` (with ``doc`` and ``cls``) and the ``payload`` of the document's set, made from its text.

    The filter spares most documents; that it lets some through that no row
    names costs time only, and at any size the join is exact.
    """
    table = _filter(rows, "doc")
    cell = F.pmod(F.xxhash64("doc"), F.lit(1 << (FILTER_BITS - 6))).cast("int").alias("cell")
    bit = F.pmod(F.xxhash64(F.lit(3), "doc"), F.lit(64)).cast("int").alias("bit")
    made = docs.select("doc", "text", cell, bit).mapInArrow(_again(table, k, whole), "doc long, cls long, payload binary")
    return rows.join(made, ["doc", "cls"])


def _linked(rows: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    blocks = _with_payload(rows, docs, k, whole=True).withColumnRenamed("payload", "shingles")
    blocks = blocks.repartition("block").sortWithinPartitions("block", F.col("side").desc())
    return materialise(blocks.mapInArrow(_linker(percent), "a long, b long"), "pairs")


def class_components(docs: DataFrame, profile: DataFrame, *, percent: int, k: int) -> DataFrame:
    """``node, label`` of the classes that link with another."""
    members = _buckets(docs, percent, k, _levels(profile))
    first = profile.where("n > 0").groupBy("cls").agg(F.min("doc").alias("doc"))

    small = materialise(members.where(F.col("c") <= BLOCK).select("bucket", "cls", "n").join(first, "cls"), "members")
    trees = _with_payload(small, docs, k, whole=False).withColumnRenamed("payload", "bits").select("bucket", "cls", "n", "bits")
    star = trees.repartition("bucket").sortWithinPartitions("bucket", "n", "cls").mapInArrow(_grouper(percent), "cls long, to long")
    large = members.where(F.col("c") > BLOCK)
    large = large.join(large.groupBy("bucket").agg(F.min("cls").alias("to")), "bucket").select("cls", "to")
    # What goes on from here is ids; sets are made again for the last step only.
    groups = components(star.unionByName(large).distinct(), "cls", "to").select(F.col("node").alias("cls"), F.col("label").alias("grp"))
    counts = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("c"))
    dealt = groups.join(counts, "grp").join(first, "cls")
    parts = F.ceil(F.col("c") / BLOCK).cast("int")
    part = F.when(F.col("c") <= BLOCK, 0).otherwise(F.pmod(F.xxhash64("cls", F.lit(11)), parts)).cast("int")
    dealt = materialise(dealt.withColumn("part", part).withColumn("label", F.col("cls")).withColumn("side", F.lit(0)), "groups")
    block = F.xxhash64("grp", "part").alias("block")
    big = dealt.where(F.col("c") > BLOCK)
    # Some members of a large group stand in each of its blocks, so that its blocks come together.
    least = F.min(F.struct(F.xxhash64("cls", F.lit(17)), "cls"))
    heads = big.groupBy("grp", F.pmod(F.xxhash64("cls"), F.lit(ANCHORS))).agg(least.alias("h")).select("grp", F.col("h.cls").alias("cls"))
    anchors = big.join(heads, ["grp", "cls"]).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    columns = [block, "cls", "doc", "label", "side"]
    links = _linked(dealt.select(*columns).unionByName(anchors.select(*columns)).distinct(), docs, percent, k)
    label = components(links, "a", "b")
    if not big.limit(1).count():
        return label
    own = big.drop("label").join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    own = materialise(own, "labelled")
    most = own.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("grp").agg(F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    own = own.join(most.where("labels > 1").select("grp", F.col("top.label").alias("top")), "grp")
    left = own.where("label <> top")
    few = left.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("turns"))
    cross = F.xxhash64("grp", "part", "turn", F.lit(5)).alias("block")
    ask = left.join(few, "grp").withColumn("turn", F.pmod(F.xxhash64("cls", F.lit(13)), F.col("turns")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("side", F.lit(1))
    told = own.join(few, "grp").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    columns = [cross, "cls", "doc", "label", "side"]
    more = _linked(ask.select(*columns).unionByName(told.select(*columns)), docs, percent, k)
    return components(links.unionByName(more), "a", "b")


def jaccard_components(docs: DataFrame, *, percent: int = 85, k: int = 4, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id``: a row for each document.

    ``class_id`` is the smallest doc_id with the same set, ``component_id`` the
    smallest doc_id reachable by links.
    """
    rows = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    profile = materialise(rows.mapInArrow(_profiler(k), "doc long, n long, cls long, cell int"), "profile")
    label = class_components(rows, profile, percent=percent, k=k)
    found = profile.where("doc is not null")
    classes = found.where("n > 0").groupBy("cls").agg(F.min("doc").alias("class_id"))
    classes = classes.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    classes = materialise(classes, "classes")
    least = classes.groupBy("label").agg(F.min("class_id").alias("component_id"))
    known = classes.join(least, "label").select("cls", "class_id", "component_id")
    full = found.where("n > 0").join(known, "cls").select("doc", "n", "class_id", "component_id")
    empty = found.where("n = 0").select("doc", "n", F.col("doc").alias("class_id"), F.col("doc").alias("component_id"))
    return full.unionByName(empty).select(F.col("doc").alias(doc_col), F.col("n").alias("n_shingles"), "class_id", "component_id")


def one_of_each(docs: DataFrame, *, percent: int = 80, k: int = 5, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one that gives the component its id.

    Of rows with one id and one text one stays. Documents without words are no copies of
    each other and stay; so do rows without an id.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no column's name clashes
    doc, text = f"c{names.index(doc_col)}", f"c{names.index(text_col)}"
    found = jaccard_components(plain, percent=percent, k=k, doc_col=doc, text_col=text)
    gone = found.where(F.col("component_id") != F.col(doc)).select(F.col(doc).alias("gone")).distinct()
    kept = plain.join(gone, plain[doc] == gone["gone"], "left_anti")
    several = materialise(found.groupBy(F.col(doc).alias("id")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id"), "repeats")
    if several.limit(1).count():
        again = kept.join(several, kept[doc] == several["id"], "left_semi").dropDuplicates([doc, text])
        kept = kept.join(several, kept[doc] == several["id"], "left_anti").unionByName(again)
    return kept.toDF(*names)
