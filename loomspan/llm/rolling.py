"""Features of trailing time windows by block-aligned suffixes and prefixes.

For a width W, time is cut into blocks of W. The window [t - W, t) of a time t in
block b is a suffix of block b - 1 and a prefix of block b. Each block has two
persistent sorted trees over the values of both: one grows as times ascend (its
versions are the prefixes), one as they descend (the suffixes). A rank in the window
is found by walking down one version of each at once: the sizes of the two left
children, added, say whether the rank lies to the left. Counts and sums come from
running totals over the same versions; a category is in a window unless the window
begins after its last time in block b - 1 and ends at or before its first in b.

A row goes to two groups (key, width, block), whatever its key holds besides, so a hot
key is spread over its blocks. Rows equal in key, time and value become one with a
count before that. Where a block is still larger than ``group_rows``, its trees are cut
into ranges of values: each range reports how many of a window's values it holds, and
a second search asks the range that has the rank. One group is then at most
``group_rows`` rows, and the rows of one value (one a time, so at most two widths), with
its distinct times.

Defined cases: null keys are one key; a null value counts as a row only, a null category
not at all; a row without time is in no window and its own windows are empty (counts and
sums 0, ranks null); rows that repeat all count; an empty table gives no rows; columns
besides those named are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

#: Rows of a group of blocks, but for the rows of one value.
GROUP_ROWS = 1 << 20
#: Rows that a task works on at once; a larger group is worked on alone.
BATCH_ROWS = 1 << 16
PREVIOUS, CURRENT, CATEGORY, QUERY = 0, 1, 2, 3
GROUP = ["k", "w", "block", "part"]
ROWS = "k string, w long, block long, part int, parts int, kind int, t long, v long, n long, ranks array<long>"
FOUND = "k string, w long, block long, part int, t long, n_rows long, n_values long, total long, n_categories long, at array<long>"


class Trees:
    """Persistent sorted trees, many at once: tree ``i`` holds the rows with ``tree == i``.

    Rows must come ordered by tree and by insertion in it; version ``j`` of a tree is named
    by its last row. Level ``l`` has a node for each row, over the values that share the row's
    ``l`` first bits of rank; its children are the latest nodes of the level below.
    """

    def __init__(self, tree: np.ndarray, rank: np.ndarray, n: np.ndarray):
        self.height = int(rank.max(initial=0)).bit_length()
        self.count, self.left, self.right = [], [], []
        size = len(rank)
        place = np.arange(size)
        for level in range(self.height + 1):
            path = (tree << level) | (rank >> (self.height - level))
            order = np.argsort(path, kind="stable")
            begin = np.zeros(size, np.int64)
            edge = np.flatnonzero(np.diff(path[order])) + 1
            begin[edge] = edge
            np.maximum.accumulate(begin, out=begin)
            running = np.cumsum(n[order])
            count = np.empty(size, np.int64)
            count[order] = running - (running - n[order])[begin]
            self.count.append(count)
            if level == self.height:
                break
            bit = (rank[order] >> (self.height - level - 1)) & 1
            for side, nodes in ((0, self.left), (1, self.right)):
                last = np.maximum.accumulate(np.where(bit == side, place, -1))
                node = np.empty(size, np.int64)
                node[order] = np.where(last >= begin, order[last], -1)
                nodes.append(node)

    @staticmethod
    def _at(values: np.ndarray, node: np.ndarray, empty: int) -> np.ndarray:
        return np.where(node >= 0, values[node], empty) if len(values) else np.full(len(node), empty, np.int64)

    def sizes(self, node: np.ndarray) -> np.ndarray:
        return self._at(self.count[0], node, 0)

    def select(self, x: np.ndarray, y: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """A row that holds the ``rank``-th value (from 1) of versions ``x`` and ``y`` together."""
        for level in range(self.height):
            lx, ly = self._at(self.left[level], x, -1), self._at(self.left[level], y, -1)
            below = self._at(self.count[level + 1], lx, 0) + self._at(self.count[level + 1], ly, 0)
            go = rank > below
            rank = rank - np.where(go, below, 0)
            x = np.where(go, self._at(self.right[level], x, -1), lx)
            y = np.where(go, self._at(self.right[level], y, -1), ly)
        return np.maximum(x, y)


def _dense(group: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Ranks of the distinct values in each group, from 0."""
    order = np.lexsort((v, group))
    g, x = group[order], v[order]
    new_group = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
    step = np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])[: len(g)]
    run = np.cumsum(step)
    rank = np.empty(len(v), np.int64)
    rank[order] = run - np.maximum.accumulate(np.where(new_group, run, 0))
    return rank


class _Versions:
    """Where the versions of many trees end: rows ordered by tree and by distance from the block's begin."""

    def __init__(self, group, kind, t, start, width):
        self.span = int(width.max(initial=1)) + 1
        side = (kind == CURRENT).astype(np.int64)
        away = np.where(side == 1, t - start[group], start[group] - 1 - t)
        key = (2 * group + side) * self.span + away
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.tree = (2 * group + side)[self.order]

    def last(self, group, t, start, width) -> tuple[np.ndarray, np.ndarray]:
        """The last row of the suffix and of the prefix that a window at ``t`` has; -1 without rows."""
        into = t - start[group]
        suffix = np.searchsorted(self.key, 2 * group * self.span + width[group] - 1 - into, side="right") - 1
        prefix = np.searchsorted(self.key, (2 * group + 1) * self.span + into, side="left") - 1
        of = lambda at, tree: np.where((at >= 0) & (self.tree[at] == tree), at, -1) if len(self.tree) else np.full(len(at), -1)
        return of(suffix, 2 * group), of(prefix, 2 * group + 1)

    def total(self, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The sum over each version's rows."""
        running = np.cumsum(values[self.order])
        if not len(running):
            return np.zeros(len(ends), np.int64)
        first = np.searchsorted(self.tree, self.tree[ends], side="left")
        return np.where(ends >= 0, running[ends] - np.where(first > 0, running[first - 1], 0), 0)


def _features(rows: pa.Table, group: np.ndarray, percents: Sequence[int]) -> pa.RecordBatch:
    """Features of all windows asked for in whole groups; ``group`` numbers each row's group from 0."""
    column = lambda name: rows.column(name).combine_chunks()
    number = lambda name: column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    kind, t, v, n, parts = (number(x) for x in ("kind", "t", "v", "n", "parts"))
    has_t, has_v = (~column(x).is_null().to_numpy(zero_copy_only=False) for x in ("t", "v"))
    first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    width = number("w")[first]
    start = number("block")[first] * width

    member = (kind == PREVIOUS) | (kind == CURRENT)
    # In an uncut group each time of the block is asked for once; a cut group is told what is asked.
    own = (kind == CURRENT) & (parts == 1)
    asked = np.flatnonzero(own)
    if len(asked):
        pair = np.lexsort((t[asked], group[asked]))
        asked = asked[pair]
        asked = asked[np.concatenate([[True], (np.diff(group[asked]) != 0) | (np.diff(t[asked]) != 0)])]
    asked = np.concatenate([asked, np.flatnonzero(kind == QUERY)])
    qg, qt = group[asked], t[asked]

    some = np.flatnonzero(member)
    all_rows = _Versions(group[some], kind[some], t[some], start, width)
    n_rows = sum(all_rows.total(n[some], e) for e in all_rows.last(qg, qt, start, width))

    valued = np.flatnonzero(member & has_v)
    versions = _Versions(group[valued], kind[valued], t[valued], start, width)
    ends = versions.last(qg, qt, start, width)
    total = sum(versions.total(v[valued] * n[valued], e) for e in ends)
    rank = _dense(group[valued], v[valued])
    trees = Trees(versions.tree, rank[versions.order], n[valued][versions.order])
    n_values = trees.sizes(ends[0]) + trees.sizes(ends[1])
    values = v[valued][versions.order]

    told = column("ranks").take(pa.array(asked))
    given = ~told.is_null().to_numpy(zero_copy_only=False)
    counted = (parts[asked] == 1) & ~given
    at, missing = [], []
    for i, percent in enumerate(percents):
        asks = np.where(counted, -(-percent * n_values // 100), 0)
        if given.any():
            asks[given] = [r[i] or 0 for r in told.filter(pa.array(given)).to_pylist()]
        row = trees.select(ends[0], ends[1], np.maximum(asks, 1))
        found = (asks > 0) & (row >= 0)
        at.append(np.where(found, values[row], 0) if len(values) else np.zeros(len(asked), np.int64))
        missing.append(~found)

    # A category is away from the windows whose end lies in (last + W, first].
    cats = np.flatnonzero(kind == CATEGORY)
    cg = group[cats]
    here = np.bincount(cg, minlength=len(first))[qg]
    leaves = np.where(has_t[cats], t[cats] + width[cg] - start[cg], -1)  # from the block's begin; no row before: always away
    comes = np.where(has_v[cats], v[cats] - start[cg], 2 * width[cg])
    away = leaves < comes
    span = 2 * int(width.max(initial=1)) + 2
    count_below = lambda x: np.searchsorted(np.sort((cg * span + 1 + x)[away]), qg * span + 1 + qt - start[qg], side="left")
    n_categories = here - (count_below(leaves) - count_below(comes))

    flat = np.stack(at, axis=1).reshape(-1) if at else np.zeros(0, np.int64)
    gone = np.stack(missing, axis=1).reshape(-1) if at else np.zeros(0, bool)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(asked) + 1, dtype=np.int32) * len(percents)), pa.array(flat, pa.int64(), mask=gone))
    where = pa.array(asked)
    named = [column(x).take(where) for x in GROUP]
    cols = [*named, pa.array(qt), pa.array(n_rows), pa.array(n_values), pa.array(total), pa.array(n_categories), lists]
    return pa.RecordBatch.from_arrays([c.cast(pa.int64()) if pa.types.is_integer(c.type) and i != 3 else c for i, c in enumerate(cols)], names=[*GROUP, "t", "n_rows", "n_values", "total", "n_categories", "at"])


def _group_ends(rows: pa.Table) -> np.ndarray:
    """Which row begins another group than the row before it."""
    change = np.zeros(len(rows), bool)
    for name in GROUP:
        codes = rows.column(name).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) if name == "k" else rows.column(name).to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    return change


def _worker(percents: Sequence[int], batch_rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting, need = 0, batch_rows
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting < need:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            change = _group_ends(rows)
            cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
            if cut:
                yield _features(rows.slice(0, cut), np.cumsum(change[:cut]), percents)
            held, waiting = rows.slice(cut).to_batches(), len(rows) - cut
            need = max(batch_rows, 2 * waiting)  # a long group is looked through again only as it doubles
        if waiting:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield _features(rows, np.cumsum(_group_ends(rows)), percents)

    return work


def _search(rows: DataFrame, percents: Sequence[int], batch_rows: int) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_worker(tuple(percents), batch_rows), FOUND)


def _blocks(t: Column, widths: Sequence[int]) -> Column:
    """For each width the row's block (kind CURRENT) and the next one (kind PREVIOUS)."""
    out = []
    for w in widths:
        block = (t - F.pmod(t, F.lit(w))) / w
        for kind, later in ((CURRENT, 0), (PREVIOUS, 1)):
            out.append(F.struct(F.lit(w).cast("long").alias("w"), (block.cast("long") + later).alias("block"), F.lit(kind).alias("kind")))
    return F.explode(F.array(*out))


def _cut(members: DataFrame, heavy: DataFrame) -> DataFrame:
    """Members of cut blocks with their ``part``: values in order, about ``group_rows`` rows a part."""
    part = F.coalesce(F.size(F.filter("begins", lambda b: b <= F.col("v"))) - 1, F.lit(0))
    found = members.drop("part", "parts").join(heavy, ["k", "w", "block"])
    return found.withColumn("part", F.greatest(part, F.lit(0))).withColumn("parts", F.size("begins")).drop("begins")


def _heavy(members: DataFrame, group_rows: int) -> DataFrame:
    """``k, w, block, begins``: blocks that are cut, and the least value of each part."""
    key = ["k", "w", "block"]
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > group_rows)
    by_value = members.join(sizes, key).where(F.col("v").isNotNull()).groupBy(*key, "v").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    part = F.floor(F.coalesce(before, F.lit(0)) / group_rows)
    begins = by_value.withColumn("part", part).groupBy(*key, "part").agg(F.min("v").alias("v"))
    cut = begins.groupBy(*key).agg(F.sort_array(F.collect_list("v")).alias("begins"))
    return cut.where(F.size("begins") > 1)


def rolling_features(rows: DataFrame, *, key: Column, time: Column, value: Column, category: Column, widths: Sequence[int], percents: Sequence[int] = (50, 75), group_rows: int = GROUP_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``k, w, t, n_rows, n_values, total, n_categories, at``: the window [t - w, t) of each distinct key and time.

    ``k`` is the key behind a ``=``, or empty for null; ``time`` and ``value`` are longs; ``at`` holds
    for each percent p the ``ceil(p * n / 100)``-th smallest of the window's n values (null without values).
    """
    base = rows.select(keyed(key).alias("k"), time.cast("long").alias("t"), value.cast("long").alias("v"), category.cast("string").alias("c")).where("t IS NOT NULL")
    whole = [F.lit(0).alias("part"), F.lit(1).alias("parts")]
    none = F.lit(None).cast("array<long>").alias("ranks")
    counted = base.groupBy("k", "t", "v").agg(F.count(F.lit(1)).alias("n"))
    members = counted.select("*", _blocks(F.col("t"), widths).alias("b")).select("k", "b.w", "b.block", *whole, "b.kind", "t", "v", "n", none)
    seen = base.where("c IS NOT NULL").select("*", _blocks(F.col("t"), widths).alias("b")).groupBy("k", "b.w", "b.block", "c")
    seen = seen.agg(F.max(F.when(F.col("b.kind") == PREVIOUS, F.col("t"))).alias("t"), F.min(F.when(F.col("b.kind") == CURRENT, F.col("t"))).alias("v"))
    categories = seen.select("k", "w", "block", *whole, F.lit(CATEGORY).alias("kind"), "t", "v", F.lit(0).cast("long").alias("n"), none)

    heavy = materialise(_heavy(members, group_rows), "heavy-blocks")
    if heavy.isEmpty():
        return _search(members.unionByName(categories), percents, batch_rows).drop("block", "part")

    key_cols = ["k", "w", "block"]
    light = _search(members.unionByName(categories).join(heavy, key_cols, "left_anti").select(*ROW_NAMES), percents, batch_rows)
    parts = _cut(members, heavy).select(*ROW_NAMES)
    times = parts.where(F.col("kind") == CURRENT).select(*key_cols, "t", "parts").distinct()
    query = lambda df: df.select("k", "w", "block", "part", "parts", F.lit(QUERY).alias("kind"), "t", F.lit(None).cast("long").alias("v"), F.lit(0).cast("long").alias("n"), "ranks")
    everywhere = times.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("ranks", none)
    cats = categories.drop("parts").join(heavy.select(*key_cols, F.size("begins").alias("parts")), key_cols).select(*ROW_NAMES)
    counts = materialise(_search(parts.unionByName(cats).unionByName(query(everywhere)), percents, batch_rows), "part-counts")

    one = Window.partitionBy(*key_cols, "t")
    placed = counts.withColumn("all", F.sum("n_values").over(one)).withColumn("before", F.sum("n_values").over(one.orderBy("part")) - F.col("n_values"))
    ranks = [F.ceil(F.col("all") * p / 100) - F.col("before") for p in percents]
    here = [F.when((r > 0) & (r <= F.col("n_values")), r) for r in ranks]
    asked = placed.withColumn("ranks", F.array(*here)).where(F.exists("ranks", lambda r: r.isNotNull()))
    asked = asked.join(heavy.select(*key_cols, F.size("begins").alias("parts")), key_cols)
    found = _search(parts.unionByName(query(asked)), percents, batch_rows).groupBy(*key_cols, "t").agg(F.array(*(F.max(F.col("at")[i]) for i in range(len(percents)))).alias("at"))
    sums = counts.groupBy(*key_cols, "t").agg(*(F.sum(x).alias(x) for x in ("n_rows", "n_values", "total", "n_categories")))
    nothing = F.array(*(F.lit(None).cast("long") for _ in percents))
    cut = sums.join(found, [*key_cols, "t"], "left").withColumn("at", F.coalesce("at", nothing))
    return light.drop("block", "part").unionByName(cut.drop("block"))


ROW_NAMES = ["k", "w", "block", "part", "parts", "kind", "t", "v", "n", "ranks"]


def keyed(key: Column) -> Column:
    return F.when(key.isNull(), "").otherwise(F.concat(F.lit("="), key.cast("string")))


def document_features(docs: DataFrame, event: Column, *, widths: Sequence[int] = (3600, 21600), group_rows: int = GROUP_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """For each document and width the window before its event in its source: counts, characters, languages, ranks of lengths."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), event.cast("long").alias("event_s"), F.length("text").cast("long").alias("chars"), F.col("lang").cast("string").alias("lang"))
    col = F.col
    found = rolling_features(rows, key=col("source"), time=col("event_s"), value=col("chars"), category=col("lang"), widths=widths, percents=(50, 75), group_rows=group_rows, batch_rows=batch_rows)
    named = found.select("k", F.col("t").alias("event_s"), F.col("w").alias("window_s"), F.col("n_rows").alias("n_events"), F.col("total").alias("sum_chars"), F.col("n_categories").alias("n_langs"), F.col("at")[0].alias("median_chars"), F.col("at")[1].alias("high_chars"))
    ids = rows.select("doc_id", keyed(F.col("source")).alias("k"), "event_s")
    timed = ids.where("event_s IS NOT NULL").join(named, ["k", "event_s"]).drop("k")
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    rest = ids.where("event_s IS NULL").select("doc_id", "event_s", F.explode(F.array(*(F.lit(w).cast("long") for w in widths))).alias("window_s"), zero.alias("n_events"), zero.alias("sum_chars"), zero.alias("n_langs"), null.alias("median_chars"), null.alias("high_chars"))
    return timed.unionByName(rest)
