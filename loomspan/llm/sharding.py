"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by a 64-bit hash of their text and then by one of text and id, so copies of a text lie together
and everything else is shuffled. The splitters of this order are searched for, not sorted for: each round sends
a few probe keys for each splitter to all partitions, which count bytes and rows below every probe exactly;
sums over the partitions bracket each splitter, and the next probes go between. A splitter is settled when
the bytes below it differ from its share by no more than the tolerance, or no key is left between its brackets;
then the nearer bracket counts. Whole rows are exchanged once, after that.

Shards are cut further into parts of about ``part_bytes``, by splitters of the same search, so that no task sorts a
whole shard; the exact counts of rows below the splitters are where a part's slots begin.

Copies stay in one shard unless a splitter's share lies inside their run by more than the tolerance: a group
that is larger than a shard is spread over as many as it needs. Rows that are equal in id and text too
are told apart by a number in a written copy of the table, made only where a splitter falls among such rows.

The driver holds a few numbers for each splitter (shards and parts), never rows.

Defined cases: a null text has no bytes and costs ``row_bytes`` alone; null ids are allowed and hash as a value of their own; rows that
repeat are all kept, each with a slot of its own; with fewer rows than shards some shards stay empty;
an empty table gives no rows; further columns are carried along whatever their names, but for ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

#: Probes of each splitter in a round.
PROBES = 15
#: Bytes of a part: what one task sorts.
PART_BYTES = 64 << 20
#: Of a shard's mean bytes: how far a splitter may be from its share.
TOLERANCE = 0.001
LOW, HIGH = -(1 << 63), (1 << 63) - 1
KEY = ("_h", "_d", "_u")


@dataclass(frozen=True)
class Splitters:
    """Ascending keys; ``shard`` and ``base`` belong to the rows from each key on, until the next.

    The first part has no key: it begins before all rows. ``base`` is the slot of the part's first row.
    """

    keys: tuple[np.ndarray, np.ndarray, np.ndarray]
    shard: np.ndarray
    base: np.ndarray
    rows: np.ndarray
    bytes: np.ndarray


def below(keys: tuple[np.ndarray, ...], probes: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each row how many of the ascending probes are at or below its key, compared part by part."""
    lo = np.searchsorted(probes[0], keys[0], side="left")
    hi = np.searchsorted(probes[0], keys[0], side="right")
    if len(keys) == 1:
        return hi
    tied = np.flatnonzero(lo < hi)
    out = lo.copy()
    if len(tied):
        begin, which = np.unique(lo[tied], return_inverse=True)
        order = np.argsort(which, kind="stable")
        for b, at in zip(begin, np.split(tied[order], np.cumsum(np.bincount(which))[:-1])):
            e = int(hi[at[0]])
            out[at] = b + below(tuple(k[at] for k in keys[1:]), tuple(p[b:e] for p in probes[1:]))
    return out


def _counter(probes: tuple[np.ndarray, ...]):
    n = len(probes[0]) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            place = below(tuple(batch.column(x).to_numpy() for x in KEY), probes)
            size += np.bincount(place, batch.column("_size").to_numpy(), minlength=n).astype(np.int64)
            rows += np.bincount(place, minlength=n)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], names=["place", "size", "rows"])

    return count


def _count(keys: DataFrame, probes: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows below each probe; one number of each a probe reaches the driver."""
    found = keys.mapInArrow(_counter(probes), "place long, size long, rows long").groupBy("place").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).toArrow()
    size, rows = np.zeros(len(probes[0]) + 1, np.int64), np.zeros(len(probes[0]) + 1, np.int64)
    at = found.column("place").to_numpy()
    size[at], rows[at] = found.column("size").to_numpy(), found.column("rows").to_numpy()
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def _as_int(key: tuple[int, ...]) -> int:
    out = 0
    for x in key:
        out = out << 64 | x - LOW
    return out


def _as_key(n: int) -> tuple[int, ...]:
    return tuple((n >> 64 * i & (1 << 64) - 1) + LOW for i in (2, 1, 0))


class _Search:
    """One splitter: brackets of its key as an integer of 192 bits, with the exact bytes and rows below both."""

    def __init__(self, target: float, size: int, rows: int, slack: float):
        self.target, self.slack = target, slack
        self.lo, self.hi = (0, 0, 0), (1 << 192, size, rows)

    @property
    def best(self) -> tuple[int, int, int]:
        return min((self.lo, self.hi), key=lambda x: (abs(x[1] - self.target), x[0]))

    @property
    def settled(self) -> bool:
        return abs(self.best[1] - self.target) <= self.slack or self.hi[2] - self.lo[2] <= 1 or self.hi[0] - self.lo[0] <= 1

    @property
    def one_key(self) -> bool:
        """Whether all between the brackets is one row's key but for its number: equal rows."""
        return self.hi[0] - self.lo[0] <= 1 << 64

    def probes(self, n: int) -> list[int]:
        (lo, a, _), (hi, b, _) = self.lo, self.hi
        # Most around the place that even spacing gives, the rest evenly.
        guess = lo + (hi - lo) * int((self.target - a) * 1024 / max(1, b - a)) // 1024
        step = max(1, (hi - lo) // (n + 1))
        near = [guess + k * max(1, step // 32) for k in range(-(n // 4), n // 4 + 1)]
        # Between texts while there are several, then between ids: no run is cut as long as its end will do.
        whole = next(u for u in (1 << 128, 1 << 64, 1) if u < hi - lo)
        return [x for x in {y // whole * whole for y in (*near, *range(lo + step, hi, step))} if lo < x < hi]

    def learn(self, key: int, size: int, rows: int) -> None:
        if size <= self.target and key > self.lo[0]:
            self.lo = (key, size, rows)
        if size >= self.target and key < self.hi[0]:
            self.hi = (key, size, rows)


def find_splitters(keys: DataFrame, *, shards: int, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES, probes: int = PROBES, numbered: bool = True) -> Splitters | None:
    """Splitters of ``_h, _d, _u, _size`` rows; None where equal rows have to be numbered first."""
    total = keys.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("rows")).first()
    parts = max(1, -(-total.size // (shards * part_bytes)))
    mean = total.size / shards
    # A part that begins a shard keeps to the tolerance; one inside may be off by a tenth of itself.
    wanted = [_Search(mean * i / parts, total.size, total.rows, mean * tolerance if i % parts == 0 else mean / parts / 10) for i in range(1, shards * parts)]
    while open_ := [s for s in wanted if not s.settled and (numbered or not s.one_key)]:
        asked = sorted({x for s in open_ for x in s.probes(probes)})
        columns = tuple(np.array(c, np.int64) for c in zip(*map(_as_key, asked)))
        size, rows = _count(keys, columns)
        at = np.array([s.target for s in open_])
        # The last count at or below each target and the first at or above it.
        left, right = np.searchsorted(size, at, side="right") - 1, np.searchsorted(size, at, side="left")
        for s, i, j in zip(open_, left.tolist(), right.tolist()):
            for k in (i, j):
                if 0 <= k < len(asked):
                    s.learn(asked[k], int(size[k]), int(rows[k]))
    if not all(s.settled for s in wanted):
        return None
    ends = [s.best for s in wanted]
    for i in range(1, len(ends)):
        ends[i] = max(ends[i], ends[i - 1])
    at = np.array([0, *(e[2] for e in ends), total.rows], np.int64)
    size = np.array([0, *(e[1] for e in ends), total.size], np.int64)
    first = np.arange(shards * parts) // parts * parts
    columns = tuple(np.array(c, np.int64) for c in zip(*(_as_key(min(e[0], (1 << 192) - 1)) for e in ends))) if ends else (np.zeros(0, np.int64),) * 3
    beyond = np.array([e[0] >= 1 << 192 for e in ends], bool)
    columns = tuple(c[~beyond] for c in columns)  # no row comes after them
    return Splitters(columns, np.arange(shards * parts) // parts, at[:-1] - at[first], np.diff(at), np.diff(size))


def _with_keys(docs: DataFrame, id_col: str, text_col: str, row_bytes: int, number: Column) -> DataFrame:
    """The search's columns beside each row, which is one value, so that no names clash."""
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + row_bytes).cast("long")
    keys = (F.xxhash64(text.isNull(), text), F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text), number)
    return docs.select(F.struct(*docs.columns).alias("row"), *(k.alias(n) for k, n in zip(keys, KEY)), size.alias("_size"))


def _placer(found: Splitters):
    keys, shard, base = found.keys, found.shard, found.base

    @F.pandas_udf("part int, shard int, base long")
    def place(h: pd.Series, d: pd.Series, u: pd.Series) -> pd.DataFrame:
        part = below(tuple(x.to_numpy(np.int64) for x in (h, d, u)), keys)
        return pd.DataFrame({"part": part, "shard": shard[part], "base": base[part]})

    return place


def shard_rows(docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 16, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES, probes: int = PROBES) -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard), after one exchange of whole rows.

    A row's size is the bytes of its text and ``row_bytes``; a splitter is off its equal share of all
    sizes by no more than ``tolerance`` of a shard, or half of the row it falls in.
    """
    docs = docs.drop("shard", "slot")
    limits = {"shards": shards, "tolerance": tolerance, "part_bytes": part_bytes, "probes": probes}
    rows = _with_keys(docs, id_col, text_col, row_bytes, F.lit(0).cast("long"))
    found = find_splitters(materialise(rows.select(*KEY, "_size"), "shard-keys"), numbered=False, **limits)
    if found is None:
        rows = materialise(_with_keys(docs, id_col, text_col, row_bytes, F.monotonically_increasing_id()), "numbered-rows")
        found = find_splitters(rows.select(*KEY, "_size"), **limits)
    placed = rows.select("row", *KEY, _placer(found)(*KEY).alias("_at"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*KEY)) - 1
    numbered = placed.select("row", *KEY, "_at", F.col("_at.part").alias("_part")).withColumn("_nth", nth)
    return numbered.select("row.*", F.col("_at.shard").alias("shard"), (F.col("_at.base") + F.col("_nth")).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, folder: str) -> None:
    """A folder ``shard=N`` for each shard."""
    sharded.write.partitionBy("shard").parquet(folder)


def digest(sharded: DataFrame, *, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 16) -> DataFrame:
    """What the rows of each shard hold."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + row_bytes).cast("long")
    return sharded.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
