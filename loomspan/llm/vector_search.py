"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves, and each half is quantised by its own ``cells``
centroids, fitted by k-means on a sample of at most about ``sample_rows``
distinct vectors (a documented bound; every vector is indexed). A vector lies in the cell
(i, j) of its halves' nearest centroids. A query takes the cells in the order of
the summed distances of their two centroids, popped from a heap that begins
with the nearest pair and is fed with each popped pair's successors, until the
cells hold a share ``probe`` of all distinct vectors. These entries are reranked
with inner products in double precision.

Where ``probe`` is not given, it is measured: up to CALIBRATION vectors of the sample
are searched for in the whole sample by brute force, and the share is the least
at which the cells in their order hold ``recall`` of the true neighbours. Data with
near neighbours need a small share; vectors without any, as random ones, a large one.
Neighbours in a larger table are nearer, so the share that the sample needs is enough.

Equal vectors are one entry with their k + 1 smallest ids, which is all that a
result can hold of them; every task cuts its ids down to these before the
shuffle, so a vector that very many rows share is no large group.

Cells are spread by their first half: a query goes once to each first-half
centroid that it visits, with the second halves it wants there. Neither side is held
by key: a centroid with more vectors than ``block`` is dealt over several keys by a
hash of the vector, and so are more queries than ``query_block``.

A score is the sum of products in the order of the components, so equal vectors
have equal scores wherever they stand; ties go to the smaller id.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, neither as queries nor as entries; a null id neither;
an inner product needs equal lengths, so vectors of each length are a search of
their own (lengths, not vectors, are counted on the driver); repeated rows of one id
and vector count once, and an id with several vectors is a query with each; with
fewer than ``k`` candidates all are returned; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .textbuf import ragged

QUERY_BLOCK = 256
CALIBRATION = 256
#: Distinct vectors whose ids a task holds before it hands them on.
HELD = 50_000


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return _nearest(x[:, :h], self.first), _nearest(x[:, h:], self.second)

    def visit(self, query: np.ndarray, wanted: int) -> list[tuple[int, int]]:
        """Cells in the order of the summed centroid distances, until they hold ``wanted`` vectors."""
        h = self.first.shape[1]
        if not wanted:
            return []
        d1, d2 = ((self.first - query[:h]) ** 2).sum(axis=1), ((self.second - query[h:]) ** 2).sum(axis=1)
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        d1, d2 = d1[o1].tolist(), d2[o2].tolist()
        heap, out, have = [(d1[0] + d2[0], 0, 0)], [], 0
        while heap and have < wanted:
            _, i, j = heapq.heappop(heap)
            n = self.counts[o1[i], o2[j]]
            if n:
                out.append((int(o1[i]), int(o2[j])))
                have += n
            if j + 1 < len(d2):
                heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(d1):
                heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
        return out


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    norm = (centroids**2).sum(axis=1)
    for i in range(0, len(x), 8192):
        out[i : i + 8192] = (norm - 2 * x[i : i + 8192] @ centroids.T).argmin(axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    if not x.shape[1]:
        return np.zeros((1, 0))
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of vectors, of a column of their bytes."""
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, "<f8").reshape(-1, d)


def probe_for(x: np.ndarray, first: np.ndarray, second: np.ndarray, k: int, recall: float) -> float:
    """The least share of vectors in a query's first cells that holds ``recall`` of its nearest, over some of ``x``."""
    index = MultiIndex(first, second, np.zeros(0))
    i, j = index.assign(x)
    cell = i * len(second) + j
    counts = np.bincount(cell, minlength=len(first) * len(second))
    picks = np.linspace(0, len(x) - 1, min(CALIBRATION, len(x))).astype(int)
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    half, shares = first.shape[1], []
    for r in picks:
        s = x @ x[r]
        s[r] = -np.inf
        near = np.argpartition(-s, k - 1)[:k]
        far = ((first - x[r, :half]) ** 2).sum(axis=1)[:, None] + ((second - x[r, half:]) ** 2).sum(axis=1)[None, :]
        order = np.argsort(far.ravel(), kind="stable")
        before = np.zeros(len(order))
        before[order] = np.cumsum(counts[order]) - counts[order]  # a cell is visited while those before hold too few
        shares.append((before[cell[near]] + 1) / len(x))
    shares = np.sort(np.concatenate(shares))
    return float(min(1.0, shares[min(len(shares) - 1, int(np.ceil(recall * len(shares))) - 1)]))


def scores(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows (or of one with all), added up in the order of the components."""
    query = np.broadcast_to(query, x.shape)
    s = np.zeros(len(x))
    for d in range(x.shape[1]):
        s += query[:, d] * x[:, d]
    return s


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) of one length -> (id, bytes of v)."""
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False) + 0.0  # of two zeros, one
        d = len(flat) // max(1, batch.num_rows)
        rows = [r.tobytes() for r in flat.astype("<f8").reshape(-1, max(1, d))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "v"])


def _fewest(k: int):
    """Rows (id, v) -> (ids, v): for each vector of a task its ``k`` smallest ids."""

    def rows(held: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sorted(set(x))[:k] for x in held.values()], pa.list_(pa.int64())), pa.array(list(held), pa.binary())], names=["ids", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = held.setdefault(v, [])
                own.append(i)
                if len(own) > 4 * k:
                    held[v] = sorted(set(own))[:k]
            if len(held) >= HELD:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    return run


def _assigner(first: np.ndarray, second: np.ndarray):
    index = MultiIndex(first, second, np.zeros(0))
    d = first.shape[1] + second.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, j = index.assign(matrix(batch.column(0), d))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], names=["v", "ids", "i", "j"])

    return run


def _router(index: MultiIndex, wanted: int):
    """Queries -> a row for each first half that one visits, with a bit for each second half."""
    d = index.first.shape[1] + index.second.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, half, wants = [], [], []
            for r, v in enumerate(matrix(batch.column(1), d)):
                cells = np.array(index.visit(v, wanted), np.int64).reshape(-1, 2)
                mask = np.zeros((len(index.first), len(index.second)), bool)
                mask[cells[:, 0], cells[:, 1]] = True
                own = np.flatnonzero(mask.any(axis=1))
                row += [r] * len(own)
                half += own.tolist()
                wants += [b.tobytes() for b in np.packbits(mask[own], axis=1)]
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(half, pa.int32()), pa.array(wants, pa.binary())], names=["id", "v", "i", "wants"])

    return run


FOUND = "query_id long, vec_id long, score double"


def _rerank(k: int, d: int, seconds: int):
    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if queries.num_rows and entries.num_rows:
            x, cell = matrix(entries["v"].combine_chunks(), d), entries["j"].to_numpy()
            lists = entries["ids"].combine_chunks()
            ids, at = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            alone = np.where(np.diff(at) == 1, ids[at[:-1]], -1)  # an entry with one id, the query's own, is no candidate
            single = np.diff(at) == 1
            q, qid = matrix(queries["v"].combine_chunks(), d), queries["id"].to_numpy()
            wants = np.unpackbits(np.frombuffer(b"".join(queries["wants"].to_pylist()), np.uint8).reshape(len(q), -1), axis=1)[:, :seconds].astype(bool)
            for i in range(0, len(q), QUERY_BLOCK):
                own = slice(i, i + QUERY_BLOCK)
                rough = q[own] @ x.T
                rough[~wants[own][:, cell] | (single & (alone == qid[own][:, None]))] = -np.inf
                limit = np.full(len(rough), -np.inf)
                if len(x) > k:  # the product above errs in the last digits only
                    limit = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k]
                with np.errstate(invalid="ignore"):
                    row, e = np.nonzero(np.isfinite(rough) & (rough >= (limit - 1e-9 * np.maximum(1.0, np.abs(limit)))[:, None]))
                s = scores(q[own][row], x[e])
                n = at[e + 1] - at[e]
                row, s, vec = np.repeat(row, n), np.repeat(s, n), ids[ragged(at[e], n)]
                other = vec != qid[own][row]
                row, s, vec = row[other], s[other], vec[other]
                order = np.lexsort((vec, -s, row))
                row, s, vec = row[order], s[order], vec[order]
                begin = np.searchsorted(row, row)
                best = np.arange(len(row)) - begin < k
                for to, value in zip(out, (qid[own][row], vec, s)):
                    to.append(value[best])
        return pa.table({n: np.concatenate(v) for n, v in zip(("query_id", "vec_id", "score"), out)})

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v, d`` of the rows that take part; ``d`` is the length."""
    v = F.col(vector_col).cast("array<double>").alias("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).withColumn("d", F.size("v"))


def _of_length(rows: DataFrame, d: int, *, is_query, k: int, cells: int, probe: float | None, recall: float, sample_rows: int, block: int, query_block: int) -> DataFrame:
    rows = materialise(rows.select("id", "v").mapInArrow(_packer, "id long, v binary"), "vectors")
    few = rows.mapInArrow(_fewest(k + 1), "ids array<long>, v binary").groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    few = materialise(few, "distinct")
    total = few.count()
    draw = F.pmod(F.xxhash64(F.lit("index"), "v"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = few.where(draw < max(sample_rows / total, 1e-9)).select("v", F.element_at("ids", 1).alias("id")).toArrow().sort_by("id")
    if not sample.num_rows:
        sample = few.select("v", F.element_at("ids", 1).alias("id")).orderBy("id").limit(1000).toArrow()
    x = matrix(sample["v"].combine_chunks(), d)
    half = max(1, d // 2)
    first, second = kmeans(x[:, :half], cells), kmeans(x[:, half:], cells)
    share = probe if probe is not None else probe_for(x, first, second, k, recall)
    entries = materialise(few.select("v", "ids").mapInArrow(_assigner(first, second), "v binary, ids array<long>, i int, j int"), "entries")
    counts = np.zeros((len(first), len(second)), np.int64)
    for r in entries.groupBy("i", "j").count().collect():  # cells squared numbers at most
        counts[r.i, r.j] = r["count"]
    asked = rows.where(is_query(F.col("id"))).distinct()
    n = asked.count()
    parts = max(1, -(-n // query_block))
    per_key = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // block))) for n in counts.sum(axis=1)]), F.col("i") + 1)
    asked = asked.repartition(min(20_000, max(1, -(-n // QUERY_BLOCK))), "id").mapInArrow(_router(MultiIndex(first, second, counts), int(np.ceil(share * total))), "id long, v binary, i int, wants binary")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), per_key - 1)))
    entries = entries.withColumn("salt", F.pmod(F.xxhash64("v"), per_key).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    key = ["i", "salt", "part"]
    found = asked.groupBy(*key).cogroup(entries.groupBy(*key)).applyInArrow(_rerank(k, d, len(second)), FOUND)
    # Each key gives at most k rows a query, so a query's rows here are bounded by k times its keys.
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best")
    return found.distinct().groupBy("query_id").agg(best)  # an id with several vectors may find a row twice


def nearest(
    vectors: DataFrame,
    *,
    is_query,
    k: int = 20,
    cells: int = 64,
    probe: float | None = None,
    recall: float = 0.94,
    sample_rows: int = 20_000,
    block: int = 20_000,
    query_block: int = 1 << 16,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest by inner product."""
    rows = usable(vectors, id_col, vector_col)
    best = None
    options = dict(is_query=is_query, k=k, cells=cells, probe=probe, recall=recall, sample_rows=sample_rows, block=block, query_block=query_block)
    for r in rows.groupBy("d").count().orderBy("d").collect():
        own = _of_length(rows.where(F.col("d") == r.d), r.d, **options)
        best = own if best is None else best.unionByName(own)
    if best is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # An id that has vectors of several lengths has the best of all.
    each = best.select("query_id", F.explode("best").alias("b")).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set("b")), 1, k).alias("best")) if best is not own else best
    return each.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
