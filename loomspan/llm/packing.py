"""Packing of token pieces into sequences, shortest pack first.

Documents are cut into pieces of at most ``seq_len`` ids. The lengths of all
pieces make a histogram with at most ``seq_len`` entries, which goes to the
driver. There the lengths are placed longest first, each into the shortest pack
that exists, or into a new pack if it does not fit there. Packs with one history
are a run of consecutive sequences and are handled as one pattern with a count;
placing a length on part of a run splits it. Every placement is a slot: pieces
of this length with ranks [r, r + n) go to sequences [s, s + n) at one offset.
Pieces are joined back to slots by their rank among the pieces of their length.

The rank needs no group of one length in one task: each task numbers its own pieces
of each length as it writes them, and prefix sums over the tasks' counts give the bases.

Defined cases: a null text is the empty text and is the end id alone; repeated
rows are packed each on its own (equal pieces may swap places); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise
from .subwords import encoder, tokenizer_path
from .token_output import _append_end

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
#: Columns that numbering adds; pieces must not have them.
OWN = ("_pack_part", "_pack_local")


def _cutter(path: str, end_id: int, seq_len: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for i, ids, at in enc.batches(batch.column(1), 4 << 20):
                ids, at = _append_end(ids, at, end_id)
                n = np.diff(at)
                k = (n + seq_len - 1) // seq_len
                row = np.repeat(np.arange(len(n)), k)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)) * seq_len
                length = np.minimum(seq_len, n[row] - start)
                edges = np.zeros(len(row) + 1, np.int64)
                np.cumsum(length * 4, out=edges[1:])
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(n)).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(n[row]), raw.cast(pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    return cut


def token_pieces(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, seq_len: int = 2048) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of at most ``seq_len``."""
    rows = docs.select(F.col(doc_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(_cutter(tokenizer or tokenizer_path(), end_id, seq_len), PIECES)


def plan_slots(histogram: dict[int, int], seq_len: int = 2048) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, offset) for a histogram of lengths."""
    slots, packs, sequences = [], [], 0  # packs: (tokens used, first sequence, count)
    for length in sorted((x for x, c in histogram.items() if c > 0), reverse=True):
        if not 0 < length <= seq_len:
            raise ValueError(f"a piece of {length} ids does not fit {seq_len}")
        rank, left = 0, histogram[length]
        while left:
            if packs and packs[0][0] + length <= seq_len:
                used, first, count = heapq.heappop(packs)
                n = min(left, count)
                if n < count:
                    heapq.heappush(packs, (used, first + n, count - n))
            else:
                used, first, n = 0, sequences, left
                sequences += n
            slots.append((length, rank, n, first, used))
            if used + length < seq_len:
                heapq.heappush(packs, (used + length, first, n))
            rank, left = rank + n, left - n
    return slots


def _placer(slots: list[tuple[int, int, int, int, int]]):
    table = np.array(slots, np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] * (1 << 44) + table[:, 1]  # ranks stay below 2**44
        order = np.argsort(key, kind="stable")
        own, key = table[order], key[order]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "_pack_rank"))
            slot = own[np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return place


def _numberer(at: int, seq_len: int):
    """Adds the task, and how many pieces of its length the task has written before."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(seq_len + 1, np.int64)
        for batch in batches:
            length = batch.column(at).to_numpy()
            if len(length) and not 0 < length.min() <= length.max() <= seq_len:
                raise ValueError(f"a piece of {length.max()} ids does not fit {seq_len}")
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            local = np.empty(len(length), np.int64)
            local[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=seq_len + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(local)], names=[*batch.schema.names, *OWN])

    return number


def pack(pieces: DataFrame, *, seq_len: int = 2048) -> DataFrame:
    """``pieces`` (with ``length``) and for each its ``sequence_id`` and ``offset``.

    The numbered pieces are written to the shared folder, so a task that is run again
    changes no number. The driver gets the histogram, ``seq_len`` rows, and as many slots
    as the placements of ``seq_len`` lengths, whatever the number of documents. Which of
    several pieces of one length goes to which slot follows the order of the input.
    """
    clash = {*OWN, "_pack_rank", "sequence_id", "offset"} & set(pieces.columns)
    if clash:
        raise ValueError(f"pieces have columns of packing's own: {sorted(clash)}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    numbered = materialise(pieces.mapInArrow(_numberer(pieces.columns.index("length"), seq_len), f"{schema}, _pack_part int, _pack_local long"), "pieces")
    counts = materialise(numbered.groupBy("length", "_pack_part").agg(F.count(F.lit(1)).alias("_pack_n")), "counts")  # a row for each task and length
    before = Window.partitionBy("length").orderBy("_pack_part").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(counts.select("length", "_pack_part", F.coalesce(F.sum("_pack_n").over(before), F.lit(0)).alias("_pack_base")), "bases")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_pack_n")).collect()}
    # Spark sees the size of ``base`` and sends it to the pieces where it is small.
    ranked = numbered.join(base, ["length", "_pack_part"]).select(*pieces.columns, (F.col("_pack_base") + F.col("_pack_local")).alias("_pack_rank"))
    return ranked.mapInArrow(_placer(plan_slots(histogram, seq_len)), f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, *, seq_len: int = 2048, end_id: int = 1, tokenizer: str | None = None, doc_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack whole documents; one row a piece.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    and, with ``with_ids``, the piece's ``ids`` as little-endian unsigned 32-bit
    integers. Pieces are written once to the shared folder, so no id is made twice.
    """
    pieces = token_pieces(docs, seq_len=seq_len, end_id=end_id, tokenizer=tokenizer, doc_col=doc_col, text_col=text_col)
    columns = [F.col("doc_id"), F.col("start"), F.col("length"), F.crc32("ids").alias("ids_crc32"), F.col("doc_tokens")]
    return pack(pieces.select(*columns, *(["ids"] if with_ids else [])), seq_len=seq_len)
