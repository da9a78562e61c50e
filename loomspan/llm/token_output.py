"""Token-id output: flat files of unsigned integers with 64-bit offsets.

A data set is a folder of shards. Shard ``s`` holds three files:

* ``<s>.ids``   the ids of its documents, one after the other, little-endian,
  two bytes each if every id of the vocabulary fits, else four;
* ``<s>.off``   one little-endian int64 more than documents: where, in ids from
  the shard's begin, each document starts, and the shard's length;
* ``<s>.doc``   the documents' ids, int64.

Shards are ranges of ``doc_id`` of at most SHARD_TOKENS ids (but for a longer document); a manifest (one row a shard) gives each shard's
base, the prefix sum of the lengths before it, so ``base + off[i]`` is a
document's place in the whole data set. Readers map the files into memory where
the folder is a file system's, and read them through pyarrow elsewhere.

Defined cases: a null text is the empty text and gives the end id alone; an
empty table gives no shard; rows that repeat (also with one ``doc_id``) are all
written, ordered by ``doc_id`` and then text, null ids first and read back as
null; columns besides the two named are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_path
from .subwords import encoder, tokenizer_path

MANIFEST = "path string, part int, shard int, n_docs long, n_tokens long, width int"
NO_DOC = np.iinfo(np.int64).min
READ_TOKENS = 4 << 20
#: Ids of a shard; a task whose range has more writes several.
SHARD_TOKENS = 1 << 26


def _append_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.empty(len(ids) + len(at) - 1, np.uint32)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out[np.arange(len(ids)) + rows] = ids
    at = at + np.arange(len(at))
    out[at[1:] - 1] = end_id
    return out, at


class _Shard:
    """The files of one shard, written as documents come."""

    def __init__(self, folder: str, part: int, number: int, width: int):
        self.filesystem, base = pafs.FileSystem.from_uri(folder)
        self.filesystem.create_dir(base, recursive=True)
        # Another name for each attempt: a task that runs twice never writes into the files of the first.
        self.name = f"{base}/{uuid.uuid4().hex}"
        self.part, self.number, self.width = part, number, width
        self.out = self.filesystem.open_output_stream(f"{self.name}.ids")
        self.offsets, self.docs, self.n = [], [], 0

    def add(self, docs: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >= 1 << 8 * self.width:
            raise ValueError(f"id {int(ids.max())} does not fit {self.width} bytes")
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.docs.append(docs)
        self.offsets.append(self.n + at[:-1])
        self.n += int(at[-1])

    def close(self) -> pa.RecordBatch:
        self.out.close()
        for end, parts in ((".off", [*self.offsets, [self.n]]), (".doc", self.docs)):
            with self.filesystem.open_output_stream(self.name + end) as f:
                f.write(np.concatenate(parts).astype("<i8").tobytes())
        row = {"path": [self.name], "part": [self.part], "shard": [self.number], "n_docs": [sum(map(len, self.docs))], "n_tokens": [self.n], "width": [self.width]}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))


def _writer(folder: str, path: str, end_id: int, width: int, shard_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = None, 0
        for batch in batches:
            docs = batch.column(0).fill_null(NO_DOC).to_numpy(zero_copy_only=False)
            for i, ids, at in encoder(path).batches(batch.column(1)):
                ids, at = _append_end(ids, at, end_id)
                if shard is None:
                    shard = _Shard(folder, TaskContext.get().partitionId(), number, width)
                shard.add(docs[i : i + len(at) - 1], ids, at)
                if shard.n >= shard_tokens:
                    yield shard.close()
                    shard, number = None, number + 1
        if shard is not None:
            yield shard.close()

    return write


def largest_id(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


def write_token_files(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards and return the manifest, with each shard's ``base``.

    The manifest has one row a shard, so the prefix sum over it is taken on the
    driver. The tokenizer's largest id fixes the width; a larger one would fail the job.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    path = tokenizer or tokenizer_path()
    width = 2 if max(largest_id(path), end_id) < 1 << 16 else 4
    rows = (
        docs.select(F.col(doc_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
        .repartitionByRange("d")
        .sortWithinPartitions("d", "t")
        .mapInArrow(_writer(folder, path, end_id, width, shard_tokens), MANIFEST)
    )
    # Ranges are in the order of the partitions, and a task's shards in theirs.
    return manifest(spark, folder, sorted(rows.collect(), key=lambda r: (r.part, r.shard)))


def manifest(spark: SparkSession, folder: str, rows: list) -> DataFrame:
    base, out = 0, []
    for r in rows:
        out.append((folder, r.path, base, r.n_docs, r.n_tokens, r.width))
        base += r.n_tokens
    schema = "folder string, path string, base long, n_docs long, n_tokens long, width int"
    return spark.createDataFrame(out, schema)


def open_array(folder: str, path: str, dtype: str):
    """A file as an array: mapped where the folder is local, else a reader of ranges."""
    filesystem, _ = pafs.FileSystem.from_uri(folder)
    if isinstance(filesystem, pafs.LocalFileSystem):
        size = filesystem.get_file_info(path).size
        return np.memmap(path, dtype=dtype, mode="r") if size else np.zeros(0, dtype)
    return _Ranges(filesystem.open_input_file(path), np.dtype(dtype))


class _Ranges:
    def __init__(self, file, dtype: np.dtype):
        self.file, self.dtype = file, dtype

    def __len__(self) -> int:
        return self.file.size() // self.dtype.itemsize

    def __getitem__(self, s: slice) -> np.ndarray:
        i, j, _ = s.indices(len(self))
        return np.frombuffer(self.file.read_at((j - i) * self.dtype.itemsize, i * self.dtype.itemsize), self.dtype)


def _reader(batches: Iterator[pa.RecordBatch], payload: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            off = np.asarray(open_array(r["folder"], r["path"] + ".off", "<i8")[:])
            docs = np.asarray(open_array(r["folder"], r["path"] + ".doc", "<i8")[:])
            ids = open_array(r["folder"], r["path"] + ".ids", f"<u{r['width']}")
            i = 0
            while i < len(docs):
                j = max(i + 1, int(np.searchsorted(off, off[i] + READ_TOKENS, side="right")) - 1)
                j = min(j, len(docs))
                flat = np.asarray(ids[int(off[i]) : int(off[j])]).astype("<u4")
                raw, at = flat.tobytes(), (off[i : j + 1] - off[i]) * 4
                parts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                cols = [
                    pa.array(docs[i:j], pa.int64(), mask=docs[i:j] == NO_DOC),
                    pa.array(r["base"] + off[i:j], pa.int64()),
                    pa.array(np.diff(off[i : j + 1]), pa.int64()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()) if payload == "crc" else pa.array(parts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32" if payload == "crc" else "ids"])
                i = j


def read_token_files(manifest: DataFrame, *, digest: bool = False) -> DataFrame:
    """Each document read back from the files: ``doc_id, start, n_tokens`` and ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers; with ``digest`` their
    CRC-32 stands instead of them, as ``ids_crc32``.
    """
    payload = "crc" if digest else "ids"
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary")
    n = max(1, manifest.count())
    return manifest.repartition(n, "path").mapInArrow(lambda it: _reader(it, payload), schema)
