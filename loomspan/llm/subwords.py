"""Token ids by a tokenizer file, with a cache of the pieces between spaces.

The tokenizer drops white space before it splits words, so a text's ids are
those of its pieces between spaces and line feeds, one after the other. Each
distinct piece is encoded by the ``tokenizers`` library once per worker while
it stays in a cache of bounded size; the rest is gathering in numpy.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textbuf import cache, chunks, ragged, release, utf8

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: The tokenizer always splits between a letter (here of Latin-1: lower-casing makes one letter of it) and one of these, so a space there changes nothing.
AFTER_LETTER = r"([a-zA-ZÀ-ÖØ-öø-ÿ])([.,;:!?#$%&*])"
#: Distinct pieces kept by a worker (about 250 bytes each).
CACHE_PIECES = 700_000


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


TO_SPACE = np.arange(256, dtype=np.uint8)
TO_SPACE[10] = 32
TO_LOWER = TO_SPACE.copy()
TO_LOWER[65:91] += 32


class Encoder:
    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit = cache_pieces
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.store = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 50_000):
            part = pieces[i : i + 50_000]
            ids = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for row in ids for x in row), np.uint32, int(lens.sum()))
            at = len(self.known)
            while self.used + len(flat) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            while at + len(part) > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
                self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.store[self.used : self.used + len(flat)] = flat
            self.start[at : at + len(part)] = self.used + np.cumsum(lens) - lens
            self.length[at : at + len(part)] = lens
            self.used += len(flat)
            self.known.update(zip(part, range(at, at + len(part))))

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids before each row and in all); null rows are empty."""
        data, offsets = utf8(arr)
        special = pc.any(pc.match_substring(arr, "<|")).as_py()  # matched before lower-casing
        data = (TO_SPACE if special else TO_LOWER)[data]
        arr = pa.LargeStringArray.from_buffers(len(arr), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data))
        lists = pc.split_pattern(pc.replace_substring_regex(arr, AFTER_LETTER, r"\1 \2"), " ")
        offsets = lists.offsets.to_numpy()
        pieces = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        offsets = offsets - offsets[0]
        names = pieces.dictionary.to_pylist()
        known = self.known
        new = [x for x in names if x not in known]
        if new:
            if len(known) + len(new) > self.limit:  # begun anew with all pieces of this part
                self._reset()
                known, new = self.known, names
            self._learn(new)
        place = np.fromiter((known[x] for x in names), np.int64, len(names))
        at = place[pieces.indices.to_numpy()]
        lens = self.length[at]
        ids = self.store[ragged(self.start[at], lens)]
        before = np.zeros(len(at) + 1, np.int64)
        np.cumsum(lens, out=before[1:])
        return ids, before[offsets]

    def batches(self, arr: pa.Array, limit: int = 4 << 20):
        """(first row, ids, offsets) of parts of a column of about ``limit`` bytes."""
        _, offsets = utf8(arr)
        for i, j in chunks(offsets, limit):
            ids, at = self.encode(arr.slice(i, j - i))
            yield i, ids, at


_encoders: dict[str, Encoder] = cache("encoder")


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    release("encoder")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
