"""Token alignment between two tokenizers: minimal groups, links, counts of linked id pairs.

Tokenizer A is a byte-level BPE (``tokenizers``), B a BPE of pieces with byte fallback
(``sentencepiece``). Both cover the bytes of a space and the text. A token of A and one of B
are linked where their byte ranges overlap; the connected components of this bipartite graph are the
minimal groups, and a union-find over it finds them. A component's links are expanded from its members.

Neither tokenizer joins what lies on both sides of a single space between two other
characters: A splits before such a space, and no piece of B holds a space after another character
(checked when the vocabulary is read; if one did, texts would not be cut). Where A splits words as
GPT-2 does and no piece of B holds a Latin letter before a mark or any line feed, texts are also cut between
such a letter and an ASCII mark and before a line feed between two visible characters: words are
units then, whatever follows them. Each distinct unit is encoded, aligned and expanded once while it stays in a
worker's cache, and the rest is gathering. A full cache keeps the units that were met again.

Counts of pairs are added up in blocks of documents first. A block keeps its documents
as numbers of its own units, and its distinct pairs with their counts; only pairs
are shuffled to be added, and the sums go back to the blocks that have them. A pair that is everywhere is one
row a block. Blocks are written to the shared folder before they are counted.

Defined cases: a text that is null, empty, or whose bytes a tokenizer does not give back (B
takes U+2581 for a space) has no tokens: all numbers are 0 and the digest is empty; null ids and
repeated rows are kept, each a row; strings of special tokens are ordinary text; an empty
table gives no rows; columns besides the two named are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .subwords import tokenizer_path
from .textbuf import cache, chunks, ragged, release, utf8

#: Bytes of text in a block, but for a longer document.
BLOCK_BYTES = 8 << 20
#: Distinct units, and bytes of them, that a worker keeps.
CACHE_UNITS = 400_000
CACHE_BYTES = 32 << 20
#: Longer units are encoded each time.
KEPT_UNIT = 64
#: A single space between two characters that are neither white space nor U+2581.
CUT = re.compile(r"(?<=[^\s▁])(?= [^\s▁])")
#: First bytes of characters among which white space and U+2581 are, besides ASCII.
_LEADS2, _LEADS3 = 0xC2, (0xE1, 0xE2, 0xE3)
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: Letters of ASCII, and first bytes of U+00C0 to U+017F, letters but for two; marks of ASCII; bytes of what is surely visible, its first and its last.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LATIN, _NOT_LATIN = np.zeros(256, bool), (0x97, 0xB7)
_LATIN[[0xC3, 0xC4, 0xC5]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LETTER_MARK = re.compile(r"[A-Za-zÀ-ÖØ-öø-ſ][!-/:-@\[-`{-~]")
#: Units that are encoded in one call, as the text that they make.
TOGETHER = 500
BLOCK = (
    "block long, doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, groups_sha256 array<string>, "
    "units binary, n_units array<int>, unit_pairs binary, n_unit_pairs array<int>, pair_a array<int>, pair_b array<int>, pair_n array<long>"
)
SCALARS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Union-find over edges ``u - v`` of ``n`` nodes: each node's root, the least node of its component.

    All edges hook at once: the larger root of an edge goes under the smaller one, then
    every node is pointed at its root by halving paths; this repeats until no edge joins two roots.
    """
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j) of two sequences of tokens over the same bytes, and each link's group from 0.

    ``ends`` are where tokens end, ascending, over any number of texts laid end to end.
    """
    ends = np.union1d(ends_a, ends_b)
    # Bytes between two neighbouring ends lie in one token of each side: every such stretch is one overlapping pair.
    i, j = np.searchsorted(ends_a, ends, side="left"), np.searchsorted(ends_b, ends, side="left")
    root = components(i, len(ends_a) + j, len(ends_a) + len(ends_b))[i]
    _, group = np.unique(root, return_inverse=True)
    return i, j, group


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cut(data: np.ndarray, fine: bool) -> np.ndarray:
    """Where units begin in the bytes of even texts, each behind its space: at spaces and, if ``fine``, at marks and line feeds (see above)."""
    begins = data == 0x20
    if fine and len(data):
        latin = np.zeros(len(data), bool)  # last bytes of such letters
        latin[1:] = _LATIN[data[:-1]] & (data[1:] >= 0x80) & ~((data[:-1] == 0xC3) & np.isin(data[1:], _NOT_LATIN))
        begins[1:] |= (_LETTER[data[:-1]] | latin[:-1]) & _MARK[data[1:]]
        feed = np.flatnonzero(data[1:-1] == 0x0A) + 1
        feed = feed[(_VISIBLE[data[feed - 1]] | latin[feed - 1]) & (_VISIBLE[data[feed + 1]] | _LATIN[data[feed + 1]])]
        begins[feed] = True
    return np.flatnonzero(begins)


def uneven(texts: pa.Array) -> np.ndarray:
    """Which texts have a space at an end or beside what may be white space or U+2581; in others each space is a cut."""
    data, offsets = utf8(texts)
    size = len(data)
    at = np.flatnonzero(data == 0x20)
    byte = lambda i: np.where((i >= 0) & (i < size), data[np.clip(i, 0, max(size - 1, 0))], 0x20)
    after, before = byte(at + 1), byte(at - 1)
    odd = _WHITE[after] | _WHITE[before] | np.isin(after, (_LEADS2, *_LEADS3)) | (byte(at - 2) == _LEADS2) | np.isin(byte(at - 3), _LEADS3)
    row = np.searchsorted(offsets, at, side="right") - 1
    odd |= (at == offsets[row]) | (at + 1 == offsets[row + 1])
    out = np.zeros(len(texts), bool)
    out[row[odd]] = True
    return out


def odd(unit: str) -> bool:
    """Whether what stands beside a unit could change its tokens: it ends, or begins behind its space or line feed, with white space or U+2581."""
    begin = unit[1:2] if unit[0] in " \n" else unit[0]
    return not begin or begin == "▁" or unit[-1] == "▁" or begin.isspace() or unit[-1].isspace()


class Aligner:
    """Encodes and aligns the distinct units of texts."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        # GPT-2's split has words of letters alone, so one ends before a mark, and white space between visible characters stands alone.
        rules = json.loads(self.a.to_str())
        split = rules["pre_tokenizer"] or {}
        self.fine = self.cuts and rules["normalizer"] is None and all(t["special"] for t in rules["added_tokens"]) and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        named = lambda i: self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i)
        self.fine &= not any("\n" in p or _LETTER_MARK.search(p) for i, p in enumerate(pieces) if not named(i))
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        #: How often each unit was met.
        self.met = np.zeros(1024, np.int64)
        self.bytes = 0
        self.texts: list[str] = []
        #: Of each unit: tokens of A and B, groups, links; -1 links where bytes are not given back.
        self.sizes = np.zeros((1024, 4), np.int64)
        #: Pairs (id of A, id of B) of all links, one unit after the other.
        self.pairs = np.zeros((4096, 2), np.int32)
        self.first = np.zeros(1025, np.int64)

    def units(self, text: str) -> list[str]:
        """Units of a text, each with the space that it begins with."""
        return CUT.split(" " + text) if self.cuts else [" " + text]

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B of a text that begins with a space."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(a, np.int32), np.array(self.b.encode(text[1:], num_threads=1), np.int32)

    def encode(self, units: list[str]) -> tuple[list[np.ndarray], ...]:
        """Of one unit or some that are not ``odd``: whether both sides give the bytes back; ids of A and of B laid end to end, and how many each unit has."""
        raw = [u.encode() for u in units]
        joins = np.fromiter((u[0] in " \n" for u in units), bool, len(units))
        good = np.ones(len(units), bool)
        # Units, one after the other, make a text whose units they are: it begins with " a", and a unit that begins
        # with neither space nor line feed stands behind a line feed. What was added is a token of its own, and goes.
        if len(units) > 1 or units[0][0] != " ":
            text = " a" + "".join(u if j else "\n" + u for u, j in zip(units, joins))
            own = text.encode()
            lengths = np.insert(np.fromiter(map(len, raw), np.int64, len(raw)), np.flatnonzero(~joins), 1)
            place = np.arange(len(units)) + np.cumsum(~joins)  # of units among the parts, without the first
            ends = np.cumsum(np.r_[2, lengths])
            flat, counts, whole = [], [], True
            for ids, table, width in zip(self.ids(text), (self.bytes_a, self.bytes_b), (self.len_a, self.len_b)):
                until = np.cumsum(width[ids])
                after = np.searchsorted(until, ends, side="right")
                whole &= b"".join(map(table.__getitem__, ids.tolist())) == own and bool((np.r_[0, until][after] == ends).all())
                n = np.diff(after, prepend=0)
                keep = np.zeros(len(n), bool)
                keep[place + 1] = True
                flat.append(ids[np.repeat(keep, n)] if whole else ids)
                counts.append(n[keep])
            if whole:
                return good, *flat, *counts
        if len(units) > 1:
            half = len(units) // 2
            return tuple(np.concatenate(x) for x in zip(self.encode(units[:half]), self.encode(units[half:])))
        ids_a, ids_b = self.ids(units[0])
        good = [units[0][0] == " ", *(b"".join(map(t.__getitem__, ids.tolist())) == raw[0] for t, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)))]
        ids_a, ids_b = (ids_a, ids_b) if all(good) else (ids_a[:0], ids_b[:0])
        return np.array([all(good)]), ids_a, ids_b, np.array([len(ids_a)]), np.array([len(ids_b)])

    def aligned(self, units: list[str]):
        """What ``encode`` gives, links between the ids and each link's group."""
        parts, k = [], 0
        alone = [*(k for k, u in enumerate(units) if not self.cuts or odd(u)), len(units)]
        for n in alone:  # one that is odd ends each run
            parts += [self.encode(units[i : min(i + TOGETHER, n)]) for i in range(k, n, TOGETHER)]
            parts += [self.encode(units[n : n + 1])] if n < len(units) else []
            k = n + 1
        good, a, b, n_a, n_b = (np.concatenate(x) for x in zip(*parts))
        return good, a, b, n_a, n_b, *align(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))

    def learn(self, units: list[str]) -> None:
        """Add units: their sizes, linked pairs and texts of groups."""
        good, a, b, n_a, n_b, i, j, group = self.aligned(units)
        unit = np.repeat(np.arange(len(units)), n_a)[i]
        n_links = np.bincount(unit, minlength=len(units))
        begins = np.flatnonzero(np.diff(group, prepend=-1))
        n_groups = np.bincount(unit[begins], minlength=len(units))
        at = len(self.texts)
        while at + len(units) > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
            self.first = np.concatenate([self.first, np.zeros(len(self.first) - 1, np.int64)])
        used = int(self.first[at])
        while used + len(i) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.pairs[used : used + len(i), 0], self.pairs[used : used + len(i), 1] = a[i], b[j]
        self.sizes[at : at + len(units)] = np.stack([n_a, n_b, n_groups, np.where(good, n_links, -1)], axis=1)
        self.first[at + 1 : at + len(units) + 1] = used + np.cumsum(n_links)
        # A group's tokens are consecutive on either side, from those of its first link to those of its last.
        last = np.append(begins[1:], len(i)) - 1 if len(begins) else begins
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        spans = zip(i[begins].tolist(), i[last].tolist(), j[begins].tolist(), j[last].tolist())
        groups = [f"{names_a[p]}|{names_b[r]}" if p == q and r == s else f"{','.join(names_a[p : q + 1])}|{','.join(names_b[r : s + 1])}" for p, q, r, s in spans]
        ends = np.cumsum(n_groups).tolist()
        texts = [";".join(groups[p:q]) for p, q in zip([0, *ends], ends)]
        self.known.update(zip(units, range(at, at + len(units))))
        self.texts += texts
        self.bytes += sum(map(len, units)) + sum(map(len, texts))

    @property
    def full(self) -> bool:
        return len(self.texts) > CACHE_UNITS or self.bytes > CACHE_BYTES

    def shrink(self) -> None:
        """Keep the units that were met most, and more than once: half of what a full cache holds, at most."""
        names, at = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        size = np.fromiter((len(u) + len(self.texts[k]) for u, k in self.known.items()), np.int64, len(at))
        order = np.argsort(-self.met[at], kind="stable")[: CACHE_UNITS // 2]
        order = order[(np.cumsum(size[order]) <= CACHE_BYTES // 2) & (self.met[at[order]] > 1)]
        own, n_pairs = at[order], self.first[at[order] + 1] - self.first[at[order]]
        old_texts, sizes, met, pairs = self.texts, self.sizes[own], self.met[own] // 2, self.pairs[ragged(self.first[own], n_pairs)]
        self.reset()
        self.texts, self.bytes = [old_texts[k] for k in own.tolist()], int(size[order].sum())
        self.known = {names[k]: i for i, k in enumerate(order.tolist())}
        spare = lambda x, n: np.concatenate([x, np.zeros((n, *x.shape[1:]), x.dtype)])
        self.sizes, self.met, self.pairs = spare(sizes, 1024), spare(met, 1024), spare(pairs, 4096)
        self.first = spare(np.concatenate([[0], np.cumsum(n_pairs)]), 1024)

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts, and how many each text has."""
        apart = uneven(texts) if self.cuts else np.ones(len(texts), bool)
        whole = pc.if_else(pa.array(apart), "", texts) if apart.any() else texts
        data, offsets = utf8(pc.binary_join_element_wise("", whole, " "))
        begins = cut(data, self.fine)
        counts = np.diff(np.searchsorted(begins, offsets))
        ends = pa.py_buffer(np.append(begins, len(data)))
        words = pa.LargeStringArray.from_buffers(len(begins), ends, pa.py_buffer(data)).dictionary_encode()
        names, place = words.dictionary.to_pylist(), words.indices.to_numpy()
        rest = np.flatnonzero(apart)
        split = [self.units(t) for t in texts.take(pa.array(rest)).to_pylist()]
        known = self.known
        of_name = np.fromiter(map(known.get, names, itertools.repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(of_name < 0)
        of_name[fresh] = len(self.texts) + np.arange(len(fresh))  # as they are learnt
        new = [names[k] for k in fresh.tolist()]
        own = set(new)
        new += [u for u in dict.fromkeys(u for us in split for u in us) if u not in known and u not in own]
        for k in range(0, len(new), 20_000):
            self.learn(new[k : k + 20_000])
        at = of_name[place]
        if len(rest):
            parts = np.split(at, np.cumsum(counts)[:-1])
            for r, us in zip(rest.tolist(), split):
                parts[r] = np.fromiter(map(known.__getitem__, us), np.int64, len(us))
                counts[r] = len(us)
            at = np.concatenate(parts)
        self.met[: len(self.texts)] += np.bincount(at, minlength=len(self.texts))
        for u in new:  # long ones are not asked for again
            if len(u) > KEPT_UNIT:
                del known[u]
        return at, counts

_aligners: dict[tuple[str, str], Aligner] = cache("aligner")


def aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker."""
    release("aligner")
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of ``values``."""
    running = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return running[ends] - running[ends - counts]


class _Block:
    """Documents of one block, met so far."""

    def __init__(self, own: Aligner):
        self.own, self.docs, self.parts, self.counts, self.scalars, self.digests, self.bytes = own, [], [], [], [], [], 0

    def add(self, docs: pa.Array, texts: pa.Array) -> None:
        at, counts = self.own.numbers(texts)
        sizes = self.own.sizes[at]
        length = pc.binary_length(texts).to_numpy().astype(np.int64)
        whole = (_sums((sizes[:, 3] < 0).astype(np.int64), counts) == 0) & (length > 0)
        if not whole.all():
            keep = np.repeat(whole, counts)
            at, counts, sizes = at[keep], np.where(whole, counts, 0), sizes[keep]
        self.scalars.append(np.stack([_sums(sizes[:, k], counts) for k in range(4)], axis=1))
        names, ends = self.own.texts, np.cumsum(counts).tolist()
        texts_of = list(map(names.__getitem__, at.tolist()))
        for p, q in zip([0, *ends], ends):
            self.digests.append(hashlib.sha256(";".join(texts_of[p:q]).encode()).hexdigest() if q > p else "")
        self.docs.append(docs)
        self.parts.append(at.astype(np.uint32))
        self.counts.append(counts)
        self.bytes += int(length.sum())

    def row(self, number: int) -> pa.RecordBatch:
        units, counts = np.concatenate(self.parts), np.concatenate(self.counts)
        scalars = np.concatenate(self.scalars)
        often = np.bincount(units, minlength=1)
        used = np.flatnonzero(often)
        number_of = np.cumsum(often > 0) - 1
        inverse, often = number_of[units], often[used]
        n_pairs = self.own.first[used + 1] - self.own.first[used]
        pairs = self.own.pairs[ragged(self.own.first[used], n_pairs)].astype(np.int64)
        code, place = np.unique(pairs[:, 0] << 32 | pairs[:, 1], return_inverse=True)
        n = np.bincount(place, np.repeat(often, n_pairs), minlength=len(code)).astype(np.int64)
        one = lambda x, t: pa.array([x], pa.list_(t))
        cols = [
            pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.concat_arrays(self.docs)), *(one(scalars[:, k].astype(np.int32), pa.int32()) for k in range(4)), one(self.digests, pa.string()),
            pa.array([inverse.astype("<u4").tobytes()], pa.binary()), one(counts.astype(np.int32), pa.int32()),
            pa.array([place.astype("<u4").tobytes()], pa.binary()), one(n_pairs.astype(np.int32), pa.int32()),
            one((code >> 32).astype(np.int32), pa.int32()), one((code & 0xFFFFFFFF).astype(np.int32), pa.int32()), one(n, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in BLOCK.split(", ")])


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    return a or tokenizer_path("byte_bpe_50k.json"), b or tokenizer_path("piece_bpe_32k.model")


def _blocks(path_a: str, path_b: str, block_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        number, block = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).fill_null("")
            _, offsets = utf8(texts)
            for i, j in chunks(offsets, 1 << 20):
                if block is None:
                    if own.full:
                        own.shrink()
                    block = _Block(own)
                block.add(docs.slice(i, j - i), texts.slice(i, j - i))
                if block.bytes >= block_bytes or own.full:
                    yield block.row(number)
                    number, block = number + 1, None
        if block is not None:
            yield block.row(number)

    return work


def align_blocks(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", tokenizer_a: str | None = None, tokenizer_b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of aligned documents, written to the shared folder; a row is some 10 MB, so each is a group of its file."""
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(_blocks(*_paths(tokenizer_a, tokenizer_b), block_bytes), BLOCK), "aligned-blocks", group_rows=1)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``a, b, count, best``: how many links of the corpus hold a pair of ids, and whether no pair has more with its ``b``."""
    rows = blocks.select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p")).select("p.*")
    counts = rows.groupBy(F.col("pair_a").alias("a"), F.col("pair_b").alias("b")).agg(F.sum("pair_n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            value = lambda name: batch.column(name)[k]
            array = lambda name: value(name).values.to_numpy(zero_copy_only=False).astype(np.int64)
            size = value("pairs").as_py()
            count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
            if size:
                place = array("place")
                count[place], best[place] = array("count_of"), array("best_of")
            pair, n_pairs = np.frombuffer(value("unit_pairs").as_py(), "<u4"), array("n_unit_pairs")
            unit, n_units = np.frombuffer(value("units").as_py(), "<u4"), array("n_units")
            of_doc = lambda x: pa.array(_sums(_sums(x[pair], n_pairs)[unit], n_units))
            scalars = [value(name).values for name in SCALARS]
            scalars = [x.cast(pa.int64()) if pa.types.is_integer(x.type) else x for x in scalars]
            yield pa.RecordBatch.from_arrays([*scalars, of_doc(best), of_doc(count)], names=[*SCALARS, "n_best", "count_sum"])


def digest(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", tokenizer_a: str | None = None, tokenizer_b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document its numbers of tokens, groups and links, the digest of its groups, and how common its links are."""
    blocks = align_blocks(docs, doc_col=doc_col, text_col=text_col, tokenizer_a=tokenizer_a, tokenizer_b=tokenizer_b, block_bytes=block_bytes)
    counts = materialise(pair_counts(blocks), "pair-counts")
    own = blocks.select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("place", "p")).select("block", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"))
    told = own.join(counts, ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("told"))
    told = told.select("block", F.col("told.place").alias("place"), F.col("told.count").alias("count_of"), F.col("told.best").alias("best_of"))
    rows = blocks.withColumn("pairs", F.size("pair_a")).drop("pair_a", "pair_b", "pair_n").join(told, "block", "left").drop("block")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.mapInArrow(_documents, schema)


GROUPS = "doc_id long, number long, ids_a array<int>, ids_b array<int>, start long, end long"


def groups(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """One row a minimal group: its ids on both sides and its bytes in a space and the text, in order from 0."""
    path_a, path_b = _paths(tokenizer_a, tokenizer_b)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                units = own.units(text)
                good, a, b, _, _, i, j, group = own.aligned(units)
                if not good.all():
                    continue
                begins = np.flatnonzero(np.diff(group, prepend=-1))
                ends = np.append(begins[1:], len(i))
                stop = np.cumsum(own.len_a[a])[i[ends - 1]]
                slices = lambda ids, k: pa.array([ids[k[p] : k[q - 1] + 1] for p, q in zip(begins, ends)], pa.list_(pa.int32()))
                n = len(begins)
                cols = [pa.array([doc] * n, pa.int64()), pa.array(np.arange(n)), slices(a, i), slices(b, j), pa.array(np.concatenate([[0], stop[:-1]])), pa.array(stop)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "number", "ids_a", "ids_b", "start", "end"])

    return docs.select(F.col(doc_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInArrow(work, GROUPS)
