"""Benchmark decontamination with an FM-index for each training shard.

Words are runs of ASCII letters (folded to lower case), digits and non-ASCII
characters. A test phrase ("window") is ``window`` consecutive words of a
benchmark item, or the whole item if it has fewer words.

A shard is some megabytes of document text. Its alphabet is the words of the
benchmark; every other word, and every end of a document, is a terminator, since
no phrase can hold one. Runs between terminators that are shorter than the
shortest phrase can hold none either and are left out. Over this text the shard
gets a suffix array (prefix doubling on the suffixes that are still tied), its
Burrows-Wheeler transform, and a wavelet tree of it laid out as a matrix of
bits. All phrases are searched backwards at once, a phrase leaving as soon as
its range is empty. Occurrences are located by LF steps to a sampled suffix:
every SAMPLE-th place and every run's begin. Removal spans are the union of the
words covered by occurrences.

The benchmark is a query set: it is read in blocks of at most ``block_items`` items,
about ``block_bytes`` of text and ``block_words`` words, of which the driver holds one at a
time. A block's phrases are broadcast, some 20 bytes a word, and make one pass over the
documents. With several blocks, all search the original
texts; what they find is written (texts with hits only), merged by the text's two hashes,
and given to each row with that text, so the number of blocks changes no result. No
document is shuffled for a single block.

Defined cases: null or empty texts have no words and no hit; items without
words, or with a null id, are left out; repeated items count once by id; documents' rows
that repeat give a row each; further columns are ignored (``find``) or kept
(``remove``), whatever their names; an empty benchmark hits nothing. A text is searched whole
in one task, with about 60 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .textbuf import ALNUM_WORDS, chunks, ragged, release, utf8, word_hashes

SAMPLE = 8
SHARD_BYTES = 1 << 20
BLOCK_ITEMS = 50_000
BLOCK_BYTES = 32 << 20
BLOCK_WORDS = 5_000_000
SLICE = 1 << 17


class Phrases:
    """Distinct phrases of a block of items as places in its text of symbols (1 and up), and the items that hold each.

    A word costs some 20 bytes, whatever the window's width. Windows are sorted by a hash and
    compared word for word with the one before, so none is taken for another; should two of one
    hash be mixed up in the order, a phrase is listed twice, which changes no result.
    """

    FILTER_BITS = 22

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        items = sorted(items, key=lambda x: x[0])
        self.ids = np.array([i for i, _ in items], np.int64)
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        parts, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in chunks(offsets, SHARD_BYTES):
            h, _, _, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM_WORDS)
            parts.append(h)
            n.append(np.diff(first))
        n = np.concatenate(n)
        h = np.concatenate(parts)
        del parts, data, offsets
        self.vocabulary = np.unique(h)
        self.text = np.empty(len(h), np.int32)
        for i in range(0, len(h), SLICE):
            self.text[i : i + SLICE] = np.searchsorted(self.vocabulary, h[i : i + SLICE]) + 1
        del h
        k = np.where(n >= window, n - window + 1, (n > 0).astype(np.int64))
        item = np.repeat(np.arange(len(n), dtype=np.int32), k)
        length = np.minimum(window, n).astype(np.min_scalar_type(-window - 1))[item]
        ends = (ragged(np.cumsum(n) - n, k) + (length - 1)).astype(np.int32)
        key = np.empty(len(ends), np.uint64)
        for i in range(0, len(ends), SLICE):
            key[i : i + SLICE] = self._hashes(ends[i : i + SLICE], length[i : i + SLICE])
        order = np.argsort(key, kind="stable")  # the items of one phrase stay in the order of their ids
        ends, length, item = ends[order], length[order], item[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        del key, order
        same = np.flatnonzero(~fresh)
        for i in range(0, len(same), SLICE):
            at = same[i : i + SLICE]
            fresh[at] = (self._symbols(ends[at], length[at]) != self._symbols(ends[at - 1], length[at - 1])).any(axis=1)
        pair = fresh.copy()
        pair[1:] |= self.ids[item[1:]] != self.ids[item[:-1]]
        self.ends, self.lengths = ends[fresh], length[fresh]
        self.item_of = item[pair]
        self.item_at = np.append(np.flatnonzero(fresh[pair]), len(self.item_of)).astype(np.int32)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        self._filter = None

    def __len__(self) -> int:
        return len(self.ends)

    def _symbols(self, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A row of symbols for each window, aligned at the right, zeros before."""
        back = np.arange(self.window - 1, -1, -1)
        rows = self.text[np.maximum(ends[:, None] - back, 0)]
        rows[back >= lengths[:, None]] = 0
        return rows

    def _hashes(self, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        rows = self._symbols(ends, lengths)
        out = np.zeros(len(rows), np.uint64)
        for j in range(self.window):
            out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(rows[:, j] > 0, self.vocabulary[rows[:, j] - 1], np.uint64(0))
        return out

    def rows(self, i: int, j: int) -> np.ndarray:
        """The phrases from ``i`` to ``j``."""
        return self._symbols(self.ends[i:j], self.lengths[i:j])

    def items(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many items hold each phrase, and their ids one after the other."""
        k = (self.item_at[who + 1] - self.item_at[who]).astype(np.int64)
        return k, self.ids[self.item_of[ragged(self.item_at[who].astype(np.int64), k)]]

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """A symbol for each word hash, 0 for words that no item has."""
        mask = np.uint64((1 << self.FILTER_BITS) - 1)
        if self._filter is None:  # made where it is used
            self._filter = np.zeros(1 << self.FILTER_BITS, bool)
            self._filter[(self.vocabulary & mask).astype(np.int64)] = True
        out = np.zeros(len(h), np.int64)
        may = np.flatnonzero(self._filter[(h & mask).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, h[may])
        at[at == len(self.vocabulary)] = 0
        same = self.vocabulary[at] == h[may]
        out[may[same]] = at[same] + 1
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes; each 0 is a terminator of its own, the earlier the smaller."""
    n = len(text)
    ends = text == 0
    key = text + int(ends.sum())
    key[ends] = np.arange(int(ends.sum()))
    order = np.argsort(key, kind="stable")
    rank, tied = _ranks(key[order], order, np.empty(n, np.int64))
    step = 1
    while len(tied):
        # A tied suffix has no terminator among its first ``step`` symbols, so the next part exists.
        at = order[tied]
        first, second = rank[at], rank[at + step]
        sub = np.lexsort((second, first))
        at, first, second = at[sub], first[sub], second[sub]
        order[tied] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        head = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[at] = head
        alone = fresh & np.r_[fresh[1:], True]
        tied = tied[~alone]
        step *= 2
    return order


def _ranks(sorted_key: np.ndarray, order: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fresh = np.ones(len(order), bool)
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    alone = fresh & np.r_[fresh[1:], True]
    return rank, np.flatnonzero(~alone)


class WaveletMatrix:
    """Ranks of symbols: a wavelet tree whose levels are stored one after the other."""

    def __init__(self, text: np.ndarray, top: int):
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (text >> bit) & 1
            before = np.zeros(len(text) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(text) - int(before[-1])
            self.levels.append((bit, before, zeros))
            text = np.concatenate([text[ones == 0], text[ones == 1]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before ``lo`` and before ``hi``."""
        base = np.zeros_like(lo)
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            lo, hi, base = (np.where(one, zeros + before[x], x - before[x]) for x in (lo, hi, base))
        return lo - base, hi - base


class FMIndex:
    def __init__(self, text: np.ndarray, top: int):
        self.order = suffix_array(text)
        self.bwt = text[self.order - 1]  # the first place's predecessor is the last symbol, a terminator
        self.tree = WaveletMatrix(self.bwt, top)
        self.before = np.searchsorted(np.sort(text), np.arange(top + 2))
        begin = np.r_[True, text[:-1] == 0]
        sampled = begin | (np.arange(len(text)) % SAMPLE == 0)
        self.sampled = sampled[self.order]
        self.places = np.cumsum(self.sampled) - 1
        self.sample = self.order[self.sampled]
        del self.order

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, range begin, range end) of the phrases that occur."""
        who = np.arange(len(rows))
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.bwt), np.int64)
        for j in range(rows.shape[1] - 1, -1, -1):
            symbol = rows[who, j]
            more = symbol > 0
            if more.any():
                below, above = self.tree.rank(symbol[more], lo[more], hi[more])
                lo[more], hi[more] = self.before[symbol[more]] + below, self.before[symbol[more]] + above
            live = hi > lo
            who, lo, hi = who[live], lo[live], hi[live]
            if not len(who):
                break
        return who, lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Places in the text of these rows of the suffix array."""
        at, steps = at.copy(), np.zeros(len(at), np.int64)
        far = np.flatnonzero(~self.sampled[at])
        while len(far):
            symbol = self.bwt[at[far]]
            below, _ = self.tree.rank(symbol, at[far], at[far])
            at[far] = self.before[symbol] + below
            steps[far] += 1
            far = far[~self.sampled[at[far]]]
        return self.sample[self.places[at]] + steps


def search_shard(phrases: Phrases, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every occurrence among the words of a shard's rows."""
    none = np.zeros(0, np.int64)
    symbol = phrases.symbols(h)
    inside = symbol > 0
    if not len(phrases) or not inside.any():
        return none, none
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[first[:-1][first[:-1] < len(h)]] = True
    begin &= inside
    start = np.flatnonzero(begin)
    outside = np.append(np.flatnonzero(~inside), len(h))
    stop = np.minimum(np.r_[start[1:], len(h)], outside[np.searchsorted(outside, start)])
    long = stop - start >= phrases.shortest
    start, length = start[long], (stop - start)[long]
    if not len(start):
        return none, none
    words = ragged(start, length + 1)  # one more for the terminator
    text = np.zeros(len(words), np.int64)
    ends = np.cumsum(length + 1) - 1
    keep = np.ones(len(words), bool)
    keep[ends] = False
    text[keep] = symbol[words[keep]]
    index = FMIndex(text, len(phrases.vocabulary))
    found, places = [none], [none]
    for i in range(0, len(phrases), SLICE):
        who, lo, hi = index.search(phrases.rows(i, i + SLICE))
        found.append(np.repeat(who + i, hi - lo))
        places.append(index.locate(ragged(lo, hi - lo)))
    return np.concatenate(found), words[np.concatenate(places)]


def _sent(docs: DataFrame, block: list[tuple[int, str]], window: int) -> Broadcast:
    """The phrases of a block, whose size has a bound; a worker unpacks them once, not once a task."""
    return docs.sparkSession.sparkContext.broadcast(Phrases(block, window))


def _finder(sent: Broadcast, shard_bytes: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        phrases = sent.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets, shard_bytes):
                part = data[offsets[i] : offsets[j]]
                h, lo, hi, first = word_hashes(part, offsets[i : j + 1] - offsets[i], ALNUM_WORDS)
                who, word = search_shard(phrases, h, first)
                yield _rows(batch.column(0).slice(i, j - i), phrases, part, offsets[i : j + 1] - offsets[i], lo, hi, first, who, word)

    return find


def _rows(doc, phrases, data, offsets, lo, hi, first, who, word) -> pa.RecordBatch:
    n = len(doc)
    edge = np.zeros(len(lo) + 1, np.int64)
    np.add.at(edge, word, 1)
    np.add.at(edge, word + phrases.lengths[who], -1)
    hit = np.cumsum(edge[:-1]) > 0
    hits = np.concatenate([[0], np.cumsum(hit)])
    row = np.searchsorted(first, word, side="right") - 1
    pair = np.unique(row * len(phrases) + who)
    row, who = pair // max(1, len(phrases)), pair % max(1, len(phrases))
    k, ids = phrases.items(who)
    both = np.unique(np.stack([np.repeat(row, k), ids], 1), axis=0)
    items = pa.ListArray.from_arrays(pa.array(np.searchsorted(both[:, 0], np.arange(n + 1)).astype(np.int32)), pa.array(both[:, 1], pa.int64()))
    begin = np.flatnonzero(hit & ~np.r_[False, hit[:-1]] | hit & np.isin(np.arange(len(hit)), first))
    last = np.flatnonzero(hit & ~np.r_[hit[1:], False] | hit & np.isin(np.arange(len(hit)) + 1, first))
    owner = np.searchsorted(first, begin, side="right") - 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(begin) else np.zeros(1, np.int64)
    at = chars[offsets[owner]] if len(begin) else owner
    spans = pa.StructArray.from_arrays([pa.array(chars[lo[begin]] - at, pa.int64()), pa.array(chars[hi[last]] - at, pa.int64()), pa.array(begin - first[owner], pa.int64()), pa.array(last + 1 - first[owner], pa.int64())], names=["start", "end", "first_word", "end_word"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([doc, pa.array(np.diff(first), pa.int64()), pa.array(hits[first[1:]] - hits[first[:-1]], pa.int64()), items, spans], names=["key", "n_words", "n_hit", "items", "spans"])


FOUND = "n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long,first_word:long,end_word:long>>"


#: Words, before letters are folded.
A_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, items: int, size: int, words: int) -> Iterator[list[tuple[int, str]]]:
    """Blocks of the benchmark; none is empty. Each keeps all three bounds, or is one item."""
    rows = benchmark.select(F.col(id_col).cast("long"), text_col, F.regexp_count(text_col, F.lit(A_WORD))).where(f"`{id_col}` is not null and `{text_col}` is not null").dropDuplicates()
    block: list[tuple[int, str]] = []
    held = held_words = 0
    for r in rows.toLocalIterator():  # a partition at a time
        if block and (len(block) >= items or held + len(r[1]) > size or held_words + r[2] > words):
            yield block
            block, held, held_words = [], 0, 0
        block.append((r[0], r[1]))
        held, held_words = held + len(r[1]), held_words + r[2]
    if block:
        yield block


#: A text, by its own hashes.
TEXT_KEY = "struct<h1:long,h2:string>"
MERGED = """aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<struct<start:long,end:long,first_word:long,end_word:long>>),
 (a, s) -> if(size(a) > 0 and element_at(a, -1).end_word >= s.first_word,
  concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end),
   'first_word', element_at(a, -1).first_word, 'end_word', greatest(element_at(a, -1).end_word, s.end_word)))),
  concat(a, array(s))))"""


def _text_key(text: str):
    return F.struct(F.xxhash64(text).alias("h1"), F.sha2(text, 256).alias("h2"))


def _of_blocks(docs: DataFrame, text_col: str, first: list, second: list, blocks: Iterator[list], window: int, shard_bytes: int) -> DataFrame:
    """``key, n_words, items, spans`` of every distinct text, from all blocks."""
    rows = docs.select(_text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    every = None
    for n, block in enumerate(itertools.chain([first, second], blocks)):
        sent = _sent(docs, block, window)
        part = rows.mapInArrow(_finder(sent, shard_bytes), f"key {TEXT_KEY}, {FOUND}")
        # Each text's words are counted once, with the first block; of the others only hits matter.
        part = part if n == 0 else part.where("n_hit > 0")
        part = materialise(part.dropDuplicates(["key"]), "hits")
        sent.unpersist()
        every = part if every is None else every.unionByName(part)
    return every.groupBy("key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.expr(MERGED).alias("spans"))


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans``: a row for each row of ``docs``.

    ``items`` are the ids of items with occurring phrases; ``spans`` are the
    merged removal spans, in code points (``start``, ``end``) and in words.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, block_items, block_bytes, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        kind = dict(docs.dtypes)[doc_col]
        found = docs.select(F.col(doc_col).alias("key"), F.col(text_col)).mapInArrow(_finder(_sent(docs, first, window), shard_bytes), f"key {kind}, {FOUND}")
        return found.withColumnRenamed("key", doc_col)
    out = _of_blocks(docs, text_col, first, second, blocks, window, shard_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end_word"] - s["first_word"])
    # A null text has a null second hash; it joins as equal to itself.
    rows = docs.select(F.col(doc_col).alias("id"), _text_key(text_col).alias("own"))
    both = rows.join(out, F.col("own").eqNullSafe(F.col("key")))
    return both.select(F.col("id").alias(doc_col), "n_words", n_hit.alias("n_hit"), "items", "spans")


def _replaced(batch: pa.RecordBatch, at: int, texts: dict[int, str]) -> pa.Array:
    column = batch.column(at)
    if not texts:
        return column
    values = column.to_pylist()
    for r, t in texts.items():
        values[r] = t
    return pa.array(values, column.type)


def _remover(sent: Broadcast, at: int, shard_bytes: int):
    """Cuts what occurs of the phrases."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            texts: dict[int, str] = {}
            for i, j in chunks(offsets, shard_bytes):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h, lo, hi, first = word_hashes(part, off, ALNUM_WORDS)
                who, word = search_shard(phrases, h, first)
                edge = np.zeros(len(part) + 1, np.int64)
                np.add.at(edge, lo[word], 1)
                np.add.at(edge, hi[word + phrases.lengths[who] - 1], -1)
                keep = np.cumsum(edge[:-1]) == 0
                for r in np.unique(np.searchsorted(first, word, side="right") - 1):
                    own = slice(off[r], off[r + 1])
                    texts[i + int(r)] = part[own][keep[own]].tobytes().decode()
            yield pa.RecordBatch.from_arrays([_replaced(batch, at, texts) if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return cut


def _span_remover(at: int):
    """Cuts the spans of the last column, which goes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = {}
            for r, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    t, end, parts = batch.column(at)[r].as_py(), 0, []
                    for s in spans:
                        parts.append(t[end : s["start"]])
                        end = s["end"]
                    texts[r] = "".join([*parts, t[end:]])
            yield pa.RecordBatch.from_arrays([_replaced(batch, at, texts) if k == at else c for k, c in enumerate(batch.columns[:-1])], names=batch.schema.names[:-1])

    return cut


def remove(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text_col: str = "text", length_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with the removal spans cut out of the texts; no row goes.

    What any block finds in the original text is cut, all at once. A single block's cuts
    are made where the text is read; with several, texts meet a table of those with hits.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no column's name clashes
    at = names.index(text_col)
    blocks = _blocks(benchmark, item_col, item_text_col, block_items, block_bytes, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        out = plain.mapInArrow(_remover(_sent(docs, first, window), at, shard_bytes), plain.schema) if first else plain
    else:
        hits = materialise(_of_blocks(plain, f"c{at}", first, second, blocks, window, shard_bytes).where("size(spans) > 0").select("key", "spans"), "cuts")
        out = plain.join(hits, _text_key(f"c{at}") == F.col("key"), "left").select(*plain.columns, "spans").mapInArrow(_span_remover(at), plain.schema)
    if length_col in names:
        length = f"c{names.index(length_col)}"
        out = out.withColumn(length, F.when(F.col(f"c{at}").isNull(), F.col(length)).otherwise(F.length(f"c{at}")).cast(docs.schema[length_col].dataType))
    return out.toDF(*names)


def digest(found: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """The columns of the contract from ``find``'s."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(doc_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
