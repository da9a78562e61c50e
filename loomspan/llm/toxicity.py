"""Toxicity by a lexicon, misspellings caught with Levenshtein automata.

The lexicon has three kinds of terms: a given list of abusive words, words
learned from labelled documents, and learned beginnings of words (``STEM``
letters). Learned terms are those whose share of toxic documents is too high to
be chance. Exact hits are looked up by hash. Misspelled hits are found with the
Levenshtein automata of all given and learned words of FUZZY_LETTERS and more, in
any script: the trie of these words is walked with each distinct word of a worker
(what a word is near to is kept for the next time), and a state of the walk is a
node, a place in the word, and the edits so far. One edit is a letter too many, too
few, another letter, or two letters in each other's place; digits that stand for
letters (LOOKS_LIKE) cost none. A near word that clean training documents use is no
misspelling, and a learned word with more near words in clean documents than
chance explains takes no misspellings.

Each hit is weighted by its term's log-odds and by its context window: a hit
inside quotation marks, or after a word of reporting, counts as quoted, and
quoted hits are features of their own. A logistic regression over the sums turns
a document's features into its score; it is trained on lexicons that were
learned without the documents in question (two folds).

Learning uses a sample of labelled rows of at most about ``max_train`` rows (a
documented bound; rows are chosen by a hash of the id), of which near copies count
once. Scoring reads every text whole.

Defined cases: null and empty texts get the score of a text without hits; if no
labelled row can be learned from, the given words alone decide; repeated rows
get a row each; rows with a null id are scored; ids may be of any type that has a
text; further columns are ignored; a text is scored whole in one task, with about 40
bytes of memory for each of its bytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .textbuf import ALNUM_WORDS, cache, chunks, mix, prefix_sums, range_hash, release, shingles, utf8, word_hashes

#: Abusive words that are known before any label is seen.
BASE_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting")
STEM = 5
#: Words that announce a quotation.
REPORTING = frozenset("said says say saying wrote writes written quoted quote quotes called word term dit écrit sagte schrieb dijo escribió".split())
WINDOW = 64  # bytes on either side of a hit
#: Shorter words have too many neighbours that are words of their own.
FUZZY_LETTERS = 5
#: Digits that are read as letters.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
#: Distinct words whose nearness a worker keeps.
KEPT_WORDS = 300_000
QUOTES = {"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‘": "'", "’": "'"}
COUNTS = "term string, stem boolean, half int, toxic int, n long"
FEATURES = "doc string, label int, half int, x array<double>"


def _folded(arr: pa.Array) -> pa.Array:
    """Lower case, with one kind of quotation marks, so that no mark sticks to a word."""
    out = []
    for t in arr.to_pylist():
        t = (t or "").lower()
        if not t.isascii():
            for a, b in QUOTES.items():
                t = t.replace(a, b)
        out.append(t)
    return pa.array(out, pa.large_string())


class Words:
    """The words of some rows: hashes, byte ranges, and their beginnings of STEM letters."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = utf8(_folded(texts))
        self.hash, self.start, self.end, self.first = word_hashes(self.data, self.offsets, ALNUM_WORDS)
        self.row = np.searchsorted(self.first, np.arange(len(self.hash)), side="right") - 1
        lead = np.flatnonzero((self.data & 0xC0) != 0x80) if len(self.data) else np.zeros(0, np.int64)
        at = np.searchsorted(lead, self.start)
        stem_end = np.append(lead, [len(self.data)] * (STEM + 1))[at + STEM]
        self.stems = np.flatnonzero(stem_end < self.end)
        self.stem_end = stem_end[self.stems]
        self.stem_hash = range_hash(prefix_sums(self.data), self.start[self.stems], self.stem_end) if len(self.data) else np.zeros(0, np.uint64)

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "ignore")


def word_hash(term: str) -> np.uint64:
    data, offsets = utf8(pa.array([term]))
    return range_hash(prefix_sums(data), np.zeros(1, np.int64), offsets[1:])[0]


# ---- automata


class Trie:
    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        for i, t in enumerate(terms):
            node = 0
            for ch in t:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.final.append(-1)
                node = self.children[node][ch]
            self.final[node] = i

    def nearest(self, word: str) -> int:
        """The term with the fewest edits from a word, 0 or 1; the earliest term of several; -1 for none."""
        children, final, n = self.children, self.final, len(word)
        best = (2, -1)
        todo, seen = [(0, 0, 0)], set()
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            node, i, e = state
            below = children[node]
            if i == n and final[node] >= 0:
                best = min(best, (e, final[node]))
            if i < n:
                ch = word[i]
                for c in (ch, *LOOKS_LIKE.get(ch, "")):
                    if c in below:
                        todo.append((below[c], i + 1, e))
            if e:
                continue
            for x in below.values():
                todo.append((x, i, 1))  # a letter is missing
                if i < n:
                    todo.append((x, i + 1, 1))  # another letter
            if i < n:
                todo.append((node, i + 1, 1))  # a letter too many
            if i + 1 < n and word[i + 1] in below and ch in children[below[word[i + 1]]]:
                todo.append((children[below[word[i + 1]]][ch], i + 2, 1))  # two letters have changed places
        return best[1]


#: What words (by hash) are near to, for each list of terms that a worker has met.
_near: dict[int, dict[int, int]] = cache("near")


class Fuzzy:
    """The nearest term of each word, of those within one edit of any."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.trie = Trie(terms)
        hashes = np.array([word_hash(t) for t in terms], np.uint64) + np.arange(len(terms), dtype=np.uint64)
        self.name = int(np.bitwise_xor.reduce(mix(hashes), initial=np.uint64(0)))
        self.lengths = (min(map(len, terms), default=0) - 1, max(map(len, terms), default=0) + 1)

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of the words within one edit of a term, equal ones too."""
        none = np.zeros(0, np.int64)
        if not self.terms or not len(words.hash):
            return none, none
        near = _near.setdefault(self.name, {})
        if len(near) > KEPT_WORDS:
            near.clear()
        lead = np.cumsum((words.data & 0xC0) != 0x80)
        length = lead[words.end - 1] - lead[words.start] + 1
        may = np.flatnonzero((length >= self.lengths[0]) & (length <= self.lengths[1]))
        distinct, first, at = np.unique(words.hash[may], return_index=True, return_inverse=True)
        term = np.full(len(distinct), -1, np.int64)
        for d, (h, w) in enumerate(zip(distinct.tolist(), may[first].tolist())):
            got = near.get(h)
            if got is None:
                got = near[h] = self.trie.nearest(words.text(words.start[w], words.end[w]))
            term[d] = got
        found = np.flatnonzero(term[at] >= 0)
        return may[found], term[at[found]]


# ---- lexicon


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    fuzzy: list[str] = field(default_factory=list)
    clean: set[str] = field(default_factory=set)

    def prepare(self) -> None:
        def table(terms: dict[str, float]):
            h = np.array([word_hash(t) for t in terms], np.uint64)
            w = np.array(list(terms.values()), float)
            order = np.argsort(h)
            return h[order], w[order]

        self.word_table, self.stem_table = table(self.words), table(self.stems)
        self.automaton = Fuzzy(self.fuzzy)
        self.fuzzy_weight = np.array([self.words.get(t, 0.0) for t in self.fuzzy])

    def sift(self, near: pd.DataFrame, terms: list[str]) -> None:
        """Set the terms that take misspellings, by the sample's near words: term, word, toxic, n."""
        seen = near[~near["word"].isin(self.words)]
        clean, toxic = (seen[seen["toxic"] == y].groupby("word")["n"].sum() for y in (0, 1))
        self.clean = {w for w, n in clean.items() if n > 0.5 * toxic.get(w, 0)}
        use = []
        for t in terms:
            own = seen[seen["term"] == t]
            c, x = own.loc[own["toxic"] == 0, "n"].sum(), own.loc[own["toxic"] == 1, "n"].sum()
            if t in BASE_TERMS or (t in self.words and c <= 0.2 * x):
                use.append(t)
        self.fuzzy = use
        self.prepare()


def learn(counts: pd.DataFrame, toxic: int, clean: int) -> Lexicon:
    """Terms whose documents are toxic too often to be chance, with log-odds."""
    base = math.log(8.0)
    lexicon = Lexicon({t: base for t in BASE_TERMS})
    if toxic and clean and len(counts):
        both = counts.groupby(["term", "stem", "toxic"], as_index=False)["n"].sum().pivot_table(index=["term", "stem"], columns="toxic", values="n", fill_value=0, aggfunc="sum")
        t = both[1].to_numpy(float) if 1 in both else np.zeros(len(both))
        c = both[0].to_numpy(float) if 0 in both else np.zeros(len(both))
        odds = np.log((t + 0.2) / (toxic + 0.4)) - np.log((c + 0.2) / (clean + 0.4))
        share, n = toxic / (toxic + clean), t + c
        # Chernoff's bound on so many toxic documents among n by chance
        p = np.clip(t / np.maximum(n, 1), 1e-9, 1 - 1e-9)
        surprise = n * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))
        sure = (odds > math.log(4)) & (surprise > math.log(max(100, len(both)))) & (t >= 3)
        order = np.flatnonzero(sure)[np.argsort(-surprise[sure], kind="stable")]
        for i in order:
            term, stem = both.index[i]
            if stem:
                lexicon.stems[term] = float(odds[i])
            else:
                lexicon.words[term] = max(float(odds[i]), base if term in BASE_TERMS else 0)
    lexicon.fuzzy = [t for t in lexicon.words if len(t) >= FUZZY_LETTERS]
    lexicon.prepare()
    return lexicon


def _lookup(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in h, weight) of the hashes that the table has."""
    keys, weight = table
    if not len(keys) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    found = np.flatnonzero(keys[at] == h)
    return found, weight[at[found]]


_WORD = re.compile(r"[^\W_]+")


def quoted(before: str, after: str) -> bool:
    """Whether a hit between these two windows is quoted, not meant."""
    for mark in '"':
        if before.count(mark) % 2 == 1 and mark in after:
            return True
    if re.search(r"(?:^|\W)'[^']*$", before) and re.search(r"^[^']*'(?:\W|$)", after):
        return True
    near = _WORD.findall(before)[-3:]
    return any(w in REPORTING for w in near)


def hits(lexicon: Lexicon, words: Words) -> pd.DataFrame:
    """Hits: row, byte range, kind (word, stem or fuzzy), weight, and whether quoted."""
    exact, we = _lookup(lexicon.word_table, words.hash)
    stem, ws = _lookup(lexicon.stem_table, words.stem_hash)
    stem_at = words.stems[stem]
    fresh = ~np.isin(stem_at, exact)
    stem_at, ws = stem_at[fresh], ws[fresh]
    near, term = lexicon.automaton.matches(words)
    fresh = ~np.isin(near, exact)
    near, term = near[fresh], term[fresh]
    if len(near) and lexicon.clean:
        good = np.array([words.text(words.start[i], words.end[i]) not in lexicon.clean for i in near], bool)
        near, term = near[good], term[good]
    at = np.concatenate([exact, stem_at, near]).astype(np.int64)
    kind = np.repeat([0, 1, 2], [len(exact), len(stem_at), len(near)])
    weight = np.concatenate([we, ws, lexicon.fuzzy_weight[term] if len(term) else np.zeros(0)])
    begin, end, row = words.start[at], words.end[at], words.row[at]
    said = [
        quoted(words.text(max(words.offsets[r], b - WINDOW), b), words.text(e, min(words.offsets[r + 1], e + WINDOW)))
        for r, b, e in zip(row.tolist(), begin.tolist(), end.tolist())
    ]
    return pd.DataFrame({"row": row, "start": begin, "end": end, "kind": kind, "weight": weight, "quoted": np.array(said, bool)})


N_FEATURES = 8


def document_features(lexicon: Lexicon, words: Words) -> np.ndarray:
    n = len(words.offsets) - 1
    x = np.zeros((n, N_FEATURES))
    h = hits(lexicon, words)
    for kind in range(3):
        own = h[(h["kind"] == kind) & ~h["quoted"]]
        np.add.at(x[:, kind], own["row"], own["weight"])
        np.maximum.at(x[:, 3 + kind], own["row"], own["weight"])
    said = h[h["quoted"]]
    np.add.at(x[:, 6], said["row"], said["weight"])
    count = np.diff(words.first)
    x[:, 7] = x[:, :3].sum(axis=1) / np.sqrt(np.maximum(count, 1))
    x[:, [0, 1, 2, 6]] = np.log1p(np.maximum(x[:, [0, 1, 2, 6]], 0))
    return x


@dataclass
class Model:
    lexicon: Lexicon
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -30, 30)))


#: Weights that the regression keeps to where the sample tells nothing, as of misspellings that it has none of.
PRIOR = np.array([0.6, 0.6, 0.8, 0.1, 0.1, 0.1, 0.0, 0.5])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Newton steps, a weight at a time; weights of hits stay at or above 0, but that of quotations.

    The loss is convex and every step bounded, so it settles; where hits tell toxic
    from clean documents without a fault, the ridge keeps the weights finite.
    """
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.append(PRIOR, -2.0)
    prior, penalty = w.copy(), np.full(len(w), ridge)
    penalty[-1] = 0.01
    z = xb @ w
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            grad = xb[:, j] @ (p - y) + penalty[j] * (w[j] - prior[j])
            # The largest curvature near by, so that no step goes too far.
            curve = (xb[:, j] ** 2) @ np.maximum(p * (1 - p), 0.02) + penalty[j]
            to = w[j] - np.clip(grad / curve, -1.0, 1.0)
            if j < N_FEATURES - 2:
                to = max(to, 0.0)
            z += xb[:, j] * (to - w[j])
            most, w[j] = max(most, abs(to - w[j])), to
        if most < 1e-5:
            break
    return w[:-1], float(w[-1])


# ---- Spark


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words]]:
    release("near")
    _, offsets = utf8(batch.column(column))
    for i, j in chunks(offsets):
        yield i, j, Words(batch.column(column).slice(i, j - i))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the sample -> in how many each word and each beginning stands, by fold and label."""
    for batch in batches:
        label, half = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for i, j, words in _parts(batch, 3):
            for stem in (False, True):
                h = words.stem_hash if stem else words.hash
                at = words.stems if stem else np.arange(len(h))
                if not len(h):
                    continue
                group = words.row[at] if len(at) else at
                _, one = np.unique(np.stack([group.astype(np.uint64), h]), axis=1, return_index=True)
                at, h = at[one], h[one]
                end = words.stem_end[one] if stem else words.end[at]
                key = label[i + words.row[at]] * 2 + half[i + words.row[at]]
                order = np.lexsort((h, key))
                at, h, key, end = at[order], h[order], key[order], end[order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
                n = np.diff(np.r_[new, len(h)])
                terms = [words.text(words.start[a], e) for a, e in zip(at[new].tolist(), end[new].tolist())]
                yield pa.RecordBatch.from_pydict({"term": pa.array(terms), "stem": pa.array([stem] * len(new)), "half": pa.array(key[new] % 2, pa.int32()), "toxic": pa.array(key[new] // 2, pa.int32()), "n": pa.array(n, pa.int64())})


def _minhasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the sample -> three minhashes of their shingles of three words."""
    for batch in batches:
        for i, j, words in _parts(batch, 1):
            s, at = shingles(words.hash, words.first, 3)
            row = np.searchsorted(words.first, at, side="right") - 1
            ids = word_hashes(*utf8(batch.column(0).slice(i, j - i)), np.ones(256, bool))[0]  # an id has no separator
            full = np.unique(row)
            begin = np.searchsorted(row, full)
            cols = []
            for k in range(3):
                own = mix(ids + np.uint64(k))  # a document without words is like no other
                if len(full):
                    own[full] = np.minimum.reduceat(mix(s + np.uint64(k * 77)), begin)
                cols.append(pa.array(own.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols], names=["doc", "m0", "m1", "m2"])


def _featurer(lexicons: list[Lexicon]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(2).to_numpy()
            for i, j, words in _parts(batch, 3):
                both = [document_features(lx, words) for lx in lexicons]
                x = np.stack([both[1 - half[i + r]][r] for r in range(j - i)]) if j > i else np.zeros((0, N_FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], names=["doc", "label", "half", "x"])

    return run


def _nearer(fuzzy: Fuzzy):
    """Documents of the sample -> in how many each word near a term stands, by fold and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, half = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i, _, words in _parts(batch, 3):
                at, term = fuzzy.matches(words)
                rows = [(fuzzy.terms[t], words.text(words.start[a], words.end[a]), i + words.row[a]) for a, t in zip(at, term)]
                f = pd.DataFrame(rows, columns=["term", "word", "row"]).drop_duplicates()
                at = f["row"].to_numpy(dtype=np.int64)
                f = f.assign(half=half[at].astype(np.int32), toxic=label[at].astype(np.int32)).groupby(["term", "word", "half", "toxic"], as_index=False).size()
                yield pa.RecordBatch.from_pydict({"term": pa.array(f["term"], pa.string()), "word": pa.array(f["word"], pa.string()), "half": pa.array(f["half"], pa.int32()), "toxic": pa.array(f["toxic"], pa.int32()), "n": pa.array(f["size"], pa.int64())})

    return run


def fit(docs: DataFrame, labels: DataFrame, *, learnable, doc_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 12_000) -> Model:
    """Learn from labelled rows where ``learnable`` holds; see the module's text."""
    spark = docs.sparkSession
    marks = labels.select(F.col(doc_col).alias("doc"), F.col(label_col).cast("int").alias("label")).where("doc is not null and label in (0, 1)").groupBy("doc").agg(F.max("label").alias("label"))
    marks = marks.where(learnable(F.col("doc")))
    total = marks.count()
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    marks = marks.where(draw < (min(1.0, max_train / total) if total else 0.0))
    half = F.pmod(F.xxhash64(F.lit("half"), F.xxhash64(F.substring(text_col, 1, 200))), F.lit(2)).cast("int").alias("half")
    # The sample's ids are bounded by max_train, so the texts are not shuffled for them.
    marks = marks.withColumn("doc", F.col("doc").cast("string"))
    sample = docs.select(F.col(doc_col).cast("string").alias("doc"), F.col(text_col)).join(F.broadcast(marks), "doc").select("doc", "label", half, F.coalesce(text_col, F.lit("")).alias("t")).withColumn("half", F.coalesce("half", F.lit(0)))
    sample = materialise(sample, "sample")
    # Copies and near copies would make their words look telling: one document of each set that shares a minhash counts.
    left = sample.select("doc", "t").mapInArrow(_minhasher, "doc string, m0 long, m1 long, m2 long")
    for m in ("m0", "m1", "m2"):
        left = left.groupBy(m).agg(F.min(F.struct("doc", "m0", "m1", "m2")).alias("r")).select("r.*")
    left = spark.createDataFrame(left.select("doc").collect(), "doc string")  # max_train ids at most
    sample = materialise(sample.join(F.broadcast(left), "doc"), "sample")
    stats = {(r.half, r.label): r.n for r in sample.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = sample.mapInArrow(_counter, COUNTS).groupBy("term", "stem", "half", "toxic").agg(F.sum("n").alias("n"))
    # A term needs three toxic documents.
    useful = counts.groupBy("term", "stem").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t")).where("t >= 3").select("term", "stem")
    table = pd.DataFrame([tuple(r) for r in counts.join(useful, ["term", "stem"]).collect()], columns=["term", "stem", "half", "toxic", "n"])

    def lexicon(use: list[int]) -> Lexicon:
        part = table[table["half"].isin(use)]
        return learn(part, sum(n for (h, y), n in stats.items() if h in use and y == 1), sum(n for (h, y), n in stats.items() if h in use and y == 0))

    whole, folds = lexicon([0, 1]), [lexicon([0]), lexicon([1])]
    terms = list(whole.fuzzy)
    near = sample.mapInArrow(_nearer(whole.automaton), "term string, word string, half int, toxic int, n long").groupBy("term", "word", "half", "toxic").agg(F.sum("n").alias("n"))
    near = pd.DataFrame([tuple(r) for r in near.collect()], columns=["term", "word", "half", "toxic", "n"])
    for lx, use in ((whole, [0, 1]), (folds[0], [0]), (folds[1], [1])):
        lx.sift(near[near["half"].isin(use)], terms)

    rows = sample.mapInArrow(_featurer(folds), FEATURES).collect()
    prior_x = np.eye(N_FEATURES)[[0]] * np.log1p(math.log(8.0))
    prior_x[0, 3] = math.log(8.0)
    if not any(r.label == 1 for r in rows) or not any(r.label == 0 for r in rows):
        w, b = logistic(np.vstack([prior_x] * 20 + [np.zeros((1, N_FEATURES))] * 60), np.r_[np.ones(20), np.zeros(60)], ridge=0.1)
        return Model(whole, w, b)
    rows.sort(key=lambda r: str(r.doc))
    w, b = logistic(np.array([r.x for r in rows]), np.array([r.label for r in rows], float))
    return Model(whole, w, b)


def _keep_only(name: int) -> None:
    """Lets go of what words were near to under other lexicons, as those of the training."""
    for other in [n for n in _near if n != name]:
        del _near[other]


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_only(model.lexicon.automaton.name)
        for batch in batches:
            for i, j, words in _parts(batch, 1):
                score = model.score(document_features(model.lexicon, words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score)], names=["key", "score"])

    return run


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for each row of ``docs``."""
    kind = dict(docs.dtypes)[doc_col]
    rows = docs.select(F.col(doc_col).alias("key"), F.col(text_col)).mapInArrow(_scorer(model), f"key {kind}, score double")
    return rows.select(F.col("key").alias(doc_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keeper(model: Model, column: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_only(model.lexicon.automaton.name)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, j, words in _parts(batch, column):
                keep[i:j] = model.score(document_features(model.lexicon, words)) < threshold
            yield batch.filter(pa.array(keep))

    return run


def keep_clean(docs: DataFrame, model: Model, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold."""
    return docs.mapInArrow(_keeper(model, docs.columns.index(text_col), threshold), docs.schema)


def fold(doc, parts: int = 4):
    """The remainder of crc32 of the id's text: which fold a row is in."""
    return F.crc32(doc.cast("string")) % parts
