"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors: document frequencies are counted over all documents, in a hashed table of fixed size;
a term weighs the square of its bounded IDF, so that ordinary words hardly count.
A randomised SVD of passages and of the windows of all documents gives latent directions over the benchmark's terms: what it needs
of the windows are sums over pairs of terms, made in one pass for a block.
Windows of every document, whole and overlapping, are projected and searched by cosine against the benchmark's
passages of about their length. Windows around which enough of a passage's words occur are taken as well, whatever their
cosine: no other can hold the share of it that counts. All these are then read word by word: the longest common subsequence with
the benchmark passage, and with its answer, decide.

The benchmark is the bounded side. Latent spaces are made for blocks of about BENCHMARK_BLOCK items; a pass over the documents
searches for as many blocks as PASS_BYTES allow, so what executors hold doesn't grow with the benchmark. Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import folded, grouped, word_hashes

#: Hashed terms of the document-frequency table.
TERMS = 1 << 17
#: Lengths of windows, each a quarter of its length after the last. A passage is searched at the first scale of
#: which it fills three quarters at most, so that some window holds all of it and not much else.
SCALES = (24, 32, 48, 64, 96)
#: Latent directions beyond one for each passage of a block, oversampling, and power iterations.
MORE_DIRECTIONS, EXTRA, POWER = 56, 16, 2
#: The latent space is fitted on the benchmark and on windows of so many words of all documents; their products are summed as whole
#: numbers of this size, so reruns agree.
FIT_WINDOW, ONE = 32, float(1 << 30)
#: Words taken together, pairs of terms that a task holds before it hands them on, and rows of the matrix of all pairs in one piece.
FIT_WORDS, FIT_PAIRS, FIT_ROWS = 1 << 18, 1 << 21, 64
COSINE = 0.4
#: Terms in a larger share of documents enter no vector, only norms; a passage with fewer than FEW others keeps them.
COMMON, FEW = 0.02, 2
#: Shares of the passage and of its answer that the longest common subsequence must cover; or the passage alone.
PASSAGE_SHARE, ANSWER_SHARE, ALONE = 0.6, 0.5, 0.85
BENCHMARK_BLOCK = 500
#: Bytes of blocks that a worker holds at once: so many are searched for in one pass over the documents.
PASS_BYTES = 96 << 20
SEED = 2
#: Windows projected together.
TOGETHER = 512
_ANSWER = re.compile(r"(?is)(?:^|\s)(?:answer|a)\s*:\s*(?=\S)")


def words_of(text: str) -> np.ndarray:
    """64-bit hashes of all words of a text, in order."""
    return word_hashes(folded(text.encode("utf-8", "replace")))[1]


def placed(hashes: np.ndarray) -> np.ndarray:
    """Terms of words: their places in tables of fixed size."""
    return (hashes & np.uint64(TERMS - 1)).astype(np.int32)


def terms(text: str) -> np.ndarray:
    return placed(words_of(text))


def answer_of(text: str) -> str:
    """What follows the last ``Answer:``; else the last sentence."""
    marked = list(_ANSWER.finditer(text))
    if marked:
        return text[marked[-1].end() :]
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s.strip(" .!?")]
    return sentences[-1] if sentences else text


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each element of ``a``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << i)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b.tolist():
        hit = places.get(x)
        if hit:
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _counted(docs: DataFrame) -> DataFrame:
    """Rows of kind 0: a partition's document frequencies; of kind 1: terms of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS + 1), 0
        part = TaskContext.get().partitionId()
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["kind", "part", "payload"])
        for batch in batches:
            terms = []
            for numbers, hashes, at in grouped(t.as_py() for t in batch.column(0)):
                ids = placed(hashes)
                for k in range(len(numbers)):
                    own = ids[at[k] : at[k + 1]]
                    n += 1
                    df[own] += 1  # once, however often a term occurs
                    if len(own):
                        terms.append((1, own.tobytes()))
            if terms:
                yield out(terms)
        if n:
            df[TERMS] = n
            yield out([(0, df.tobytes())])
        common.give_back()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "kind int, part long, payload binary")


def term_weights(df: np.ndarray) -> np.ndarray:
    """Squared IDF of every hashed term. All terms in fewer documents than the root of their number are equally rare:
    else a benchmark item that leaked often would weigh less than the odd words around it."""
    n = df[TERMS] + 1
    idf = np.log(n / (df[:TERMS] + 0.5)).clip(0.1, max(0.5, np.log(n) / 2))
    return (idf**2).astype(np.float32)


class Passages:
    """A block of the benchmark: pieces with their terms, scales and vectors over the block's own vocabulary."""

    def __init__(self, items: list[tuple[int, str]], weight: np.ndarray, common_terms: np.ndarray | None = None) -> None:
        often = np.zeros(TERMS, bool) if common_terms is None else common_terms
        self.item, self.hashes, self.words, self.answers, self.after = [], [], [], [], []
        longest = SCALES[-1] * 3 // 4
        for item, text in items:
            hashes = words_of(text)
            if not len(hashes):
                continue
            answer = words_of(answer_of(text))
            whole = len(hashes) <= 1.25 * longest
            starts = [0] if whole else list(range(0, len(hashes) - longest // 2, longest))
            if not whole and starts[-1] + longest < len(hashes):  # a short rest
                starts.append(len(hashes) - longest)
            for start in starts:
                piece = hashes if whole else hashes[start : start + longest]
                self.item.append(item)
                self.after.append(len(hashes) - start - len(piece))
                self.hashes.append(piece)
                self.words.append(placed(piece))
                self.answers.append(answer)
        used = [rare if len(np.unique(rare := w[~often[w]])) >= FEW else w for w in self.words]
        self.vocabulary = np.unique(np.concatenate(used)) if used else np.empty(0, np.int32)
        self.column = np.full(TERMS, -1, np.int32)
        self.column[self.vocabulary] = np.arange(len(self.vocabulary))
        lengths = np.array([len(w) for w in self.words])
        self.scale = np.array([next((s for s in SCALES if n <= s * 3 // 4), SCALES[-1]) for n in lengths], dtype=int)
        self.matrix = np.zeros((len(self.words), len(self.vocabulary)), np.float32)
        for k, w in enumerate(used):
            self.matrix[k, self.column[w]] = weight[w]
        self.matrix /= np.maximum(np.linalg.norm(self.matrix, axis=1, keepdims=True), 1e-9)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, number of each one's window) of about FIT_WORDS words; windows never cross texts."""
    held, windows, words, first = [], [], 0, 0
    for batch in batches:
        for payload in batch.column(0):
            ids = np.frombuffer(payload.as_py(), np.int32)
            for s in range(0, len(ids), FIT_WORDS):
                held.append(ids[s : s + FIT_WORDS])
                windows.append(first + np.arange(len(held[-1])) // FIT_WINDOW)
                first, words = int(windows[-1][-1]) + 1, words + len(held[-1])
                if words >= FIT_WORDS:
                    yield np.concatenate(held), np.concatenate(windows)
                    held, windows, words, first = [], [], 0, 0
    if held:
        yield np.concatenate(held), np.concatenate(windows)


def pair_sums(passages: Passages, texts: DataFrame, weight: np.ndarray) -> DataFrame:
    """key, value: over the windows of all texts, the products of the entries of two of the vocabulary's terms in a window's vector
    of unit length, summed, in units of 1 / ONE. The key of columns i <= j is i * size + j.
    """
    size, column, square = len(passages.vocabulary), passages.column, weight.astype(np.float64) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, more, held = np.empty(0, np.int64), np.empty(0), [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([keys, *(k for k, _ in more)]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([sums, *(v for _, v in more)]), len(every))

        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums.astype(np.int64))], names=["key", "value"])
        for ids, windows in _pieces(batches):
            cells = np.unique(windows * TERMS + ids)
            window, term = cells // TERMS, cells % TERMS
            whole = np.bincount(window, square[term])
            known = np.flatnonzero(column[term] >= 0)
            window, term = window[known], term[known]
            own, entry = column[term].astype(np.int64), weight[term] / np.sqrt(whole[window])
            for d in range(FIT_WINDOW):
                same = np.flatnonzero(window[d:] == window[: len(window) - d])
                if not len(same):
                    break
                more.append((own[same] * size + own[same + d], np.rint(entry[same] * entry[same + d] * ONE)))
                held += len(same)
            if held >= FIT_PAIRS:
                (keys, sums), more, held = added(), [], 0
                if len(keys) >= FIT_PAIRS:
                    yield out()
                    keys, sums = np.empty(0, np.int64), np.empty(0)
        keys, sums = added()
        if len(keys):
            yield out()
        common.give_back()

    return texts.select("payload").mapInArrow(run, "key long, value long").groupBy("key").agg(F.sum("value").alias("value"))


def latent_space(passages: Passages, texts: DataFrame, weight: np.ndarray, more: int = MORE_DIRECTIONS) -> np.ndarray:
    """Right singular vectors (terms by rank) of the TF-IDF matrix of the benchmark's and all texts' windows.

    Randomised range finding with power iterations: the tall matrix comes in by its products with itself alone, rows of which
    are multiplied in tasks. The benchmark's rows weigh as much together as the windows', or the corpus would crowd them out.
    """
    size = len(passages.vocabulary)
    rank = min(len(passages.words) + more, size)
    width = min(rank + EXTRA, size)
    basis = np.random.default_rng(SEED).normal(size=(size, width))
    sums = common.written(pair_sums(passages, texts, weight), "dc-pairs")
    i, j = F.floor(F.col("key") / size).cast("int"), (F.col("key") % size).cast("int")
    pairs = sums.select(i.alias("i"), j.alias("j"), "value")
    both = pairs.unionByName(pairs.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    mass = (pairs.filter("i = j").agg(F.sum("value")).first()[0] or 0) / ONE

    def dense(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group.i.iat[0]) // FIT_ROWS
        rows = np.zeros((min(FIT_ROWS, size - block * FIT_ROWS), size))
        rows[group.i - block * FIT_ROWS, group.j] = group.value / ONE
        return pd.DataFrame({"block": [block], "payload": [rows.tobytes()]})

    rows = common.written(both.groupBy(F.floor(F.col("i") / FIT_ROWS)).applyInPandas(dense, "block int, payload binary"), "dc-rows")

    def product(q: np.ndarray, name: str) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, payload in zip(batch.column(0), batch.column(1), strict=True):
                    part = np.frombuffer(payload.as_py(), np.float64).reshape(-1, size) @ q
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "payload"])

        parts = common.written(rows.mapInArrow(run, "block int, payload binary"), name)
        there = np.zeros((size, width))
        for r in parts.toLocalIterator():
            there[r["block"] * FIT_ROWS : (r["block"] + 1) * FIT_ROWS] = np.frombuffer(r["payload"], np.float64).reshape(-1, width)
        common.discard(parts)
        here = passages.matrix.T @ (passages.matrix @ q)
        return here * max(1.0, mass / len(passages.words)) + there

    for _ in range(POWER):
        basis, _r = np.linalg.qr(product(basis, "dc-svd"))
    small = basis.T @ product(basis, "dc-svd")
    common.discard(sums, rows)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (basis @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


class Overlaps:
    """Finds the windows around which the words of a piece are common enough for its share of PASSAGE_SHARE.

    A common subsequence is at most as long as the places of the piece whose words occur there at all. Each term lists
    the pieces that hold it, and how often; what is held grows with the words of the benchmark's block.
    """

    def __init__(self, words: list[np.ndarray], scales: np.ndarray) -> None:
        piece = np.repeat(np.arange(len(words)), [len(w) for w in words])
        keys, times = np.unique(np.concatenate(words).astype(np.int64) * len(words) + piece, return_counts=True)
        self.vocabulary, self.first, self.length = np.unique(keys // len(words), return_index=True, return_counts=True)
        self.column = np.full(TERMS, -1, np.int32)
        self.column[self.vocabulary] = np.arange(len(self.vocabulary))
        self.piece, self.times = (keys % len(words)).astype(np.int32), times.astype(np.int32)
        self.own = [np.unique(self.column[w], return_counts=True) for w in words]
        self.scales, self.margins = scales, [margin(s, len(w)) for s, w in zip(scales, words, strict=True)]
        self.need = np.array([len(w) for w in words]) * min(PASSAGE_SHARE, ALONE) - 1e-9

    def windows(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, scale, piece) for the terms of a text."""
        at = np.flatnonzero(self.column[ids] >= 0)
        if not len(at):
            return
        terms = self.column[ids[at]]
        distinct = np.unique(terms)
        listed = _ragged(self.first[distinct], self.length[distinct])
        pieces = np.flatnonzero(np.bincount(self.piece[listed], self.times[listed], len(self.need)) >= self.need)
        if not len(pieces):
            return
        order = np.argsort(terms, kind="stable")
        again = np.flatnonzero(np.diff(terms[order]) == 0)
        before = np.full(len(at), -1)
        before[order[again + 1]] = at[order[again]]
        table, spans = np.zeros(len(self.vocabulary), np.int32), {}
        for piece in pieces:
            key = scale, more = int(self.scales[piece]), self.margins[piece]
            if key not in spans:
                spans[key] = self._spans(at, before, len(ids), scale, more)
            first, last, which, number = spans[key]
            known, often = self.own[piece]
            table[known] = often
            times = table[terms[which]]
            table[known] = 0
            hit = np.flatnonzero(times)
            sums = np.bincount(first[hit], times[hit], number + 1) - np.bincount(last[hit], times[hit], number + 1)
            for k in np.flatnonzero(np.cumsum(sums)[:-1] >= self.need[piece]):
                yield int(k) * (scale // 4), scale, int(piece)

    @staticmethod
    def _spans(at: np.ndarray, before: np.ndarray, size: int, scale: int, more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """From which to which window a word counts, for the words that do, and the number of windows.

        Windows start every quarter of the scale and are read with ``more`` words on either side. A word counts where its
        first place there is this one.
        """
        step = scale // 4
        number = -(-max(1, size - 3 * step) // step)
        reached = lambda x: np.clip(x // step + 1, 0, number)  # noqa: E731  how many windows start at or before a place
        first = np.maximum(reached(at - scale - more), np.where(before >= 0, reached(before + more), 0))
        last = reached(at + more)
        which = np.flatnonzero(first < last)
        return first[which], last[which], which, number


def margin(scale: int, n: int) -> int:
    """Words on either side of a window that are read with it for a piece of n words."""
    return max(scale // 2, n // 2)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for every range, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Searcher:
    """A block of the benchmark, ready to be searched for: its passages and their latent vectors."""

    def __init__(self, passages: Passages, space: np.ndarray, weight: np.ndarray) -> None:
        latent = passages.matrix @ space
        scales = [(s, np.nonzero(passages.scale == s)[0]) for s in SCALES if (passages.scale == s).any()]
        self.by_scale = [(s, which, np.ascontiguousarray(latent[which].T)) for s, which in scales]
        self.column, self.words, self.hashes, self.answers, self.items, self.scales = passages.column, passages.words, passages.hashes, passages.answers, passages.item, passages.scale
        self.after = passages.after
        self.latent, self.space, self.weight = latent, space, weight

    def bytes(self) -> int:
        return 2 * self.latent.nbytes + self.space.nbytes + self.column.nbytes + sum(24 * len(w) for w in self.words)

    def ready(self) -> None:
        """What a worker needs besides."""
        self.overlaps = Overlaps(self.words, self.scales)
        self.square = self.weight.astype(np.float64) ** 2
        self.inside = np.where(self.column >= 0, self.square, 0)

    def judged(self, hashes: np.ndarray, piece: int, start: int, scale: int) -> tuple[float, float]:
        """Shares of the passage and of its answer that the text around a window holds in order, word by word."""
        words, answer = self.hashes[piece], self.answers[piece]
        more = margin(scale, len(words))
        low, high = max(0, start - more), start + scale + more
        passage = common_subsequence(words, hashes[low:high]) / len(words)
        if passage < PASSAGE_SHARE or not len(answer):
            return passage, passage
        # The answer of a long item may stand as many words later as the item goes on after this piece.
        return passage, common_subsequence(answer, hashes[low : high + self.after[piece] * 5 // 4]) / len(answer)

    def near(self, ids: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, start of a window in it, scale, piece, cosine) of the windows of texts that come near a piece."""
        sizes = np.diff(at)
        mass = np.concatenate([[0], np.cumsum(self.square[ids])])
        own = np.concatenate([[0], np.cumsum(self.inside[ids])])
        for scale, which, vectors in self.by_scale:
            step = scale // 4
            number = np.where(sizes > 0, -(-np.maximum(1, sizes - 3 * step) // step), 0)
            text = np.repeat(np.arange(len(sizes)), number)
            starts = at[text] + step * _ragged(np.zeros(len(sizes), np.int64), number)
            ends = np.minimum(starts + scale, at[text + 1])
            whole = mass[ends] - mass[starts]
            # A cosine is at most the share of the window's norm that lies on the benchmark's terms.
            left = np.flatnonzero((own[ends] - own[starts] >= COSINE**2 * whole) & (own[ends] > own[starts]))
            for i in range(0, len(left), TOGETHER):
                some = left[i : i + TOGETHER]
                lengths = ends[some] - starts[some]
                place = ids[_ragged(starts[some], lengths)]
                window = np.repeat(np.arange(len(some)), lengths)
                known = self.column[place] >= 0
                place, window = place[known], window[known]
                rows = self.weight[place][:, None] * self.space[self.column[place]]
                sums = np.add.reduceat(rows, np.flatnonzero(np.diff(window, prepend=-1)), axis=0)
                cosines = (sums @ vectors) / np.sqrt(whole[some])[:, None]
                for k, j in zip(*np.nonzero(cosines >= COSINE), strict=True):
                    t = text[some[k]]
                    yield int(t), int(starts[some[k]] - at[t]), scale, int(which[j]), float(cosines[k, j])

    def proposed(self, ids: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """What comes near, and then what overlaps besides, with its cosine."""
        done = set()
        for t, start, scale, piece, cosine in self.near(ids, at):
            done.add((t, start, piece))
            yield t, start, scale, piece, cosine
        for t in range(len(at) - 1):
            text = ids[at[t] : at[t + 1]]
            for start, scale, piece in self.overlaps.windows(text):
                if (t, start, piece) not in done:
                    window = text[start : start + scale]
                    known = window[self.column[window] >= 0]
                    cosine = float(self.weight[known] @ (self.space[self.column[known]] @ self.latent[piece])) / float(np.sqrt(self.square[window].sum()))
                    yield t, start, scale, piece, cosine

    def found(self, hashes: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple]:
        """By (text, item), the best window that the checks accept."""
        best: dict[tuple[int, int], tuple] = {}
        for t, start, scale, piece, cosine in self.proposed(placed(hashes), at):
            passage, answer = self.judged(hashes[at[t] : at[t + 1]], piece, start, scale)
            if passage >= ALONE or (passage >= PASSAGE_SHARE and answer >= ANSWER_SHARE):
                key, new = (t, self.items[piece]), (passage, min(cosine, 1.0), answer, start)
                if new > best.get(key, (-1.0,)):
                    best[key] = new
        return best


def _search(docs: DataFrame, searchers: list[Searcher]) -> DataFrame:
    """One pass over the documents for several blocks of the benchmark: words are hashed once for all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for searcher in searchers:
            searcher.ready()
        for batch in batches:
            out = []
            names = batch.column(0).to_pylist()
            for numbers, hashes, at in grouped(t.as_py() for t in batch.column(1)):
                for searcher in searchers:
                    out += [(names[numbers[t]], item, *found) for (t, item), found in searcher.found(hashes, at).items()]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "passage_share", "cosine", "answer_share", "word"])
        common.give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, item_id long, passage_share double, cosine double, answer_share double, word long")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: doc_id, item_id, passage_share, cosine, answer_share, word.

    ``word`` is where the best window starts. Null and empty texts hold nothing and are held by nothing;
    items with a null id are ignored; repeated items and rows are found alike. Empty tables give no rows. Columns other
    than doc_id and text (item_id and text) are ignored.
    """
    docs = docs.select("doc_id", "text")
    counted = common.written(_counted(docs), "dc-count")
    sums = common.summed(counted.filter("kind = 0").select(F.lit(0).alias("chunk"), "part", "payload"), "dc-df")
    df = sums[0] if sums else np.zeros(TERMS + 1)
    weight = term_weights(df)
    texts = counted.filter("kind = 1")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    found, searchers, held = None, [], 0
    total = items.count()
    blocks = common.blocks_for(total, BENCHMARK_BLOCK)

    def more(found: DataFrame | None) -> DataFrame:
        new = common.written(_search(docs, searchers), "dc-found")
        return new if found is None else found.unionByName(new)

    for b in range(blocks if total else 0):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = Passages([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").toLocalIterator()], weight, df[:TERMS] > COMMON * max(df[TERMS], 50.0))
        if not block.words:
            continue
        searcher = Searcher(block, latent_space(block, texts, weight), weight)
        if searchers and held + searcher.bytes() > PASS_BYTES:
            found, searchers, held = more(found), [], 0
        searchers.append(searcher)
        held += searcher.bytes()
    if searchers:
        found = more(found)
    common.discard(counted)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, passage_share double, cosine double, answer_share double, word long")
    return found


def op2_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; a null doc_id stays."""
    held = common.written(leaks(docs, benchmark).select("doc_id").filter("doc_id IS NOT NULL").distinct(), "dc-held")
    return common.sized_join(docs, held, ["doc_id"], "left_anti")
