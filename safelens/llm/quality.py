"""Quality classifier: random Fourier features, ridge regression by normal equations, isotonic calibration.

Statistics of the whole text are standardised and mapped by random cosines whose inner products approximate
a Gaussian kernel. Every partition sums its part of the normal equations, fold by fold; the sums are added in a tree and
solved for all rows, and for all but each fold. Every labelled row is scored by the solution that hasn't seen its fold; these raw scores
are counted on a fixed grid and calibrated by pooling adjacent violators. Rows with equal statistics, so all copies, share a fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import word_hashes

COSINES = 256
RIDGE = 1e-3
FOLDS = 3
SEED = 20
#: Bytes of texts that are counted together, unless one text has more.
TOGETHER = 1 << 16
GRID = 768
LOW, HIGH = -1.0, 2.0
STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "upper", "digits", "marks", "bars", "odd_marks", "exclamations",
    "stops", "commas", "spaces", "beyond_ascii", "entropy", "distinct_words", "top_word", "short_words", "shouted_words", "marked_words",
    "repeated_lines", "log_line_length", "barred_words",
)
_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)


def _members(codes) -> np.ndarray:
    out = np.zeros(256)
    out[list(codes)] = 1
    return out


_SPACE = _members(b" \t\n\x0b\x0c\r")
_CLASSES = np.stack([
    _members(_UPPER), _members(_DIGIT), _members(c for c in range(33, 127) if not chr(c).isalnum()), _members(b"|"), _members(b"#$%&*@^~<>{}[]\\=+_"),
    _members(b"!"), _members(b"."), _members(b","), _SPACE, _members(range(128, 256)),
])
#: Bytes of words: spaces for white space, all else as it is; of lines: spaces for their ends, and ends for spaces.
_WORDS = np.array([32 if _SPACE[c] else c for c in range(256)], np.uint8)
_LINES = np.array([{10: 32, 32: 10}.get(c, c) for c in range(256)], np.uint8)
_IS_UPPER, _IS_LOWER, _IS_MARK, _IS_INK = (_members(x).astype(np.uint8) for x in (_UPPER, _LOWER, b"#$%&*@^~!|=+<>", (c for c in range(256) if not _SPACE[c])))


def _runs(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of other bytes than spaces start and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], folded != 32, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _within(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of each run have a flag. Runs are never empty and ``flags`` goes on after the last."""
    return np.add.reduceat(flags, np.stack([starts, ends], axis=1).ravel(), dtype=np.int64)[::2] if len(starts) else np.empty(0, np.int64)


def _tallied(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each of n texts, and how often the most frequent one occurs."""
    if not len(doc):
        return np.zeros(n, np.int64), np.zeros(n)
    ordered = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20)))
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    of = (ordered[first] >> np.uint64(44)).astype(np.int64)
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    most = np.zeros(n)
    most[of[at]] = np.maximum.reduceat(np.diff(np.append(first, len(doc))), at)
    return np.bincount(of, minlength=n), most


def statistics_of(texts: list[bytes]) -> np.ndarray:
    """The statistics of whole texts, one row each; zeros for an empty one. All texts are counted together."""
    n = len(texts)
    out = np.zeros((n, len(STATISTICS)))
    size = np.array([len(t) for t in texts])
    counts = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]) if n else np.empty((0, 256))
    whole = np.maximum(size, 1)[:, None]
    out[:, 4:14] = counts @ _CLASSES.T / whole
    shares = counts / whole
    out[:, 14] = -(shares * np.log2(shares, out=np.zeros_like(shares), where=shares > 0)).sum(axis=1)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if n else np.empty(0, np.int64)

    folded = _WORDS[raw]
    starts, ends = _runs(folded)
    doc = np.searchsorted(begins, starts, "right") - 1
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    mean = lambda of: np.bincount(doc, of, n) / some
    length = (ends - starts).astype(np.float64)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    out[:, 2] = mean(length)
    out[:, 3] = np.sqrt(mean((length - out[doc, 2]) ** 2))
    distinct, most = _tallied(doc, word_hashes(folded)[1], n)
    out[:, 15], out[:, 16] = distinct / some**0.8, most / some
    out[:, 17] = mean(length <= 3)
    loud = np.flatnonzero((length > 1) & (_within(_IS_LOWER[raw], starts, ends) == 0))
    loud = loud[_within(_IS_UPPER[raw], starts[loud], ends[loud]) > 0]
    out[:, 18] = np.bincount(doc[loud], minlength=n) / some
    out[:, 19] = mean(_IS_MARK[raw[ends - 1]] > 0)
    out[:, 22] = mean((length == 1) & (raw[starts] == ord("|")))

    swapped = _LINES[raw]
    starts, ends = _runs(swapped)
    inked = _within(_IS_INK[raw], starts, ends) > 0
    doc, key = np.searchsorted(begins, starts[inked], "right") - 1, word_hashes(swapped)[1][inked]
    lines = np.bincount(doc, minlength=n)
    distinct, _ = _tallied(doc, key, n)
    out[:, 20] = np.where(lines > 0, 1 - distinct / np.maximum(lines, 1), 0)
    out[:, 21] = np.where(lines > 0, np.log1p(size / np.maximum(lines, 1)), 0)
    out[size == 0] = 0
    return out


def statistics(text: bytes | None) -> np.ndarray:
    return statistics_of([text or b""])[0]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, size = [], [], 0
            for text in batch.column(1):
                held.append(text.as_py() or b"")
                size += len(held[-1]) + 1
                if size >= TOGETHER:
                    rows.append(statistics_of(held))
                    held, size = [], 0
            rows.append(statistics_of(held))
            flat = np.concatenate(rows).ravel()
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["doc_id", "stats"])
        common.give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray
    constant: float | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.spread, self.frequencies, self.phases)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        return np.interp(self.features(stats) @ self.weights, self.steps, self.values)


def fourier(stats, mean, spread, frequencies, phases) -> np.ndarray:
    """A constant, then random cosines of the standardised statistics (held to 6 spreads)."""
    z = np.clip((stats - mean) / spread, -6, 6)
    cosines = np.sqrt(2 / len(phases)) * np.cos(z @ frequencies + phases)
    return np.concatenate([np.ones((len(z), 1)), cosines], axis=1)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Means of y by pooling adjacent violators, weights n."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, n, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, k = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * w) / (blocks[-1][1] + w), blocks[-1][1] + w, blocks[-1][2] + k]
    return np.concatenate([[v] * k for v, _, k in blocks]) if blocks else np.empty(0)


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame.stats.to_list()) if len(frame) else np.empty((0, len(STATISTICS)))


def _partition_sums(rows: DataFrame, sums, name: str) -> np.ndarray | None:
    """Sum over all rows (stats, y, fold) of ``sums(stats, y, fold)``, a vector, partition by partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                more = sums(_matrix(frame), frame.y.to_numpy(np.float64), frame.fold.to_numpy())
                total = more if total is None else total + more
        if total is not None:
            yield pd.DataFrame({"chunk": [0], "part": [TaskContext.get().partitionId()], "payload": [total.tobytes()]})

    return common.summed(rows.select("stats", "y", "fold").mapInPandas(run, "chunk int, part long, payload binary"), name).get(0)


def fit(rows: DataFrame, cosines: int = COSINES, ridge: float = RIDGE, seed: int = SEED, folds: int = FOLDS) -> Model:
    """From (stats, y) over all labelled rows. With no rows, or one class only, the score is constant."""
    d = len(STATISTICS)
    rows = rows.select("stats", "y", F.pmod(F.xxhash64("stats"), F.lit(folds)).cast("int").alias("fold"))
    moments = _partition_sums(rows, lambda x, y, _: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]), "q-moments")
    n, good = (0, 0) if moments is None else moments[:2]
    if not n or good in (0, n):
        return Model(*[np.empty(0)] * 7, constant=0.5 if not n else float(good / n))
    mean = moments[2 : 2 + d] / n
    spread = np.sqrt(np.maximum(moments[2 + d :] / n - mean**2, 1e-8))
    rng = np.random.default_rng(seed)
    frequencies, phases = rng.normal(size=(d, cosines)) / np.sqrt(2 * d), rng.uniform(0, 2 * np.pi, cosines)
    k = cosines + 1

    def normal(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        f = fourier(x, mean, spread, frequencies, phases)
        parts = [(f[fold == i], y[fold == i]) for i in range(folds)]
        return np.concatenate([np.concatenate([(g.T @ g).ravel(), g.T @ z, [len(z)]]) for g, z in parts])

    sums = _partition_sums(rows, normal, "q-normal").reshape(folds, k * k + k + 1)

    def solved(part: np.ndarray) -> np.ndarray:
        a = part[: k * k].reshape(k, k) + np.diag([0.0] + [ridge * part[-1] / k + 1e-6] * cosines)
        a[0, 0] += 1e-9  # a fold may hold every row
        return np.linalg.solve(a, part[k * k : -1])

    weights = solved(sums.sum(axis=0))
    unseen = np.stack([solved(sums.sum(axis=0) - sums[i]) for i in range(folds)], axis=1)

    def histogram(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        raw = (fourier(x, mean, spread, frequencies, phases) @ unseen)[np.arange(len(x)), fold]
        at = np.clip(((raw - LOW) / (HIGH - LOW) * GRID).astype(int), 0, GRID - 1)
        return np.concatenate([np.bincount(at, minlength=GRID), np.bincount(at, y, GRID), np.bincount(at, raw, GRID)]).astype(np.float64)

    count, right, raw = _partition_sums(rows, histogram, "q-grid").reshape(3, GRID)
    full = count > 0
    values = isotonic(right[full] / count[full], count[full])
    return Model(mean, spread, frequencies, phases, weights, raw[full] / count[full], np.clip(values, 0, 1))


def score_documents(docs: DataFrame, labels: DataFrame, held_out=None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    ``held_out`` is a condition on doc_id; labels of such rows are never read. A null doc_id has no label and
    is not held out. Null and empty texts are scored by their statistics, all zero. A doc_id with several labels
    counts once for each; labels other than 0 and 1 (and null) teach nothing. Without labels every score is
    0.5. An empty table gives no rows; other columns are ignored.
    """
    held_out = F.lit(False) if held_out is None else held_out
    stats = common.written(measured(docs).withColumn("held_out", F.coalesce(held_out, F.lit(False))), "q-stats")
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("y IN (0, 1) AND doc_id IS NOT NULL")
    rows = common.written(stats.filter("NOT held_out").select("doc_id", "stats").join(y, "doc_id").select("stats", "y"), "q-rows")
    model = fit(rows)
    common.discard(rows)

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(s.to_list()))) if len(s) else pd.Series([], dtype=float)

    scored = stats.select("doc_id", "held_out", score("stats").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def op9_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return score_documents(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"), held_out)


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score at least ``least``.

    A document is rejected by its doc_id; rows that share one stay if any of them scores well. A null doc_id stays.
    """
    scored = score_documents(docs, labels).groupBy("doc_id").agg(F.max("score").alias("score"))
    gone = common.written(scored.filter((F.col("score") < least) & F.col("doc_id").isNotNull()).select("doc_id"), "q-gone")
    return common.sized_join(docs, gone, ["doc_id"], "left_anti")
