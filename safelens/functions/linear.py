"""A linear model over hashed word and character n-grams: how texts become buckets, how weights become scores, and where weights are kept."""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
from pyspark.sql import SparkSession

#: Buckets that n-grams are hashed to; a prime, as buckets are remainders.
BUCKETS = 262_139
#: Texts are read in lots of about this many code points.
LOT = 1 << 20


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): those that each text's n-grams fall into, once each and ascending: words, pairs of neighbouring words, and every three characters.

    Words are parted by white space as ASCII knows it, which is a space among characters; A-Z are lower-cased, nothing else is.
    """
    points = np.frombuffer("".join(t + " " for t in texts).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    points[(points >= 65) & (points <= 90)] += 32
    points[(points >= 9) & (points <= 13)] = 32
    inside = points != 32
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    row_of = lambda at: np.searchsorted(ends, at, side="right")
    words = np.empty(0, np.int64)
    if len(starts):
        at = np.arange(len(points)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(points)]])))
        words = np.add.reduceat(np.where(inside, points * ((at + 1) * 40503 % 65521), 0), starts) % BUCKETS
    rows = row_of(starts)
    pairs = (words[:-1] * 8191 + words[1:] * 131071 + 7) % BUCKETS
    together = rows[:-1] == rows[1:]
    three = (points[:-2] * 31337 + points[1:-1] * 1009 + points[2:] * 65537 + 11) % BUCKETS
    own = np.arange(len(points))
    own_row = row_of(own)
    full = own[:-2] + 2 < ends[own_row[:-2]] - 1 if len(own) > 2 else np.empty(0, bool)
    row = np.concatenate([rows, rows[:-1][together], own_row[:-2][full]])
    each = np.unique(row * BUCKETS + np.concatenate([words, pairs[together], three[full]]))
    return (each % BUCKETS).astype(np.int32), np.searchsorted(each, np.arange(len(texts) + 1) * BUCKETS)


def lots(texts: Iterable[str]) -> Iterable[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= LOT:
            yield held
            held, size = [], 0
    if held:
        yield held


def kept_only(buckets: np.ndarray, offsets: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with each bucket's ``place``, without the buckets that have none (-1)."""
    there = place[buckets]
    kept = there >= 0
    return there[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]


def margins(buckets: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(texts, classes): the weights of a text's buckets summed over the root of their number, and the bias, which is the last row of the weights."""
    out = np.repeat(weights[-1:], len(offsets) - 1, axis=0)
    counts = np.diff(offsets)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] += np.add.reduceat(weights[buckets], offsets[some], axis=0) / np.sqrt(counts[some, None])
    return out


def probabilities(margin: np.ndarray) -> np.ndarray:
    raised = np.exp(margin - margin.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


class LinearModel:
    """Callable as scorers want it: texts in, one ``{class: probability}`` each out. Travels to workers by value; only buckets that have weights count."""

    def __init__(self, classes: Iterable[str], buckets: np.ndarray, weights: np.ndarray) -> None:
        self.classes, self.buckets, self.weights = tuple(classes), np.asarray(buckets, np.int32), weights
        if weights.shape != (len(self.buckets) + 1, len(self.classes)):
            raise ValueError(f"weights of shape {weights.shape} don't fit {len(self.buckets)} buckets, a bias and {len(self.classes)} classes")
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[self.buckets] = np.arange(len(self.buckets))

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        found = [probabilities(margins(*kept_only(*grams(lot), self.place), self.weights)) for lot in lots(texts)]
        return np.concatenate(found) if found else np.empty((0, len(self.classes)))

    def __call__(self, texts: list[str]) -> list[dict[str, float]]:
        return [dict(zip(self.classes, row, strict=True)) for row in self.scores(texts).tolist()]

    def write(self, spark: SparkSession, path: str) -> None:
        """A folder of Parquet: the classes, and a row for each bucket that has weights; the bias is that of the bucket after the last."""
        names = json.dumps(self.classes)
        rows = [(int(b), [float(x) for x in w], names) for b, w in zip([*self.buckets, BUCKETS], self.weights, strict=True)]
        spark.createDataFrame(rows, "bucket int, weights array<double>, classes string").coalesce(1).write.parquet(path)


def read_model(spark: SparkSession, path: str) -> LinearModel | None:
    """The model in a folder that ``write`` has made; None if there is no such folder. Its size is bounded by the buckets."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return None
    found = sorted(spark.read.parquet(path).collect(), key=lambda r: r["bucket"])
    return LinearModel(json.loads(found[0]["classes"]), np.array([r["bucket"] for r in found[:-1]], np.int32), np.array([r["weights"] for r in found]))
