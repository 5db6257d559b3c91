"""Fitting the router's and the models' linear scorers on labelled texts, and how well scores part classes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import BUCKETS, LinearModel, grams, kept_only, lots, margins, probabilities
from ..functions.scoring import ArrowScorer
from ..sources.sinks import discard, scratch

ROUNDS, SHRINK = 16, 0.05
#: Standard errors by which the share of a class's texts that have a bucket must differ from that of the other texts.
TELLING = 4.0
#: More classes than this are no labels.
MOST_CLASSES = 64


def _summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the arrays in ``payload`` over rows (part, payload), in a tree: no task adds more than 16."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(group.payload.iat[0], np.float64).copy()
        for more in group.payload.iloc[1:]:
            total += np.frombuffer(more, np.float64)
        return pd.DataFrame({"part": [group.part.iat[0] // 16], "payload": [total.tobytes()]})

    for _ in range(math.ceil(math.log(max(2, parts.rdd.getNumPartitions()), 16))):
        parts = parts.groupBy(F.floor(F.col("part") / 16)).applyInPandas(add, "part long, payload binary")
    return sum((np.frombuffer(r["payload"], np.float64) for r in parts.collect()), np.zeros(math.prod(shape))).reshape(shape)


def _per_partition(table: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """What ``add(total, buckets, offsets, labels)`` sums up over all lots of texts, each partition in an array of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for batch in batches:
            for b, o, y in zip(batch.buckets, batch.offsets, batch.labels, strict=True):
                add(total, np.frombuffer(b, np.int32), np.frombuffer(o, np.int64), np.frombuffer(y, np.int64))
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "payload": [total.tobytes()]})

    return _summed(table.mapInPandas(run, "part long, payload binary"), shape)


def telling_buckets(counts: np.ndarray, least: float = TELLING) -> np.ndarray:
    """Buckets in which some class's texts differ from the others by at least so many standard errors. ``counts``: texts by bucket and class; the last row is all texts."""
    texts, n = counts[-1], counts[-1].sum()
    has = counts[:-1].sum(axis=1)
    out = np.zeros(len(has), bool)
    for c in range(counts.shape[1]):
        rest = n - texts[c]
        if texts[c] and rest:
            apart = counts[:-1, c] / texts[c] - (has - counts[:-1, c]) / rest
            out |= np.abs(apart) >= least * np.sqrt((has + 1) / n * (1 / texts[c] + 1 / rest))
    return np.flatnonzero(out)


def fit(rows: DataFrame, text: str, label: str, classes: Iterable[str] | None = None, rounds: int = ROUNDS, shrink: float = SHRINK, least: float = TELLING) -> LinearModel:
    """A multinomial model of ``label`` (a string column) by ``text``; rows where either is null, or whose label isn't among ``classes``, teach nothing.

    Texts become buckets once, in a written table; one pass counts in how many texts of each class a bucket is, and only those that tell classes apart
    go on. Every round sums, by partition, what each bucket's weights got wrong, and moves all weights at once by that over the number of texts
    with the bucket. This is the minimum of a bound from above, so the loss never rises and no step length is tuned. ``shrink`` texts without a class
    are in every bucket besides, so rare ones learn little. Without rows, or with one class, the model knows the classes and nothing else.
    """
    spark = rows.sparkSession
    known = rows.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")
    if classes is None:
        classes = sorted(r["label"] for r in known.select("label").distinct().limit(MOST_CLASSES + 1).collect())
    names = tuple(classes)
    if not 0 < len(names) <= MOST_CLASSES:
        raise ValueError(f"{len(names)} classes; a model has from 1 to {MOST_CLASSES}")
    places = {n: i for i, n in enumerate(names)}
    columns = "buckets binary, offsets binary, labels binary"
    frame = lambda *arrays: pd.DataFrame({c.split()[0]: [a.tobytes()] for c, a in zip(columns.split(", "), arrays, strict=True)})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, labels = 0, batch["label"].map(places).to_numpy(np.int64)
            for lot in lots(batch["text"]):
                yield frame(*grams(lot), labels[at : at + len(lot)])
                at += len(lot)

    def counted(total: np.ndarray, buckets: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> None:
        cells = buckets.astype(np.int64) * len(names) + np.repeat(labels, np.diff(offsets))
        total[:-1] += np.bincount(cells, minlength=total[:-1].size).reshape(-1, len(names))
        total[-1] += np.bincount(labels, minlength=len(names))

    at = scratch(spark)
    known.filter(F.col("label").isin(*names)).mapInPandas(hashed, columns).write.parquet(f"{at}/all")
    everything = spark.read.parquet(f"{at}/all")
    counts = _per_partition(everything, (BUCKETS + 1, len(names)), counted)
    buckets = telling_buckets(counts, least)
    model = LinearModel(names, buckets, np.zeros((len(buckets) + 1, len(names))))

    def telling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, o, y in zip(batch.buckets, batch.offsets, batch.labels, strict=True):
                yield frame(*kept_only(np.frombuffer(b, np.int32), np.frombuffer(o, np.int64), model.place), np.frombuffer(y, np.int64))

    everything.mapInPandas(telling, columns).write.parquet(f"{at}/telling")
    table = spark.read.parquet(f"{at}/telling")
    mass = np.append(counts[buckets].sum(axis=1) + shrink, max(1.0, counts[-1].sum()))[:, None]

    def wrong(weights: np.ndarray) -> Callable:
        def add(total: np.ndarray, buckets: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> None:
            error = probabilities(margins(buckets, offsets, weights))
            error[np.arange(len(labels)), labels] -= 1
            total[-1] += error.sum(axis=0)
            n = np.diff(offsets)
            error = np.repeat(error / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0)
            for c in range(error.shape[1]):
                total[:-1, c] += np.bincount(buckets, error[:, c], len(total) - 1)

        return add

    for _ in range(rounds):
        model.weights = model.weights - _per_partition(table, model.weights.shape, wrong(model.weights)) / mass
    discard(spark, at)
    return model


def trained_scorer(router: LinearModel | None = None, prompt: LinearModel | None = None, moderation: LinearModel | None = None, batch: int = 128, max_length: int | None = None) -> ArrowScorer:
    """The cascade's scorer from fitted models. Without a router the router scores zeros and isn't named; another model that is missing scores nothing."""
    load = lambda model: (lambda: model) if model is not None else (lambda: lambda texts: [{} for _ in texts])
    return ArrowScorer(None if router is None else load(router), load(prompt), load(moderation), batch, max_length)


def auc(rows: DataFrame, gold: Column, score: Column, by: tuple[str, ...] = (), bins: int = 1024) -> DataFrame:
    """rows, positives and auc: how often a positive row scores above a negative one, ties half; null where there is no such pair.

    Equal scores are counted first, then bins of scores from 0 to 1, so no task orders a whole group.
    """
    counted = rows.select(*by, score.cast("double").alias("s"), gold.cast("boolean").alias("g")).groupBy(*by, "s").agg(F.count_if("g").alias("p"), F.count_if(~F.col("g")).alias("n"))
    counted = counted.withColumn("bin", F.least(F.greatest(F.floor(F.col("s") * bins), F.lit(0)), F.lit(bins - 1)))
    below = Window.partitionBy(*by, "bin").orderBy("s")
    inside = counted.withColumn("won", F.col("p") * (F.sum("n").over(below) - F.col("n") / 2)).groupBy(*by, "bin").agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("bin")) - F.col("n")
    out = inside.withColumn("won", F.col("won") + F.col("p") * before).groupBy(*by).agg(F.sum(F.col("p") + F.col("n")).alias("rows"), F.sum("p").alias("positives"), F.sum("won").alias("won"))
    return out.select(*by, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("positives", F.lit(0)).alias("positives"), F.try_divide(F.col("won"), F.col("positives") * (F.col("rows") - F.col("positives"))).alias("auc"))
