"""Approximate nearest neighbours by shifted space-filling curves.

Every curve projects the vectors by its own random rotation to a few dimensions, shifts them, and orders
them along a Hilbert curve. Spark range-partitions each ordering; a row's rank on a curve is its place in its
partition plus the sizes of those before. A query looks at the rows within a window of ranks around its own on every
curve; the windows are cut into blocks of bounded size, each block keeps its nearest, and the blocks' results merge by exact distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NEAREST = 10
CURVES, DIMENSIONS, BITS = 10, 4, 12
#: A window holds this share of all rows on either side, and WIDER more.
WINDOW, WIDER = 0.1, 64
BLOCK = 1024
QUERIES = 512
#: Projections are scaled on at most about so many vectors, those with the smallest hashes.
SAMPLE = 10_000
SEED = 4


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of cells (rows of coordinates under 2**bits), as integers."""
    x = cells.astype(np.int64).copy()
    n, d = x.shape
    if d * bits > 62:
        raise ValueError("key does not fit 62 bits")
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections, the largest subcubes first
        for i in range(d):
            far = (x[:, i] & q) != 0
            swap = np.where(far, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(far, q - 1, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


class Curves:
    """Rotations, scales and shifts of all curves."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        dimensions = min(dimensions, size)
        self.bits = bits
        self.rotations = np.stack([np.linalg.qr(rng.normal(size=(size, size)))[0][:, :dimensions] for _ in range(curves)])
        projected = np.einsum("nd,cdk->cnk", sample, self.rotations)
        self.low = projected.min(axis=1)
        self.span = np.maximum(projected.max(axis=1) - self.low, 1e-12)
        self.shifts = rng.random((curves, dimensions))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Keys by curve (rows) and vector; outside the sample's range the outermost cells hold."""
        out = []
        for rotation, low, span, shift in zip(self.rotations, self.low, self.span, self.shifts, strict=True):
            unit = (np.clip((vectors @ rotation - low) / span, 0, 1) + shift) / 2
            out.append(hilbert_keys(np.minimum((unit * 2**self.bits).astype(np.int64), 2**self.bits - 1), self.bits))
        return np.stack(out)


def _usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector (doubles), without those that take no part; the most frequent length is the dimension."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    kept = kept.filter(~bad & F.exists("v", lambda x: x != 0))
    size = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return kept.filter(F.size("v") == (size["d"] if size else 0))


def _matrix(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def nearest(rows: DataFrame, is_query, k: int = NEAREST, window: float = WINDOW, curves: int = CURVES) -> DataFrame:
    """For each query its k nearest others found: query_id, rank (from 1), vec_id, score (Euclidean distance).

    ``is_query`` is a condition on vec_id. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do those of another length than most have, nor rows without a vec_id. Ties go to the smaller vec_id.
    Of equal vectors only the k + 1 smallest vec_ids can ever be among a query's nearest, so the others are searched for but
    not searched in. Rows that repeat a vec_id are one candidate, at the smallest distance. Empty tables give no rows; other
    columns are ignored.
    """
    spark = rows.sparkSession
    usable = _usable(rows).withColumn("query", is_query)
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    ranked = usable.dropDuplicates(["vec_id", "v"]).withColumn("place", place).filter(F.col("place") <= k + 1)
    searched = ranked.select("vec_id", "v", F.lit(True).alias("candidate"))
    asked = usable.filter("query").dropDuplicates(["vec_id", "v"]).select("vec_id", "v", F.lit(True).alias("query"))
    both = searched.join(asked, ["vec_id", "v"], "full").select("vec_id", "v", F.coalesce("candidate", F.lit(False)).alias("candidate"), F.coalesce("query", F.lit(False)).alias("query"))
    # Single precision travels as such; nothing is lost by it.
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [x.values.to_numpy().astype(kind).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary()), batch.column(3), batch.column(4)], names=["row", "vec_id", "blob", "candidate", "query"])

    both = both.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", "candidate", "query")
    both = common.written(both.mapInArrow(blobs, "row long, vec_id long, blob binary, candidate boolean, query boolean"), "nn-rows")
    n = both.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    sample = both.filter(F.pmod(F.xxhash64("vec_id"), F.lit(2**31)) < int(min(1.0, SAMPLE / n) * 2**31) + 1).select("blob").toPandas()
    shape = Curves(_matrix(sample.blob if len(sample) else both.select("blob").limit(1).toPandas().blob, kind), curves)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                for c, keys in enumerate(shape.keys(_matrix(part.column(2).to_pylist(), kind))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys), part.column(1), part.column(0)], names=["curve", "key", "vec_id", "row"])

    # Only keys are ordered. Vectors join their places afterwards, once for all curves.
    schema = "curve int, key long, vec_id long, row long"
    keys = common.written(both.select("row", "vec_id", "blob").mapInArrow(keyed, schema), "nn-keys")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * curves / 200_000))
    by = ["curve", "key", "vec_id", "row"]
    ordered = keys.repartitionByRange(parts, *by).sortWithinPartitions(*by)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(np.full(m, part, np.int32)), pa.array(np.arange(at, at + m))], names=["curve", "row", "part", "at"])
            at += m

    ordered = common.written(ordered.mapInArrow(placed, "curve int, row long, part int, at long"), "nn-order")
    common.discard(keys)
    sizes = ordered.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("from"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("curve", "part", (before - F.col("from")).alias("offset"))
    offsets = common.written(offsets, "nn-offsets")
    places = common.sized_join(ordered, offsets, ["curve", "part"]).select("row", F.struct("curve", (F.col("at") + F.col("offset")).alias("place")).alias("p"))
    of_row = places.groupBy("row").agg(F.collect_list("p").alias("p"))  # one place a curve
    placed_rows = common.written(both.join(of_row, "row").select("vec_id", "blob", "candidate", "query", "p"), "nn-places")
    queries = both.filter("query").count()
    common.discard(both, ordered, offsets)
    placed_rows = placed_rows.select(F.explode("p").alias("p"), "vec_id", "blob", "candidate", "query").select("p.curve", "p.place", "vec_id", "blob", "candidate", "query")
    wide = math.ceil(window * n) + WIDER
    # Queries that meet in a block are dealt to groups of about QUERIES, each with its copy of the block.
    share = max(1, math.ceil(queries * min(1.0, (2 * wide + BLOCK) / n) / QUERIES))
    blocks = placed_rows.filter("candidate").select("curve", F.floor(F.col("place") / BLOCK).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(share - 1))).alias("deal"), "place", "vec_id", "blob")
    first, last = F.floor(F.greatest(F.lit(0), F.col("place") - wide) / BLOCK), F.floor(F.least(F.lit(n - 1), F.col("place") + wide) / BLOCK)
    deal = F.pmod(F.xxhash64("vec_id"), F.lit(share)).cast("int")
    asking = placed_rows.filter("query").select(F.col("curve").alias("q_curve"), F.explode(F.sequence(first, last)).alias("q_block"), deal.alias("q_deal"), F.col("place").alias("q_place"), F.col("vec_id").alias("query_id"), F.col("blob").alias("q_blob"))

    def search(here: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        vectors, ids, places = _matrix(here.blob, kind), here.vec_id.to_numpy(), here.place.to_numpy()
        asked, names, at = _matrix(queries.q_blob, kind), queries.query_id.to_numpy(), queries.q_place.to_numpy()
        # One product of matrices tells which are near, but for rounding; only those are measured exactly.
        mass, own = (vectors**2).sum(axis=1), (asked**2).sum(axis=1)
        square = own[:, None] + mass[None] - 2 * (asked @ vectors.T)
        square[(np.abs(places[None] - at[:, None]) > wide) | (ids[None] == names[:, None])] = np.inf
        least = np.partition(square, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        slack = 1e-12 * vectors.shape[1] * (own + mass.max())
        q, x = np.nonzero((square <= (least + slack)[:, None]) & np.isfinite(square))
        distance = np.concatenate([np.sqrt(((vectors[x[i : i + 8192]] - asked[q[i : i + 8192]]) ** 2).sum(axis=1)) for i in range(0, len(q), 8192)] or [np.empty(0)])
        order = np.lexsort((ids[x], distance, q))
        q, x, distance = q[order], x[order], distance[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        return pd.DataFrame({"query_id": names[q[best]], "vec_id": ids[x[best]], "score": distance[best]})

    found = blocks.groupBy("curve", "block", "deal").cogroup(asking.groupBy("q_curve", "q_block", "q_deal")).applyInPandas(search, "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return merged.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_hilbert_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
