"""Connected components of links by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_ROUNDS = 60
#: Of a row in a broadcast table of hashes, at most.
ROW_BYTES = 64
#: Rows of two numbers that a task writes at least, where there are so many.
TASK_ROWS = 100_000
#: Tables of more tasks keep the partitions that shuffles give them.
FEW_TASKS = 64


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(links: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reachable.

    Each round hangs larger neighbours on the smallest neighbour, then the rest likewise; the number of rounds
    grows with the logarithm of the longest path. Every round is a written table, so lineage stays short.
    The smallest neighbours are joined apart from the aggregation that finds them: broadcast where their number allows it, and
    else in a join that AQE splits where a node has very many neighbours. Tables have as many parts as their rows ask for, whatever the
    number of shuffle partitions: small ones would cost more in tasks than in work.
    """

    def written(df: DataFrame, kind: str, n: int) -> DataFrame:
        tasks = 1 + n // TASK_ROWS
        return common.written(df.coalesce(tasks) if tasks < FEW_TASKS else df, f"{name}-{kind}")

    def joined(sides: DataFrame, n: int) -> DataFrame:
        least = sides.groupBy("u").agg(F.min("v").alias("m"))
        if 2 * n * ROW_BYTES <= common.BROADCAST_BYTES:  # there are at most two nodes an edge
            return sides.join(F.broadcast(least), "u")
        tables.append(written(least, "least", 2 * n))
        return sides.join(tables[-1], "u")

    tables: list[DataFrame] = []
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.written(edges, f"{name}-edges")
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        if state[0] == 0:
            break
        # Large star: every larger neighbour of u moves to the smallest of u and its neighbours.
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(joined(sides, state[0]).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large", state[0])
        # Small star: u and its smaller neighbours move to the smallest of them.
        pairs = joined(large, state[0])
        moved = pairs.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before, edges = edges, written(moved.filter("u <> v").distinct(), "edges", 2 * state[0])
        common.discard(before, large, *tables)
        tables.clear()
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components", 2 * state[0])
    common.discard(edges)
    return out
