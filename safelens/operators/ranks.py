"""Exact values at ranks of a group, with no group's values in one task: a mergeable sketch brackets each rank, and counts inside the bracket decide it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import scratch

#: The sketch is off by one in so many ranks at most; a bracket is two such errors wide on either side.
ACCURACY = 10_000
#: Up to so many groups, their brackets go to every task; beyond, rows are shuffled to them.
GROUPS = 10_000


def at_ranks(df: DataFrame, column: str, by: tuple[str, ...], wanted: dict[str, tuple[float, Callable[[Column], Column]]], store: bool = False) -> DataFrame:
    """by, n, min, max, mean, and for each name the value at a rank from 0: (its share of the group, its place among n values).

    Nulls don't count; NaN is above everything. ``store``: the values are written first, as they cost more to compute than to read; they are read twice.
    """
    spark = df.sparkSession
    rows = df.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col(column).cast("double").alias("v"))
    if store:
        rows.write.parquet(at := f"{scratch(spark)}/ranked")
        rows = spark.read.parquet(at)
    rows = rows.filter("v IS NOT NULL")
    keys, number = [f"__b{i}" for i in range(len(by))], ~F.isnan("v")
    ends = [min(1.0, max(0.0, q + side * 2 / ACCURACY)) for q, _ in wanted.values() for side in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(number).alias("numbers"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"),
        F.percentile_approx(F.when(number, F.col("v")), ends, ACCURACY).alias("ends"), F.max(F.when(number, F.col("v"))).alias("most"),
    ).filter("n > 0")
    few = sketch.limit(GROUPS + 1).collect()
    if len(few) <= GROUPS:
        sketch = spark.createDataFrame(few, sketch.schema)
    brackets = sketch.select(*[F.col(k).alias(f"{k}x") for k in keys], "n", "numbers", "min", "max", "mean", "ends", "most")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}x"))
    placed = rows.filter(number).join(F.broadcast(brackets) if len(few) <= GROUPS else brackets, same)
    each = []
    for i, (q, rank) in enumerate(wanted.values()):
        # In a small group a rank is more than the sketch's error: its bracket is the whole group, some ten thousand values.
        small = F.col("n") <= 5 * ACCURACY
        low = F.when(small | F.lit(q - 2 / ACCURACY <= 0), F.lit(float("-inf"))).otherwise(F.col("ends")[2 * i])
        high = F.when(small | F.lit(q + 2 / ACCURACY >= 1), F.col("most")).otherwise(F.col("ends")[2 * i + 1])
        below = F.col("v") < low
        each.append(F.when(F.col("v") <= high, F.struct(F.lit(i).alias("i"), rank(F.col("n")).cast("long").alias("rank"), below.alias("below"), F.when(~below, F.col("v")).alias("x"))))
    counted = placed.select(*keys, F.explode(F.array_compact(F.array(*each))).alias("e")).groupBy(*keys, "e.i", "e.rank", "e.below", "e.x").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy(F.desc("below"), "x"))
    hit = counted.withColumn("upto", upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
    # A rank below its bracket would be the sketch's fault: no value rather than a wrong one.
    found = hit.groupBy(*keys).agg(*[F.max(F.when((F.col("i") == i) & ~F.col("below"), F.col("x"))).alias(f"__{name}") for i, name in enumerate(wanted)])
    out = brackets.join(found, same, "left")
    values = [F.when(rank(F.col("n")) >= F.col("numbers"), F.lit(float("nan"))).otherwise(F.col(f"__{name}")).alias(name) for name, (_, rank) in wanted.items()]
    return out.select(*[F.col(f"{k}x").alias(c) for k, c in zip(keys, by, strict=True)], "n", "min", "max", "mean", *values)


def percentiles(df: DataFrame, column: str, by: tuple[str, ...], qs: tuple[float, ...], store: bool = False) -> DataFrame:
    """by, n, min, max, mean and p<q> for each q in percent: inclusive linear interpolation."""
    wanted = {}
    for q in qs:
        at = lambda n, q=q: (n - 1) * F.lit(q / 100)
        wanted |= {f"low{q}": (q / 100, lambda n, at=at: F.floor(at(n))), f"high{q}": (q / 100, lambda n, at=at: F.ceil(at(n)))}
    out = at_ranks(df, column, by, wanted, store)
    place = lambda q: (F.col("n") - 1) * F.lit(q / 100)
    between = lambda q: (F.ceil(place(q)) - place(q)) * F.col(f"low{q}") + (place(q) - F.floor(place(q))) * F.col(f"high{q}")
    value = lambda q: F.when(F.col(f"low{q}") == F.col(f"high{q}"), F.col(f"low{q}")).otherwise(between(q)).alias(f"p{q:g}")
    return out.select(*by, "n", "min", "max", "mean", *[value(q) for q in qs])
