"""Deduplication, seeded shuffles, stratified samples and splits. Shuffles are orders of a hash, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, strip

KEY_CHARACTERS = 1000


def shuffled_by(seed: int, key: str | Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def text_key(text: Column) -> Column:
    """Lower case, whitespace collapsed, the first 1000 code points."""
    return F.left(strip(F.regexp_replace(F.lower(text), SPACE + "+", " ")), F.lit(KEY_CHARACTERS))


def first_of_each(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in scan order."""
    place = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    return df.withColumn("__key", key).withColumn("__place", place).filter("__place = 1").drop("__key", "__place")


def top_of_each(df: DataFrame, stratum: str, seed: int, key: str, n: int | Column) -> DataFrame:
    """At most n rows of each stratum, by hash. Spark cuts every stratum before its shuffle (WindowGroupLimit)."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(shuffled_by(seed, key), key))
    return df.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def balanced_sample(df: DataFrame, stratum: str, key: str, limit: int, seed: int = 7, strata: int = 4) -> DataFrame:
    """Equal parts of each stratum; what a small one lacks is filled from the others; ``ord`` is the final order."""
    target = max(1, limit // strata)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(shuffled_by(seed, key), key))
    # No more than limit rows of a stratum can ever be used, so the rest goes before anything global.
    ranked = df.withColumn("__place", place).filter(F.col("__place") <= target + limit)
    ranked = ranked.withColumn("__later", F.col("__place") > target)
    chosen = ranked.orderBy("__later", F.when(F.col("__later"), shuffled_by(seed + 1, key)).otherwise(F.lit("")), F.when(~F.col("__later"), F.col("__place")), key)
    taken = chosen.limit(limit) if limit else chosen
    order = F.row_number().over(Window.orderBy(shuffled_by(seed + 2, key), key))
    return taken.withColumn("ord", order).drop("__place", "__later")


def binary_sample(df: DataFrame, gold: str, key: str, limit: int, seed: int = 7) -> DataFrame:
    """The first half of the limit of either class."""
    return top_of_each(df.filter(F.col(gold).isin(0, 1)), gold, seed, key, limit // 2)


def auto_balanced(df: DataFrame, stratum: str, key: str, per_label: int, seed: int = 42) -> DataFrame:
    """As many of each stratum as the smallest has, at most ``per_label``."""
    least = df.groupBy(stratum).count().agg(F.least(F.min("count"), F.lit(per_label)).alias("__n"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(shuffled_by(seed, key), key))
    ranked = df.withColumn("__place", place).filter(F.col("__place") <= per_label)
    return ranked.crossJoin(F.broadcast(least)).filter("__place <= __n").drop("__place", "__n")  # one row


def place_within(df: DataFrame, stratum: str, seed: int, key: str, name: str) -> DataFrame:
    """Number the rows of each stratum by hash. Bins of the hash are counted and only they are sorted, never a whole stratum."""
    hashed = df.withColumn("__h", shuffled_by(seed, key)).withColumn("__bin", F.left("__h", F.lit(3)))
    counted = hashed.groupBy(stratum, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(stratum).orderBy("__bin")) - F.col("__n")
    size = F.sum("__n").over(Window.partitionBy(stratum))
    offsets = counted.select(F.col(stratum).alias("__s"), F.col("__bin").alias("__b"), before.alias("__before"), size.alias("__size"))
    inside = F.row_number().over(Window.partitionBy(stratum, "__bin").orderBy("__h", key))
    out = hashed.withColumn("__inside", inside).join(offsets, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__bin") == F.col("__b")))
    return out.withColumn(name, F.col("__before") + F.col("__inside")).drop("__h", "__bin", "__inside", "__s", "__b", "__before")


def stratified_split(df: DataFrame, gold: str, key: str, seed: int = 7) -> DataFrame:
    """``is_fit`` for the first half, rounded down, of each shuffled class."""
    placed = place_within(df, gold, seed, key, "__place")
    return placed.withColumn("is_fit", F.col("__place") <= F.floor(F.col("__size") / 2)).drop("__place", "__size")
