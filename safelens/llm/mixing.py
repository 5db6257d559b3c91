"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. The whole part of the target over the source's size is how
many copies of each of its documents are certain. The words left are spent on one copy more of some, with
inclusion probabilities in proportion to their size; where that would pass 1 the copy is certain too, and the others share
what is left. For that copy documents are ranked by the odds of a random number over the odds of inclusion, and the best
ranked are taken until the words left are spent, a sample of fixed size with unequal probabilities.
Everything is DataFrame operations.

The cut is found from histograms of ranks, each of the one bin of the last that holds it, and only the last such bin is
ordered. So no task sorts a source with a third of all rows, nor a histogram that grows with the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2.0
#: Bins into which ranks are cut, again and again, until a bin has about BIN_ROWS documents.
BINS, BIN_ROWS = 256, 256
SEED = "pareto-7"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """From (source, source_size): each source's target.

    Weights repeat over the sources by code point, null last. Targets share ``share`` of all words by
    weight and stop at ``most`` times the size; what is over is shared again. Sources in order of size
    over weight reach their stop first, so the stopped ones are a prefix of that order.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    placed = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    placed = placed.withColumns({"cap": F.lit(most) * F.col("source_size"), "total": F.lit(share) * F.sum("source_size").over(Window.partitionBy())})
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    placed = placed.withColumn("level", level).withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    shared = F.min(F.when(~F.col("stops"), F.struct("__at", "level"))).over(Window.partitionBy())["level"]
    placed = placed.withColumn("__at", F.row_number().over(by_ratio)).withColumn("shared", shared)
    # The first source that doesn't stop fixes the level for it and all after it.
    target = F.when(F.col("shared").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("shared") * F.col("weight")))
    return placed.select("source", "source_size", target.cast("double").alias("target"))


def _rank(u: Column, inclusion: Column) -> Column:
    """Pareto's ranking number, odds of u over odds of inclusion, brought into [0, 1): 0 where inclusion is certain."""
    over, under = u * (1 - inclusion), (1 - u) * inclusion
    return over / (over + under)


def inclusions(counts: DataFrame) -> DataFrame:
    """From (key, size, n, left_words), how many documents of a source have a size: key, factor and largest.

    Documents of up to ``largest`` words are included with probability ``factor`` times their size, larger ones with certainty, so that
    the words expected are those left. The largest size for which no probability passes 1 decides.
    """
    down = Window.partitionBy("key").orderBy(F.desc("size"))
    words, squares = F.col("size") * F.col("n"), F.col("size").cast("decimal(38,0)") * F.col("size") * F.col("n")
    summed = counts.filter("size > 0").select("key", "size", "left_words", words.alias("words"), squares.cast("decimal(38,0)").alias("squares"))
    larger = down.rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("words").over(larger), F.lit(0))
    below = F.sum("squares").over(Window.partitionBy("key")) - F.coalesce(F.sum("squares").over(larger), F.lit(0))
    tried = summed.select("key", "size", (F.greatest(F.lit(0.0), F.col("left_words") - above) / below.cast("double")).alias("factor"))
    return tried.filter(F.col("factor") * F.col("size") <= 1).groupBy("key").agg(F.max(F.struct("size", "factor")).alias("c")).select("key", F.col("c.factor").alias("factor"), F.col("c.size").alias("largest"))


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with __key (of the source), __id, __digest and __size. Neither key is ever null."""
    return docs.withColumns({
        "__key": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
        "__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        "__digest": F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")),
        "__size": word_count(F.col("text")),
    })


@dataclass
class Mix:
    """What decides: the groups of equal rows, the plan of each source, and the choice among the few documents at its cut."""

    groups: DataFrame
    plan: DataFrame
    bins: int
    seed: str
    near: DataFrame | None = None

    def ranked(self, rows: DataFrame) -> DataFrame:
        """Rows (__key, __id, __digest, __size, __twin) with the plan of their source, __rank and __bin."""
        out = common.sized_join(rows, self.plan, ["__key"])
        inclusion = F.when(F.col("__size") > F.col("__largest"), F.lit(1.0)).otherwise(F.coalesce(F.col("__factor") * F.col("__size"), F.lit(0.0)))
        u = common.unit_hash(F.lit(self.seed), F.col("__id"), F.col("__digest"), F.col("__twin"))
        out = out.withColumns({"__inclusion": inclusion, "__u": u}).withColumn("__rank", F.when(F.col("__inclusion") > 0, _rank(F.col("__u"), F.col("__inclusion"))))
        return out.withColumn("__bin", F.floor(F.col("__rank") * self.bins).cast("long")).drop("__inclusion", "__u")

    def decided(self, rows: DataFrame) -> DataFrame:
        """The rows with __copies. Only the documents at the cut need a join, with a table that has about BIN_ROWS rows a source."""
        out = common.sized_join(self.ranked(rows), self.near, ["__key", "__id", "__digest", "__twin"], "left")
        more = F.when(F.col("__rank").isNull() | (F.col("__left") <= 0), 0).when(F.col("__cut").isNull() | (F.col("__bin") < F.col("__cut")), 1)  # no cut: rounding
        more = more.when(F.col("__bin") == F.col("__cut"), F.coalesce("__near", F.lit(0))).otherwise(0)
        return out.withColumn("__copies", (F.col("__whole") + more).cast("long"))

    def twins(self, which: str = "true") -> DataFrame:
        """Every row of the groups, numbered from 1."""
        return self.groups.filter(which).withColumn("__twin", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rows")))).drop("__rows")


def pareto_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, bins: int = BINS, seed: str = SEED) -> Mix:
    # Repeated rows are counted before they are numbered, so none of their groups meets in one task.
    groups = _keyed(docs.select("doc_id", "source", "text")).groupBy("__key", "__id", "__digest").agg(F.first("__size").alias("__size"), F.count(F.lit(1)).alias("__rows"))
    groups = common.written(groups, "mix-groups")
    by_size = common.written(groups.groupBy(F.col("__key").alias("key"), F.col("__size").alias("size")).agg(F.sum("__rows").alias("n")), "mix-sizes")
    source = F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30)).alias("source")
    sizes = by_size.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets(sizes.select(source, "source_size"), weights, share, most).withColumn("whole", F.floor(copies + F.lit(1e-12)).cast("long"))
    plan = plan.withColumn("left_words", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = common.written(plan.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source"), "mix-targets")
    included = common.written(inclusions(common.sized_join(by_size, plan.select("key", "left_words"), ["key"])), "mix-included")
    plan = common.sized_join(plan, included, ["key"], "left").select(
        F.col("key").alias("__key"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"),
        F.col("left_words").alias("__left"), F.col("factor").alias("__factor"), F.col("largest").alias("__largest"),
    )
    rows, levels = by_size.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], 1
    while bins**levels * BIN_ROWS < rows and bins ** (levels + 1) < 1 << 52:
        levels += 1
    mix = Mix(groups, common.written(plan, "mix-plan"), bins**levels, seed)
    at = None
    for level in range(1, levels + 1):
        # The histogram of words by rank within the last cut: at most so many rows a source.
        ranked = mix.ranked(mix.twins()).filter(F.col("__rank").isNotNull()).withColumn("__before", F.lit(0))
        if at is not None:
            ranked = common.sized_join(ranked.drop("__before"), at, ["__key"]).filter(F.floor(F.col("__bin") / bins ** (levels - level + 1)) == F.col("__cut"))
        by_bin = ranked.groupBy("__key", F.floor(F.col("__bin") / bins ** (levels - level)).alias("__cut")).agg(F.sum("__size").alias("words"), F.first("__left").alias("left"), F.first("__before").alias("from"))
        before = F.col("from") + F.sum("words").over(Window.partitionBy("__key").orderBy("__cut")) - F.col("words")
        cut = by_bin.withColumn("before", before).filter((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left")))
        at = common.written(cut.groupBy("__key").agg(F.min(F.struct("__cut", "before")).alias("c")).select("__key", "c.__cut", F.col("c.before").alias("__before")), "mix-cut")
    mix.plan = common.written(common.sized_join(mix.plan, at, ["__key"], "left"), "mix-plan")
    order = Window.partitionBy("__key").orderBy("__rank", "__id", "__digest", "__twin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A document is taken if the middle of its words lies before the end of the words left.
    near = mix.ranked(mix.twins()).filter(F.col("__bin") == F.col("__cut")).withColumn("middle", F.col("__before") + F.sum("__size").over(order) - F.col("__size") / 2)
    mix.near = common.written(near.select("__key", "__id", "__digest", "__twin", (F.col("middle") <= F.col("__left")).cast("int").alias("__near")), "mix-near")
    return mix


def pareto_mix(docs: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(rows, plan). rows: doc_id, key of the source, size, source_size, target, taken and copies, one per document.
    plan: per source what decides its copies.

    Null or empty texts have size 0 and take nothing. A null source is a source. Null doc_ids are told
    apart by their texts. Repeated rows are numbered, so each stands for itself. An empty table gives no
    rows. Columns other than doc_id, text and source are ignored.
    """
    mix = pareto_plan(docs, **kw)
    rows = mix.decided(mix.twins())
    rows = rows.select(
        F.when(F.col("__id") != "", F.col("__id")).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("__key").alias("key"),
        F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).cast("long").alias("taken"), F.col("__copies").alias("copies"),
    )
    return rows, mix.plan


def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(common.read(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it (one of no words never).

    Documents are decided where they stand: no text is shuffled. Only rows that repeat doc_id, source and text are numbered, by
    their places in a written table; the copies of such a group are dealt evenly to its rows.
    """
    mix = pareto_plan(docs, **kw)
    # No filter on the size: it would be pushed to the scan, and words counted once more.
    copies = F.when(F.col("__size") > 0, F.col("__copies")).otherwise(0).cast("int")
    repeat = lambda df: df.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
    keyed = _keyed(docs)
    group = ["__key", "__id", "__digest"]
    again = common.written(mix.decided(mix.twins("__rows > 1 AND __size > 0")).groupBy(*group).agg(F.sum("__copies").alias("__total"), F.count(F.lit(1)).alias("__n")), "mix-again")
    if not again.limit(1).count():
        return repeat(mix.decided(keyed.withColumn("__twin", F.lit(1).cast("long"))))
    single = mix.decided(common.sized_join(keyed, again.select(*group), group, "left_anti").withColumn("__twin", F.lit(1).cast("long")))
    twins = common.written(common.sized_join(keyed, again, group).withColumn("__part", F.spark_partition_id()), "mix-twins")
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = common.written(twins.groupBy(*group, "__part").count().select(*group, "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__from")), "mix-offsets")
    place = F.row_number().over(Window.partitionBy(*group, "__part").orderBy("__size")) + F.col("__from") - 1
    numbered = common.sized_join(twins, offsets, [*group, "__part"]).withColumn("__place", place)
    each = F.floor(F.col("__total") / F.col("__n")) + (F.col("__place") < F.col("__total") % F.col("__n")).cast("int")
    return repeat(single).unionByName(repeat(numbered.withColumn("__copies", each)))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest ORDER BY size) AS twin FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1)::INT] AS weight,
      2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
q AS (SELECT *, row_number() OVER w AS ord, (total - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM p WINDOW w AS (ORDER BY cap / weight, source IS NULL, source)),
l AS (SELECT level AS shared FROM q WHERE NOT cap <= level * weight ORDER BY ord LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN (SELECT shared FROM l) IS NULL THEN cap ELSE least(cap, (SELECT shared FROM l) * weight) END AS target FROM q),
h AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS c FROM g),
k AS (SELECT *, floor(c + 1e-12)::BIGINT AS whole FROM h),
m AS (SELECT *, greatest(0, target - whole * source_size) AS left_words FROM k),
b AS (SELECT d.source, d.size, any_value(m.left_words) AS left_words, count(*) AS n FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source WHERE d.size > 0 GROUP BY d.source, d.size),
f AS (SELECT source, size, greatest(0.0::DOUBLE, left_words - coalesce(sum(size * n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(size::HUGEINT * size * n) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS factor FROM b WINDOW w AS (PARTITION BY source ORDER BY size DESC)),
i AS (SELECT source, max(size) AS largest, arg_max(factor, size) AS factor FROM f WHERE factor * size <= 1 GROUP BY source),
u AS (SELECT t.*, m.source_size, m.target, m.whole, m.left_words, CASE WHEN t.size > i.largest THEN 1.0::DOUBLE ELSE coalesce(i.factor * t.size, 0.0::DOUBLE) END AS inclusion,
      (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || digest || ':' || twin), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
      FROM t JOIN m ON t.source IS NOT DISTINCT FROM m.source LEFT JOIN i ON t.source IS NOT DISTINCT FROM i.source),
o AS (SELECT *, CASE WHEN inclusion > 0 THEN u * (1 - inclusion) / (u * (1 - inclusion) + (1 - u) * inclusion) END AS rank FROM u),
n AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, digest, twin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0::DOUBLE AS middle FROM o)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN rank IS NOT NULL AND left_words > 0 AND middle <= left_words THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM n
"""
