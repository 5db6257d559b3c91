"""Ranks by brackets, temperatures by bounds, literal gates of the rules, and figures of the run itself."""

import math
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from safelens.functions import rules
from safelens.functions.scoring import HARMFUL_WORDS, INJECTION_WORDS, LexiconScorer
from safelens.operators import calibrate as G
from safelens.operators import diagnostics as X
from safelens.operators import metrics as A
from safelens.operators import ranks
from safelens.operators.cascade import spread


def slow_percentile(values, q):
    at = (len(values) - 1) * q / 100
    low, high = math.floor(at), math.ceil(at)
    return values[low] if values[low] == values[high] else (high - at) * values[low] + (at - low) * values[high]


@pytest.mark.parametrize("groups", [ranks.GROUPS, 2])
def test_ranks_are_those_of_sorted_values(spark, monkeypatch, groups):
    monkeypatch.setattr(ranks, "GROUPS", groups)
    monkeypatch.setattr(ranks, "ACCURACY", 500)  # brackets are a small part of the largest groups
    rng = random.Random(5)
    rows = [("even", rng.gauss(0, 1)) for _ in range(30000)] + [("hot", rng.choice([1.0, 2.0, 2.0, 2.0])) for _ in range(9000)] + [("far", rng.choice([0.0, -0.0, 1e300, -1e300, rng.random()])) for _ in range(5000)]
    rows += [("one", 7.0), ("two", 1.0), ("two", 4.0), (None, 3.0), (None, 5.0), ("none", None), ("odd", float("nan")), ("odd", 1.0), ("odd", float("inf")), ("odd", float("-inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: r for r in A.nearest_rank(df, "v", "k").collect()}
    cent = {r.k: r for r in A.percentiles(df, "v", ("k",), (0, 1, 50, 95, 100), store=groups == 2).collect()}
    assert set(got) == {"even", "hot", "far", "one", "two", None, "odd"} == set(cent)
    for k in got:
        values = sorted((v for g, v in rows if g == k), key=lambda v: (math.isnan(v), v))
        n = len(values)
        same = lambda a, b: a == b or math.isnan(a) and math.isnan(b)
        assert got[k].n == n and all(same(a, values[n * i // 4]) for i, a in enumerate((got[k].q1, got[k].median, got[k].q3), 1)) and same(got[k].max, values[-1])
        if k != "odd":
            assert [cent[k][f"p{q}"] for q in (0, 1, 50, 95, 100)] == [slow_percentile(values, q) for q in (0, 1, 50, 95, 100)]


def test_no_values_have_no_latency(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, v double")
    assert sorted(map(tuple, A.latency(df, "v", ("k",)).collect())) == [("a", None, 0.0, 0.0, None), ("b", 2.0, 2.0, 2.0, 2.0)]
    assert tuple(A.latency(df.limit(0), "v").first()) == (None, 0.0, 0.0, None)


def slow_best(rows, temperatures):
    def loss(t):
        total = 0.0
        for z, y in rows:
            p = min(max(1 / (1 + math.exp(-z / t)), 1e-7), 1 - 1e-7) if -z / t < 700 else 1e-7
            total -= math.log(p) if y else math.log(1 - p)
        return total / len(rows)

    losses = [loss(t) for t in temperatures]
    return temperatures[losses.index(min(losses))], losses


@pytest.mark.parametrize("kind", ["plain", "saturated", "all right", "outlier", "one row"])
def test_temperatures_are_those_of_the_whole_grid(spark, kind):
    rng = random.Random(kind)
    rows = [(rng.gauss(2 if y else -2, 2.5), y) for y in (rng.randint(0, 1) for _ in range(700))]
    if kind == "saturated":  # few errors, all of them certain: the cut-off makes the smallest temperature best
        rows = [(4.0 * (1 if y else -1) * (-1 if rng.random() < 0.001 else 1), y) for _, y in rows] + [(-4.0, 1)]
    if kind == "all right":
        rows = [(abs(z) if y else -abs(z), y) for z, y in rows]
    if kind == "outlier":
        rows += [(1e300, 1), (-1e300, 0), (1e6, 0)]
    if kind == "one row":
        rows = [(0.0, 1)]
    df = spark.createDataFrame(rows, "z double, y int")
    best, losses = slow_best(rows, G.TEMPERATURES)
    cells = G._cells(df, z=F.col("z"), y=F.col("y").cast("double"))
    for r in G.loss_bounds(G._bins(cells), G.TEMPERATURES).collect():
        assert r.least <= losses[r.ord] * (1 + 1e-9) + 1e-12 and losses[r.ord] <= r.most * (1 + 1e-9) + 1e-12
    fine = [best, *(max(0.01, best - 0.05 + 0.1 * i / 49) for i in range(50))]
    _, last = slow_best(rows, fine)
    assert last[fine.index(G.fit_temperature(df, F.col("z"), F.col("y")))] == pytest.approx(min(last), rel=1e-12, abs=1e-15)


def test_no_margins_have_temperature_one(spark):
    assert G.fit_temperature(spark.createDataFrame([(None, 1)], "z double, y int"), F.col("z"), F.col("y")) == 1.0


# --- rules ---------------------------------------------------------------------------------------


def test_literals_of_patterns():
    assert rules.required_literals("ab(c|d)?ef") in (("ab",), ("ef",)) and rules.required_literals("(abc|d+)x*") == ("abc", "d") and rules.required_literals("a?b*") == ()
    assert rules.required_literals("(?:abcdef){2,}x") == ("abcdef",) and rules.required_literals("[ab]c.defgh") == ("defgh",)
    assert all(rules.required_literals(p) for p in rules.ATTACK_PATTERNS + rules.MODERATION_PATTERNS)


def test_gated_patterns_hit_what_whole_patterns_hit(spark):
    rng = random.Random(6)
    parts = ["ignore ", "all ", "previous ", "rule", "show ", "the ", "hidden ", "prompt", "jailbreak", " mode", "you are ", "now ", "dan", "<|", "system", "|>", "[inst]", "[/sys]", "<<sys>>", "how to ", "make ", "a ", "bomb", "write ", "me ", "virus", "ways to ", "commit suicide", "minor", "…", "nude", "describe ", "graphic ", "sexual", "ıgnore ", "hidden ", "ſystem", "ways to Kill myself", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(6000)] + [None, "", "you are jaılbroken", "[ınst]", "how to buıld a weapon", "underage porn", "show prompt"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("t", F.lower("t"))
    both = [(rules.matches(F.col("t"), p), F.coalesce(F.col("t").rlike(rules.any_of(p)), F.lit(False))) for p in (rules.ATTACK_PATTERNS, rules.MODERATION_PATTERNS)]
    rows = df.select("t", *[F.coalesce(c, F.lit(False)).alias(f"c{i}{j}") for i, pair in enumerate(both) for j, c in enumerate(pair)]).collect()
    assert [r.t for r in rows if r.c00 != r.c01 or r.c10 != r.c11] == []
    assert sum(r.c00 for r in rows) > 300 and sum(r.c10 for r in rows) > 50


def test_gated_lexicons_count_what_whole_ones_count(spark):
    words = ["idiot", "idiots", "an idiot", "bypass", "bypassed", "system prompt", "x"]
    rng = random.Random(7)
    df = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))),) for _ in range(300)] + [(None,)], "t string")
    for names in (INJECTION_WORDS, HARMFUL_WORDS):
        plain = F.regexp_count("t", F.lit(rf"\b(?:{'|'.join(names)})\b")).cast("double")
        assert df.filter(~LexiconScorer()._hits(F.col("t"), names).eqNullSafe(plain)).count() == 0


# --- runs ----------------------------------------------------------------------------------------


def test_timing_computes_every_column(spark):
    def slow(x: pd.Series) -> pd.Series:
        time.sleep(0.05 * len(x))
        return x

    slow.__module__ = "__main__"
    df = spark.range(40).repartition(4).withColumn("y", F.pandas_udf(slow, "long")("id"))
    rows, found = X.timed(df)
    assert rows == 40 and found["avg_ms_per_row"] >= 12 and found["rows_per_second"] < 85


def test_few_tasks_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    one, counted = spark.range(10).coalesce(1), spark.range(10).groupBy("id").count()
    assert spread(counted) is counted
    assert spread(one).rdd.getNumPartitions() == cores and spread(one, 2).rdd.getNumPartitions() == 2
    many = spark.range(0, 100, 1, cores + 3)
    assert spread(many) is many
