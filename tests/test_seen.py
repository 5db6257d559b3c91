"""Keep-first over increments and over streams, against one run over everything."""

import random
import time

import pytest
from pyspark.sql import functions as F

from safelens.operators import seen
from safelens.streaming import first_seen as S


@pytest.mark.parametrize("expected", [10_000, 40])
def test_increments_give_the_rows_of_one_run(spark, tmp_path, monkeypatch, expected):
    """With 40 expected keys the filter is all but full, and nearly every key is looked up."""
    monkeypatch.setattr(seen, "BROADCAST_KEYS", 50)
    rng = random.Random(expected)
    rows = [(i, rng.choice(["k%d" % rng.randint(0, 500), "k%d" % rng.randint(0, 5), None, ""]), i % 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k string, part int")
    corpus = seen.SeenCorpus(spark, f"{tmp_path}/c", expected)
    assert corpus.rows() is None
    sizes = [corpus.add(df.filter(F.col("part") == p), F.col("k"), "id").count() for p in range(3)]
    got = sorted((r.id, r.run) for r in corpus.rows().collect())
    want = {}
    for i, k, p in sorted(rows, key=lambda r: (r[2], r[0])):
        want.setdefault(("n", "") if k is None else ("k", k), (i, p))
    assert got == sorted(want.values()) and sizes == [sum(p == q for _, q in want.values()) for p in range(3)]
    assert corpus.add(df, F.col("k"), "id").count() == 0 and corpus.add(df.limit(0), F.col("k"), "id").count() == 0


def test_a_run_that_broke_off_is_written_anew(spark, tmp_path):
    corpus = seen.SeenCorpus(spark, f"{tmp_path}/c", 100)
    df = spark.createDataFrame([(i, str(i % 7)) for i in range(30)], "id int, k string")
    corpus.add(df.filter("id < 3"), F.col("k"), "id")
    df.withColumn("digest", F.lit("x")).write.parquet(f"{tmp_path}/c/rows/run=1")  # no filter: it doesn't count
    assert sorted(r.id for r in corpus.add(df, F.col("k"), "id").collect()) == [3, 4, 5, 6] and corpus.rows().count() == 7
    reopened = seen.SeenCorpus(spark, f"{tmp_path}/c", 100_000)
    assert sorted(r.id for r in reopened.add(df.withColumn("k", F.col("id").cast("string")), F.col("k"), "id").collect()) == list(range(7, 30))
    assert reopened.add(df, F.col("k"), "id").count() == 0


def test_the_filter_forgets_no_key_and_rules_out_most_others(spark):
    keys = spark.range(9000).select(seen._digest(F.col("id")).alias("digest"))
    bits = seen.bloom_filter(keys.limit(9000).repartition(5), 3)
    check = spark.range(30000).select("id", seen._digest(F.col("id")).alias("digest")).withColumn("block", seen._block(F.col("digest"), 3)).join(bits, "block", "left")
    found = check.groupBy((F.col("id") < 9000).alias("known")).agg(F.count_if(seen.may_hold(F.col("bits"), F.col("digest"))).alias("hits"), F.count(F.lit(1)).alias("n")).collect()
    hits = {r.known: (r.hits, r.n) for r in found}
    assert hits[True] == (9000, 9000) and hits[False][0] < 0.03 * hits[False][1]


# --- streams -------------------------------------------------------------------------------------


def slow_kept(rows, horizon):
    last, out = {}, []
    for at, key, i in sorted(rows, key=lambda r: (r[0], str(r[2]))):
        if key not in last or at - last[key] > horizon:
            out.append(i)
            last[key] = at
    return sorted(out)


def some_events(rng, n):
    return [(rng.randint(0, 3 * 86400) if rng.random() < 0.9 else 5000, rng.choice(["hot", "hot", "a", "b", "c%d" % rng.randint(0, 30)]), i) for i in range(n)]


def test_batch_keeps_one_in_a_horizon(spark):
    rows = some_events(random.Random(1), 600)
    df = spark.createDataFrame(rows, "at int, k string, id int").select(F.timestamp_seconds("at").alias("ts"), "k", F.format_string("%04d", "id").alias("id"))
    got = S.first_seen_batch(df, "k", "ts", 7200)
    assert got.columns == df.columns and sorted(r.id for r in got.collect()) == slow_kept([(a, k, f"{i:04d}") for a, k, i in rows], 7200)


def test_stream_keeps_what_the_table_keeps(spark, tmp_path):
    """Files hold some hours each, shuffled, with repeats and stragglers that the watermark allows."""
    rng = random.Random(2)
    rows = sorted(some_events(rng, 400))
    late = [(at + rng.randint(-1500, 1500), at, k, i) for at, k, i in rows]  # when it arrives
    late.sort()
    parts = [late[i : i + 80] for i in range(0, len(late), 80)]
    end = [(10 * 86400, 10 * 86400, "end", 9999), (11 * 86400, 11 * 86400, "end", 9998)]  # moves the watermark past all others
    before = spark.conf.get(S.STATE_STORE[0], None)
    spark.conf.set(*S.STATE_STORE)
    try:
        for part in [*parts, end[:1], end[1:]]:
            df = spark.createDataFrame([(a, k, f"{i:04d}") for _, a, k, i in part], "at int, k string, id string").coalesce(1)
            df.select(F.timestamp_seconds("at").alias("ts"), "k", "id").write.mode("append").parquet(f"{tmp_path}/in")
            time.sleep(0.05)  # files are read in the order of their times
        source = spark.readStream.schema("ts timestamp, k string, id string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = S.first_seen(source, "k", "ts", 7200, "1 hour").writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(240)
        got = sorted(r.id for r in spark.table("firsts").filter("k <> 'end'").collect())
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.unset(S.STATE_STORE[0]) if before is None else spark.conf.set(S.STATE_STORE[0], before)
    assert got == slow_kept([(a, k, f"{i:04d}") for a, k, i in rows], 7200)
    assert state < 20  # what the keys held is gone
