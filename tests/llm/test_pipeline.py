import random

import pytest
from pyspark.sql import functions as F

from test_small_ops import ODD, slow_near


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A corpus with junk, near copies, leaks and a hot source."""
    at = tmp_path_factory.mktemp("sf")
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 2000)}"
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    rows, kind = [], {}
    for d in range(240):
        words = [word() for _ in range(rng.randint(30, 120))]
        kind[d] = "clean"
        if d % 8 == 1:
            kind[d], words = "junk", [w.upper() + "!!" for w in words]
        elif d % 8 == 2:
            kind[d] = "leak"
            words[10:10] = items[d % 5][1].split()
        elif d % 8 == 3 and rows and kind[d - 3] == "clean":
            kind[d], words = "copy", rows[d - 3][1].split()
            words[-1] = "changed"
        rows.append((d, " ".join(words), "en", "hot" if d % 3 else f"s{d % 4}", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, int(kind[d] != "junk"), 0) for d in range(0, 240) if d % 2], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, kind


def test_every_stage(spark, tables):
    import corpus_pipeline

    at, rows, kind = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, at).cache()
        kept[name] = sorted(r.doc_id for r in docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "minhash_near_dedup":
            assert kept[name] == sorted(i for i, _, _, own in slow_near([(r.doc_id, r.text) for r in before], 5, 80) if own)
    assert kept["quality_classifier"] == [d for d in kind if kind[d] != "junk"]
    assert kept["benchmark_decontamination"] == [d for d in kept["minhash_near_dedup"] if kind[d] != "leak"]
    assert set(kept["source_mixing"]) <= set(kept["benchmark_decontamination"]) and max(map(kept["source_mixing"].count, set(kept["source_mixing"]))) <= 2
    assert kept["jump_sharding"] == kept["source_mixing"]
    for r in docs.groupBy("shard").agg(F.collect_list("slot").alias("slots")).collect():
        assert sorted(r.slots) == list(range(len(r.slots)))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, at).collect()) == kept["jump_sharding"]


def test_stages_take_odd_rows(spark, tables, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns, through every stage; and an empty table."""
    import corpus_pipeline

    at, rows, kind = tables
    some = [(d, t, "en", s, 1, 7, 7, 0.5, "x") for d, t, _, s, _ in rows if kind[d] == "clean"][:40]
    odd = [(1000 + i if i is not None else None, t, "en", s, 1, 7, 7, 0.5, "x") for i, t, s in ODD]
    docs = spark.createDataFrame(some + odd, "doc_id long, text string, lang string, source string, n_chars long, shard int, kept int, score double, component_id string")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), at)
        assert empty.count() == 0
        docs = stage(spark, docs, at).cache()
        got = [(r.doc_id, r.text) for r in docs.collect()]
        if name == corpus_pipeline.STAGES[-1][0]:
            assert set(docs.columns) == {*columns, "slot"} and sorted(map(str, got)) == sorted(map(str, before))
        else:
            assert docs.columns == columns
        if name == "minhash_near_dedup":
            ids = [i for i, _ in got if i is not None]
            assert len(ids) == len(set(ids)) and got.count((None, "one")) == 1
        if name == "source_mixing":
            assert all((t or "").split() for _, t in got) and {i for i, _ in got} <= {i for i, _ in before}
        elif name == "benchmark_decontamination":
            assert sorted(map(str, got)) == sorted(map(str, before))  # none of them holds an item
        before = got


def test_decontamination_is_fitted_on_all_that_came_before(spark, tables, monkeypatch):
    import corpus_pipeline
    from safelens.llm import decontaminate

    at, rows, kind = tables
    fitted, space = [], decontaminate.latent_space
    monkeypatch.setattr(decontaminate, "latent_space", lambda passages, texts, weight: fitted.append(texts.count()) or space(passages, texts, weight))
    many = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.xxhash64("id", F.lit(k)) % 2000) for k in range(30)]).alias("text"))
    docs = many.unionByName(spark.createDataFrame([(3000 + r[0], r[1]) for r in rows], "doc_id long, text string"))
    kept = {r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, docs, at).collect()}
    assert fitted == [2500 + len(rows)]
    assert kept == set(range(2500)) | {3000 + d for d in kind if kind[d] != "leak"}
