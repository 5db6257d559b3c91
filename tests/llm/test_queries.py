"""Every registered query runs over the driver's smallest tables; those that SQL expresses give the rows of their SQL."""

import math
import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from safelens.llm import registry
from test_small_ops import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
COLUMNS = {
    "op1_character_ratio": ["page_id", "host", "path", "rule", "verdict"],
    "op2_latent_retrieval": ["doc_id", "item_id"],
    "op3_pareto_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_hilbert_windows": ["query_id", "rank", "vec_id", "score"],
    "op5_preference_pairs": ["pair_id", "prompt_turns", "prompt", "chosen", "chosen_spans", "rejected", "rejected_spans"],
    "op6_multi_index_hamming": ["doc_id", "n_shingles", "component_id", "kept"],
    "op7_jump_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_cross_entropy_difference": ["doc_id", "n_words", "of_target", "target_loss", "background_loss", "difference"],
    "op9_fourier_quality": ["doc_id", "held_out", "score", "predicted"],
    "op10_randomness_battery": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op11_all_lag_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12_revisit_resolution": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op13_heap_lloyd": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
}


@pytest.fixture(scope="module")
def found(spark):
    """The columns and rows of each query, run once."""
    cache = {}

    def of(name):
        if name not in cache:
            df = registry.queries()[name](spark, SF)
            cache[name] = df.columns, df.collect()
        return cache[name]

    return of


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_are_those_of_the_sql(found, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    columns, rows = found(name)
    assert sorted(names) == sorted(columns)
    assert sorted(tuple(cell(r[n]) for n in names) for r in rows) == sorted(tuple(map(cell, r)) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_columns_and_rows(spark, found, name):
    columns, rows = found(name)
    assert columns[: len(COLUMNS[name])] == COLUMNS[name]
    if name.split("_")[0] in ("op3", "op6", "op7", "op8", "op9", "op10", "op11"):
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_shards_hold_gapless_slots(spark, found):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    slots = {}
    for r in found("op7_jump_sharding")[1]:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id])) and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_neighbours_against_every_vector(spark, found):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding and None not in r.embedding and any(r.embedding)]
    want = brute(rows, [(i, v) for i, v in rows if i % 100 == 0], 10)
    got = {q: {} for q in want}
    for r in found("op4_hilbert_windows")[1]:
        got[r.query_id][r.vec_id] = r.score
    assert sum(i in got[q] for q in want for _, i in want[q]) >= 0.9 * sum(map(len, want.values()))
    exact = {q: {i: s for s, i in near} for q, near in want.items()}
    assert all(math.isclose(s, exact[q][i], rel_tol=1e-12) for q in got for i, s in got[q].items() if i in exact[q])


def test_quality_separates_labels_that_were_held_out(spark, found):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").filter(F.col("quality").isNotNull()).collect()}
    held = [(r.score, quality[r.doc_id]) for r in found("op9_fourier_quality")[1] if r.held_out and r.doc_id in quality]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found("op9_fourier_quality")[1])
    assert not good or not bad or sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad) > 0.85
