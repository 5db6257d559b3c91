"""Codes of vectors: each is cut into parts, each part becomes the index of its codebook's nearest entry.

Codebooks are fitted by Lloyd's rounds with one heap per entry in every block of vectors (Hamerly and Drake, 2015). A part's key is its
lower bound (on the distance to any other entry) less its upper bound (on the distance to its own); as entries drift, only parts whose key the
drift has overtaken are popped and measured against all entries again. All sums and squared distances are of integers, so results are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in a block: as many share their heaps.
BLOCK = 8192
#: Integer components end here, so that squared distances of a part of up to 1,024 components fit in 64 bits.
LIMIT = 1 << 25

_CHANGE = ("part", "entry", "place", "change")
_STATE = "x binary, entry binary, key binary, heap binary"


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x) of every component, within the limit."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def parted(vectors: np.ndarray) -> np.ndarray:
    """(parts, vectors, components): equal consecutive parts, the last filled up with zeros where a length asks for it."""
    width = -(-vectors.shape[1] // PARTS)
    filled = np.pad(vectors, ((0, 0), (0, width * PARTS - vectors.shape[1])))
    return filled.reshape(len(vectors), PARTS, width).swapaxes(0, 1)


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Between the rows of two integer matrices, exactly."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 52:  # every step is then a whole number that a double holds
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - entries[None, :, j]) ** 2
    return out


def measured(x: np.ndarray, entries: np.ndarray, lot: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (ties: the lowest) of each part, and lower bound less upper bound, rounded down."""
    nearest, slack = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for at in range(0, len(x), lot):
        square = squared_distances(x[at : at + lot], entries)
        nearest[at : at + lot] = square.argmin(axis=1)
        if len(entries) > 1:
            upper, lower = np.sqrt(np.partition(square, 1, axis=1)[:, :2].astype(np.float64)).T
            slack[at : at + lot] = lower - upper - 1e-9 * (1 + upper + lower)
    return nearest, slack


def heaps(entry: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The parts by entry, then key: every entry's stretch is ascending, and so is a heap from which the first are popped."""
    return np.lexsort((key, entry)).astype(np.int32)


def popped(heap: np.ndarray, entry: np.ndarray, key: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Parts whose key their entry's drift since the start has overtaken: the first ones of each heap, found by bisection."""
    edges = np.searchsorted(entry[heap], np.arange(len(drift) + 1))
    return np.concatenate([own[: np.searchsorted(key[own], d, side="right")] for own, d in ((heap[a:b], d) for a, b, d in zip(edges, edges[1:], drift, strict=False))])


def advanced(x: np.ndarray, entry: np.ndarray, key: np.ndarray, heap: np.ndarray, codebooks: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, key, heap, parts measured) after the codebooks have moved; entry -1 is a part without one, which is measured first."""
    entry, key, heap, rescanned = entry.copy(), key.copy(), heap.copy(), 0
    for p in range(len(codebooks)):
        again = np.arange(x.shape[1]) if x.shape[1] and entry[p, 0] < 0 else popped(heap[p], entry[p], key[p], drift[p])
        if len(again):
            nearest, slack = measured(x[p][again], codebooks[p])
            entry[p][again], key[p][again] = nearest, slack + drift[p][nearest]
            heap[p] = heaps(entry[p], key[p])
            rescanned += len(again)
    return entry, key, heap, rescanned


def moved_sums(x: np.ndarray, before: np.ndarray, after: np.ndarray, size: int) -> np.ndarray:
    """Rows (part, entry, place, change): what the moves change in entries' sums by component; place -1 counts parts."""
    out = []
    for p in range(len(x)):
        moved = np.flatnonzero(before[p] != after[p])
        change = np.zeros((size, x.shape[2] + 1), np.int64)
        added = np.concatenate([np.ones((len(moved), 1), np.int64), x[p][moved]], axis=1)
        np.add.at(change, after[p][moved], added)
        old = before[p][moved] >= 0
        np.subtract.at(change, before[p][moved][old], added[old])
        e, j = np.nonzero(change)
        out.append(np.stack([np.full(len(e), p), e, j - 1, change[e, j]], axis=1))
    return np.concatenate(out)


def stepped(codebooks: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New entries (the floor of their parts' mean; unused ones stay), and what each heap's drift grows by: its own move and the farthest of the others'."""
    used = counts > 0
    new = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], codebooks)
    move = np.sqrt(((new - codebooks).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-12)
    ranked = np.sort(move, axis=1)
    farthest, second = ranked[:, -1:], ranked[:, -2:-1] if move.shape[1] > 1 else 0.0
    others = np.where(np.arange(move.shape[1])[None] == move.argmax(axis=1)[:, None], second, farthest)
    return new, (move + others) * (1 + 1e-12)


def _finite(vector):
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))


def _lists(columns: list[pa.Array], m: int) -> list[pa.Array]:
    """Each column as one list of its m values."""
    return [pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), c) for c in columns]


def _blocks(kept: DataFrame, size: int, block: int, ids: str) -> DataFrame:
    """Rows of up to ``block`` vectors: their ids and labels, and their parts, entries (-1), keys and heaps as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            for at in range(0, len(table), block):
                here = table.slice(at, block).combine_chunks()
                m, one = len(here), lambda c, here=here: here.column(c).chunk(0)
                x = parted(whole_numbers(one("embedding").flatten().to_numpy(zero_copy_only=False).reshape(m, size)))
                state = [np.ascontiguousarray(x, np.int32), np.full((PARTS, m), -1, np.int16), np.zeros((PARTS, m)), np.tile(np.arange(m, dtype=np.int32), (PARTS, 1))]
                yield pa.RecordBatch.from_arrays([*_lists([one("vec_id"), one("label")], m), *[pa.array([s.tobytes()], pa.binary()) for s in state]], names=["vec_id", "label", "x", "entry", "key", "heap"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                yield from flush(held)
                held = []
        if sum(b.num_rows for b in held):
            yield from flush(held)
        common.give_back()

    return kept.select("vec_id", "label", "embedding").mapInArrow(run, f"{ids}, {_STATE}")


def _state(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    """x, entry, key and heap of a block, by part."""
    kinds = {"x": np.int32, "entry": np.int16, "key": np.float64, "heap": np.int32}
    x, *rest = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in kinds.items())
    m = len(rest[0]) // PARTS
    return [x.reshape(PARTS, m, len(x) // max(1, PARTS * m)).astype(np.int64), *[r.reshape(PARTS, m) for r in rest]]


def _round(state: DataFrame, codebooks: np.ndarray, drift: np.ndarray, ids: str) -> DataFrame:
    """The state after all parts have their nearest entries, and ``change``, the rows of ``moved_sums``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, changes = {"entry": [], "key": [], "heap": []}, []
            for i in range(batch.num_rows):
                x, entry, key, heap = _state(batch, i)
                new = dict(zip(out, advanced(x, entry, key, heap, codebooks, drift)[:3], strict=True))
                changes.append(moved_sums(x, entry, new["entry"], codebooks.shape[1]))
                for c, v in new.items():
                    out[c].append(v.astype(np.int16).tobytes() if c == "entry" else v.tobytes())
            rows = np.concatenate([np.empty((0, 4), np.int64), *changes])
            change = pa.StructArray.from_arrays([pa.array(rows[:, j]) for j in range(4)], names=list(_CHANGE))
            change = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, changes)]), pa.int32()), change)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), *[pa.array(v, pa.binary()) for v in out.values()], change], names=["vec_id", "label", "x", *out, "change"])
        common.give_back()

    return state.select("vec_id", "label", "x", "entry", "key", "heap").mapInArrow(run, f"{ids}, {_STATE}, change array<struct<{', '.join(f'{c}: bigint' for c in _CHANGE)}>>")


def _coded(state: DataFrame, codebooks: np.ndarray, drift: np.ndarray, id_type: str, label_type: str) -> DataFrame:
    """vec_id, label, code and error of every vector by the final codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, entry, key, heap = _state(batch, i)
                entry = advanced(x, entry, key, heap, codebooks, drift)[0]
                error = sum(((x[p] - codebooks[p][entry[p]]) ** 2).sum(axis=1) for p in range(PARTS))
                digits = entry.astype(np.uint8).T.tobytes().hex()
                one = lambda c, i=i: batch.column(c).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([one("vec_id"), one("label"), pa.array([digits[k : k + 2 * PARTS] for k in range(0, len(digits), 2 * PARTS)], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
        common.give_back()

    return state.mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error long")


def fitted(kept: DataFrame, size: int, n: int, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of ``n`` vectors of length ``size``, and the codebooks that the rounds end with."""
    spark = kept.sparkSession
    id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    ids = f"vec_id array<{id_type}>, label array<{label_type}>"
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    codebooks = parted(whole_numbers(np.array([r["embedding"] for r in first], np.float64)))
    tasks = min(math.ceil(n / block), max(spark.sparkContext.defaultParallelism, math.ceil(n / (32 * block))))
    dealt = kept if kept.rdd.getNumPartitions() >= tasks else kept.repartition(tasks)
    state = common.written(_blocks(dealt, size, block, ids), "codes-blocks")
    shape = codebooks.shape[:2]
    sums, drift = np.zeros((*shape, codebooks.shape[2] + 1), np.int64), np.zeros(shape)
    for _ in range(rounds):
        before, state = state, common.written(_round(state, codebooks, drift, ids), "codes-state")
        common.discard(before)
        changes = state.select(F.inline("change")).groupBy("part", "entry", "place").agg(F.sum("change").alias("change"))
        for r in changes.collect():  # at most a row for each number of the codebooks
            sums[r["part"], r["entry"], r["place"] + 1] += r["change"]
        codebooks, grown = stepped(codebooks, sums[..., 0], sums[..., 1:])
        drift = drift + grown
    coded = common.written(_coded(state, codebooks, drift, id_type, label_type), "codes")
    common.discard(state)
    return coded, codebooks


def encode(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null, empty or of another length than most (ties: the longest), or that hold null or non-finite components, are dropped. Codebooks start
    from the ``entries`` (at most 256) smallest vec_ids (nulls last; rows that share one are taken by their vectors); fewer vectors make fewer entries. A length
    that is no multiple of four is filled up with zeros. Components end at 2 ** 15 in size. Null labels are one label; repeated rows each count and give a row; an
    empty table gives no rows. Columns other than vec_id, embedding and label are ignored.
    """
    if not 1 <= entries <= ENTRIES:
        raise ValueError(f"entries must be from 1 to {ENTRIES}: a code has two hex digits a part")
    kept = rows.select("vec_id", "label", "embedding").filter(_finite(F.col("embedding")) & (F.size("embedding") > 0))
    lengths = kept.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not lengths:
        empty = kept.limit(0)
        return empty.selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    size, n = lengths[0]["size"], lengths[0]["n"]
    coded, codebooks = fitted(kept.filter(F.size("embedding") == size), size, n, entries, rounds, block)
    digest = hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
    same = {"__label": F.coalesce(F.col("label").cast("string"), F.lit("")), "__null": F.col("label").isNull()}
    coded = coded.withColumns(same)
    sums = coded.groupBy(*same).agg(F.sum("error").alias("label_error"))
    out = common.sized_join(coded, sums, list(same))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.read(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Lloyd's rounds over lists of integers, a common table expression each."""
    assign = lambda k: f"""a{k} AS MATERIALIZED (
  SELECT vec_id, label, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT r, v.vec_id, v.label, v.part, v.x, b.entry, list_sum([(x[j] - c[j]) * (x[j] - c[j]) for j in range(1, len(x) + 1)])::BIGINT AS d FROM parts v JOIN b{k} b ON v.part = b.part)
  GROUP BY r, vec_id, label, part, x)"""  # noqa: E731
    update = lambda k: f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(floor_div ORDER BY j) AS c FROM (
      SELECT part, entry, j, (s - ((s % n) + n) % n) // n AS floor_div FROM (
        SELECT part, entry, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM parts))) AS j) GROUP BY part, entry, j))
    GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)"""  # noqa: E731
    steps = ",\n".join(f"{assign(k)},\n{update(k)}" for k in range(ROUNDS))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [floor({SCALE} * e::DOUBLE)::BIGINT for e in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
parts AS MATERIALIZED (SELECT r, vec_id, label, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS part)),
b0 AS (SELECT part, r - 1 AS entry, x AS c FROM parts WHERE r <= {ENTRIES}),
{steps},
{assign(ROUNDS)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""


ORACLE_SQL = _oracle()
