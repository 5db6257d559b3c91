"""Periodic runs of words, found by holding each text against itself at every lag.

The word numbers of a text are compared with themselves shifted by 1, 2, ... up to n / MIN_EXP, many lags in one step, and
the stretches where both agree are measured. A text whose lags are more than a task should compare is dealt out in ranges of lags.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A run has at least so many words, and at least so many periods.
LEAST, MIN_EXP = 12, 2
#: Comparisons in one range of lags.
LOT = 1 << 30
#: Comparisons made in one step: as many truth values are held at a time, or one lag's where that has more.
STEP = 1 << 19
#: From this lag on a stretch that makes a run has at least 15 words, and so fills an aligned word of 8.
FILLS = 15
#: Texts of so few words are compared at all lags in one step.
SMALL = 400

_ROW = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def word_numbers(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and a number for each: equal words have equal numbers."""
    words, seen = (text or "").encode().split(), {}
    return words, np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def repeated_from(n: int, h: int | None) -> np.ndarray:
    """Which original word stands at each place: for one doc_id in ten, a stretch is repeated up to the end."""
    at = np.arange(n)
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def stretches(ids: np.ndarray, first: int = 1, last: int | None = None) -> np.ndarray:
    """Rows (start, length, period): all maximal stretches of a lag from ``first`` to before ``last`` that are long enough for runs.

    A run is found at its period, and again at multiples of it.
    """
    n = len(ids)
    last = min(n // MIN_EXP + 1, last if last is not None else n)
    out, lag = [np.empty((0, 3), np.int64)], first
    padded = np.concatenate([ids, np.full(last + 1, -1, ids.dtype)])
    while lag < last and n >= LEAST:
        width = n - lag + 1  # the last column is past the end in every row, so that rows part stretches
        rows = max(1, min((last if lag >= FILLS or n <= SMALL else min(last, FILLS)) - lag, STEP // width))
        equal = np.lib.stride_tricks.sliding_window_view(padded[lag : lag + rows - 1 + width], width) == ids_of(ids, width)
        lags = np.arange(lag, lag + rows)
        if lag >= FILLS:  # stretches are so long that they fill eight truth values that lie in one machine word
            flat = equal.reshape(-1)
            filled = np.flatnonzero(flat[: len(flat) // 8 * 8].view(np.uint64) == 0x0101010101010101)
            some = np.unique(filled * 8 // width)
            equal, lags = equal[some], lags[some]
        hits = np.flatnonzero(equal)
        if len(hits):
            edge = np.flatnonzero(np.diff(hits) != 1)
            begin, end = hits[np.concatenate([[0], edge + 1])], hits[np.concatenate([edge, [len(hits) - 1]])]
            agree = end - begin + 1
            row, place = np.divmod(begin, width)
            period = lags[row]
            long = agree >= np.maximum(LEAST - period, (MIN_EXP - 1) * period)
            out.append(np.stack([place, agree + period, period], axis=1)[long])
        lag += rows
    return np.concatenate(out)


def ids_of(ids: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` numbers; one more than there are is no word's."""
    return ids[:width] if width <= len(ids) else np.concatenate([ids, np.full(width - len(ids), -2, ids.dtype)])


def runs_of(found: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) by start, then period: of equal stretches only that of the smallest period is a run."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):
        found = found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def described(words: list[bytes], runs: np.ndarray) -> tuple:
    """What is returned of a document: its runs, the longest of them, and its words without repeats."""
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    kept = b" ".join([words[i] for i in np.flatnonzero(np.cumsum(dropped)[: len(words)] == 0)])
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    top = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (len(runs), *top, 1000 * top[1] // top[2] if len(runs) else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _ROW.split(", ")])
    return out.astype({c: "Int64" for c in out.columns[:5]})


def _read(text: str | None, h: int | None) -> tuple[list[bytes], np.ndarray]:
    words, ids = word_numbers(text)
    at = repeated_from(len(words), None if pd.isna(h) else int(h))
    return [words[i] for i in at], ids[at]


def find_runs(docs: DataFrame, key: Column | None = None, lot: int = LOT) -> DataFrame:
    """One row per document: doc_id, n_runs, the longest run, and digests of all runs and of the text without repeats.

    ``key`` is the unsigned crc32 that says which texts are given a repeat before they are searched; by default that of the decimal
    doc_id, and a text whose key (or doc_id) is null is searched as it stands. Null, empty and blank texts, and texts of fewer words
    than a run, have no run. Texts of more than ``lot`` comparisons are dealt out in ranges of lags, once for all rows that repeat
    them, whatever their number. Repeated rows each give a row; an empty table gives none; columns other than doc_id and text are ignored.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary")) if key is None else key
    rows = docs.select("doc_id", "text", h.alias("h"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # n words take at least 2n - 1 bytes, and lags up to n / 2 make 3/8 n * n comparisons.
    most = (F.octet_length("text").cast("double") + 1) / 2
    ranges = F.ceil(most * most * 3 / 8 / lot).cast("int")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, k in zip(batch.text, batch.h, strict=True):
                words, ids = _read(text, k)
                out.append(described(words, runs_of(stretches(ids))))
            common.give_back()
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), _frame(out)], axis=1)

    short = common.written(rows.filter(F.col("text").isNull() | (ranges <= 1)).mapInPandas(whole, f"doc_id {kind}, {_ROW}"), "periodic-short")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, k, digest, i, n in zip(batch.text, batch.h, batch.digest, batch.i, batch.ranges, strict=True):
                ids = _read(text, k)[1]
                lags = len(ids) // MIN_EXP
                found = stretches(ids, 1 + i * lags // n, 1 + (i + 1) * lags // n)
                out = pd.DataFrame(found, columns=["start", "length", "period"])
                yield out.assign(digest=digest, h=k).astype({"h": "Int64"})

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, k, found in zip(batch.text, batch.h, batch.found, strict=True):
                runs = np.array([[f["start"], f["length"], f["period"]] for f in found] if found is not None else [], np.int64).reshape(-1, 3)
                out.append(described(_read(text, k)[0], runs_of(runs)))
            yield pd.concat([batch[["digest", "h"]].astype({"h": "Int64"}).reset_index(drop=True), _frame(out)], axis=1)

    long = rows.filter(ranges > 1).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("ranges", ranges)
    distinct = common.written(long.dropDuplicates(["digest", "h"]).select("digest", "h", "text", "ranges"), "periodic-long")
    dealt = distinct.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)))
    dealt = dealt.repartition("digest", "h", "i")
    found = common.written(dealt.mapInPandas(part, "start long, length long, period long, digest string, h long"), "periodic-found")
    gathered = found.groupBy(F.col("digest").alias("d"), F.col("h").alias("k")).agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    same = (F.col("digest") == F.col("d")) & F.col("h").eqNullSafe(F.col("k"))
    results = distinct.join(gathered, same, "left").select("digest", "h", "text", "found").mapInPandas(told, f"digest string, h long, {_ROW}")
    results = common.written(results.withColumnsRenamed({"digest": "d", "h": "k"}), "periodic-told")
    common.discard(distinct, found)
    repeated = long.select("doc_id", "digest", "h").join(results, same).drop("digest", "h", "d", "k")
    return short.unionByName(repeated.select(*short.columns))


def op11_all_lag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(common.read(spark, sf_dir, "documents"))


# crc32 by its definition, a bit at a time: SQL has no such function.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')]), lambda x, b: list_reduce(list_prepend(xor(x, b), [0::BIGINT for k in range(8)]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
ORACLE_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w, {_CRC} AS h FROM documents),
placed AS (SELECT r, doc_id, w, len(w)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM texts),
words AS MATERIALIZED (SELECT r, doc_id, n, [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END] for i in range(n)] AS w FROM placed),
each AS MATERIALIZED (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM words),
alike AS (SELECT x.r, y.i - x.i AS q, x.i AS i FROM each x JOIN each y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // {MIN_EXP}),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM alike),
found AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest({LEAST}, {MIN_EXP} * q)),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM found GROUP BY r, start, length),
told AS (SELECT r, count(*) AS n_runs, min((-length, start, period)) AS top, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM each ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top[2] AS start, -top[1] AS length, top[3] AS period, (-1000 * top[1]) // top[3] AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM words LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""
