"""Language-model scores: cross-entropy difference of matched target and background models.

Two bigram models with one vocabulary, one order and one smoothing differ in their counts only: the target's come
from the documents marked as target, the background's from all others, and the larger side's are scaled down to
the smaller's total, so that neither wins by its size. Every distinct word and word pair of the corpus has counts of its
own, under a key that has 20 bits more than it takes to number the corpus's bytes. Documents are taken in lots; a lot sends its distinct keys, cut into slices by key, to the
tasks that count those slices over the whole corpus, and each slice goes back to its lot with the corpus's counts. So tables grow with the
corpus, and no task and no driver holds one whole. No lot is cut into more than FAN slices: in a large corpus the slices of many lots are
merged and cut again, level by level, so that rows don't multiply as lots times slices. Smoothing backs off by
Dirichlet priors to unigrams and from there to the words of both corpora together. Before a document is scored its own counts are taken out of
the model that holds them, and those of all other documents with the same text out of both, so none is judged by itself: a
document of which there are copies scores as if it were the only one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .near_dup import mix
from .words import grouped, plain

#: The smoothing's vocabulary has at least so many words, and beyond that as many as the corpus.
WORDS = 1 << 16
#: Words of a lot of documents, and bytes of text for each slice of the keys.
LOT, SLICE_BYTES = 1 << 20, 12 << 20
#: Slices into which keys are cut at once, and lots that are merged before they are cut again.
FAN = 256
UNIGRAM_PRIOR, PAIR_PRIOR = 1000.0, 50.0
_M = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def bits_for(size: int) -> int:
    """Bits of a key in a corpus of ``size`` bytes: fewer than one key in a million shares its bits with another."""
    return min(64, 20 + int(size).bit_length())


def word_ids(hashes: np.ndarray, bits: int = 64) -> np.ndarray:
    """Keys of a text's words, given by their hashes, with the start (0) before them. Keys of words are even, of pairs odd."""
    ids = np.zeros(len(hashes) + 1, np.uint64)
    ids[1:] = (hashes >> np.uint64(64 - bits)) & ~_ONE
    return ids


def pair_ids(ids: np.ndarray, bits: int = 64) -> np.ndarray:
    """Keys of all neighbours."""
    with np.errstate(over="ignore"):
        return (mix(mix(ids[:-1] + _M) * _M + ids[1:]) >> np.uint64(64 - bits)) | _ONE


def within(lengths: np.ndarray) -> np.ndarray:
    """Which neighbours of texts, one after another, lie in one text."""
    out = np.ones(int(lengths.sum()) - 1, bool)
    out[np.cumsum(lengths)[:-1] - 1] = False
    return out


def marked(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, text as bytes, whether the document is of the target, and how many other documents of either side have its text.

    Copies are counted by digest, in each task first. Only digests of several documents are joined back: broadcast where their number allows it, and
    else in a join that AQE splits.
    """
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("of_target", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = common.sized_join(rows, ids, ["doc_id"], "left").select("doc_id", "text", F.coalesce("of_target", F.lit(False)).alias("of_target"), F.unhex(F.sha2("text", 256)).alias("digest"))
    copies = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.count_if(~F.col("of_target")).alias("of_background"), F.count_if("of_target").alias("in_target"))
    copies = common.written(copies.filter("of_background + in_target > 1"), "lm-copies")
    others = lambda c, mine: F.coalesce(F.col(c) - mine.cast("long"), F.lit(0).cast("long"))
    sides = others("of_background", ~F.col("of_target")).alias("more_background"), others("in_target", F.col("of_target")).alias("more_target")
    return common.sized_join(rows, copies, ["digest"], "left").select("doc_id", "text", "of_target", *sides)


def packed(values: np.ndarray) -> bytes:
    """Non-negative whole numbers, compressed byte by byte: all lowest bytes first."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    planes = values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + bytes([kind.itemsize]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(payload: bytes) -> np.ndarray:
    n, size = int.from_bytes(payload[:8], "little"), payload[8]
    planes = np.frombuffer(pa.decompress(payload[9:], n * size, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(size, n).T.copy().view(f"u{size}").ravel().astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, as steps."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(payload: bytes) -> np.ndarray:
    return np.cumsum(unpacked(payload).view(np.uint64), dtype=np.uint64)


def lots(rows: DataFrame, bits: int = 64) -> DataFrame:
    """Documents by lots: their doc_id, side, other copies (background, target) and length, the lot's distinct words, and the word of each place by its number."""
    kinds = {"lot": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sides": pa.binary(), "copies": pa.binary(), "lengths": pa.binary(), "words": pa.binary(), "places": pa.binary()}

    def out(number: int, docs: list, sides: list, copies: list, texts: list) -> pa.RecordBatch:
        words, places = np.unique(np.concatenate(texts), return_inverse=True)
        row = [number, docs, packed(np.array(sides)), packed(np.array(copies).T.ravel()), packed(np.array([len(t) for t in texts])), packed_keys(words), packed(places)]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds.values(), strict=True)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        docs, sides, copies, texts, n = [], [], [], [], 0
        for batch in batches:
            names, marks, *more = (batch.column(c).to_pylist() for c in (0, 2, 3, 4))
            for numbers, hashes, at in grouped((t.as_py() for t in batch.column(1)), fold=plain):
                for k, i in enumerate(numbers):
                    ids = word_ids(hashes[at[k] : at[k + 1]], bits)
                    docs.append(names[i])
                    sides.append(int(marks[i]))
                    copies.append([m[i] for m in more])
                    texts.append(ids)
                    n += len(ids)
                    if n >= LOT:
                        yield out(number, docs, sides, copies, texts)
                        docs, sides, copies, texts, n, number = [], [], [], [], 0, number + 1
        if docs:
            yield out(number, docs, sides, copies, texts)
        common.give_back()

    return rows.mapInArrow(run, "lot long, doc_ids array<long>, sides binary, copies binary, lengths binary, words binary, places binary")


_SLICED = pa.schema([("lot", pa.int64()), ("slice", pa.int64()), ("keys", pa.binary()), ("first", pa.binary()), ("second", pa.binary())])
_COUNTED = pa.schema([("lot", pa.int64()), ("slice", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("words", pa.int64()), ("of_background", pa.int64()), ("of_target", pa.int64())])
_SLICED_SQL = "lot long, slice long, keys binary, first binary, second binary"
_COUNTED_SQL = "lot long, slice long, first binary, second binary, words long, of_background long, of_target long"


def table_of(rows: list, schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def cut(lot: int, keys: np.ndarray, counts: list[np.ndarray], slices: int, bits: int) -> Iterator[list]:
    """Rows of a lot's ascending keys, cut into slices."""
    at = slice_of(keys, slices, bits)
    starts = np.flatnonzero(np.diff(at, prepend=np.uint64(slices))) if len(at) else np.empty(0, np.int64)
    for start, end in zip(starts, [*starts[1:], len(at)], strict=True):
        part = slice(start, end)
        yield [lot, int(at[start]), packed_keys(keys[part]), packed(counts[0][part]), packed(counts[1][part])]


def key_slices(parts: DataFrame, slices: int, bits: int = 64) -> DataFrame:
    """Every lot's distinct keys of words and pairs, cut into slices, with the lot's counts (background, target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot, *payloads in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                sides, lengths, words, places = (f(x.as_py()) for f, x in zip((unpacked, unpacked, unpacked_keys, unpacked), payloads, strict=True))
                # A text without words gives no counts.
                of = np.repeat(np.where(lengths > 1, sides, 2), lengths)
                inner = within(lengths)
                pairs, back = np.unique(pair_ids(words[places], bits)[inner], return_inverse=True)
                side = of[1:][inner]
                keys = np.concatenate([words, pairs])
                order = np.argsort(keys, kind="stable")
                counts = [np.concatenate([np.bincount(places[of == s], minlength=len(words)), np.bincount(back[side == s], minlength=len(pairs))])[order] for s in (0, 1)]
                for row in cut(lot, keys[order], counts, slices, bits):
                    yield from table_of([row], _SLICED).to_batches()
        common.give_back()

    return parts.select("lot", "sides", "lengths", "words", "places").mapInArrow(run, _SLICED_SQL)


def slice_of(keys: np.ndarray, slices: int, bits: int = 64) -> np.ndarray:
    """Slices are equal ranges of the keys, which are spread evenly."""
    return (((keys << np.uint64(64 - bits)) >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)


def summed(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
    """The keys of each row, the distinct ones, where each key is among these, and the sums of both counts."""
    keys = [unpacked_keys(x.as_py()) for x in table["keys"]]
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for name in ("first", "second"):
        own = np.concatenate([unpacked(x.as_py()) for x in table[name]])
        sums.append(np.bincount(back, weights=own, minlength=len(distinct)).astype(np.int64))
    return keys, distinct, back, sums


def counted(sliced: DataFrame) -> DataFrame:
    """Every slice of every lot with the whole corpus's counts of its keys, in the same order; and, once for each slice with
    lot -1, how many distinct words it has and how often they occur (background, target)."""

    def count(table: pa.Table) -> pa.Table:
        number = table["slice"][0].as_py()
        keys, distinct, back, sums = summed(table)
        even = (distinct & _ONE) == 0
        rows = [[-1, number, None, None, int(even.sum()), int(sums[0][even].sum()), int(sums[1][even].sum())]]
        ends = np.cumsum([0] + [len(k) for k in keys])
        for lot, a, b in zip(table["lot"].to_pylist(), ends[:-1], ends[1:], strict=True):
            rows.append([lot, number, packed(sums[0][back[a:b]]), packed(sums[1][back[a:b]]), 0, 0, 0])
        return table_of(rows, _COUNTED)

    return sliced.groupBy("slice").applyInArrow(count, _COUNTED_SQL)


def corpus_counts(sliced: DataFrame, cuts: int, slices: int, bits: int) -> DataFrame:
    """As ``counted``, for keys cut into ``cuts`` slices that may be larger than a task can count: ``slices`` would be right.

    Rows of about FAN lots in a slice become one row of distinct keys, which is cut finer and counted in its turn; what comes back is
    handed out to the rows it was made of.
    """
    if cuts >= slices:
        return counted(sliced)
    sliced = common.written(sliced, "lm-keys")
    groups = common.blocks_for(sliced.select("lot").distinct().count(), FAN)
    named = sliced.withColumn("id", F.pmod(F.xxhash64("lot"), F.lit(groups)) * cuts + F.col("slice"))
    finer = min(cuts * FAN, slices)

    def merge(table: pa.Table) -> pa.Table:
        _, distinct, _, sums = summed(table)
        return table_of(list(cut(table["id"][0].as_py(), distinct, sums, finer, bits)), _SLICED)

    below = common.written(corpus_counts(named.groupBy("id").applyInArrow(merge, _SLICED_SQL), finer, slices, bits), "lm-below")

    def hand_out(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = [unpacked_keys(x.as_py()) for x in left["keys"]]
        distinct = np.unique(np.concatenate(keys))
        order = np.argsort(right["slice"].to_numpy())
        sums = [np.concatenate([unpacked(right[c][int(k)].as_py()) for k in order]) for c in ("first", "second")]
        rows = []
        for lot, number, own in zip(left["lot"].to_pylist(), left["slice"].to_pylist(), keys, strict=True):
            at = np.searchsorted(distinct, own)
            rows.append([lot, number, packed(sums[0][at]), packed(sums[1][at]), 0, 0, 0])
        return table_of(rows, _COUNTED)

    returned = below.filter("lot >= 0").select(F.col("lot").alias("id"), "slice", "first", "second")
    back = named.select("id", "lot", "slice", "keys").groupBy("id").cogroup(returned.groupBy("id")).applyInArrow(hand_out, _COUNTED_SQL)
    return back.unionByName(below.filter("lot = -1"))


def occurrences(doc: np.ndarray, key: np.ndarray, kinds: int) -> np.ndarray:
    """For every place, how often its document has its key."""
    _kinds, back, count = np.unique(doc * kinds + key, return_inverse=True, return_counts=True)
    return count[back]


def losses(places: np.ndarray, pairs: np.ndarray, lengths: np.ndarray, sides: np.ndarray, copies: np.ndarray, of_words: np.ndarray, of_pairs: np.ndarray, totals: np.ndarray, vocabulary: int) -> np.ndarray:
    """Mean loss in nats a word under (target, background) of each document of a lot; nan if it has no words.

    ``places`` number the words and ``pairs`` the neighbours within documents by the columns of ``of_words`` and ``of_pairs``,
    which hold the corpus's counts (background, target). ``copies``: a document's other copies, by side in the same order.
    """
    # What the corpus measures without a document's other copies, and by that how both sides' counts are made alike.
    totals = totals[:, None] - copies * lengths
    least = totals.min(axis=0)
    scale = np.where(least > 0, least / np.maximum(totals, 1), 1.0)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    own = occurrences(doc, places, of_words.shape[1])
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    doc, first, second, own_first, own_second = doc[inner], places[inner], places[inner + 1], own[inner], own[inner + 1]
    own_pairs = occurrences(doc, pairs, of_pairs.shape[1])
    size, side, gone = lengths[doc], sides[doc], copies[:, doc] + (sides[doc] == np.arange(2)[:, None])
    both = of_words[0, second] + of_words[1, second] - gone.sum(axis=0) * own_second
    shared = (both + 0.1) / (totals.sum(axis=0)[doc] - size + 0.1 * vocabulary)
    out = []
    for model in (1, 0):
        mine, scaled = side == model, scale[model, doc]
        n = (totals[model, doc] - mine * size) * scaled
        uni = ((of_words[model, second] - gone[model] * own_second) * scaled + UNIGRAM_PRIOR * shared) / (n + UNIGRAM_PRIOR)
        before = (of_words[model, first] - gone[model] * own_first) * scaled
        seen = np.minimum((of_pairs[model, pairs] - gone[model] * own_pairs) * scaled, before)
        loss = -np.log((np.maximum(seen, 0) + PAIR_PRIOR * uni) / (before + PAIR_PRIOR))
        out.append(np.bincount(doc, weights=loss, minlength=len(lengths)) / np.where(lengths > 1, lengths - 1, np.nan))
    return np.array(out)


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, of_target, target_loss, background_loss, difference.

    ``target`` names the target's documents by doc_id. difference is target_loss - background_loss a word:
    the lower, the more the document reads like the target. A text that is null, empty or without words has null losses.
    A null doc_id belongs to the background. Repeated rows, and other documents of the same text, are copies: a row's copies are in no model that scores it,
    and count as often as they occur in those that score other texts. Without any target
    document the target's model is its prior. An empty table gives no rows; other columns are ignored.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("binary")).cast("long"))).first()[0] or 0
    bits = bits_for(size)
    parts = common.written(lots(marked(docs, target), bits), "lm-lots")
    slices = common.blocks_for(size, SLICE_BYTES)
    cuts = min(FAN, slices)
    counts = common.written(corpus_counts(key_slices(parts, cuts, bits), cuts, slices, bits), "lm-counts")
    common.release(docs.sparkSession)
    of = counts.filter("lot = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "of_background", "of_target")]).first()
    vocabulary, totals = max(WORDS, of[0]), np.array([of[1], of[2]], np.float64)
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "of_target": pa.bool_(), "target_loss": pa.float64(), "background_loss": pa.float64()}

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        sides, copies, lengths, words, places = (f(left[c][0].as_py()) for f, c in ((unpacked, "sides"), (unpacked, "copies"), (unpacked, "lengths"), (unpacked_keys, "words"), (unpacked, "places")))
        distinct, pairs = np.unique(pair_ids(words[places], bits)[within(lengths)], return_inverse=True)
        order = np.argsort(right["slice"].to_numpy())
        table = np.array([np.concatenate([unpacked(right[c][int(k)].as_py()) for k in order]) for c in ("first", "second")])
        at = np.empty(table.shape[1], np.int64)
        at[np.argsort(np.concatenate([words, distinct]), kind="stable")] = np.arange(len(at))
        found = losses(places, pairs, lengths, sides, copies.reshape(2, -1), table[:, at[: len(words)]], table[:, at[len(words) :]], totals, vocabulary)
        cols = [left["doc_ids"][0].as_py(), lengths - 1, sides == 1, *found]
        return pa.Table.from_arrays([pa.array(c, k, from_pandas=True) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))

    lot = parts.groupBy("lot").cogroup(counts.filter("lot >= 0").select("lot", "slice", "first", "second").groupBy("lot"))
    scored = lot.applyInArrow(score, "doc_id long, n_words long, of_target boolean, target_loss double, background_loss double")
    return scored.withColumn("difference", F.col("target_loss") - F.col("background_loss"))


def op8_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = common.read(spark, sf_dir, "labels").filter("quality = 1")
    return cross_entropy_difference(common.read(spark, sf_dir, "documents"), target)
