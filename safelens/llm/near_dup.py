"""MinHash near-duplicates by a multi-index Hamming join.

Every document gets a signature of b-bit minima over its word shingles. A pair counts as near if
its signatures differ in at most ``radius`` places. The places are split into chunks; by the pigeonhole
principle some chunk of a near pair holds at most ``errors`` differences, so leaving out every set of
``errors`` places of every chunk gives keys of which near pairs share at least one. The keys are
the index; pairs that share a key are confirmed on their full shingle sets.

Documents with equal shingle sets are one class with one representative. In a key's group first
all members are held against the smallest one, which costs as many pairs as there are members.
Connected members need no more. Large groups that are still apart are held against other centres in the same way. What is left in groups of three and more is compared and confirmed block by block
with the whole sets at hand, so no pair under the radius is lost, no pair that isn't a link becomes a row, and no group is held by
one task. Groups that overlap are taken together where that moves fewer sets.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .words import grouped, plain

BITS = 16
CHUNK = 5
ERRORS = 1
#: A pair at exactly the least similarity shares no key with at most this probability.
MISS = 1e-6
#: Members that are compared with each other at once, at least and at most; the bytes of their sets; and members of a star.
BLOCK, MOST, BLOCK_BYTES, SPREAD = 64, 1024, 16 << 20, 128
#: Groups that are still in more components than this, beyond which blocks multiply, get other centres first, so often at most.
LARGE, HUBS = 8 * MOST, 3
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``width`` words, from the hashes of a text's words.

    Fewer words than that are one shingle as a whole; no words give none.
    """
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15) * np.uint64(width + 1))
    for k in range(width):
        out = mix(out + words[k : k + n] * np.uint64(2 * k + 3))
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def sets_of(texts: Iterable[pa.Scalar], width: int) -> Iterator[list[np.ndarray]]:
    """Shingle sets of texts, in order, in groups of some 64 KB. Words are maximal runs without white space, A-Z lower-cased."""
    with np.errstate(over="ignore"):
        for numbers, hashes, at in grouped((t.as_py() for t in texts), fold=plain):
            yield [shingle_set(hashes[at[k] : at[k + 1]], width) for k in range(len(numbers))]


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """b-bit minima of multiplicative hashes, one for each factor; 16 bits each."""
    least = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[i : i + 2048, None] * factors).min(axis=0))
    return (mix(least) & np.uint64((1 << BITS) - 1)).astype("<u2")


def factors_for(places: int) -> np.ndarray:
    return mix(np.arange(1, places + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def chunks_for(similarity: float, chunk: int = CHUNK, errors: int = ERRORS, miss: float = MISS) -> int:
    """The least number of chunks for which a pair at ``similarity`` shares a key but with probability ``miss``."""
    one = sum(math.comb(chunk, e) * similarity ** (chunk - e) * (1 - similarity) ** e for e in range(errors + 1))
    return 1 if one >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - one)))


def quantile(n: int, p: float, tail: float) -> int:
    """The least k that a binomial variable of n trials exceeds with probability ``tail`` at most."""
    over, k = 1.0, -1
    while over > tail and k < n:
        k += 1
        over -= math.comb(n, k) * p**k * (1 - p) ** (n - k)
    return k


def index_keys(signatures: np.ndarray, chunk: int = CHUNK, errors: int = ERRORS) -> np.ndarray:
    """All index keys of all signatures (rows): one for each chunk and each set of places left out."""
    salt = mix(np.arange(1, signatures.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    out = []
    for c in range(signatures.shape[1] // chunk):
        for gone in itertools.combinations(range(chunk), errors):
            key = np.full(len(signatures), mix(np.array([c * 1009 + sum(1 << g for g in gone) + 1], np.uint64))[0])
            for p in range(chunk):
                if p not in gone:
                    key = mix((key ^ signatures[:, c * chunk + p].astype(np.uint64)) + salt[c * chunk + p])
            out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def sketch(docs: DataFrame, width: int, places: int) -> DataFrame:
    """doc_id, n_shingles, class_id (a hash of the whole shingle set, null if empty) and signature."""
    factors = factors_for(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                n, classes, signatures = [], [], []
                for sets in sets_of(batch.column(1), width):
                    n += map(len, sets)
                    classes += [class_of(x.tobytes()) for x in sets]
                    signatures += [signature(x, factors).tobytes() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())],
                    names=["doc_id", "n_shingles", "class_id", "signature"])
        common.give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, class_id binary, signature binary")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """node (the doc_id), class_id, and the whole shingle set: sorted 64-bit hashes, little-endian, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for found in sets_of(batch.column(1), width):
                sets = [x.astype("<u8").tobytes() for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([class_of(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["node", "class_id", "shingles"])
                at += len(sets)
        common.give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, class_id binary, shingles binary")


def class_of(shingles: bytes) -> bytes | None:
    """A hash of a whole set; none for an empty one."""
    return hashlib.blake2b(shingles, digest_size=16).digest() if shingles else None


def _index(classes: DataFrame, chunk: int, errors: int) -> DataFrame:
    """(key, node) for every representative and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                if batch.num_rows:
                    found = np.stack([np.frombuffer(x.as_py(), "<u2") for x in batch.column(1)])
                    keys = index_keys(found, chunk, errors)
                    nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                    for i in range(0, keys.size, 200_000):
                        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()[i : i + 200_000]), pa.array(nodes[i : i + 200_000])], names=["key", "node"])

    return classes.select("node", "signature").mapInArrow(run, "key long, node long")


def _differences(a: str, b: str, places: int):
    """Places in which two signatures differ."""

    @F.pandas_udf("int")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=np.int32)
        left = np.frombuffer(b"".join(x), "<u2").reshape(-1, places)
        right = np.frombuffer(b"".join(y), "<u2").reshape(-1, places)
        return pd.Series((left != right).sum(axis=1).astype(np.int32))

    return of(F.col(a), F.col(b))


class Members:
    """The members of one block with their whole sets, and which components have met in it."""

    def __init__(self, places: int, similarity: int, far: int) -> None:
        self.similarity, self.far, self.n = similarity, far, 0
        self.sets: list[np.ndarray] = []
        self.nodes, self.sizes, self.parts = (np.empty(16, np.int64) for _ in range(3))
        self.signatures = np.empty((16, places), "<u2")
        self.joined: dict[int, int] = {}

    def add(self, node: int, part: int, signature: np.ndarray, found: np.ndarray) -> None:
        if self.n == len(self.nodes):
            self.nodes, self.sizes, self.parts, self.signatures = (np.concatenate([x, x]) for x in (self.nodes, self.sizes, self.parts, self.signatures))
        self.nodes[self.n], self.sizes[self.n], self.parts[self.n], self.signatures[self.n] = node, len(found), self.root(part), signature
        self.sets.append(found)
        self.n += 1

    def root(self, part: int) -> int:
        while part in self.joined:
            part = self.joined[part]
        return part

    def links(self, node: int, part: int, signature: np.ndarray, found: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links of one more document with the members, as many as it takes to join its component with theirs.

        Sizes and signatures decide first; what they leave is counted on the whole sets.
        """
        part, n = self.root(part), self.n
        sizes, parts = self.sizes[:n], self.parts[:n]
        near = np.flatnonzero((parts != part) & (self.nodes[:n] != node) & (100 * np.minimum(sizes, len(found)) >= self.similarity * np.maximum(sizes, len(found))))
        if not len(near):
            return
        differ = (self.signatures[near] != signature).sum(axis=1)
        for m in near[np.argsort(differ, kind="stable")][: int((differ <= self.far).sum())]:
            if parts[m] != part:
                both = shared(self.sets[m], found)
                if 100 * both >= self.similarity * (len(self.sets[m]) + len(found) - both):
                    yield min(node, int(self.nodes[m])), max(node, int(self.nodes[m]))
                    gone = int(parts[m])
                    parts[parts == gone] = part
                    self.joined[gone] = part


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _confirmed(asked: DataFrame, docs: DataFrame, classes: DataFrame, width: int, similarity: int, places: int, far: int, repeated: bool, name: str) -> DataFrame:
    """Links (a, b) in groups (kind, id, i, j) of the rows asked for, which have besides: held, node, component.

    The rows with ``held`` are kept together, with their sets; all others pass by one at a time and are compared
    with them. In a group with i = j every row is compared with those before it. Sets are joined to these rows as binaries, sorted
    by group, and stream through the workers in small batches, so a worker holds one block and one batch. ``repeated``: some doc_id
    has several rows.
    """
    wanted = common.written(asked.select(F.col("node").alias("doc_id")).distinct(), f"{name}-ids")
    texts = common.sized_join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, ["doc_id"], "left_semi")
    once = lambda rows, key: rows.dropDuplicates(key) if repeated else rows
    sets = common.written(once(shingle_sets(texts, width), ["node", "class_id"]).join(classes.select("node", "class_id", "signature"), ["node", "class_id"]), f"{name}-sets")
    by = ["kind", "id", "i", "j"]
    rows = asked.select(*by, "held", "node", "component").join(sets, "node").select(*by, "held", "node", "component", "signature", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, members, found = None, None, []
        for batch in batches:
            *keys, held, node, component = (batch.column(k).to_pylist() for k in range(7))
            for r, group in enumerate(zip(*keys, strict=True)):
                if group != last:
                    last, members = group, Members(places, similarity, far)
                mine = (node[r], component[r], np.frombuffer(batch.column(7)[r].as_py(), "<u2"), np.frombuffer(batch.column(8)[r].as_py(), "<u8"))
                if group[2] == group[3] or not held[r]:
                    found += members.links(*mine)
                if held[r]:
                    members.add(*mine)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
                found = []
        common.give_back()

    links = common.written(rows.repartition(*by).sortWithinPartitions(*by, F.desc("held")).mapInArrow(run, "a long, b long"), f"{name}-links")
    common.discard(wanted, sets)
    return links


def _star_links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, similarity: int, places: int, far: int, repeated: bool) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= similarity * union. A star's members are dealt to
    groups of about SPREAD, each with the set of its centre a."""
    sig = classes.select("node", "signature")
    near = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    near = common.written(near.filter(_differences("sig_a", "sig_b", places) <= far).select("a", "b").distinct(), "nd-pairs")
    stars = common.written(near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("groups")), "nd-stars")
    dealt = common.sized_join(near, stars, ["a"]).select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("i"))
    row = lambda held, node: F.struct(F.lit(held).alias("held"), F.col(node).alias("node"), F.col(node).alias("component"))
    group = [F.lit(0).alias("kind"), F.col("a").alias("id"), "i", F.lit(-1).alias("j")]
    members = dealt.select(*group, row(False, "b").alias("x"))
    centres = stars.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("i")).select(*group, row(True, "a").alias("x"))
    links = _confirmed(members.unionByName(centres).select("kind", "id", "i", "j", "x.*"), docs, classes, width, similarity, places, far, repeated, "nd-star")
    common.discard(near, stars)
    return links


def _opened(shared_keys: DataFrame, label: DataFrame) -> DataFrame:
    """(key, node, component, first, n): the members of groups of three and more that hold several components."""
    members = common.sized_join(shared_keys.filter("n > 2").select("key", "node"), label.toDF("node", "component"), ["node"], "left")
    members = common.written(members.withColumn("component", F.coalesce("component", "node")), "nd-grouped")
    split = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("key", "first", "n")
    # The groups to open are written first: joined by a broadcast, or so that AQE can split large ones.
    split = common.written(split, "nd-split")
    opened = common.written(common.sized_join(members, split, ["key"]), "nd-open")
    common.discard(members, split)
    return opened


def _hub_pairs(opened: DataFrame, turn: int) -> DataFrame:
    """Pairs of another centre and the members of other components, for groups of many components: as many as they have members.

    Variants of one text resemble it more than each other, and the smallest of them may not be the text itself. What its star has found
    leads there: the new centre is a member, other than the first, of the group's largest component.
    """
    large = opened.filter(F.col("n") > LARGE)
    parts = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.min(F.when(F.col("node") != F.col("first"), F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node"))).alias("x"))
    best = F.max(F.when(F.col("x").isNotNull(), F.struct("size", "component", "x")))
    hubs = parts.groupBy("key").agg(best.alias("best"), F.count(F.lit(1)).alias("parts")).filter((F.col("parts") > LARGE) & F.col("best").isNotNull()).select("key", F.col("best.component").alias("own"), F.col("best.x.node").alias("hub"))
    hubs = common.written(hubs, "nd-hubs")
    pairs = common.sized_join(large, hubs, ["key"]).filter("component <> own")
    return common.written(pairs.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "nd-hub-pairs")


def _rest_links(docs: DataFrame, opened: DataFrame, classes: DataFrame, width: int, similarity: int, places: int, far: int, repeated: bool) -> DataFrame:
    """Links between different components of the opened groups, as many as it takes to join them."""
    # Groups that share members form clusters. A cluster is compared as a whole if that costs less than group by group.
    cluster = connected_components(opened.select(F.col("first").alias("a"), F.col("node").alias("b")), "nd-cluster")
    members = common.written(opened.join(cluster.toDF("node", "cluster"), "node"), "nd-members")
    common.discard(opened, cluster)
    size = lambda n: F.greatest(F.lit(BLOCK), F.least(F.lit(MOST), F.ceil(n / 8)))  # noqa: E731  of a block: larger ones make fewer copies
    load = lambda n: n * F.ceil(n / size(n))
    apart = members.groupBy("cluster", "key").agg(F.first("n").alias("n")).groupBy("cluster").agg(F.sum(load(F.col("n"))).alias("apart"))
    whole = members.select("cluster", "node").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    plan = whole.join(apart, "cluster").select("cluster", (load(F.col("size")) <= F.col("apart")).alias("as_one"))
    plan = common.written(plan, "nd-plan")
    planned = common.sized_join(members, plan, ["cluster"])
    one = planned.filter("as_one").select(F.lit(0).alias("kind"), F.col("cluster").alias("id"), "node", "component").distinct()
    many = planned.filter("NOT as_one").select(F.lit(1).alias("kind"), F.col("key").alias("id"), "node", "component")
    asked = common.written(common.sized_join(one.unionByName(many), classes.groupBy("node").agg(F.sum("n_shingles").alias("n_shingles")), ["node"]), "nd-asked")
    common.discard(members, plan)
    # Blocks hold fewer members where their texts are very long.
    n = F.count(F.lit(1))
    blocks = asked.groupBy("kind", "id").agg(F.greatest(F.ceil(n / size(n)), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = common.sized_join(asked, common.written(blocks, "nd-blocks"), ["kind", "id"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("kind", "id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("held"), "node", "component")
    links = _confirmed(dealt, docs, classes, width, similarity, places, far, repeated, "nd-rest")
    common.discard(asked)
    return links


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A and B| >= similarity * |A or B| for their sets of shingles of
    ``width`` words, and form components; the smallest doc_id of a component is kept. Texts that are null, empty
    or have no words are linked with nothing and kept. Rows that repeat a doc_id are one document to the links.
    A row with a null doc_id can't be named: it isn't linked, and it is kept with a null component.
    An empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    chunks = chunks_for(similarity / 100)
    places = chunks * CHUNK
    radius = (ERRORS + 1) * chunks - 1
    # Beyond the guaranteed radius pairs are still confirmed, up to a distance that links pass with the same probability.
    far = max(radius, quantile(places, 1 - similarity / 100, MISS))

    sketched = common.written(sketch(docs, width, places), "nd-sketch")
    usable = sketched.filter("class_id IS NOT NULL AND doc_id IS NOT NULL")
    classes = common.written(usable.groupBy("class_id").agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature"), F.min("n_shingles").alias("n_shingles")), "nd-classes")
    repeated = usable.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    index = common.written(_index(classes, CHUNK, ERRORS), "nd-index")
    grouped = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1")
    # Most keys stand alone; what is left of the index is small. The groups are written first, so that AQE can split large ones.
    grouped = common.written(grouped, "nd-groups")
    shared_keys = common.written(index.join(grouped, "key"), "nd-shared")
    common.discard(index, grouped)
    common.release(docs.sparkSession)
    pairs = shared_keys.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    stars = _star_links(pairs, docs, classes, width, similarity, places, far, repeated)
    # A doc_id given to several classes holds them together.
    held = usable.select("class_id", "doc_id").join(classes.select("class_id", "node"), "class_id").filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    first = connected_components(stars, "nd-first")
    common.release(docs.sparkSession)
    opened = _opened(shared_keys, first)
    for turn in range(HUBS):
        pairs = _hub_pairs(opened, turn)
        if not pairs.limit(1).count():
            break
        more = _star_links(pairs, docs, classes, width, similarity, places, far, repeated)
        joined = connected_components(first.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more), "nd-first")
        common.discard(first, opened, pairs, more)
        first, opened = joined, _opened(shared_keys, joined)
    others = _rest_links(docs, opened, classes, width, similarity, places, far, repeated)
    common.release(docs.sparkSession)
    links = first.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(others)
    if repeated:
        links = links.unionByName(held)
    label = connected_components(links, "nd-last")
    common.discard(shared_keys, stars, first, others)
    whole = classes.join(label, "node", "left").select("class_id", F.coalesce("component", "node").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", "class_id").join(whole, "class_id", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"), width=3, similarity=85)


def one_of_each(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """The documents without those that are linked to one with a smaller doc_id; repeated rows stay once."""
    judged = near_duplicates(docs, width, similarity)
    judged = common.written(judged.select("doc_id", "kept").filter("doc_id IS NOT NULL"), "nd-kept")
    gone = judged.filter(~F.col("kept")).select("doc_id").distinct()
    again = common.written(judged.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "nd-again")
    out = common.sized_join(docs, gone, ["doc_id"], "left_anti")
    if not again.limit(1).count():
        return out
    first = Window.partitionBy("doc_id").orderBy(F.col("text").isNull(), F.xxhash64("text"))
    twins = common.sized_join(out, again, ["doc_id"], "left_semi").withColumn("__row", F.row_number().over(first)).filter("__row = 1").drop("__row")
    return common.sized_join(out, again, ["doc_id"], "left_anti").unionByName(twins)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN words IS NULL OR len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
      ELSE [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)] END) AS set FROM w),
e AS (SELECT doc_id, unnest(set) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN s p ON p.doc_id = c.a JOIN s q ON q.doc_id = c.b WHERE 100 * c.n >= 85 * (len(p.set) + len(q.set) - c.n)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT s.doc_id, len(s.set)::BIGINT AS n_shingles, min(r.other)::BIGINT AS component_id, s.doc_id = min(r.other) AS kept FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.set
"""
