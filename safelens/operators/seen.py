"""Keep-first over increments: rows whose key no earlier run has had, found by a Bloom filter that is written with the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import first_of_each

#: Bits of a block (what Spark's bitmap functions make), and how many of them a key sets, all in one block.
BLOCK_BITS, SET_BITS = 32768, 6
#: A block for so many keys: about a key in a hundred that is new looks as if it were not.
KEYS_PER_BLOCK = 3000
#: Up to so many keys to be looked up exactly go to every task; beyond, both sides are shuffled.
BROADCAST_KEYS = 500_000


def _digest(key: Column) -> Column:
    """Rows without a key share one."""
    return F.sha2(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("")).cast("binary"), 256)


def _block(digest: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(blocks)).cast("int")


def _bits(digest: Column) -> list[Column]:
    step = F.pmod(F.xxhash64(digest, F.lit(1)), F.lit(BLOCK_BITS // 2)) * 2 + 1  # odd, so the bits of a key differ
    return [F.pmod(F.xxhash64(digest, F.lit(2)) + step * i, F.lit(BLOCK_BITS)) for i in range(SET_BITS)]


def bloom_filter(digests: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of a column ``digest``: each task makes bitmaps of its own, which are merged by block."""
    set_bits = digests.select(_block(F.col("digest"), blocks).alias("block"), F.explode(F.array(*_bits(F.col("digest")))).alias("bit"))
    return set_bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_hold(bits: Column, digest: Column) -> Column:
    """False if the key is surely in no run that the block's bits know; a block without bits knows none."""
    out = bits.isNotNull()
    for b in _bits(digest):
        byte = F.conv(F.hex(F.substring(bits, (F.floor(b / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = out & (F.getbit(byte, (b % 8).cast("int")) == 1)
    return F.coalesce(out, F.lit(False))


class SeenCorpus:
    """A corpus that grows by runs: ``rows/run=N`` holds a run's new rows, ``filter/run=N`` the bits of their keys.

    A run counts once its filter is written; one that broke off before is written anew. ``expected`` keys size the filter: more make it less sharp, and so more
    keys are looked up exactly, but never a wrong answer.
    """

    def __init__(self, spark: SparkSession, path: str, expected: int = 10_000_000) -> None:
        self.spark, self.path, self.blocks = spark, path.rstrip("/"), max(1, -(-expected // KEYS_PER_BLOCK))

    def _runs(self) -> list[int]:
        """Runs that are complete, in order."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/filter")
        files = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(at):
            return []
        done = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith("run=")]
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[4:]) for p in done if files.exists(hadoop(p, "_SUCCESS")))

    def _filter(self, runs: list[int]) -> DataFrame:
        """The bits of all runs; a run may have been written with another number of blocks, so blocks go by number of blocks, too."""
        parts = self.spark.read.parquet(*[f"{self.path}/filter/run={n}" for n in runs])
        return parts.groupBy("blocks", "block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def rows(self) -> DataFrame | None:
        """All rows of complete runs, with ``digest`` and ``run``."""
        parts = [self.spark.read.parquet(f"{self.path}/rows/run={n}").withColumn("run", F.lit(n)) for n in self._runs()]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
        return out

    def add(self, df: DataFrame, key: Column, *order: str) -> DataFrame:
        """Write, as a run of its own, the first row of each key that no earlier run has had, and return them.

        Rows that the filter rules out are new; only the others are looked up among the keys of earlier runs.
        """
        runs = self._runs()
        run = runs[-1] + 1 if runs else 0
        at = f"{self.path}/rows/run={run}"
        new = first_of_each(df.withColumn("digest", _digest(key)), F.col("digest"), *order)
        if runs:
            kept, staged = self._filter(runs), f"{self.path}/staged"
            sizes = [r["blocks"] for r in kept.select("blocks").distinct().collect()]  # one, unless the corpus was reopened with another size
            new = new.withColumn("__seen", F.lit(False))
            for n in sizes:
                bits = kept.filter(F.col("blocks") == n).select(F.col("block").alias("__block"), "bits")
                new = new.withColumn("__at", _block(F.col("digest"), n)).join(bits, F.col("__at") == F.col("__block"), "left")
                new = new.withColumn("__seen", F.col("__seen") | may_hold(F.col("bits"), F.col("digest"))).drop("__at", "__block", "bits")
            new.write.mode("overwrite").parquet(staged)
            new = self.spark.read.parquet(staged)
            asked = new.filter("__seen").select("digest")
            old = self.spark.read.parquet(*[f"{self.path}/rows/run={n}" for n in runs]).select("digest")
            few = asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
            known = old.join(F.broadcast(asked) if few else asked, "digest", "left_semi")
            new = new.filter("NOT __seen").unionByName(new.filter("__seen").join(known, "digest", "left_anti")).drop("__seen")
        new.write.mode("overwrite").parquet(at)
        written = self.spark.read.parquet(at)
        bloom_filter(written.select("digest"), self.blocks).withColumn("blocks", F.lit(self.blocks)).write.mode("overwrite").parquet(f"{self.path}/filter/run={run}")
        return written
