"""What the training-data operators share: written tables, sized joins, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its measured size is at most this.
BROADCAST_BYTES = 32 << 20
#: Words are maximal runs of anything but space and U+0009..U+000D; ``bytes.split()`` follows the same rule.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only where none is configured and all run in one process (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="llm-shared-"))
    return spark.conf.get("spark.checkpoint.dir")


#: Where tables stand that were written and not yet deleted, in order.
_standing: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and lost executors cost nothing.

    Python workers that take part get small batches, so what they hold doesn't depend on the length of texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    _standing.append(path)
    return out


def delete(spark: SparkSession, at: str) -> None:
    """Delete a folder, wherever it stands."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if at in _standing:
        _standing.remove(at)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for table in tables:
        delete(table.sparkSession, table._written_at)


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete, at the end, the tables written meanwhile, apart from those put on the list."""
    before, kept = set(_standing), []
    yield kept
    stay = before | {table._written_at for table in kept}
    for at in [x for x in _standing if x not in stay]:
        delete(spark, at)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Python workers get batches of about this many bytes, whatever the rows measure, in what is run meanwhile."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and broadcasts of plans that are over, which executors hold until the driver has collected the plans."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers stay for later tasks, and so would its memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def measured_bytes(df: DataFrame) -> int:
    """Rows times 16 bytes a column, and the real length of strings and binaries."""
    text = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    total = F.count(F.lit(1)) * (16 * len(df.columns))
    for part in text:
        total = total + part
    return int(df.agg(total.alias("n")).first()["n"])


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Broadcast ``small`` if its measured size allows it; else a shuffled join, whose skew AQE splits."""
    if measured_bytes(small) <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def unit_hash(*parts: Column) -> Column:
    """A reproducible number in (0, 1) from the parts; the same arithmetic is easy in other SQL engines."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def summed(parts: DataFrame, name: str, most: int = 16) -> dict[int, np.ndarray]:
    """By chunk, the sum of the float64 vectors in ``payload`` over all rows (chunk, part, payload), in a tree.

    However many partitions there are, no task adds more than 16 vectors of a chunk and the driver no more than ``most``.
    """

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(group.payload.iat[0], np.float64).copy()
        for more in group.payload.iloc[1:]:
            total += np.frombuffer(more, np.float64)
        return pd.DataFrame({"chunk": [group.chunk.iat[0]], "part": [group.part.iat[0] // 16], "payload": [total.tobytes()]})

    schema = "chunk int, part long, payload binary"
    parts = written(parts.select(F.col("chunk").cast("int").alias("chunk"), F.col("part").cast("long").alias("part"), "payload"), name)
    while (parts.groupBy("chunk").count().agg(F.max("count")).first()[0] or 0) > most:
        before, parts = parts, written(parts.groupBy("chunk", F.floor(F.col("part") / 16).alias("to")).applyInPandas(add, schema), name)
        discard(before)
    out: dict[int, np.ndarray] = {}
    for r in parts.toLocalIterator():
        vector = np.frombuffer(r["payload"], np.float64)
        out[r["chunk"]] = vector + out[r["chunk"]] if r["chunk"] in out else vector
    discard(parts)
    return out
