"""Label counters over streams. The cascade is row-wise, so it is the same plan on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.cascade import classify


def windowed_labels(stream: DataFrame, settings: Settings, ts: str = "ts", text: str = "text", every: str = "1 hour", late: str = "10 minutes", scorer=None) -> DataFrame:
    """Rows by window and label; only closed windows are emitted in append mode."""
    labelled = classify(stream, settings, scorer, text)
    label = F.explode(F.when(F.size("labels") == 0, F.array(F.lit("safe"))).otherwise(F.col("labels"))).alias("label")
    return labelled.withWatermark(ts, late).select(ts, label).groupBy(F.window(ts, every).alias("w"), "label").agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").alias("start"), "label", "rows")


def windowed_events(stream: DataFrame, ts: str = "ts", kind: str = "event_type", every: str = "1 day", late: str = "1 hour") -> DataFrame:
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), kind).agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), kind, "rows", "total")
