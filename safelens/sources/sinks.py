"""Reports and results: JSON, recommended YAML, calibration files, result rows."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def section(df: DataFrame, key: str | None = None, most: int = 10_000) -> Any:
    """A report's section: aggregated rows as dicts, or by a key column. More rows than ``most`` are no report."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report section has more than {most} rows")
    return rows if key is None else {r.pop(key): r for r in rows}


def write_report(report: dict[str, Any], path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(report, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    return path


def write_recommended(report_path: str | Path, recommended: dict[str, Any]) -> Path:
    """Next to a report, its recommended thresholds as YAML."""
    path = Path(report_path).with_suffix(".recommended.yaml")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(recommended, sort_keys=False), encoding="utf-8")
    return path


def write_calibration(path: str | Path, temperature: float, threshold: float, before: dict, after: dict) -> Path:
    return write_report({"temperature": temperature, "threshold": threshold, "before": before, "after": after}, path)


def scratch(spark: SparkSession) -> str:
    """A new folder for files on their way: under spark.checkpoint.dir, which all executors share; a local one only where all run in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="safelens-")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``scratch`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def write_results(df: DataFrame, path: str, kind: str = "parquet", partition_by: str | None = None) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).format(kind).save(path)


def write_json_arrays(rows: DataFrame, path: str, key: Column, per_file: int = 2000, wrapped: bool = True) -> None:
    """Files of one JSON array each, of about ``per_file`` rows, dealt out by a hash of ``key``; ``wrapped``: below the key ``rows`` of an object."""
    files = max(1, -(-rows.count() // per_file))
    arrays = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(files)).alias("__file")).agg(F.collect_list(F.struct(*[F.col(c) for c in rows.columns])).alias("rows"))
    value = F.to_json(F.struct("rows") if wrapped else F.col("rows"), {"ignoreNullFields": "false"})
    arrays.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def as_json(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def label_counters(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows by label; a row without labels counts as safe."""
    label = F.explode(F.when(F.size("labels") == 0, F.array(F.lit("safe"))).otherwise(F.col("labels"))).alias("label")
    return results.select(*by, label).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("rows"))
