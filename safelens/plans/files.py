"""Queries over files that the engine writes from the given tables and reads again: order of rows, JSON arrays, CSV with line ends in cells."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable

from pyspark.sql import functions as F

from .. import config
from ..config import PROFILES
from ..operators import reports
from ..operators import sampling as W
from ..operators.cascade import classify, spread
from ..operators.seen import SeenCorpus
from ..sources import readers, sinks


def _documents(spark, sf, *columns):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", *columns)


def scan_order_first(spark, sf):
    """First row of each text key of a corpus of many parts, whose sizes double from part to part: the one that stands first in the files."""
    docs = _documents(spark, sf).withColumn("p", F.format_string("%03d", F.lit(99) - F.floor(F.log2(F.col("doc_id") + 1)).cast("int")))
    lines = docs.repartitionByRange("p", F.desc("doc_id")).sortWithinPartitions("p", F.desc("doc_id")).select("p", F.to_json(F.struct("doc_id", "text")).alias("value"))
    at = f"{sinks.scratch(spark)}/a.jsonl"
    lines.write.partitionBy("p").text(at)
    rows = readers.read_rows(spark, at).select("ord", F.expr("variant_get(row, '$.doc_id', 'long')").alias("doc_id"), F.expr("variant_get(row, '$.text', 'string')").alias("text"))
    return W.first_of_each(rows, W.text_key(F.col("text")), "ord").select("doc_id")


def json_array_documents(spark, sf):
    """Every document from files that are one JSON array each, half of them below the key ``rows``."""
    docs, at = _documents(spark, sf, "source"), sinks.scratch(spark)
    for part, wrapped in (("a", True), ("b", False)):
        sinks.write_json_arrays(docs.filter(F.col("doc_id") % 2 == int(wrapped)), f"{at}/{part}.json", F.col("doc_id"), wrapped=wrapped)
    get = lambda path, kind: F.variant_get("row", path, kind)
    rows = readers.read_rows(spark, f"{at}/a.json").unionByName(readers.read_rows(spark, f"{at}/b.json"))
    return rows.select(get("$.doc_id", "long").alias("doc_id"), F.md5(F.coalesce(get("$.text", "string"), F.lit(""))).alias("text_md5"), get("$.source", "string").alias("source"))


def csv_documents(spark, sf):
    """Every document from CSV files whose cells hold line ends, commas and quotes."""
    at = f"{sinks.scratch(spark)}/a.csv"
    cells = _documents(spark, sf, "source").select(F.concat(F.lit('"cited", '), F.coalesce("text", F.lit("")), F.lit('\n"')).alias("text"), "doc_id", "source")
    cells.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at)
    get = lambda path: F.variant_get("row", path, "string")
    return readers.read_rows(spark, at).select(get("$.doc_id").cast("long").alias("doc_id"), F.md5(get("$.text")).alias("text_md5"), get("$.source").alias("source"))


def incremental_documents(spark, sf):
    """Documents in three runs: of each text key the first row of the first run that has it, and the run."""
    corpus, docs = SeenCorpus(spark, f"{sinks.scratch(spark)}/seen"), _documents(spark, sf)
    for third in (2, 0, 1):
        corpus.add(docs.filter(F.col("doc_id") % 3 == third).select("doc_id", W.text_key(F.col("text")).alias("key")), F.col("key"), "doc_id")
    return corpus.rows().select("doc_id", F.col("run").cast("long").alias("run"))


#: Rows of the suite's sample.
SAMPLE = 1000


def suite_report(spark, sf):
    """The suite over the labelled documents: its report is written, read again, and told by label."""
    docs = _documents(spark, sf, "source").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter(F.col("toxic").isNotNull() & F.col("text").rlike(r"\S"))
    toxic = F.col("toxic") == 1
    corpus = docs.select(F.lit(0).alias("path_ord"), F.col("doc_id").alias("ord"), "text", F.when(toxic, F.array(F.lit("harmful_content"))).otherwise(F.array().cast("array<string>")).alias("labels"),
                         F.array(F.when(toxic, "toxic").otherwise("fine")).alias("raw_labels"), F.lit("documents").alias("source_path"), "source")
    with tempfile.TemporaryDirectory() as at:  # a report is a file of the driver's
        path = sinks.write_report(reports.evaluate(corpus, PROFILES["default"], limit=SAMPLE), f"{at}/report.json")
        report = json.loads(path.read_text(encoding="utf-8"))
    rows = [(label, report["rows"], *(v[k] for k in ("tp", "fp", "fn", "tn")), float(v["precision"]), float(v["recall"])) for label, v in report["per_label"].items()]
    return spark.createDataFrame(rows, "label string, rows long, tp long, fp long, fn long, tn long, precision double, recall double")


def recommended_thresholds(spark, sf):
    """Thresholds that all searches recommend for the labelled documents: written as YAML, read again."""
    docs = spread(_documents(spark, sf)).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("toxic IS NOT NULL")
    scored = classify(docs, PROFILES["default"]).withColumn("gold", F.when(F.col("toxic") == 1, F.array(F.lit("harmful_content"))).otherwise(F.array().cast("array<string>")))
    scored.select("gold", "force_route", "router", "pi", "harmful", "sexual").write.parquet(stored := f"{sinks.scratch(spark)}/scored")
    found = reports.calibrate_all(spark.read.parquet(stored), min_route_recall=0.6, min_label_recall=0.5)
    with tempfile.TemporaryDirectory() as at:
        settings = config.load(sinks.write_recommended(f"{at}/report.json", found["recommended"]))
    thresholds = config.as_mapping(settings)["thresholds"]
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(thresholds.items())], "name string, value double")


QUERIES = [scan_order_first, json_array_documents, csv_documents, incremental_documents, suite_report, recommended_thresholds]


def oracle_sql(key: str, scored: Callable[[str], str], counts: Callable[[str, str], str], prf: Callable[[], str]) -> dict[str, str]:
    """``key``: the text key in SQL; ``scored``: the cascade's columns over a relation; ``counts`` and ``prf``: confusion counts and ratios."""
    sample = f"""SELECT text, toxic FROM (SELECT *, row_number() OVER (ORDER BY later, CASE WHEN later THEN md5('8:' || k) ELSE '' END, CASE WHEN NOT later THEN p END, k) AS q FROM (
SELECT *, p > {SAMPLE // 4} AS later FROM (SELECT *, row_number() OVER (PARTITION BY toxic = 1 ORDER BY md5('7:' || k), k) AS p FROM (
SELECT text, toxic, md5({key}) AS k, row_number() OVER (PARTITION BY {key} ORDER BY doc_id) AS first FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND regexp_matches(text, '\\S')) WHERE first = 1)
WHERE p <= {SAMPLE // 4 + SAMPLE})) WHERE q <= {SAMPLE}"""
    gold = "CASE WHEN l.label = 'harmful_content' THEN toxic = 1 ELSE false END"
    pred = "CASE l.label WHEN 'prompt_injection' THEN attack >= 0.5 WHEN 'harmful_content' THEN harm0 >= 0.93::DOUBLE ELSE sex0 >= 0.93::DOUBLE END"
    return {
        "suite_report": f"""WITH {scored(sample)}, e AS (SELECT l.label, {gold} AS g, {pred} AS p FROM s CROSS JOIN (VALUES ('prompt_injection'), ('harmful_content'), ('sexual')) l(label)),
c AS (SELECT label, count(*) AS rows, {counts('g', 'p')} FROM e GROUP BY label), r AS (SELECT *, {prf()} FROM c) SELECT label, rows, tp, fp, fn, tn, precision, recall FROM r""",
        "incremental_documents": f"SELECT doc_id, run FROM (SELECT doc_id, (doc_id + 1) % 3 AS run, row_number() OVER (PARTITION BY {key} ORDER BY (doc_id + 1) % 3, doc_id) AS p FROM documents) WHERE p = 1",
        "scan_order_first": f"SELECT max(doc_id) AS doc_id FROM documents GROUP BY {key}",
        "json_array_documents": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, source FROM documents",
        "csv_documents": "SELECT doc_id, md5('\"cited\", ' || coalesce(text, '') || chr(10) || '\"') AS text_md5, coalesce(source, '') AS source FROM documents",
    }
