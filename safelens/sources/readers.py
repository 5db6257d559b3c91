"""Labelled corpora from files and tables, and adapters of public benchmark schemas."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import is_blank, strip
from .ranges import ORD, csv_rows, json_rows, numbered, place

CANONICAL = ("text", "labels", "source_path", "raw_labels", "source")


def _suffix(path: str) -> str:
    return Path(str(path).split("?")[0].rstrip("/")).suffix.lower()


def read_rows(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(ord, row VARIANT) of .jsonl, .json or .csv files: one, or a folder of parts. ``ord`` sorts rows as they stand in the files, these by name.

    Malformed lines raise, or are dropped if not strict. All three formats are read in ranges, so a large file takes many tasks.
    """
    suffix, parse = _suffix(path), F.parse_json if strict else F.try_parse_json
    if suffix == ".jsonl":
        lines = spark.read.text(str(path)).select(place().alias("ord"), "value").filter(~is_blank(F.col("value")))
        # The parser sees no blank line, wherever the optimiser puts the filters.
        return lines.select("ord", parse(F.when(~is_blank(F.col("value")), F.col("value"))).alias("row")).filter("row IS NOT NULL")
    if suffix == ".json":
        return json_rows(spark, str(path), strict)
    if suffix == ".csv":
        return csv_rows(spark, str(path))
    raise ValueError(f"unsupported file type: {path}")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Lines of .jsonl files that don't parse: ord, value, and line, the number in their file, from 1."""
    lines = numbered(spark.read.text(str(path)).select(place().alias("ord"), "value"), "line")
    return lines.filter(~is_blank(F.col("value")) & F.try_parse_json("value").isNull()).select("ord", "value", (F.col("line") + 1).alias("line"))


def canonical_rows(rows: DataFrame, source_path: str = "", injection_flag: bool = True) -> DataFrame:
    """Canonical records of (ord, row VARIANT): ord, text, labels, source_path, raw_labels, source. Rows without text go."""
    source = F.coalesce(F.variant_get("row", "$.source", "string"), F.lit(""))
    out, row, lists = L.keyed(rows.withColumn("source", source))
    out = out.withColumn("text", L.pick_text(row)).filter(F.col("text") != "")
    return out.select("ord", "text", L.labels_for(row, injection_flag, lists).alias("labels"), F.lit(source_path).alias("source_path"), L.raw_labels(row, lists).alias("raw_labels"), "source")


def read_corpora(spark: SparkSession, paths: Iterable[str], missing_ok: bool = True) -> DataFrame:
    """Canonical records of several files, with path_ord and ord for scan order. A missing file is empty, or raises."""
    out = None
    for i, path in enumerate(paths):
        local = Path(str(path).removeprefix("file://"))
        if "://" not in str(path).removeprefix("file://") and not local.exists():
            if not missing_ok:
                raise FileNotFoundError(str(path))
            continue
        one = canonical_rows(read_rows(spark, path), str(path)).withColumn("path_ord", F.lit(i))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], f"ord {ORD}, text string, labels array<string>, source_path string, raw_labels array<string>, source string, path_ord int")
    return out


def filtered(rows: DataFrame, exclude: Iterable[str] = (), include: Iterable[str] = ()) -> DataFrame:
    return rows.filter(~L.excluded(F.col("raw_labels"), exclude) & L.included(F.col("raw_labels"), include))


def from_text(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "text string")


def _text(df: DataFrame, *names: str) -> Column:
    """The first non-empty of the columns there are, stripped."""
    found = [F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")) for n in names if n in df.columns]
    return strip(F.coalesce(*found, F.lit("")).cast("string"))


def _adapter(df: DataFrame, text: Column, gold: Column) -> DataFrame:
    return df.select(text.alias("text"), F.coalesce(gold, F.lit(False)).cast("int").alias("gold")).filter(F.col("text") != "")


def _number(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def injection_texts(df: DataFrame) -> DataFrame:
    label = F.col("label").cast("string") if "label" in df.columns else F.lit("0")
    return _adapter(df, _text(df, "text", "prompt"), label.isin("1", "true", "injection"))


def behaviours(harmful: DataFrame | None, benign: DataFrame | None) -> DataFrame:
    parts = [_adapter(d, _text(d, "Goal", "Behavior"), F.lit(bool(g))) for d, g in ((harmful, 1), (benign, 0)) if d is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def labelled_texts(df: DataFrame) -> DataFrame:
    return _adapter(df, _text(df, "text"), _number(df, "label").cast("int") == 1)


def chatbot_prompts(df: DataFrame) -> DataFrame:
    return _adapter(df, _text(df, "User Prompt"), _number(df, "Prompt injection").cast("int") == 1)


def hate_scores(df: DataFrame, least: float = 0.5) -> DataFrame:
    return _adapter(df, _text(df, "text"), _number(df, "hate_speech_score") >= F.lit(least))


def comments(df: DataFrame, least: float = 0.5) -> DataFrame:
    return _adapter(df, _text(df, "comment_text"), _number(df, "toxicity") >= F.lit(least))


# The held-out sets by their names, each with the adapter of its schema.
HELD_OUT = {
    "JasperLS/prompt-injections": injection_texts,
    "JailbreakBench/JBB-Behaviors": behaviours,
    "xTRam1/safe-guard-prompt-injection": labelled_texts,
    "reshabhs/SPML_Chatbot_Prompt_Injection": chatbot_prompts,
    "ucberkeley-dlab/measuring-hate-speech": hate_scores,
    "civil_comments": comments,
}


def held_out(name: str, splits: dict[str, DataFrame]) -> DataFrame:
    """(text, gold) of a held-out set from its splits: ``train`` if there is one, else the first; behaviours take both of theirs."""
    if name not in HELD_OUT:
        raise ValueError(f"unknown held-out set {name}")
    if HELD_OUT[name] is behaviours:
        return behaviours(splits.get("harmful"), splits.get("benign"))
    return HELD_OUT[name](splits["train"] if "train" in splits else next(iter(splits.values())))


def chosen_split(splits: dict[str, DataFrame], split: str | None = None) -> DataFrame:
    """For sets without an adapter: the named split; else ``test`` if there is one, else the first."""
    return splits[split or ("test" if "test" in splits else next(iter(splits)))]


# Positive names of the bake-off, by task, and the fields it looks for, in order.
POSITIVE = {
    "injection": ("injection", "inject", "prompt_injection", "jailbreak", "1", "true", "attack", "malicious", "unsafe"),
    "moderation": ("harmful_content", "harmful", "toxic", "hate", "sexual", "1", "true", "unsafe", "harassment", "violence"),
}
TEXT_FIELDS = ("text", "prompt", "comment_text", "content", "input", "question", "instruction")
LABEL_FIELDS = ("label", "labels", "toxicity", "toxic", "gold", "class")


def generic(df: DataFrame, task: str, text_field: str | None = None, label_field: str | None = None) -> DataFrame:
    """(text, gold) by field names, any case, in the table's column order. Numbers are positive if they truncate to 1."""
    find = lambda names: next((c for c in df.columns if c.lower() in names), None)
    text, label = text_field or find(TEXT_FIELDS), label_field or find(LABEL_FIELDS)
    if text is None or label is None:
        raise ValueError(f"no text or label field among {df.columns}")
    kind = dict(df.dtypes)[label]
    c = F.col(f"`{label}`")
    gold = F.lower(strip(c)).isin(*POSITIVE[task]) if kind == "string" else (c if kind == "boolean" else c.cast("int") == 1)
    return _adapter(df, _text(df, text), gold)


def four_classes(injection: DataFrame, hate: DataFrame, sexual: DataFrame, questions: DataFrame, safe_comments: DataFrame) -> DataFrame:
    """(text, true): the assembled corpus of four classes, distinct texts within each."""
    part = lambda df, text, keep, label: df.filter(keep).select(text.alias("text"), F.lit(label).alias("true")).filter("text <> ''").dropDuplicates(["text"])
    out = part(injection, _text(injection, "text", "prompt"), F.col("label").cast("int") == 1, "prompt_injection")
    out = out.unionByName(part(hate, _text(hate, "text"), _number(hate, "hate_speech_score") >= 1.0, "harmful_content"))
    out = out.unionByName(part(sexual, _text(sexual, "comment_text"), _number(sexual, "sexual_explicit") >= 0.4, "sexual"))
    calm = (_number(safe_comments, "toxicity") < 0.1) & (_number(safe_comments, "sexual_explicit") < 0.1)
    asked = questions.select(_text(questions, "question").alias("text")).unionByName(safe_comments.filter(calm).select(_text(safe_comments, "comment_text").alias("text")))
    return out.unionByName(asked.filter("text <> ''").dropDuplicates(["text"]).select("text", F.lit("safe").alias("true")))


def model_config(path: str | Path) -> dict:
    """id2label (lower case), number of labels and problem type of a model's config.json."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    names = {int(k): str(v).lower() for k, v in (data.get("id2label") or {}).items()}
    return {"id2label": names, "num_labels": data.get("num_labels", len(names)), "problem_type": data.get("problem_type")}


def first_existing(candidates: Iterable[str | Path], pattern: str | None = None) -> Path:
    """The first candidate that exists; with a pattern, its first match there by name."""
    for candidate in map(Path, candidates):
        if candidate.exists():
            if pattern is None:
                return candidate
            if found := sorted(candidate.glob(pattern)):
                return found[0]
    raise FileNotFoundError("none of the candidates exists")
