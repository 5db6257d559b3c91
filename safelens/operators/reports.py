"""Suite reports, bake-off leaderboards, contamination flags, subcategories and coverage."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PUBLIC_LABELS, Settings, as_mapping
from ..functions.labels import bucket_for, token_bucket
from ..functions.scoring import word_total
from ..sources.sinks import section
from . import calibrate, metrics
from .cascade import classify
from .sampling import balanced_sample, first_of_each, text_key

# Which public label a fine category belongs to, and from which score a category counts.
SUBCATEGORY_HEADS = {
    "harassment": "harmful_content", "harassment/threatening": "harmful_content", "hate": "harmful_content", "hate/threatening": "harmful_content",
    "self-harm": "harmful_content", "self-harm/intent": "harmful_content", "self-harm/instructions": "harmful_content",
    "violence": "harmful_content", "violence/graphic": "harmful_content", "sexual": "sexual", "sexual/minors": "sexual",
}
CATEGORY_THRESHOLD = 0.15
# Parts of dataset names that each model was trained on.
TRAINED_ON = {
    "ours": ("shieldlm", "threat-matrix", "wambosec", "deepset/prompt-injections", "jasperls", "rogue-security", "qualifire"),
    "deepset": ("deepset/prompt-injections", "jasperls"),
    "distilbert-pi": ("deepset/prompt-injections", "jasperls"),
    "protectai": ("deepset/prompt-injections", "jasperls", "safe-guard"),
    "toxic-bert": ("jigsaw", "civil_comments", "civil"),
    "minilm-jigsaw": ("jigsaw", "civil_comments", "civil"),
    "distil-toxic": ("jigsaw", "civil_comments", "civil"),
}


def trained_on(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, f) for m, families in TRAINED_ON.items() for f in families], "model string, family string")


def contamination(models: DataFrame, datasets: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """(model, dataset, contaminated): whether the dataset's name contains a family that the model was trained on."""
    families = trained_on(models.sparkSession) if families is None else families
    known = families.groupBy("model").agg(F.collect_set("family").alias("families"))  # a registry of a few rows a model
    pairs = models.select("model").crossJoin(datasets.select("dataset"))  # two registries
    hit = F.coalesce(F.exists("families", lambda f: F.lower("dataset").contains(f)), F.lit(False))
    return pairs.join(known, "model", "left").select("model", "dataset", hit.alias("contaminated"))


def leaderboard(scores: DataFrame, by: str = "model") -> DataFrame:
    """Best-F1 threshold of every model from (model, gold, score), best first. One pass over the rows for all models."""
    values = sorted(set(calibrate.BEST_F1_GRID))
    cells = scores.select(by, F.col("gold").cast("boolean").alias("gold"), calibrate.reached(F.col("score"), values).alias("level")).groupBy(by, "gold", "level").agg(F.count(F.lit(1)).alias("n"))
    swept = cells.crossJoin(F.broadcast(calibrate.grid(scores.sparkSession, threshold=values)))
    pred, g = F.col("level") >= calibrate.level("threshold", values), F.col("gold")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    c = swept.groupBy(by, "threshold").agg(total(g & pred).alias("tp"), total(~g & pred).alias("fp"), total(g & ~pred).alias("fn"))
    c = c.withColumns(metrics.prf(F.col("tp"), F.col("fp"), F.col("fn"), None))
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("f1"), (F.col("threshold") == F.lit(0.5)).desc(), "threshold"))
    return c.withColumn("__b", best).filter("__b = 1").select(by, "threshold", "precision", "recall", "f1").orderBy(F.desc("f1"), by)


@F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
def parse_category_scores(raw: pd.Series) -> pd.Series:
    """Category scores written as JSON or as a Python literal: pairs or a mapping; anything else is empty."""
    import ast

    def one(text):
        if text is None:
            return {}
        try:
            data = json.loads(text)
        except ValueError:
            try:
                data = ast.literal_eval(text)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                return {}
        if isinstance(data, dict):
            return {str(k): float(v) for k, v in data.items()}
        if isinstance(data, list | tuple):
            return {str(p[0]): float(p[1]) for p in data if isinstance(p, list | tuple) and len(p) == 2}
        return {}

    return raw.map(one)


def subcategories(df: DataFrame, categories: Column, harmful: Column, sexual: Column, harmful_threshold: float = 0.5, sexual_threshold: float = 0.5, least: float = CATEGORY_THRESHOLD, digits: int = 4) -> DataFrame:
    """Per fine category: positives, and how well its public label's score finds them. Most positives first."""
    heads = F.create_map(*[F.lit(x) for pair in SUBCATEGORY_HEADS.items() for x in pair])
    names = F.array(*[F.lit(k) for k in SUBCATEGORY_HEADS])
    rows = df.select(categories.alias("c"), (harmful >= F.lit(harmful_threshold)).alias("h"), (sexual >= F.lit(sexual_threshold)).alias("s")).select("c", "h", "s", F.explode(names).alias("subcategory"))
    rows = rows.select("subcategory", F.element_at(heads, F.col("subcategory")).alias("head"), (F.coalesce(F.element_at("c", F.col("subcategory")), F.lit(0.0)) >= F.lit(least)).alias("gold"), "h", "s")
    pred = F.when(F.col("head") == "sexual", F.col("s")).otherwise(F.col("h"))
    out = metrics.binary_metrics(rows.withColumn("pred", pred), F.col("gold"), F.col("pred"), ("subcategory", "head"), digits)
    return out.withColumn("n_pos", F.col("tp") + F.col("fn")).orderBy(F.desc("n_pos"), "subcategory")


def coverage_holes(df: DataFrame, true: str, pred: str, key: str, show: int = 10) -> DataFrame:
    """Unsafe rows that were called safe."""
    return df.filter((F.col(true) != "safe") & (F.col(pred) == "safe")).orderBy(key).limit(show)


def rescues(df: DataFrame, key: str, injection_threshold: float = 0.5, moderation_threshold: float = 0.5, rescued: int = 5, missed: int = 8) -> DataFrame:
    """Rows that the injection model misses: those that moderation finds, and those that both miss."""
    miss = df.filter(F.col("pi") < F.lit(injection_threshold)).withColumn("kind", F.when(F.greatest("harmful", "sexual") >= F.lit(moderation_threshold), "rescued").otherwise("missed"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(key))
    return miss.withColumn("__p", place).filter(F.col("__p") <= F.when(F.col("kind") == "rescued", rescued).otherwise(missed)).drop("__p")


def shown(df: DataFrame, text: str = "text", most: int = 70) -> DataFrame:
    """Texts cut to ``most`` code points for display."""
    return df.withColumn(text, F.left(F.col(text), F.lit(most)))


def console_table(df: DataFrame, title: str = "", digits: int = 3, most: int = 1000) -> str:
    """A report table as aligned text: numbers to the right, doubles with ``digits`` decimals."""
    rows = [r.asDict() for r in df.limit(most).collect()]
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    right = {c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal")}
    wide = {c: max([len(c), *(len(cell(r[c])) for r in rows)]) for c in df.columns}
    line = lambda get: "  ".join(get(c).rjust(wide[c]) if c in right else get(c).ljust(wide[c]) for c in df.columns).rstrip()
    body = [line(lambda c, r=r: cell(r[c])) for r in rows]
    head = line(lambda c: c)
    return "\n".join([*([title] if title else []), head, "-" * len(head), *body])


def leaderboard_table(board: DataFrame, flags: DataFrame, dataset: str) -> str:
    """The bake-off's console table: a model trained on the dataset is flagged ``TRAIN!``, any other is ``clean``."""
    own = flags.filter(F.col("dataset") == dataset).select("model", F.when(F.col("contaminated"), "TRAIN!").otherwise("clean").alias("flag"))
    return console_table(board.join(own, "model", "left").select("model", F.coalesce("flag", F.lit("clean")).alias("flag"), "f1", "threshold", "precision", "recall").orderBy(F.desc("f1"), "model"), f"dataset={dataset}")


def deployable(models: DataFrame, ceiling: bool = False, parents: bool = False) -> DataFrame:
    """Models of a registry (deployable, parent flags) that take part."""
    return models.filter((F.col("deployable") | F.lit(ceiling)) & (~F.col("parent") | F.lit(parents)))


def prepare(corpus: DataFrame, limit: int, seed: int = 7) -> DataFrame:
    """The suite's sample of canonical rows: first of each text key in scan order, then balanced over gold buckets."""
    unique = first_of_each(corpus, text_key(F.col("text")), "path_ord", "ord")
    keyed = unique.withColumn("bucket", bucket_for(F.col("labels"))).withColumn("row_key", F.md5(text_key(F.col("text"))))  # the same however files are dealt out
    return balanced_sample(keyed.drop("ord"), "bucket", "row_key", limit, seed)


def evaluate(corpus: DataFrame, settings: Settings, scorer=None, limit: int = 1000, seed: int = 7, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> dict:
    """A full suite report. The scored sample is cached once; every section is one small aggregation over it.

    ``include`` and ``exclude`` name raw labels, to be reported; the corpus has been filtered by them.
    """
    began = time.perf_counter()
    sample = prepare(corpus, limit, seed).withColumnRenamed("labels", "gold")
    scored = classify(sample, settings, scorer).withColumn("tokens", F.least(word_total(F.col("model_text")), F.lit(settings.max_length)))
    scored = scored.withColumn("token_bucket", token_bucket(F.col("tokens"))).cache()
    try:
        rows = scored.count()
        seconds = time.perf_counter() - began
        per_label = metrics.per_label_metrics(scored, "gold", "labels")
        routed = section(metrics.model_rows(scored))[0]
        against = {k: routed.pop(k) for k in ("tp", "fp", "fn", "tn", "precision", "recall", "f1")}
        routed.pop("rows")
        return {
            "rows": rows,
            "excluded_labels": sorted({x.lower() for x in exclude}),
            "included_labels": sorted({x.lower() for x in include}),
            "settings": as_mapping(settings),
            "sample": section(metrics.counts(scored, "bucket"), "value"),
            "raw_labels": section(metrics.exploded_counts(scored, "raw_labels"), "value"),
            "sources": section(metrics.counts(scored, "source_path"), "value"),
            "per_label": section(per_label, "label"),
            "macro_f1": section(metrics.macro_f1(per_label))[0]["macro_f1"],
            "unsafe_any": section(metrics.any_label_metrics(scored, "gold", "labels"))[0],
            "false_pass": section(metrics.false_pass(scored))[0],
            "routing": section(metrics.route_counts(scored), "route_outcome"),
            "models": routed | {"route_any_model_vs_unsafe": against},
            "direct": section(metrics.direct_precision(scored))[0],
            "tokens": section(metrics.counts(scored, "token_bucket"), "value") | {"stats": section(metrics.latency(scored, "tokens"))[0]},
            "performance": metrics.throughput(rows, seconds) | {"latency_ms": _model_latency(scored)},
        }
    finally:
        scored.unpersist()


def _model_latency(scored: DataFrame) -> dict:
    """Average, median, 95th percentile and largest milliseconds a row of every model whose scorer measures them."""
    timed = {"prompt_injection": "prompt_ms", "moderation": "moderation_ms"}
    return {name: section(metrics.latency(scored.filter(F.col(c).isNotNull()), c, digits=3))[0] for name, c in timed.items() if c in scored.columns}


def calibrate_all(scored: DataFrame, min_label_recall: float = 0.85, beta: float = 1.5, min_route_recall: float = 0.97, max_false_pass_pct: float = 1.0, min_precision: float = 0.95, veto: bool = True, score_scope: str = "all") -> dict:
    """All searches over scored rows (gold, force_route, router, pi, harmful, sexual), and what they recommend.

    ``score_scope``: label thresholds are chosen on ``all`` rows, or, for each model, on the ``routed`` rows only, those that the chosen
    route thresholds or a rule send to it; a threshold chosen on rows that a model never sees would be too high.
    """
    if score_scope not in ("all", "routed"):
        raise ValueError(f"unknown score_scope {score_scope}")
    one = lambda df: section(df)[0]
    columns = dict(zip(PUBLIC_LABELS, (F.col("pi"), F.col("harmful"), F.col("sexual")), strict=True))
    routes = one(calibrate.choose_joint_routes(scored, min_recall=min_route_recall))
    if score_scope == "all":
        labels = section(calibrate.choose_label_thresholds(scored, columns, min_recall=min_label_recall, beta=beta), "label")
    else:
        labels = {}
        for label, (rule, score, route) in {"prompt_injection": ("attack", "router.attack", "attack_route"), "harmful_content": ("moderation", "router.moderation", "moderation_route"), "sexual": ("moderation", "router.moderation", "moderation_route")}.items():
            seen = scored.filter(calibrate.forced(rule) | (F.col(score) >= F.lit(routes[route])))
            labels[label] = one(calibrate.choose_label_threshold(seen, F.array_contains("gold", label), columns[label], min_label_recall, beta))
    fast = one(calibrate.choose_fast_allow(scored, max_false_pass_pct=max_false_pass_pct))
    safe = one(calibrate.choose_direct_safe(scored, max_false_pass_pct=max_false_pass_pct))
    prompt = one(calibrate.choose_direct_label(scored, "prompt_injection", F.col("router.attack"), F.col("router.moderation"), min_precision=min_precision))
    harmful = one(calibrate.choose_direct_label(scored, "harmful_content", F.col("router.moderation"), F.col("router.attack"), min_precision=min_precision))
    capped = one(calibrate.choose_veto(scored, F.array_contains("gold", "prompt_injection"), F.col("pi"), F.col("harmful"), min_label_recall, beta)) if veto else {"max_harmful": 1.01}
    recommended = calibrate.recommend(routes, {k: v["threshold"] for k, v in labels.items()}, prompt, harmful, safe, capped["max_harmful"], fast["fast_allow"])
    return {"labels": labels, "routes": routes, "fast_allow": fast, "direct_safe": safe, "direct_prompt_injection": prompt, "direct_harmful_content": harmful, "veto": capped, "recommended": recommended}
