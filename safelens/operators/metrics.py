"""Confusion counts, precision, recall, F1, percentiles, routing and latency figures. One aggregation each; ranks take two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HARMFUL_CONTENT, PROMPT_INJECTION, PUBLIC_LABELS, SAFE, SEXUAL
from .ranks import at_ranks, percentiles

ROUTE_OUTCOMES = ("direct_prompt_injection", "direct_harmful_content", "direct_safe", "fast_allow", "both_models", "prompt_only", "moderation_only", "no_model")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def pct(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(ratio(a, b) * 100, digits)


def confusion(gold: Column, pred: Column, weight: Column | None = None) -> dict[str, Column]:
    """Aggregates tp, fp, fn, tn; ``weight`` counts a row several times."""
    w = F.lit(1) if weight is None else weight
    total = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0)).cast("long")
    return {"tp": total(gold & pred), "fp": total(~gold & pred), "fn": total(gold & ~pred), "tn": total(~gold & ~pred)}


def prf(tp: Column, fp: Column, fn: Column, digits: int | None = 4) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}
    return out if digits is None else {k: F.round(v, digits) for k, v in out.items()}


def binary_metrics(df: DataFrame, gold: Column, pred: Column, by: tuple[str, ...] = (), digits: int | None = 4, accuracy: bool = False) -> DataFrame:
    counted = df.groupBy(*by).agg(*[c.alias(k) for k, c in confusion(gold, pred).items()])
    out = counted.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"), digits))
    if accuracy:
        out = out.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
    return out


def per_label_metrics(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row per public label, in a single pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("label"), F.array_contains(gold, p).alias("g"), F.array_contains(pred, p).alias("p")) for p in PUBLIC_LABELS])).alias("x")
    return binary_metrics(df.select(pairs).select("x.*"), F.col("g"), F.col("p"), ("label",))


def macro_f1(per_label: DataFrame) -> DataFrame:
    return per_label.agg(F.avg("f1").alias("macro_f1"))


def any_label_metrics(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return binary_metrics(df, F.size(gold) > 0, F.size(pred) > 0)


def confusion_matrix(df: DataFrame, true: str, pred: str, classes: tuple[str, ...] = (PROMPT_INJECTION, HARMFUL_CONTENT, SEXUAL, SAFE)) -> DataFrame:
    return df.groupBy(true).pivot(pred, list(classes)).count().na.fill(0)


def multiclass_metrics(df: DataFrame, true: str, pred: str, classes: tuple[str, ...] = (PROMPT_INJECTION, HARMFUL_CONTENT, SEXUAL, SAFE)) -> DataFrame:
    """Per class: counts and ratios, from one small table of pairs of classes."""
    pairs = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    each = pairs.select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"), "t", "p", "n")
    counted = each.groupBy("class").agg(*[c.alias(k) for k, c in confusion(F.col("t") == F.col("class"), F.col("p") == F.col("class"), F.col("n")).items()])
    return counted.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def false_pass(df: DataFrame, gold: str = "gold", pred: str = "labels") -> DataFrame:
    """Unsafe rows without any label that no model has seen, and those that were skipped; shares of the unsafe."""
    unsafe, none = F.size(gold) > 0, ~F.col("prompt_ran") & ~F.col("moderation_ran")
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(unsafe).alias("unsafe_rows"), F.count_if(unsafe & (F.size(pred) == 0) & none).alias("unsafe_false_pass_rows"), F.count_if(unsafe & none).alias("unsafe_skipped_rows")
    )
    return counted.withColumn("unsafe_false_pass_pct", pct(F.col("unsafe_false_pass_rows"), F.col("unsafe_rows")))


def route_counts(df: DataFrame) -> DataFrame:
    """Rows and share by route outcome, and how many were forced by a rule."""
    counted = df.groupBy("route_outcome").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("force_route") > 0).alias("rule_forced"))
    return counted.withColumn("pct", pct(F.col("rows"), F.sum("rows").over(Window.partitionBy())))


def model_rows(df: DataFrame, gold: str = "gold") -> DataFrame:
    """Rows that each model sees, those classified directly, and how well "some model ran" finds the unsafe rows."""
    prompt, moderation, any_model, unsafe = F.col("prompt_ran"), F.col("moderation_ran"), F.col("prompt_ran") | F.col("moderation_ran"), F.size(gold) > 0
    direct = F.col("direct_prompt") | F.col("direct_harmful")
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(prompt).alias("prompt_rows"), F.count_if(moderation).alias("moderation_rows"), F.count_if(any_model).alias("any_model_rows"),
        F.count_if(direct | F.col("fast_allow")).alias("direct_rows"), F.count_if(direct).alias("direct_unsafe_rows"), *[c.alias(k) for k, c in confusion(unsafe, any_model).items()],
    )
    return counted.withColumns({"any_model_pct": pct(F.col("any_model_rows"), F.col("rows")), "direct_pct": pct(F.col("direct_rows"), F.col("rows"))} | prf(F.col("tp"), F.col("fp"), F.col("fn")))


def direct_precision(df: DataFrame, gold: str = "gold") -> DataFrame:
    """How many directly classified rows are right: tp / max(1, tp + fp)."""
    shortcut = {"direct_prompt": PROMPT_INJECTION, "direct_harmful": HARMFUL_CONTENT}
    aggs = []
    for flag, label in shortcut.items():
        tp, n = F.count_if(F.col(flag) & F.array_contains(gold, label)), F.count_if(F.col(flag))
        aggs += [n.alias(f"{flag}_rows"), F.round(tp / F.greatest(F.lit(1), n), 4).alias(f"{flag}_precision")]
    return df.agg(*aggs, F.count_if(F.col("direct_safe")).alias("direct_safe_rows"), F.count_if(F.col("direct_safe") & (F.size(gold) > 0)).alias("direct_safe_false_pass_rows"))


def counts(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    return df.groupBy(F.col(column).alias(name)).agg(F.count(F.lit(1)).alias("rows"))


def exploded_counts(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    return df.select(F.explode(column).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("rows"))


def distinct_values(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """The distinct elements of an array column."""
    return df.select(F.explode(column).alias(name)).distinct()


def latency(df: DataFrame, column: str, by: tuple[str, ...] = (), digits: int = 2, store: bool = False) -> DataFrame:
    """avg, p50, p95 (inclusive interpolation; 0 for no values) and max of each group."""
    found = percentiles(df, column, by, (50, 95), store)
    shown = [F.round(F.col(c), digits).alias(name) for c, name in (("mean", "avg"), ("p50", "p50"), ("p95", "p95"), ("max", "max"))]
    if by:  # groups without a value have percentiles of 0
        every = df.select(*[F.col(c).alias(f"__{c}") for c in by]).distinct()
        same = F.lit(True)
        for c in by:
            same = same & F.col(f"__{c}").eqNullSafe(F.col(c))
        found = every.join(found, same, "left").select(*[F.col(f"__{c}").alias(c) for c in by], "mean", "p50", "p95", "max")
    else:
        found = found.agg(*[F.max(c).alias(c) for c in ("mean", "p50", "p95", "max")])
    return found.select(*by, *shown).na.fill(0.0, ["p50", "p95"])


def nearest_rank(df: DataFrame, column: str, by: str) -> DataFrame:
    """min, the elements at n/4, n/2 and 3n/4 of the sorted values, max and mean of each group."""
    wanted = {name: (k / 4, lambda n, k=k: F.floor(n * k / 4)) for k, name in ((1, "q1"), (2, "median"), (3, "q3"))}
    return at_ranks(df, column, (by,), wanted).select(by, "n", "min", "q1", "median", "q3", "max", "mean")


def recall_at(df: DataFrame, scores: dict[str, float]) -> DataFrame:
    """Share of rows over each score's threshold, and over any."""
    hits = {name: F.col(name) >= F.lit(t) for name, t in scores.items()}
    either = F.lit(False)
    for h in hits.values():
        either = either | h
    return df.agg(*[ratio(F.count_if(h), F.count(F.lit(1))).alias(f"recall_{name}") for name, h in hits.items()], ratio(F.count_if(either), F.count(F.lit(1))).alias("recall_either"))


def bce(z: Column, y: Column, temperature: Column, eps: float = 1e-7) -> Column:
    """Loss of one row at a temperature; average it."""
    p = F.least(F.greatest(F.lit(1.0) / (F.lit(1.0) + F.exp(-z / temperature)), F.lit(eps)), F.lit(1 - eps))
    return -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))


def throughput(rows: int, seconds: float) -> dict[str, float]:
    return {"rows_per_second": rows / seconds if seconds else 0.0, "avg_ms_per_row": 1000 * seconds / rows if rows else 0.0}


def disagreement(df: DataFrame, a: str, b: str, least: float = 0.3) -> DataFrame:
    """Means of a score in two modes of inference, and how many rows differ by more than ``least``."""
    return df.agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.count_if(F.abs(F.col(a) - F.col(b)) > F.lit(least)).alias("flagged"), (F.abs(F.avg(a) - F.avg(b)) > F.lit(least)).alias("inconsistent"))
