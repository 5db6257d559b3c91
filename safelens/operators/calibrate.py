"""Threshold and temperature calibration.

Rows are read once: they are counted by how many grid values their scores reach, which decides every comparison with
the grid exactly. The search itself then joins the grid with at most a few thousand counted cells, whatever
the corpus measures. A feasible candidate with the best key wins; of equals the first of the grid.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PUBLIC_LABELS
from ..functions.rules import ATTACK, MODERATION
from ..sources.sinks import discard, scratch
from .metrics import bce, pct, prf, ratio

# The grids, in the order in which candidates are tried.
LABEL_GRID = tuple(round(x / 100, 2) for x in range(5, 96, 5))
ROUTE_GRID = (0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)
SINGLE_ROUTE_GRID = (0.0, 0.005, *ROUTE_GRID)
FAST_ALLOW_GRID = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2)
SAFE_GRID, SAFE_ROUTE_GRID = (0.999, 0.995, 0.99, 0.98, 0.97, 0.95), (0.001, 0.002, 0.005, 0.01, 0.02)
DIRECT_GRID, DIRECT_OTHER_GRID = (0.999, 0.995, 0.99, 0.98, 0.97, 0.95, 0.9, 0.85, 0.8), (0.001, 0.002, 0.005, 0.01, 0.02, 0.05)
VETO_SCORE_GRID = (*(round(x / 100, 2) for x in range(50, 96, 5)), 0.97, 0.99)
VETO_GRID = (1.01, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)
SWEEP_GRID = (0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
BEST_F1_GRID = (0.5, *(round(x / 100, 2) for x in range(1, 100)))
TEMPERATURES = tuple(round(x * 0.05, 2) for x in range(1, 200))


def grid(spark: SparkSession, **axes: Sequence[float]) -> DataFrame:
    """All combinations, the first axis outermost, numbered by ``ord``."""
    rows: list[tuple[float, ...]] = [()]
    for values in axes.values():
        rows = [(*r, float(v)) for r in rows for v in values]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, " + ", ".join(f"{a} double" for a in axes))


def reached(score: Column, values: Sequence[float]) -> Column:
    """How many of the grid's values are at or under the score.

    The score is named once for each value, so the optimiser computes it in a projection of its own, once a row;
    inside a lambda it would be put in place of its name and computed for every value.
    """
    return _place(values, lambda g: score >= g)


def passed(score: Column, values: Sequence[float]) -> Column:
    """How many of the grid's values are under the score."""
    return _place(values, lambda g: score > g)


def _place(values: Sequence[float], under: Callable[[Column], Column]) -> Column:
    ordered = sorted(values)
    out = F.when(under(F.lit(float(ordered[-1]))), len(ordered))
    for n in range(len(ordered) - 1, 0, -1):
        out = out.when(under(F.lit(float(ordered[n - 1]))), n)
    return out.otherwise(0)


def level(value: str, values: Sequence[float]) -> Column:
    """Place, from 1, of a grid value: score >= value means reached >= level, score <= value means passed < level."""
    return F.array_position(F.array(*[F.lit(float(v)) for v in sorted(values)]), F.col(value)).cast("int")


def fbeta(p: Column, r: Column, beta: float) -> Column:
    b = F.lit(beta * beta)
    return F.coalesce(F.try_divide((1 + b) * p * r, b * p + r), F.lit(0.0))


def _cells(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(k) for k, c in columns.items()]).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")


def _first(candidates: DataFrame, *order: Column) -> DataFrame:
    return candidates.orderBy(*order, F.col("ord").asc()).limit(1)


def _over(g: DataFrame, cells: DataFrame) -> DataFrame:
    """Grid by cells; both sides have sizes that the grids fix, so the small grid is broadcast."""
    return cells.crossJoin(F.broadcast(g))


def forced(route: str) -> Column:
    return F.array_contains("force_route", route)


def sweep(df: DataFrame, gold: Column, score: Column, values: Sequence[float], digits: int | None = 4) -> DataFrame:
    """ord, threshold, tp, fp, fn, tn, precision, recall, f1 for every threshold; zeros where there are no rows."""
    cells, every = _cells(df, gold=gold, level=reached(score, values)), grid(df.sparkSession, threshold=values)
    pred, g = F.col("level") >= level("threshold", values), F.col("gold")
    counted = _over(every, cells).groupBy("ord").agg(_sum(g & pred).alias("tp"), _sum(~g & pred).alias("fp"), _sum(g & ~pred).alias("fn"), _sum(~g & ~pred).alias("tn"))
    counted = every.join(F.broadcast(counted), "ord", "left").na.fill(0, ["tp", "fp", "fn", "tn"])  # one row for each value of the grid
    return counted.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"), digits))


def choose_label_threshold(df: DataFrame, gold: Column, score: Column, min_recall: float = 0.85, beta: float = 1.5) -> DataFrame:
    """Feasible by recall: most precise, then best F-beta. None feasible: the first of the grid."""
    swept = sweep(df, gold, score, LABEL_GRID).withColumn("fbeta", F.round(fbeta(F.col("precision"), F.col("recall"), beta), 4))
    ok = F.col("recall") >= F.lit(min_recall)
    return _first(swept, ok.desc(), F.when(ok, F.col("precision")).desc(), F.when(ok, F.col("fbeta")).desc()).select("threshold", "precision", "recall", "f1", "fbeta")


def choose_label_thresholds(df: DataFrame, scores: dict[str, Column], gold: str = "gold", **kw) -> DataFrame:
    out = None
    for label in PUBLIC_LABELS:
        one = choose_label_threshold(df, F.array_contains(gold, label), scores[label], **kw).select(F.lit(label).alias("label"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def choose_joint_routes(df: DataFrame, gold: str = "gold", min_recall: float = 0.97) -> DataFrame:
    """Two route thresholds: recall of unsafe rows, then the fewest model calls, then precision; else the most recall."""
    cells = _cells(df, gold=F.size(gold) > 0, a=F.when(forced(ATTACK), 99).otherwise(reached(F.col("router.attack"), ROUTE_GRID)), m=F.when(forced(MODERATION), 99).otherwise(reached(F.col("router.moderation"), ROUTE_GRID)))
    attack, moderation, g = F.col("a") >= level("attack_route", ROUTE_GRID), F.col("m") >= level("moderation_route", ROUTE_GRID), F.col("gold")
    any_model = attack | moderation
    counted = _over(grid(df.sparkSession, attack_route=ROUTE_GRID, moderation_route=ROUTE_GRID), cells).groupBy("ord", "attack_route", "moderation_route").agg(
        _sum(g & any_model).alias("tp"), _sum(~g & any_model).alias("fp"), _sum(g & ~any_model).alias("fn"), (_sum(attack) + _sum(moderation)).alias("calls"), F.sum("n").alias("rows"))
    c = counted.withColumns({f"route_{k}": v for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()})
    ok = F.col("route_recall") >= F.lit(min_recall)
    best = _first(c, ok.desc(), F.when(ok, F.col("calls")).asc(), F.when(ok, F.col("route_precision")).desc(), F.when(~ok, F.col("route_recall")).desc())
    return best.select("attack_route", "moderation_route", "route_precision", "route_recall", "route_f1", F.col("calls").alias("bert_calls"), F.round(ratio(F.col("calls"), F.col("rows")), 4).alias("bert_calls_per_row"), (F.col("tp") + F.col("fp")).alias("any_bert_rows"))


def route_curve(df: DataFrame, score: Column, force: str, target: Column) -> DataFrame:
    """For every single-route threshold: routed rows and recall of the route's own class."""
    cells = _cells(df, gold=target, level=F.when(forced(force), 99).otherwise(reached(score, SINGLE_ROUTE_GRID)))
    routed, g = F.col("level") >= level("threshold", SINGLE_ROUTE_GRID), F.col("gold")
    counted = _over(grid(df.sparkSession, threshold=SINGLE_ROUTE_GRID), cells).groupBy("ord", "threshold").agg(_sum(g & routed).alias("caught"), _sum(g).alias("total"), _sum(routed).alias("routed"), F.sum("n").alias("rows"))
    return counted.withColumns({"recall": F.round(ratio(F.col("caught"), F.col("total")), 4), "routed_pct": pct(F.col("routed"), F.col("rows"))})


def choose_route(df: DataFrame, score: Column, force: str, target: Column, min_recall: float = 0.97) -> DataFrame:
    ok = F.col("recall") >= F.lit(min_recall)
    return _first(route_curve(df, score, force, target), ok.desc(), F.when(ok, F.col("routed")).asc(), F.when(~ok, F.col("recall")).desc()).select("threshold", "recall", "routed", "routed_pct")


def choose_fast_allow(df: DataFrame, gold: str = "gold", max_false_pass_pct: float = 1.0) -> DataFrame:
    cells = _cells(df.filter(F.size("force_route") == 0), gold=F.size(gold) > 0, a=reached(F.col("router.attack"), FAST_ALLOW_GRID), m=reached(F.col("router.moderation"), FAST_ALLOW_GRID))
    total = df.agg(F.count_if(F.size(gold) > 0).alias("unsafe"), F.count(F.lit(1)).alias("rows"))
    low = (F.col("a") < level("fast_allow", FAST_ALLOW_GRID)) & (F.col("m") < level("fast_allow", FAST_ALLOW_GRID))
    g = grid(df.sparkSession, fast_allow=FAST_ALLOW_GRID)
    counted = g.join(_over(g, cells).groupBy("ord").agg(_sum(low).alias("p"), _sum(low & F.col("gold")).alias("f")), "ord", "left")
    return _false_pass_choice(counted, total, max_false_pass_pct, "fast_allow")


def choose_direct_safe(df: DataFrame, gold: str = "gold", max_false_pass_pct: float = 1.0) -> DataFrame:
    cells = _cells(df.filter(F.size("force_route") == 0), gold=F.size(gold) > 0, s=reached(F.col("router.safe"), SAFE_GRID), a=reached(F.col("router.attack"), SAFE_ROUTE_GRID), m=reached(F.col("router.moderation"), SAFE_ROUTE_GRID))
    total = df.agg(F.count_if(F.size(gold) > 0).alias("unsafe"), F.count(F.lit(1)).alias("rows"))
    below = level("max_route", SAFE_ROUTE_GRID)
    hit = (F.col("s") >= level("score", SAFE_GRID)) & (F.col("a") < below) & (F.col("m") < below)
    g = grid(df.sparkSession, score=SAFE_GRID, max_route=SAFE_ROUTE_GRID)
    counted = g.join(_over(g, cells).groupBy("ord").agg(_sum(hit).alias("p"), _sum(hit & F.col("gold")).alias("f")), "ord", "left")
    return _false_pass_choice(counted, total, max_false_pass_pct, "score", "max_route")


def _false_pass_choice(counted: DataFrame, total: DataFrame, most: float, *axes: str) -> DataFrame:
    """Most passed rows under the limit of false passes; else the smallest share of false passes, then most passed."""
    c = counted.na.fill(0, ["p", "f"]).crossJoin(F.broadcast(total))  # one row
    c = c.withColumns({"false_pct": pct(F.col("f"), F.col("unsafe")), "passed_pct": pct(F.col("p"), F.col("rows"))})
    ok = F.col("false_pct") <= F.lit(most)
    best = _first(c, ok.desc(), F.when(ok, F.col("p")).desc(), F.when(ok, F.col("f")).asc(), F.when(~ok, F.col("false_pct")).asc(), F.col("p").desc())
    return best.select(*axes, F.col("p").alias("passed_rows"), "passed_pct", F.col("f").alias("unsafe_false_pass_rows"), F.col("false_pct").alias("unsafe_false_pass_pct"))


def choose_direct_label(df: DataFrame, label: str, score: Column, other: Column, gold: str = "gold", min_precision: float = 0.95) -> DataFrame:
    """Direct class: precise enough and most rows; else the most precise, disabled. Ratios are over hits only."""
    g_col = F.array_contains(gold, label)
    cells = _cells(df.filter(F.size("force_route") == 0), gold=g_col, s=reached(score, DIRECT_GRID), o=passed(other, DIRECT_OTHER_GRID))
    total = df.agg(F.count_if(g_col).alias("targets"), F.count(F.lit(1)).alias("all_rows"))
    hit = (F.col("s") >= level("score", DIRECT_GRID)) & (F.col("o") < level("max_other", DIRECT_OTHER_GRID))
    g = grid(df.sparkSession, score=DIRECT_GRID, max_other=DIRECT_OTHER_GRID)
    c = g.join(_over(g, cells).groupBy("ord").agg(_sum(hit).alias("rows"), _sum(hit & F.col("gold")).alias("tp")), "ord", "left").na.fill(0).crossJoin(F.broadcast(total))  # one row
    c = c.withColumns({"precision": F.round(ratio(F.col("tp"), F.col("rows")), 4), "coverage_of_label": F.round(ratio(F.col("tp"), F.col("targets")), 4), "fp": F.col("rows") - F.col("tp")})
    ok = (F.col("precision") >= F.lit(min_precision)) & (F.col("rows") > 0)
    best = _first(c, ok.desc(), F.when(ok, F.col("rows")).desc(), F.col("precision").desc(), F.col("rows").desc())
    return best.select(ok.alias("enabled"), "score", "max_other", "rows", pct(F.col("rows"), F.col("all_rows")).alias("rows_pct"), "precision", "coverage_of_label", "tp", "fp")


def choose_veto(df: DataFrame, gold: Column, injection: Column, harmful: Column, min_recall: float = 0.85, beta: float = 1.5) -> DataFrame:
    cells = _cells(df, gold=gold, s=reached(injection, VETO_SCORE_GRID), h=reached(harmful, VETO_GRID))
    pred, g = (F.col("s") >= level("threshold", VETO_SCORE_GRID)) & (F.col("h") < level("max_harmful", VETO_GRID)), F.col("gold")
    counted = _over(grid(df.sparkSession, threshold=VETO_SCORE_GRID, max_harmful=VETO_GRID), cells).groupBy("ord", "threshold", "max_harmful").agg(_sum(g & pred).alias("tp"), _sum(~g & pred).alias("fp"), _sum(g & ~pred).alias("fn"))
    c = counted.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))
    c = c.withColumn("fbeta", F.round(fbeta(F.col("precision"), F.col("recall"), beta), 4))
    ok = F.col("recall") >= F.lit(min_recall)
    best = _first(c, ok.desc(), F.when(ok, F.col("precision")).desc(), F.when(ok, F.col("fbeta")).desc(), F.when(~ok, F.col("recall")).desc())
    return best.select("threshold", "max_harmful", "precision", "recall", "f1", "fbeta")


def best_f1(df: DataFrame, gold: Column, score: Column) -> DataFrame:
    """Best unrounded F1; ties stay at 0.5, then go to the smallest threshold."""
    values = sorted(set(BEST_F1_GRID))
    swept = sweep(df, gold, score, values, digits=None)
    return swept.orderBy(F.col("f1").desc(), (F.col("threshold") == F.lit(0.5)).desc(), F.col("threshold").asc()).limit(1).select("threshold", "precision", "recall", "f1")


def loss_by_temperature(df: DataFrame, z: Column, y: Column, temperatures: Sequence[float]) -> DataFrame:
    """Mean loss at every temperature; equal rows are counted first."""
    return _losses(_cells(df, z=z.cast("double"), y=y.cast("double")), temperatures)


def _losses(cells: DataFrame, temperatures: Sequence[float]) -> DataFrame:
    losses = _over(grid(cells.sparkSession, temperature=temperatures), cells)
    return losses.groupBy("ord", "temperature").agg((F.sum(bce(F.col("z"), F.col("y"), F.col("temperature")) * F.col("n")) / F.sum("n")).alias("loss"))


def _bins(cells: DataFrame) -> DataFrame:
    """Neighbouring margins together, finer near 0: at most some hundred thousand rows whatever the cells, each with its ends and its mean."""
    place = F.floor(F.asinh(F.col("z") * 1000) * 256)
    return cells.groupBy("y", place.alias("bin")).agg(F.sum("n").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"), (F.sum(F.col("z") * F.col("n")) / F.sum("n")).alias("mean"))


def loss_bounds(bins: DataFrame, temperatures: Sequence[float]) -> DataFrame:
    """ord, temperature, least and most: between them lies the mean loss.

    Where no probability is cut off, the loss is convex in the margin: a bin's is at least that of its mean and at most its chord's. Elsewhere each
    class's part rises or falls with the margin, so the bin's ends bound it.
    """
    t, y, n = F.col("temperature"), F.col("y"), F.col("n")
    each = {f"{end}{k}": bce(F.col(end), F.lit(float(k)), t) for end in ("low", "high", "mean") for k in (0, 1)}
    smooth = (F.abs("low") < 16 * t) & (F.abs("high") < 16 * t)
    share = F.coalesce(F.try_divide(F.col("mean") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    rows = _over(grid(bins.sparkSession, temperature=temperatures), bins).select("ord", "temperature", "y", "n", smooth.alias("smooth"), share.alias("share"), *[c.alias(k) for k, c in each.items()])
    of = lambda end, other=None: y * F.col(f"{end}1") + (1 - y) * F.col(f"{other or end}0")
    rows = rows.select("ord", "temperature", "n", "smooth", of("mean").alias("middle"), (of("low") + F.col("share") * (of("high") - of("low"))).alias("chord"), of("high", "low").alias("least"), of("low", "high").alias("most"))
    return rows.groupBy("ord", "temperature").agg(
        (F.sum(n * F.when(F.col("smooth"), F.least("middle", "chord")).otherwise(F.col("least"))) / F.sum(n)).alias("least"),
        (F.sum(n * F.when(F.col("smooth"), F.greatest("middle", "chord")).otherwise(F.col("most"))) / F.sum(n)).alias("most"),
    )


def _best_temperature(cells: DataFrame, temperatures: Sequence[float]) -> float | None:
    """The first temperature of the smallest loss. Bounds by bins leave a few; only those meet every margin."""
    bounds = sorted(loss_bounds(_bins(cells), temperatures).collect(), key=lambda r: r["ord"])
    if not bounds:
        return None
    limit = min(r["most"] for r in bounds) * (1 + 1e-9) + 1e-12  # sums are rounded
    left = [r["temperature"] for r in bounds if r["least"] <= limit]
    return left[0] if len(left) == 1 else _losses(cells, left).orderBy("loss", "ord").first()["temperature"]


def fit_temperature(df: DataFrame, z: Column, y: Column) -> float:
    """The coarse grid, then 50 steps around its best. The first smallest loss wins. No rows: 1. Equal margins are counted once, and written."""
    spark = df.sparkSession
    _cells(df, z=z.cast("double"), y=y.cast("double")).write.parquet(at := f"{scratch(spark)}/margins")
    cells = spark.read.parquet(at).filter("z IS NOT NULL AND y IS NOT NULL")  # not before: the optimiser would compute margins for the filter too
    start = _best_temperature(cells, TEMPERATURES)
    best = 1.0 if start is None else _best_temperature(cells, [start, *(max(0.01, start - 0.05 + 0.1 * i / 49) for i in range(50))])
    discard(spark, at)
    return best


def prf_at_temperature(df: DataFrame, z: Column, y: Column, temperature: float, threshold: float) -> DataFrame:
    pred = F.lit(1.0) / (F.lit(1.0) + F.exp(-z / F.lit(float(temperature)))) >= F.lit(float(threshold))
    gold = y == 1
    one = lambda c: F.count_if(c)
    counted = df.agg(one(gold & pred).alias("tp"), one(~gold & pred).alias("fp"), one(gold & ~pred).alias("fn"))
    return counted.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"), None))


def recommend(routes: dict, labels: dict[str, float], prompt: dict, harmful: dict, safe: dict, veto: float = 1.01, fast_allow: float = 0.0) -> dict:
    """Recommended thresholds and run settings; a disabled direct class gets the impossible score 1.1."""
    score = lambda d: d["score"] if d.get("enabled") else 1.1
    thresholds = {
        "attack_route": routes["attack_route"], "moderation_route": routes["moderation_route"], "fast_allow": fast_allow,
        "fasttext_direct_prompt_injection_score": score(prompt), "fasttext_direct_prompt_injection_max_moderation": prompt["max_other"],
        "fasttext_direct_harmful_content_score": score(harmful), "fasttext_direct_harmful_content_max_attack": harmful["max_other"],
        "fasttext_direct_safe_score": safe["score"], "fasttext_direct_safe_max_route": safe["max_route"], "prompt_injection_max_harmful": veto,
    } | {f"{label}_review": t for label, t in labels.items()}
    runtime = {"fasttext_direct_classification_enabled": bool(prompt.get("enabled") or harmful.get("enabled")), "fasttext_direct_safe_enabled": safe.get("passed_rows", 0) > 0}
    return {"thresholds": thresholds, "runtime": runtime}


def settings_sweep(runs: DataFrame) -> DataFrame:
    """Settings by throughput, then macro-F1, best first."""
    order = Window.orderBy(F.desc("rows_per_second"), F.desc("macro_f1"), "ord")
    return runs.withColumn("place", F.row_number().over(order))
