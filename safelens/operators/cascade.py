"""The cascade: normalise, rules, router, confirming models only where they are needed, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import HARMFUL_CONTENT, PROMPT_INJECTION, SEXUAL, Settings
from ..functions.rules import ATTACK, MODERATION, apply_rules
from ..functions.scoring import LexiconScorer, moderation_scores, prompt_score
from ..functions.text import is_blank, normalize

OFF = 1.01


def route(df: DataFrame, settings: Settings) -> DataFrame:
    """Routing decisions from ``router`` and ``force_route``: which models run and which shortcut applies.

    The suite's policy lets a direct class skip both models, the runtime's only the prompt model.
    """
    t, scan = settings.thresholds, F.lit(settings.full_scan)
    attack, moderation, safe = F.col("router.attack"), F.col("router.moderation"), F.col("router.safe")
    free = F.size("force_route") == 0
    out = df.withColumns({
        "run_attack": scan | F.array_contains("force_route", ATTACK) | (attack >= F.lit(t.attack_route)),
        "run_moderation": scan | F.array_contains("force_route", MODERATION) | (moderation >= F.lit(t.moderation_route)),
        "direct_prompt": F.lit(settings.direct_classification) & ~scan & free & (attack >= F.lit(t.fasttext_direct_prompt_injection_score)) & (moderation <= F.lit(t.fasttext_direct_prompt_injection_max_moderation)),
    })
    out = out.withColumn("direct_harmful", F.lit(settings.direct_classification) & ~F.col("direct_prompt") & ~scan & free & (moderation >= F.lit(t.fasttext_direct_harmful_content_score)) & (attack <= F.lit(t.fasttext_direct_harmful_content_max_attack)))
    below = F.lit(t.fasttext_direct_safe_max_route)
    out = out.withColumn("direct_safe", F.lit(settings.direct_safe) & ~scan & ~F.col("direct_prompt") & ~F.col("direct_harmful") & free & (safe >= F.lit(t.fasttext_direct_safe_score)) & (attack < below) & (moderation < below))
    low = ~scan & free & (attack < F.lit(t.fast_allow)) & (moderation < F.lit(t.fast_allow))
    out = out.withColumn("fast_allow", F.col("direct_safe") | low)
    stop = F.col("fast_allow")
    if settings.policy == "suite":
        stop = stop | F.col("direct_prompt") | F.col("direct_harmful")
    out = out.withColumns({"prompt_ran": ~F.col("direct_prompt") & F.col("run_attack") & ~stop, "moderation_ran": F.col("run_moderation") & ~stop})
    outcome = F.when(F.col("direct_prompt"), "direct_prompt_injection").when(F.col("direct_harmful"), "direct_harmful_content").when(F.col("direct_safe"), "direct_safe").when(F.col("fast_allow"), "fast_allow")
    outcome = outcome.when(F.col("prompt_ran") & F.col("moderation_ran"), "both_models").when(F.col("prompt_ran"), "prompt_only").when(F.col("moderation_ran"), "moderation_only").otherwise("no_model")
    return out.withColumn("route_outcome", outcome)


def decide(df: DataFrame, settings: Settings) -> DataFrame:
    """Labels from the scores pi, harmful and sexual of the models that ran, with the veto; scores of 1 for direct classes."""
    t, zero = settings.thresholds, F.lit(0.0)
    ran = lambda flag, c: F.when(F.col(flag), F.coalesce(F.col(c), zero)).otherwise(zero)
    out = df.withColumns({
        "pi": F.when(F.col("direct_prompt"), F.lit(1.0)).otherwise(ran("prompt_ran", "pi")),
        "harmful": F.greatest(F.when(F.col("direct_harmful"), F.lit(1.0)).otherwise(zero), ran("moderation_ran", "harmful")),
        "sexual": ran("moderation_ran", "sexual"),
    })
    injected = (F.col("pi") >= F.lit(t.prompt_injection_review)) & (F.col("harmful") < F.lit(t.prompt_injection_max_harmful))
    labels = F.array(F.when(injected, PROMPT_INJECTION), F.when(F.col("harmful") >= F.lit(t.harmful_content_review), HARMFUL_CONTENT), F.when(F.col("sexual") >= F.lit(t.sexual_review), SEXUAL))
    return out.withColumn("labels", F.array_compact(labels))


def _names(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, name) for c, name in pairs]))


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Deal rows out to ``least`` tasks (as many as there are cores) where the plan has fewer, as one small file gives.

    Streams are left, and so are plans that shuffle: those have the partitions of their shuffles, and to ask for these would run them.
    """
    if df.isStreaming or df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def classify(df: DataFrame, settings: Settings, scorer=None, text: str = "text", dealt: bool = False) -> DataFrame:
    """Rows with labels, scores, routing and everything between. Row-wise: no shuffle, and it runs on streams as well.

    ``dealt``: an input of fewer tasks than there are cores is dealt out first. Models see a text only where they run (a null otherwise), so a costly scorer isn't called for routed-out rows.
    """
    scorer = scorer or LexiconScorer()
    out = apply_rules(normalize((spread(df) if dealt else df).filter(~is_blank(F.col(text))), text), text)
    if isinstance(scorer, LexiconScorer):
        out = route(scorer.scored(out), settings).withColumns({"pi": F.col("__pi"), "harmful": F.col("__harmful"), "sexual": F.col("__sexual")}).drop("__pi", "__harmful", "__sexual")
    else:
        out = route(out.withColumn("router", scorer.router(F.col("detection_text"))), settings)
        prompt, moderation = (F.when(F.col(flag), F.col("model_text")) for flag in ("prompt_ran", "moderation_ran"))
        if hasattr(scorer, "measured_prompt"):
            out = out.withColumns({"__p": scorer.measured_prompt(prompt), "__m": scorer.measured_moderation(moderation)})
            for at, name in (("__p", "prompt"), ("__m", "moderation")):
                out = out.withColumns({f"{name}_raw": F.col(f"{at}.scores"), f"{name}_tokens": F.col(f"{at}.tokens"), f"{name}_ms": F.col(f"{at}.ms")})
            out = out.withColumns({"pi": prompt_score(F.col("prompt_raw")), "__moderation": moderation_scores(F.col("moderation_raw"))}).drop("__p", "__m")
        else:
            out = out.withColumns({"pi": scorer.prompt(prompt), "__moderation": scorer.moderation(moderation)})
        out = out.withColumns({"harmful": F.col("__moderation.harmful"), "sexual": F.col("__moderation.sexual")}).drop("__moderation")
    out = out.withColumn("router_loaded", F.lit(getattr(scorer, "router_loaded", True)))
    return decide(out, settings)


def _raw(df: DataFrame) -> Column:
    """What router, rules and the models that ran have said, unrounded. Scorers without raw output give their scores."""
    prompt = F.col("prompt_raw") if "prompt_raw" in df.columns else F.when(F.col("prompt_ran"), F.create_map(F.lit(PROMPT_INJECTION), F.col("pi")))
    moderation = F.col("moderation_raw") if "moderation_raw" in df.columns else F.when(F.col("moderation_ran"), F.create_map(F.lit(HARMFUL_CONTENT), F.col("harmful"), F.lit(SEXUAL), F.col("sexual")))
    return F.struct(
        F.struct(F.col("router").alias("scores"), F.col("router_loaded").alias("loaded")).alias("fasttext"),
        F.struct(F.col("force_route").alias("routes"), F.col("reasons").alias("reasons")).alias("rules"),
        prompt.alias("prompt_injection"), moderation.alias("moderation"),
    )


def results(df: DataFrame, settings: Settings, keep: tuple[str, ...] = (), include_raw: bool = False) -> DataFrame:
    """Classified rows as nested results; scores are rounded only here. Triggered models stand in the order in which they act."""
    t = settings.thresholds
    four = lambda c: F.round(F.col(c), 4).alias(c.rsplit(".", 1)[-1])
    value = lambda name, key: F.lit(getattr(t, name)).alias(key)
    triggered = _names((F.col("router_loaded"), "fasttext_router"), (F.col("direct_prompt"), "fasttext_direct_prompt_injection"), (F.col("prompt_ran"), "prompt_injection"), (F.col("direct_harmful"), "fasttext_direct_harmful_content"), (F.col("moderation_ran"), "moderation"))
    skipped = _names((~F.col("prompt_ran"), "prompt_injection"), (~F.col("moderation_ran"), "moderation"))
    routing = F.struct(
        F.struct(four("router.attack"), four("router.moderation"), four("router.safe")).alias("fasttext"),
        F.col("reasons").alias("rule_reasons"), "run_attack", "run_moderation",
        F.struct(value("fasttext_direct_safe_score", "safe_score"), value("fasttext_direct_safe_max_route", "max_route")).alias("fasttext_direct_safe_thresholds"),
        F.struct(
            value("fasttext_direct_prompt_injection_score", "prompt_injection_score"), value("fasttext_direct_prompt_injection_max_moderation", "prompt_injection_max_moderation"),
            value("fasttext_direct_harmful_content_score", "harmful_content_score"), value("fasttext_direct_harmful_content_max_attack", "harmful_content_max_attack"),
        ).alias("fasttext_direct_classification_thresholds"),
    )
    return df.select(
        *keep,
        "labels",
        F.struct(F.round("pi", 4).alias(PROMPT_INJECTION), F.round("harmful", 4).alias(HARMFUL_CONTENT), F.round("sexual", 4).alias(SEXUAL)).alias("scores"),
        "fast_allow",
        F.col("direct_safe").alias("fasttext_direct_safe"),
        F.col("direct_prompt").alias("fasttext_direct_prompt_injection"),
        F.col("direct_harmful").alias("fasttext_direct_harmful_content"),
        triggered.alias("triggered_models"),
        skipped.alias("skipped_models"),
        routing.alias("routing"),
        *([_raw(df).alias("raw")] if include_raw else []),
    )
