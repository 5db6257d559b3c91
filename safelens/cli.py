"""``python -m safelens.cli``: classify, evaluate, calibrate, import-thresholds."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import config
from .classifier import SafetyClassifier
from .functions.labels import WEAK_LABELS
from .operators import reports
from .operators.cascade import classify
from .sources import readers, sinks

_OVERRIDES = {"fast_allow": "fast_allow", "attack_route": "attack_route", "moderation_route": "moderation_route", "direct_safe_score": "fasttext_direct_safe_score", "direct_safe_max_route": "fasttext_direct_safe_max_route"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="safelens")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("classify")
    one.add_argument("text", nargs="*")
    one.add_argument("--full-scan", action="store_true", default=None)
    one.add_argument("--include-raw", action="store_true")
    suite, search = sub.add_parser("evaluate"), sub.add_parser("calibrate")
    for p in (suite, search):
        p.add_argument("--data", action="append", required=True)
        p.add_argument("--limit", type=int, default=1000)
        p.add_argument("--seed", type=int, default=7)
        p.add_argument("--include-label", action="append", default=[])
        p.add_argument("--output", default=f"reports/{p.prog.split()[-1]}.json")
    suite.add_argument("--exclude-label", action="append", default=[])
    suite.add_argument("--full-scan", action="store_true", default=None)
    suite.add_argument("--enable-direct-classification", action="store_true", default=None)
    suite.add_argument("--enable-direct-safe", action="store_true", default=None)
    suite.add_argument("--threshold-report")
    for name in _OVERRIDES:
        suite.add_argument("--" + name.replace("_", "-"), type=float)
    # Given labels extend the default ones.
    search.add_argument("--exclude-label", action="append", default=sorted(WEAK_LABELS))
    for name, value in (("min-label-recall", 0.85), ("label-beta", 1.5), ("min-route-recall", 0.97), ("max-safe-false-pass-pct", 1.0), ("min-direct-precision", 0.95)):
        search.add_argument("--" + name, type=float, default=value)
    search.add_argument("--score-scope", choices=("all", "routed"), default="all")
    for p in (one, suite, search):
        p.add_argument("--config")
    bring = sub.add_parser("import-thresholds")
    bring.add_argument("--report", required=True)
    bring.add_argument("--config", required=True)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "import-thresholds":
        config.import_router_report(args.report, args.config)
        return 0
    spark = SparkSession.builder.appName("safelens").getOrCreate()
    if args.command == "classify":
        text = " ".join(args.text) if args.text else sys.stdin.read()
        print(SafetyClassifier(spark, args.config).to_json(text, full_scan=args.full_scan, include_raw=args.include_raw))
        return 0
    settings = config.load(args.config) if args.config else config.PROFILES["default"]
    corpus = readers.filtered(readers.read_corpora(spark, args.data), args.exclude_label, args.include_label)
    if args.command == "evaluate":
        from dataclasses import replace

        settings = config.overlay(settings, args.threshold_report, **{to: getattr(args, name) for name, to in _OVERRIDES.items()})
        given = {"full_scan": args.full_scan, "direct_classification": args.enable_direct_classification, "direct_safe": args.enable_direct_safe}
        settings = replace(settings, policy="suite", **{k: v for k, v in given.items() if v is not None})
        sinks.write_report(reports.evaluate(corpus, settings, limit=args.limit, seed=args.seed, include=args.include_label, exclude=args.exclude_label), args.output)
        return 0
    scored = classify(reports.prepare(corpus, args.limit, args.seed).withColumnRenamed("labels", "gold"), settings).cache()
    report = reports.calibrate_all(scored, args.min_label_recall, args.label_beta, args.min_route_recall, args.max_safe_false_pass_pct, args.min_direct_precision, score_scope=args.score_scope)
    sinks.write_report(report, args.output)
    sinks.write_recommended(args.output, report["recommended"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
