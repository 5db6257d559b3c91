"""One text at a time, as an application calls it."""

from __future__ import annotations

import json
import time
from dataclasses import replace

from pyspark.sql import SparkSession

from . import config
from .operators.cascade import classify, results
from .sources.readers import from_text


class SafetyClassifier:
    def __init__(self, spark: SparkSession, path: str | None = None, scorer=None) -> None:
        self.spark, self.scorer = spark, scorer
        self.settings = config.PROFILES["default"] if path is None else config.load(path)

    def classify(self, text: str, *, full_scan: bool | None = None, include_raw: bool = False) -> dict:
        """Labels, scores and routing of a text; a blank one raises."""
        if not isinstance(text, str) or not text.strip():
            raise ValueError("text is empty")
        began = time.perf_counter()
        settings = self.settings if full_scan is None else replace(self.settings, full_scan=full_scan)
        scored = classify(from_text(self.spark, text), settings, self.scorer)
        out = results(scored, settings, include_raw=include_raw).first().asDict(recursive=True)
        raw = out.pop("raw", None)
        if raw is not None:  # a model that didn't run has said nothing
            raw = {k: v for k, v in raw.items() if v is not None}
        return out | {"latency_ms": round(1000 * (time.perf_counter() - began), 2), "raw": raw}

    def to_json(self, text: str, **kw) -> str:
        return json.dumps(self.classify(text, **kw), ensure_ascii=False)
