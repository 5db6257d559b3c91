"""Thresholds, profiles and run settings; YAML and report overlays."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

import yaml

# The three public labels, in the order in which results list them.
PROMPT_INJECTION, HARMFUL_CONTENT, SEXUAL, SAFE = "prompt_injection", "harmful_content", "sexual", "safe"
PUBLIC_LABELS = (PROMPT_INJECTION, HARMFUL_CONTENT, SEXUAL)


@dataclass(frozen=True)
class Thresholds:
    """The shipped defaults."""

    attack_route: float = 0.01
    moderation_route: float = 0.0
    fast_allow: float = 0.0
    fasttext_direct_prompt_injection_score: float = 0.8
    fasttext_direct_prompt_injection_max_moderation: float = 0.05
    fasttext_direct_harmful_content_score: float = 1.1
    fasttext_direct_harmful_content_max_attack: float = 0.001
    fasttext_direct_safe_score: float = 1.1
    fasttext_direct_safe_max_route: float = 0.0
    prompt_injection_review: float = 0.50
    harmful_content_review: float = 0.93
    sexual_review: float = 0.93
    #: At or over this harmful score an injection label is vetoed; over 1 the veto is off.
    prompt_injection_max_harmful: float = 1.01


@dataclass(frozen=True)
class Settings:
    """``policy`` is ``runtime`` (a direct injection skips one model) or ``suite`` (it skips both)."""

    thresholds: Thresholds = field(default_factory=Thresholds)
    max_length: int = 128
    full_scan: bool = True
    direct_safe: bool = False
    direct_classification: bool = False
    policy: str = "runtime"


#: ``default`` scans everything with both models; ``scoped_v0`` routes and classifies directly.
PROFILES = {
    "default": Settings(),
    "scoped_v0": Settings(
        thresholds=Thresholds(prompt_injection_review=0.75, harmful_content_review=0.40, sexual_review=0.70), full_scan=False, direct_classification=True
    ),
}
_RUNTIME_KEYS = {"max_length": "max_length", "full_scan_default": "full_scan", "fasttext_direct_safe_enabled": "direct_safe", "fasttext_direct_classification_enabled": "direct_classification"}


def with_thresholds(settings: Settings, values: dict[str, Any]) -> Settings:
    """Settings with those of the values that name a threshold and aren't None."""
    known = {f.name for f in fields(Thresholds)}
    return replace(settings, thresholds=replace(settings.thresholds, **{k: float(v) for k, v in values.items() if k in known and v is not None}))


def from_mapping(data: dict[str, Any]) -> Settings:
    runtime = data.get("runtime") or {}
    settings = replace(PROFILES["default"], **{to: runtime[key] for key, to in _RUNTIME_KEYS.items() if key in runtime})
    return with_thresholds(settings, data.get("thresholds") or {})


def load(path: str | Path) -> Settings:
    return from_mapping(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def resolve(path: str | Path, root: str | Path = ".") -> Path:
    """An absolute path as it is, any other against ``root``."""
    return Path(path) if Path(path).is_absolute() else Path(root) / path


def overlay(settings: Settings, report: str | Path | None = None, **overrides: Any) -> Settings:
    """Precedence: settings, then a report's recommended thresholds, then overrides that aren't None."""
    if report is not None:
        data = json.loads(Path(report).read_text(encoding="utf-8"))
        recommended = data.get("recommended") or {}
        settings = with_thresholds(settings, recommended.get("thresholds") or {})
        runtime = recommended.get("runtime") or {}
        settings = replace(settings, **{to: bool(runtime[key]) for key, to in _RUNTIME_KEYS.items() if key in runtime and key != "max_length"})
    return with_thresholds(settings, overrides)


def as_mapping(settings: Settings) -> dict[str, Any]:
    return {"thresholds": asdict(settings.thresholds), "runtime": {key: getattr(settings, to) for key, to in _RUNTIME_KEYS.items()}}


def import_router_report(report: str | Path, path: str | Path) -> dict[str, Any]:
    """Rewrite a YAML configuration's route thresholds from a report; both shapes of report are read."""
    data = json.loads(Path(report).read_text(encoding="utf-8"))
    given = dict((data.get("recommended") or {}).get("thresholds") or {})
    route = data.get("route") or {}
    given |= {k: v for k, v in {"attack_route": route.get("attack"), "moderation_route": route.get("moderation"), "fast_allow": (data.get("fast_allow") or {}).get("threshold")}.items() if v is not None}
    config = yaml.safe_load(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else {}
    config = config or {}
    config["thresholds"] = (config.get("thresholds") or {}) | given
    Path(path).write_text(yaml.safe_dump(config, sort_keys=False), encoding="utf-8")
    return config
