"""Label canonicalisation over rows of unknown shape (VARIANT) or plain columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import HARMFUL_CONTENT, PROMPT_INJECTION, PUBLIC_LABELS, SAFE, SEXUAL
from .text import is_blank, strip

# Keys that hold texts, names that mean a public label, and truthy spellings.
TEXT_KEYS = ("text", "prompt", "instruction", "content", "input")
HARMFUL_ALIASES = ("harmful_content", "toxicity", "toxic", "hate", "harassment", "violence", "self_harm", "self-harm", "dangerous_information", "illegal_activity")
PROMPT_ALIASES = ("prompt_injection", "injection", "inject", "jailbreak", "attack", "malicious")
TRUTHY = ("1", "true", "yes", "positive")
FLAG_TRUTHY = ("1", "true", "yes")
WEAK_LABELS = ("self_harm", "self-harm", "dangerous_information", "illegal_activity")
WEAK_LABELS_GPU = (*WEAK_LABELS, "unknown", "violence")
TOKEN_BUCKETS = ((32, "001-032"), (64, "033-064"), (128, "065-128"))


def _array(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


#: Keys that hold raw labels.
LABEL_KEYS = ("labels", "label", "original_labels")


def _get(row: Column | dict[str, Column], key: str) -> Column:
    """A key's value of a VARIANT row, or of keys that were read into columns before."""
    return row[key] if isinstance(row, dict) else F.variant_get(row, f"$['{key}']", "variant")


def keyed(rows: DataFrame, row: str = "row") -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """Rows with columns that hold every key that texts and labels are read from, and the label keys' lists: each is read once, however often it is named."""
    keys = tuple(dict.fromkeys((*TEXT_KEYS, *LABEL_KEYS, *PUBLIC_LABELS, "is_prompt_injection")))
    out = rows.withColumns({f"__{k}": _get(F.col(row), k) for k in keys})
    values = {k: F.col(f"__{k}") for k in keys}
    out = out.withColumns({f"__list_{k}": _listed(values[k]) for k in LABEL_KEYS})
    return out, values, {k: F.col(f"__list_{k}") for k in LABEL_KEYS}


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def as_text(v: Column) -> Column:
    """A scalar as Python writes it: whole doubles keep their point, booleans and nulls are words."""
    kind, text = _kind(v), F.variant_get(v, "$", "string")
    point = kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")
    return F.when(F.is_variant_null(v), F.lit("None")).when(point & ~text.rlike(r"[.eE]"), F.concat(text, F.lit(".0"))).otherwise(text)


def pick_text(row: Column | dict[str, Column]) -> Column:
    """The first of the text keys whose value is a string that isn't blank, as it is; else empty."""
    found = []
    for key in TEXT_KEYS:
        v = _get(row, key)
        text = F.when(_kind(v) == "STRING", F.variant_get(v, "$", "string"))
        found.append(F.when(~is_blank(text), text))
    return F.coalesce(*found, F.lit(""))


def _listed(v: Column) -> Column:
    """Labels of a value that may be null, a scalar or an array; lower case, stripped."""
    many = F.transform(F.variant_get(v, "$", "array<variant>"), lambda x: F.lower(strip(as_text(x))))
    one = F.array(F.lower(strip(as_text(v))))
    return F.when(v.isNull() | F.is_variant_null(v), _array()).when(_kind(v).startswith("ARRAY"), many).otherwise(one)


def canonical(labels: Column, flags: dict[str, Column] | None = None, injection_flag: Column | None = None) -> Column:
    """Public labels, in their order, of an array of raw labels and of label columns given as texts."""
    flags = flags or {}
    truthy = lambda c, words: F.coalesce(F.lower(c).isin(*words), F.lit(False))
    has = {
        PROMPT_INJECTION: F.arrays_overlap(labels, _array(*PROMPT_ALIASES)),
        HARMFUL_CONTENT: F.arrays_overlap(labels, _array(*HARMFUL_ALIASES)),
        SEXUAL: F.array_contains(labels, SEXUAL),
    }
    for name, c in flags.items():
        has[name] = has[name] | truthy(c, TRUTHY)
    if injection_flag is not None:
        has[PROMPT_INJECTION] = has[PROMPT_INJECTION] | truthy(injection_flag, FLAG_TRUTHY)
    return F.array_compact(F.array(*[F.when(F.coalesce(has[p], F.lit(False)), p) for p in PUBLIC_LABELS]))


def labels_for(row: Column | dict[str, Column], injection_flag: bool = True, lists: dict[str, Column] | None = None) -> Column:
    """Public labels of a VARIANT row. The key ``labels`` wins over ``label`` wherever it exists, null included. ``lists``: those of the label keys."""
    if lists is None:
        raw = _listed(F.coalesce(_get(row, "labels"), _get(row, "label")))
    else:
        raw = F.when(_get(row, "labels").isNotNull(), lists["labels"]).otherwise(lists["label"])
    return canonical(raw, {p: as_text(_get(row, p)) for p in PUBLIC_LABELS}, as_text(_get(row, "is_prompt_injection")) if injection_flag else None)


def moderation_labels_for(row: Column) -> Column:
    """Harmful and sexual only, from the raw labels only."""
    return F.array_except(canonical(_listed(F.coalesce(_get(row, "labels"), _get(row, "label")))), _array(PROMPT_INJECTION))


def raw_labels(row: Column | dict[str, Column], lists: dict[str, Column] | None = None) -> Column:
    """All raw labels of the three label keys: lower case, stripped, distinct, sorted, without empty ones."""
    every = F.concat(*(lists or {k: _listed(_get(row, k)) for k in LABEL_KEYS}).values())
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x != "")))


def excluded(raw: Column, names: Iterable[str]) -> Column:
    return F.coalesce(F.arrays_overlap(raw, _array(*names)), F.lit(False))


def included(raw: Column, names: Iterable[str]) -> Column:
    """All rows if no names are given; else an overlap, or ``safe`` is named and the row has no raw labels."""
    names = tuple(names)
    if not names:
        return F.lit(True)
    hit = F.coalesce(F.arrays_overlap(raw, _array(*names)), F.lit(False))
    return hit | (F.size(raw) == 0) if SAFE in names else hit


def bucket_for(labels: Column) -> Column:
    """Gold bucket: injection over sexual over harmful."""
    chosen = F.when(F.array_contains(labels, PROMPT_INJECTION), PROMPT_INJECTION).when(F.array_contains(labels, SEXUAL), SEXUAL)
    return chosen.when(F.array_contains(labels, HARMFUL_CONTENT), HARMFUL_CONTENT).otherwise(SAFE)


def predicted_class(injection: Column, harmful: Column, sexual: Column, injection_threshold: float = 0.5, moderation_threshold: float = 0.93) -> Column:
    """Single label of scores: injection over harmful over sexual."""
    chosen = F.when(injection >= F.lit(injection_threshold), PROMPT_INJECTION).when(harmful >= F.lit(moderation_threshold), HARMFUL_CONTENT)
    return chosen.when(sexual >= F.lit(moderation_threshold), SEXUAL).otherwise(SAFE)


def one_hot(labels: Column) -> list[Column]:
    return [F.array_contains(labels, p).cast("int").alias(p) for p in PUBLIC_LABELS]


def token_bucket(n: Column) -> Column:
    out = F.when(n <= TOKEN_BUCKETS[0][0], TOKEN_BUCKETS[0][1])
    for most, name in TOKEN_BUCKETS[1:]:
        out = out.when(n <= most, name)
    return out.otherwise("129+")
