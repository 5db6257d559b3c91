"""Scores: a native lexicon scorer, an Arrow scorer for real models, and mappings of raw model output."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE

# Our own word lists: a stand-in for trained models, whose figures say nothing about theirs.
INJECTION_WORDS = ("disregard", "override", "bypass", "jailbreak", "system prompt", "ignore previous", "ignore all")
HARMFUL_WORDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "worthless", "pathetic", "disgusting")
SEXUAL_WORDS = ("nude", "porn", "erotic", "explicit", "xxx")


def lexicon_pattern(words: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def word_total(text: Column) -> Column:
    """Words of a text whose whitespace is collapsed."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


class LexiconScorer:
    """Native and deterministic. A score rises with the hits and falls with the length: h / (h + 0.02 * (1 + words / 50))."""

    LISTS = {"__attack": INJECTION_WORDS, "__harmful": HARMFUL_WORDS, "__sexual": SEXUAL_WORDS}

    def _score(self, hits: Column, words: Column) -> Column:
        return hits / (hits + F.lit(0.02) * (F.lit(1.0) + words / F.lit(50.0)))

    def _hits(self, text: Column, words: tuple[str, ...]) -> Column:
        """Words are counted only where one of them stands in the text, be it within another word."""
        there = _contains(text, words)
        return F.when(there, F.regexp_count(text, F.lit(lexicon_pattern(words)))).when(text.isNotNull(), 0).cast("double")

    def _counted(self, df: DataFrame, text: Column, suffix: str = "") -> DataFrame:
        """One column of hits for each list, and the words: plain columns, or every field of a struct would count them again."""
        hits = {k + suffix: self._hits(text, w) for k, w in self.LISTS.items()}
        return df.withColumns(hits | {"__words" + suffix: word_total(text)})

    def scored(self, df: DataFrame) -> DataFrame:
        """Add router, over the detection text, and the models' own scores __pi, __harmful and __sexual, over the lower-cased model text.

        Both texts are the same unless decoded spans stand behind the detection text; only then is the model text counted too.
        """
        out = self._counted(df, F.col("detection_text"))
        out = out.withColumn("__own", F.when(F.col("flags.base64_decoded_count").isNotNull(), F.lower("model_text")))
        out = self._counted(out, F.col("__own"), "_own")
        names = (*self.LISTS, "__words")
        out = out.withColumns({f"{c}_own": F.coalesce(f"{c}_own", c) for c in names})
        out = out.withColumns({c: self._score(F.col(c), F.col("__words")) for c in self.LISTS} | {f"{c}_own": self._score(F.col(f"{c}_own"), F.col("__words_own")) for c in self.LISTS})
        moderation = F.greatest("__harmful", "__sexual")
        router = F.struct(F.col("__attack").alias("attack"), moderation.alias("moderation"), (F.lit(1.0) - F.greatest(F.col("__attack"), moderation)).alias("safe"))
        out = out.withColumn("router", router).withColumns({"__pi": F.col("__attack_own"), "__harmful": F.col("__harmful_own"), "__sexual": F.col("__sexual_own")})
        return out.drop("__attack", "__own", "__words", *[f"{c}_own" for c in names])


def if_there(path: str | None, load: Callable) -> Callable | None:
    """``load`` if the router's file exists. Without it the router scores zeros and isn't named among the triggered models."""
    return load if path and Path(path).exists() else None


def word_cut(text: str, most: int | None) -> tuple[str, int]:
    """A text's first ``most`` words and how many there are, for models without tokens of their own."""
    words = text.split()
    return (text, len(words)) if most is None or len(words) <= most else (" ".join(words[:most]), most)


def in_windows(frames: Iterator[pd.Series], texts: int, characters: int) -> Iterator[list[pd.Series]]:
    """Frames together until they hold so many texts or characters; a window has one frame at least."""
    held, n, size = [], 0, 0
    for frame in frames:
        held.append(frame)
        n, size = n + int(frame.notna().sum()), size + int(frame.str.len().sum())
        if n >= texts or size >= characters:
            yield held
            held, n, size = [], 0, 0
    if held:
        yield held


class ArrowScorer:
    """Any model behind Arrow batches. ``load`` returns a function from texts to one ``{label: score}`` for each.

    It is called once per Python worker task; null texts are never scored, so a null gate saves the call. A model pads a batch to its longest
    text, so texts of ``window`` batches are put in the order of their tokens before they are dealt to batches; rows come out in their own order.
    A window of 1 leaves texts as they come.
    """

    #: Characters at which a window ends, however few its texts.
    WINDOW_CHARACTERS = 8 << 20

    @property
    def router_loaded(self) -> bool:
        return self.load_router is not None

    def __init__(self, load_router: Callable | None, load_prompt: Callable, load_moderation: Callable, batch: int = 128, max_length: int | None = None, window: int = 16) -> None:
        self.load_router, self.load_prompt, self.load_moderation, self.batch, self.max_length, self.window = load_router, load_prompt, load_moderation, batch, max_length, window

    def _scored(self, load: Callable) -> Callable[[Column], Column]:
        """(scores, tokens, ms, padded, padded_unsorted) of each text: raw scores, the tokens that the model has read, its share of its batch's time, and
        the tokens with padding, as batches are and as they would be in the order of rows.

        A model may bring its own ``cut(text, max_length)``, which gives the text it reads and its number of tokens, or ``cut_all`` for many; else words are tokens.
        """
        batch, most, window, characters = self.batch, self.max_length, max(1, self.window), self.WINDOW_CHARACTERS

        @F.pandas_udf("scores map<string,double>, tokens int, ms double, padded int, padded_unsorted int")
        def score(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = load()
            shorten = getattr(model, "cut", word_cut)
            cut_all = getattr(model, "cut_all", lambda texts, most: [shorten(t, most) for t in texts])
            for held in in_windows(frames, batch * window, characters):
                texts = pd.concat(held, ignore_index=True)
                out: dict[str, list] = {k: [None] * len(texts) for k in ("scores", "tokens", "ms", "padded", "padded_unsorted")}
                wanted = [i for i, t in enumerate(texts) if t is not None]
                read = dict(zip(wanted, cut_all([texts.iloc[i] for i in wanted], most), strict=True))
                for at in range(0, len(wanted), batch):
                    longest = max(read[i][1] for i in wanted[at : at + batch])
                    for i in wanted[at : at + batch]:
                        out["padded_unsorted"][i] = longest
                if window > 1:
                    wanted.sort(key=lambda i: read[i][1])  # stable: equal lengths stay in the order of rows
                for at in range(0, len(wanted), batch):
                    part = wanted[at : at + batch]
                    began = time.perf_counter()
                    found = model([read[i][0] for i in part])
                    each = 1000 * (time.perf_counter() - began) / len(part)
                    longest = max(read[i][1] for i in part)
                    for i, raw in zip(part, found, strict=True):
                        out["scores"][i], out["tokens"][i], out["ms"][i], out["padded"][i] = {str(k): float(v) for k, v in raw.items()}, read[i][1], each, longest
                done = pd.DataFrame(out).astype({"tokens": "Int32", "ms": "Float64", "padded": "Int32", "padded_unsorted": "Int32"})
                at = 0
                for frame in held:
                    yield done.iloc[at : at + len(frame)].reset_index(drop=True)
                    at += len(frame)

        return score.asNondeterministic()

    def _raw(self, load: Callable) -> Callable[[Column], Column]:
        return lambda text: self._scored(load)(text)["scores"]

    def router(self, detection: Column) -> Column:
        if self.load_router is None:
            return F.struct(*[F.lit(0.0).alias(k) for k in ("attack", "moderation", "safe")])
        raw = self._raw(self.load_router)(F.regexp_replace(detection, SPACE + "+", " "))
        return router_scores(raw)

    def measured_prompt(self, text: Column) -> Column:
        return self._scored(self.load_prompt)(text)

    def measured_moderation(self, text: Column) -> Column:
        return self._scored(self.load_moderation)(text)


def padding(measured: DataFrame, column: str) -> DataFrame:
    """texts, tokens, and the shares of what a model reads that are padding, in the order of rows and as batches were dealt; of a column that ``measured_prompt`` or ``measured_moderation`` gives."""
    c = lambda name: F.col(f"{column}.{name}")
    share = lambda name: F.coalesce(F.lit(1.0) - F.try_divide(F.sum(c("tokens")), F.sum(c(name))), F.lit(0.0))
    return measured.agg(F.count(c("tokens")).alias("texts"), F.coalesce(F.sum(c("tokens")), F.lit(0)).alias("tokens"), share("padded_unsorted").alias("padding_unsorted"), share("padded").alias("padding"))


def router_scores(raw: Column) -> Column:
    """Three known classes of the router's output, prefix stripped, 0 where absent."""
    plain = F.transform_keys(raw, lambda k, v: F.regexp_replace(k, "^__label__", ""))
    return F.struct(*[F.coalesce(F.element_at(plain, k), F.lit(0.0)).alias(k) for k in ("attack", "moderation", "safe")])


def _best(raw: Column, keep: Callable[[Column], Column]) -> Column:
    """Largest score among the entries whose lower-cased label ``keep`` accepts; 0 if none."""
    entries = F.filter(F.map_entries(raw), lambda e: keep(F.lower(e["key"])))
    return F.when(raw.isNotNull(), F.coalesce(F.array_max(F.transform(entries, lambda e: e["value"])), F.lit(0.0)))


def _contains(name: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | name.contains(p)
    return out


# Which raw labels feed which score.
INJECTION_PARTS = ("injection", "malicious", "attack", "unsafe")
HARMFUL_PARTS, HARMFUL_NAMES = ("harmful", "hate", "harassment", "toxic", "violence", "self"), ("h", "h2", "hr", "sh", "v", "v2", "label_0")
SEXUAL_PARTS, SEXUAL_NAMES = ("sexual",), ("s", "s3", "label_1")
JAILBREAK_PARTS = ("jailbreak", "injection", "malicious", "unsafe")


def prompt_score(raw: Column) -> Column:
    return _best(raw, lambda k: _contains(k, INJECTION_PARTS) | (k == "label_1"))


def jailbreak_score(raw: Column) -> Column:
    """A score only; jailbreaks are no public label."""
    return _best(raw, lambda k: _contains(k, JAILBREAK_PARTS) | (k == "label_1"))


def moderation_scores(raw: Column) -> Column:
    """(harmful, sexual); one raw label may feed both."""
    harmful = _best(raw, lambda k: _contains(k, HARMFUL_PARTS) | k.isin(*HARMFUL_NAMES))
    return F.struct(harmful.alias("harmful"), _best(raw, lambda k: _contains(k, SEXUAL_PARTS) | k.isin(*SEXUAL_NAMES)).alias("sexual"))


def _pick(raw: Column, names: tuple[str, ...], parts: tuple[str, ...]) -> Column:
    """The score of the first exact name (any case) there is; else the best of labels that contain a part."""
    low = F.transform_keys(raw, lambda k, v: F.lower(k))
    return F.coalesce(*[F.element_at(low, n) for n in names], _best(raw, lambda k: _contains(k, parts)))


def positive_score(raw: Column, adapter: str) -> Column:
    """P(positive) of a raw output by a named adapter of the bake-off."""
    # The names that each adapter looks for, exact ones first, then parts of names.
    if adapter == "injection":
        return _pick(raw, ("injection", "label_1"), ("inject", "malicious", "attack", "jailbreak"))
    if adapter == "two_heads":
        return F.greatest(_pick(raw, ("harmful_content",), ("harmful", "hate", "toxic", "harass", "violence", "self")), _pick(raw, ("sexual",), ("sexual",)))
    if adapter == "complement":
        ok = _pick(raw, ("ok", "label_0"), ("safe", "neutral", "ok"))
        return F.when(ok > 0, 1 - ok).otherwise(_pick(raw, (), ("h", "s", "v", "hr", "sh")))
    if adapter == "toxic_multi":
        return _pick(raw, ("toxic",), ("toxic", "threat", "insult", "hate", "obscene", "identity"))
    if adapter == "toxic_binary":
        return _pick(raw, ("toxic", "label_1"), ("toxic",))
    raise ValueError(f"unknown adapter {adapter}")


def head_scores(probabilities: Column, id2label: dict[int, str], parts: tuple[str, ...], default: int) -> Column:
    """The probability at the first index whose label contains a part, else at ``default``."""
    at = next((i for i in sorted(id2label) if any(p in id2label[i].lower() for p in parts)), default)
    return F.element_at(probabilities, at + 1)


def yes_no_probability(yes: Column, no: Column) -> Column:
    """Of a generative judge: P(yes) over P(yes) + P(no), from their logits."""
    return sigmoid(yes - no)


def margin(logits: Column, positive: tuple[int, ...], negative: int | None = None) -> Column:
    """Largest positive logit, less the negative one where there is one."""
    top = F.array_max(F.array(*[F.element_at(logits, i + 1) for i in positive]))
    return top if negative is None else top - F.element_at(logits, negative + 1)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(logits: Column) -> Column:
    """Stable: the largest logit is taken off first."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)
