"""Secret scans: three base patterns, and a battery of randomness tests on everything else.

Every long token outside the base spans is read in the encoding that its characters suggest, as a
sequence of symbol values; one that fits no encoding is cut at its separators first. Three tests are made for that encoding: a chi-squared test of uniform use of
the alphabet, a runs test about the middle of the alphabet, and a test of serial correlation. A token that
is too regular for a random one (runs, correlation, or nothing but repeats of its beginning) is dropped. For the others the question is how likely
ordinary writing of the same length is to look so random. Each test gives a p-value for it: writing with a given index of coincidence
has a chi-squared statistic whose mean and spread grow with the length, and its runs and neighbours depart from chance by a
share that the length makes visible. The three are combined as weighted normal scores, each weighing as much as the length and the alphabet
let it tell ordinary from random. The Benjamini-Hochberg procedure over all candidate tokens of the corpus bounds the share of false
discoveries; a short token has a wide null, so it must look more random than chance could make it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What ``assign`` needs before its value; texts without it need no search.
ASSIGN_HINT = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.IGNORECASE | re.ASCII)
KINDS = ("assign", "access", "hex", "random")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Share of false discoveries among all spans that the battery adds.
FALSE_DISCOVERIES = 0.01
#: Two-sided level of the runs and serial-correlation tests, for a battery of two.
REGULAR = 0.001
#: Index of coincidence of ordinary writing: sum of squared letter shares, the lowest of the larger European languages.
COINCIDENCE = 0.065
#: Least share by which runs and neighbouring symbols of ordinary writing depart from chance; their z-scores are this times the root of the length.
DEPARTURE = 0.1
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("decimal", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("lower", _LOWER),
    ("upper", _UPPER),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("BASE36", _DIGITS + _UPPER),
    ("letters", _UPPER + _LOWER),
    ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Characters of a token, and of a piece of one.
LEAST = 20
#: Where a token that mixes alphabets is cut: the ways leave whole keys of base64url, of base64, and of letters and digits.
CUTS = tuple(re.compile(r) for r in (r"[^+/]+", r"[^_-]+", r"[^+/_-]+"))
_TABLES = {}
for _name, _alphabet in ENCODINGS:
    _TABLES[_name] = np.full(128, -1, np.int64)
    _TABLES[_name][[ord(c) for c in _alphabet]] = np.arange(len(_alphabet))


def infer(token: str) -> tuple[str, np.ndarray] | None:
    """The first encoding whose alphabet holds the whole token (padding apart), and the symbol values."""
    codes = np.frombuffer(token.rstrip("=").encode("ascii"), np.uint8)
    for name, alphabet in ENCODINGS:
        values = _TABLES[name][codes]
        if (values >= 0).all():
            return name, values
    return None


def battery(values: np.ndarray, size: int) -> tuple[float, float, float]:
    """(chi-squared, z of the runs about the middle, z of the serial correlation) for symbols under ``size``."""
    n = len(values)
    counts = np.bincount(values, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    high = values >= size / 2
    up, down = int(high.sum()), int(n - high.sum())
    if not up or not down:
        runs = math.inf
    else:
        mean = 2 * up * down / n + 1
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        runs = (1 + int((high[1:] != high[:-1]).sum()) - mean) / spread
    centred = values - values.mean()
    power = float((centred**2).sum())
    serial = math.inf if power == 0 else float((centred[1:] * centred[:-1]).sum()) / power * math.sqrt(n) + 1 / math.sqrt(n)
    return chi, runs, serial


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def ordinary_scores(chi: float, runs: float, serial: float, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal scores of the three tests under ordinary writing of n symbols, high if it looks random, and their weights:
    how far apart, in spreads of ordinary writing, ordinary and random means lie."""
    excess = max(size * COINCIDENCE - 1, 0.2)
    spread = math.sqrt(2 * (size - 1) + 4 * (n - 1) * excess)
    apart = DEPARTURE * math.sqrt(n)
    scores = [(size - 1 + (n - 1) * excess - chi) / spread, apart - abs(runs), apart - abs(serial)]
    return np.array(scores), np.array([(n - 1) * excess / spread, apart, apart])


def ordinary_tail(chi: float, runs: float, serial: float, n: int, size: int) -> float:
    """Probability that ordinary writing of n symbols looks so random in all three tests together (weighted Stouffer)."""
    scores, weights = ordinary_scores(chi, runs, serial, n, size)
    return upper_tail(float(scores @ weights / np.linalg.norm(weights)))


def p_value(token: str) -> tuple[str, float] | None:
    """Encoding and p-value of a token; None if it is no candidate or too regular for a random one."""
    found = infer(token)
    if found is None:
        return None
    name, values = found
    again = token.find(token[: len(values) // 2], 1)
    if again > 0 and token[again : len(values)] == token[: len(values) - again]:
        return None  # repeats its own beginning to the end
    size = int(_TABLES[name].max()) + 1
    chi, runs, serial = battery(values, size)
    if 2 * upper_tail(abs(runs)) < REGULAR / 2 or 2 * upper_tail(abs(serial)) < REGULAR / 2:
        return None
    return name, ordinary_tail(chi, runs, serial, len(values), size)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, each leftmost and non-overlapping within its kind."""
    out = []
    if ASSIGN_HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def readings(token: str) -> list[tuple[int, int, float]]:
    """(start, end, p-value) in a token: of all of it, or of the pieces of one that fits no alphabet.

    Pieces of different cuts overlap: the lowest p-value is taken, times the number of cuts.
    """
    if infer(token) is not None:
        return [(0, len(token), p[1])] if (p := p_value(token)) is not None else []
    pieces = {m.span(): m[0] for cut in CUTS for m in cut.finditer(token) if len(m[0].rstrip("=")) >= LEAST}
    tested = sorted((min(1.0, p[1] * len(CUTS)), *at) for at, piece in pieces.items() if (p := p_value(piece)) is not None)
    out = []
    for p, start, end in tested:
        if not any(s < end and start < e for s, e, _ in out):
            out.append((start, end, p))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, p-value) of tokens that overlap no base span and pass the tests of regularity."""
    out = []
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    for m in TOKEN.finditer(text):
        before = bisect_left(starts, m.end())  # base spans that start before the token ends
        if not before or reach[before - 1] <= m.start():
            out += [(m.start() + start, m.start() + end, p) for start, end, p in readings(m[0])]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def discovery_cut(found: DataFrame, share: float = FALSE_DISCOVERIES) -> float:
    """Largest p-value that the Benjamini-Hochberg procedure accepts over all candidates.

    p-values are counted on a logarithmic grid of 64 steps a power of two, whose size doesn't depend on the corpus.
    """
    step = F.floor(F.greatest(F.lit(-1000.0), F.log2(F.greatest(F.col("p"), F.lit(1e-300)))) * 64).cast("int")
    counted = found.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.sum("n").over(Window.orderBy("step"))
    total = F.sum("n").over(Window.partitionBy())
    ranked = counted.withColumns({"rank": rank, "total": total, "p": F.pow(F.lit(2.0), (F.col("step") + 1) / 64.0)})
    cut = ranked.filter(F.col("p") * F.col("total") <= F.lit(share) * F.col("rank")).agg(F.max("p").alias("p")).first()["p"]
    return 0.0 if cut is None else float(cut)


_SPAN = "array<struct<start:int,kind:int,end:int,p:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans) and found (candidate spans with p-values)."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                own = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e, "p": 0.0} for s, k, e in own])
                found.append([{"start": s, "kind": 3, "end": e, "p": p} for s, e, p in candidates(text, own)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(found, span)], names=["doc_id", "base", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, base {_SPAN}, found {_SPAN}")


def find_secrets(docs: DataFrame, share: float = FALSE_DISCOVERIES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Null texts count as empty and have no spans. Base spans stay whatever the battery says. Repeated rows
    are judged alike; an empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    scanned = common.written(scan(docs), "secrets")
    cut = discovery_cut(scanned.select(F.explode("found").alias("f")).select("f.p"), share)
    name = F.array(*[F.lit(k) for k in KINDS])

    def text(spans):
        one = lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, one), ",")

    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    taken = F.filter("found", lambda s: s["p"] <= F.lit(cut))
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        text(F.array_sort(F.concat("base", taken))).alias("spans"),
        F.size(taken).cast("long").alias("n_random"),
    )


def op10_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.read(spark, sf_dir, "documents"))


def base_sha256(text: str | None) -> str:
    return hashlib.sha256(joined(base_spans(text or "")).encode()).hexdigest()
