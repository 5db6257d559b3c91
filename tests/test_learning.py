"""The linear scorer that learns, its artifact, subword tokens, and length-aware batches."""

import base64
import math
import random

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from safelens.config import PROFILES
from safelens.functions import linear, scoring, tokens
from safelens.operators import train
from safelens.operators.cascade import classify

VOCABULARIES = "/opt/tokenizers"


def slow_buckets(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text)
    q = linear.BUCKETS
    h = [sum(ord(c) * ((i + 1) * 40503 % 65521) for i, c in enumerate(w)) % q for w in text.split(" ") if w]
    out = set(h) | {(a * 8191 + b * 131071 + 7) % q for a, b in zip(h, h[1:], strict=False)}
    return sorted(out | {(ord(a) * 31337 + ord(b) * 1009 + ord(c) * 65537 + 11) % q for a, b, c in zip(text, text[1:], text[2:], strict=False)})


def test_buckets_are_those_of_each_text(monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "a", "ab", "Straße İß É 漢字 x", " \t\n", "A" * 3000] + ["".join(rng.choice("aBcé 漢\n\t ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    buckets, offsets = linear.grams(texts)
    assert [buckets[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [slow_buckets(t) for t in texts]
    monkeypatch.setattr(linear, "LOT", 50)
    model = linear.LinearModel(("a", "b"), np.arange(0, linear.BUCKETS, 7, dtype=np.int32), np.random.default_rng(1).normal(size=(len(range(0, linear.BUCKETS, 7)) + 1, 2)))
    found = model.scores(texts)
    for text, row in zip(texts, found, strict=True):
        own = [b for b in slow_buckets(text) if b % 7 == 0]
        margin = [sum(model.weights[b // 7][c] for b in own) / math.sqrt(max(1, len(own))) + model.weights[-1][c] for c in (0, 1)]
        assert np.allclose(row[0], 1 / (1 + math.exp(margin[1] - margin[0])))


@pytest.fixture(scope="module")
def taught(spark):
    rng = random.Random(2)
    word = lambda: "w%03d" % rng.randint(0, 400)
    mark = {"attack": "override", "moderation": "scoundrel", "safe": None}
    rows = []
    for i in range(600):
        label = rng.choice(list(mark))
        words = [word() for _ in range(rng.randint(5, 40))]
        if mark[label]:
            words.insert(rng.randrange(len(words)), mark[label])
        rows.append((i, " ".join(words), label))
    rows += [(-1, None, "safe"), (-2, "x", None), (-3, "", "safe"), (-4, "y", "other")]
    return spark.createDataFrame(rows, "id int, text string, label string").repartition(5)


def test_fit_finds_what_tells_classes_apart(spark, taught, tmp_path):
    model = train.fit(taught.filter("id % 3 <> 1"), "text", "label", ("attack", "moderation", "safe"))
    rows = [r for r in taught.filter("id % 3 = 1 AND id >= 0").collect()]
    best = [max(s, key=s.get) for s in model([r.text for r in rows])]
    assert sum(b == r.label for b, r in zip(best, rows, strict=True)) > 0.97 * len(rows)
    model.write(spark, f"{tmp_path}/m")
    again = linear.read_model(spark, f"{tmp_path}/m")
    assert again.classes == model.classes and (again.weights == model.weights).all() and (again.buckets == model.buckets).all()
    assert linear.read_model(spark, f"{tmp_path}/none") is None


def test_rounds_are_those_of_a_plain_descent(taught):
    rows = [r for r in taught.collect() if r.text is not None and r.label in ("attack", "safe")]
    model = train.fit(taught, "text", "label", ("attack", "safe"), rounds=3)
    y = np.array([r.label == "safe" for r in rows], int)
    own = [slow_buckets(r.text) for r in rows]
    n = len(rows)
    has = {b for o in own for b in o}
    count = {b: [sum(b in o and k == c for o, k in zip(map(set, own), y, strict=True)) for c in (0, 1)] for b in random.Random(3).sample(sorted(has), 40) + list(model.buckets[:40])}
    size = [int((y == 0).sum()), int((y == 1).sum())]
    for b, (p, q) in count.items():
        z = abs(p / size[0] - q / size[1]) / math.sqrt((p + q + 1) / n * (1 / size[0] + 1 / size[1]))
        assert (z >= train.TELLING) == (b in set(model.buckets.tolist()))
    place = {int(b): i for i, b in enumerate(model.buckets)}
    x = np.zeros((n, len(place)))
    for i, o in enumerate(own):
        kept = [place[b] for b in o if b in place]
        x[i, kept] = 1 / math.sqrt(max(1, len(kept)))
    w, bias, losses = np.zeros((len(place), 2)), np.zeros(2), []
    for _ in range(3):
        p = linear.probabilities(x @ w + bias)
        losses.append(-np.log(p[np.arange(n), y]).mean())
        p[np.arange(n), y] -= 1
        w, bias = w - x.T @ p / ((x > 0).sum(axis=0) + train.SHRINK)[:, None], bias - p.sum(axis=0) / n
    assert np.allclose(model.weights, np.vstack([w, bias]), atol=1e-9) and losses == sorted(losses, reverse=True)


def test_models_of_nothing(spark):
    none = spark.createDataFrame([], "text string, label string")
    model = train.fit(none, "text", "label", ("a", "b"))
    assert model(["x"]) == [{"a": 0.5, "b": 0.5}] and model([]) == []
    with pytest.raises(ValueError):
        train.fit(none, "text", "label")


def test_trained_models_in_the_cascade(spark, taught):
    router = train.fit(taught, "text", "label", ("attack", "moderation", "safe"))
    scorer = train.trained_scorer(router=router, prompt=router, moderation=router)
    docs = spark.createDataFrame([(0, "please override w001 w002"), (1, "w003 w004 w005")], "id int, text string")
    out = {r.id: r for r in classify(docs, PROFILES["default"], scorer).collect()}
    assert scorer.router_loaded and out[0].router.attack > 0.5 > out[1].router.attack and out[0].pi == pytest.approx(out[0].router.attack)
    assert not train.trained_scorer().router_loaded
    zero = classify(docs, PROFILES["default"], train.trained_scorer()).first()
    assert zero.router.attack == 0.0 and zero.pi == 0.0


def test_auc_is_that_of_all_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([0, 1]), rng.choice([0.0, 1.0, 0.5, rng.random(), rng.random() / 1e5])) for _ in range(500)] + [("c", 1, 0.5)]
    got = {r.k: r for r in train.auc(spark.createDataFrame(rows, "k string, g int, s double"), F.col("g") == 1, F.col("s"), ("k",), bins=16).collect()}
    for k in "ab":
        p, n = ([s for kk, g, s in rows if kk == k and g == v] for v in (1, 0))
        assert got[k].rows == len(p) + len(n) and got[k].auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n))
    assert got["c"].auc is None and train.auc(spark.createDataFrame([], "g int, s double"), F.col("g") == 1, F.col("s")).first().rows == 0


# --- tokens --------------------------------------------------------------------------------------


def slow_tokens(text, ranks):
    """Byte pairs merged by rank, the lowest first."""
    out = []
    for word in regex.findall(tokens.PATTERN, text):
        parts = [bytes([b]) for b in word.encode()]
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_tokens_are_those_of_plain_merges(spark):
    path = f"{VOCABULARIES}/byte_bpe_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    tokenizer = tokens.SubwordTokenizer(path, special=2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    counted = docs.select("text", tokens.token_counts(F.col("text"), tokenizer).alias("n"), tokens.token_counts(F.col("text"), tokenizer, 64).alias("short")).collect()
    for r in counted:
        own = slow_tokens(r.text, ranks)
        assert (r.n, r.short) == (len(own) + 2, min(64, len(own) + 2))
        cut, n = tokenizer.cut(r.text, 64)
        assert n == r.short and (len(own) > 62 or cut == r.text)
        assert len(own) <= 62 or (r.text.startswith(cut) and slow_tokens(cut, ranks)[:50] == own[:50])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_every_vocabulary_counts_and_cuts(spark, name):
    tokenizer = tokens.SubwordTokenizer(f"{VOCABULARIES}/{name}")
    texts = ["hello world, this is a longer text", "", "é漢字😀" * 5, "<|endoftext|> a", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r.n for r in rows.select("id", tokens.token_counts(F.col("text"), tokenizer).alias("n")).orderBy("id").collect()]
    assert got[:4] == [len(ids) for ids in tokenizer.encode(texts[:4])] and got[1] == 0 and got[4] is None
    for text in texts[:4]:
        cut, n = tokenizer.cut(text, 3)
        assert n == min(3, len(tokenizer.encode([text])[0])) and text.startswith(cut) and len(tokenizer.encode([cut])[0]) <= 4
    with pytest.raises(ValueError):
        tokens.SubwordTokenizer("x.txt")


# --- batches -------------------------------------------------------------------------------------


def by_length(batch, most, window):
    """Scores texts by their length."""

    def load():
        return lambda texts: [{"injection": 1 / (1 + len(t))} for t in texts]

    load.__module__ = "__main__"  # by value: workers have no copy of this file
    return scoring.ArrowScorer(None, load, load, batch, most, window)


@pytest.mark.parametrize(("batch", "window", "records"), [(1, 1, 7), (4, 1, 7), (4, 8, 7), (16, 16, 10000), (1000, 2, 3)])
def test_rows_keep_their_order_in_any_batch(spark, batch, window, records):
    rng = random.Random(batch)
    texts = [None if rng.random() < 0.1 else " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 2, 30, 200]))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3, "id")
    scorer = by_length(batch, 50, window)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        measured = rows.select("id", scorer.measured_prompt(F.col("text")).alias("m")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for r in measured:
        if texts[r.id] is None:
            assert r.m.scores is None and r.m.tokens is None
        else:
            cut, n = scoring.word_cut(texts[r.id], 50)
            assert r.m.scores["injection"] == 1 / (1 + len(cut)) and r.m.tokens == n <= r.m.padded <= 50
    assert len({r.id for r in measured}) == len(texts)


def test_sorted_windows_pad_less(spark):
    rng = random.Random(9)
    texts = [(i, "w " * rng.choice([1, 2, 3, 100])) for i in range(600)]
    rows = spark.createDataFrame(texts, "id int, text string").coalesce(1)
    measured = rows.select(by_length(16, None, 8).measured_prompt(F.col("text")).alias("m"))
    out = scoring.padding(measured, "m").first()
    assert out.texts == 600 and out.padding < 0.25 < 0.6 < out.padding_unsorted
    frames = [pd.Series(["a" * 10, None]), pd.Series(["b"]), pd.Series([], dtype=object), pd.Series(["c" * 100])]
    assert [len(w) for w in scoring.in_windows(iter(frames), 2, 1000)] == [2, 2] and [len(w) for w in scoring.in_windows(iter(frames), 100, 11)] == [2, 2]
