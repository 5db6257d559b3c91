"""The methods against plain versions of themselves."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from safelens.llm import components, decontaminate, lm_score, quality, secrets, url_filter
from test_corpus_ops import slow_lcs
from test_small_ops import docs

# --- url filter ----------------------------------------------------------------------------------


def slow_model(urls, order):
    seen = Counter(u.encode()[i - k : i + 1] for u in urls for i in range(len(u.encode())) for k in range(min(order, i) + 1))

    def probability(text, i):
        p = 1 / 256
        for k in range(min(order, i) + 1):
            after = {g: n for g, n in seen.items() if g[:-1] == text[i - k : i] and len(g) == k + 1}
            if not after:
                break
            p = (after.get(text[i - k : i + 1], 0) + len(after) * p) / (sum(after.values()) + len(after))
        return p

    return lambda text: sum(math.log(probability(text, i)) for i in range(len(text)))


def test_url_scores_and_verdicts_are_the_brute_force_ones(spark):
    rng = random.Random(4)
    path = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 5)))
    urls = [f"http://a.net/de/{path('abc')}" for _ in range(12)] + [f"http://b.com/en/{path('xyz')}" for _ in range(12)] + [f"http://c.io/{path('abcxyz')}" for _ in range(8)] + [None, ""]
    pages = spark.createDataFrame([(i, u, 1.0) for i, u in enumerate(urls)], "page_id long, url string, score double")
    got = url_filter.filter_urls(pages).collect()
    hashed = {r.url: r.h for r in pages.select("url", F.xxhash64("url").alias("h")).filter("url IS NOT NULL").collect()}
    models, kept = [], []
    for rule in ("/de/", "/en/"):
        own = sorted({u for u in urls if u and rule in u}, key=lambda u: (hashed[u], u))
        models.append(slow_model(own[::2], url_filter.ORDER))
        kept += [(u, rule == "/de/") for u in own[1::2]]
    score = lambda u: (models[0](u.encode()) - models[1](u.encode())) / len(u.encode()) if u else 0.0
    held = sorted((score(u), good) for u, good in kept)
    cuts = [held[0][0] - 1, *((a + b) / 2 for (a, _), (b, _) in zip(held, held[1:], strict=False)), held[-1][0] + 1]
    n = Counter(good for _, good in held)
    right = lambda cut: sum(s >= cut for s, good in held if good) / n[True] + sum(s < cut for s, good in held if not good) / n[False]
    threshold = max(cuts, key=lambda c: (round(right(c), 9), -c))
    for r in got:
        assert math.isclose(r.score, score(urls[r.page_id]), rel_tol=1e-9, abs_tol=1e-12)
        if r.rule is None:
            assert r.verdict == ("allow" if r.score >= threshold else "block")


@pytest.mark.parametrize("rows", [1 << 21, 300])
def test_every_ruled_url_teaches_or_calibrates(spark, monkeypatch, rows):
    monkeypatch.setattr(url_filter, "PASS_ROWS", rows)
    monkeypatch.setattr(url_filter, "TOGETHER", 1000)
    ruled = [f"http://a.net/de/{i:x}" for i in range(9000)] + ["http://b.com/en/" + "wxyz" * 600, "http://b.com/en/z", "http://b.com/en/w", "http://b.com/en/\u00e9"]
    asked = ["http://c.io/wxyzwx", "http://c.io/0123", "http://d.io/\u00e9", "q"]
    pages = spark.createDataFrame(list(enumerate(ruled + asked)), "page_id long, url string")
    hashed = pages.select("url", F.xxhash64("url").alias("h")).filter(F.length("url") > 0).collect()
    accepted, rejected, kept = url_filter.MarkovModel(), url_filter.MarkovModel(), []
    for model, rule in ((accepted, "/de/"), (rejected, "/en/")):
        own = sorted((r.h, r.url) for r in hashed if rule in r.url)
        for _, url in own[::2]:
            model.add(url.encode())
        kept += [(url, rule == "/de/") for _, url in own[1::2]]
    plain = url_filter.RatioModel(accepted, rejected)
    threshold = url_filter.best_threshold([(plain.score(u), good) for u, good in kept])
    for r in url_filter.filter_urls(pages).filter((F.col("page_id") % 97 == 0) | (F.col("page_id") >= 9000)).collect():
        url = (ruled + asked)[r.page_id]
        assert math.isclose(r.score, plain.score(url), rel_tol=1e-9, abs_tol=1e-12)
        if r.rule is None:
            assert r.verdict == ("allow" if plain.score(url) >= threshold else "block")


# --- decontamination -----------------------------------------------------------------------------


@pytest.mark.parametrize("n", [91, 108, 180, 250])
def test_any_part_of_a_long_item_is_found_as_reading_everything_finds_it(spark, n):
    """Documents that hold only the beginning, a middle or the end of a long item, against all windows of all pieces."""
    rng = random.Random(n)
    word = lambda kind="w": f"{kind}{rng.randint(0, 3000)}"
    item = [word() for _ in range(n)]
    rows = []
    for length in (30, 50, 65, 72, 90):
        for at in {0, (n - min(n, length)) // 2, n - min(n, length)}:
            rows.append((len(rows), " ".join([word("x") for _ in range(rng.randint(0, 60))] + item[at : at + length] + [word("x") for _ in range(rng.randint(0, 60))])))
    passages = decontaminate.Passages([(n, " ".join(item))], np.ones(decontaminate.TERMS, np.float32))
    assert [p.tolist() for p in passages.hashes] and set(np.concatenate(passages.hashes).tolist()) == set(decontaminate.words_of(" ".join(item)).tolist())
    want = set()
    for d, text in rows:
        ids = decontaminate.words_of(text).tolist()
        for piece, answer, scale, after in zip(passages.hashes, passages.answers, passages.scale.tolist(), passages.after, strict=True):
            more = decontaminate.margin(scale, len(piece))
            for start in range(0, max(1, len(ids) - 3 * (scale // 4)), scale // 4):
                low, high = max(0, start - more), start + scale + more
                share = slow_lcs(piece.tolist(), ids[low:high]) / len(piece)
                of_answer = slow_lcs(answer.tolist(), ids[low : high + after * 5 // 4]) / len(answer)
                if share >= decontaminate.ALONE or (share >= decontaminate.PASSAGE_SHARE and of_answer >= decontaminate.ANSWER_SHARE):
                    want.add(d)
    got = decontaminate.leaks(docs(spark, [(d, t, "a") for d, t in rows]), spark.createDataFrame([(n, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want
    assert {d for d, _ in rows if d >= len(rows) - 2} <= want and len(want) < len(rows)


def test_items_of_ordinary_words_are_found_without_their_rare_ones(spark):
    """28 words that nearly all documents hold and 2 rare ones; the copies have other words in place of the two."""
    rng = random.Random(31)
    usual = [f"u{i}" for i in range(40)]
    items = [(i, [rng.choice(usual) for _ in range(28)] + [f"rare{i}a", f"rare{i}b"]) for i in range(10)]
    rows = [(d, [rng.choice(usual) for _ in range(rng.randint(60, 200))]) for d in range(400)]
    for i, words in items:
        rng.shuffle(words)
        at = rng.randint(0, 60)
        rows[i * 7][1][at:at] = [f"new{i}{w[-1]}" if w.startswith("rare") else w for w in words]
    got = decontaminate.leaks(docs(spark, [(d, " ".join(t), "a") for d, t in rows]), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")).collect()
    assert {(i * 7, i) for i, _ in items} <= {(r.doc_id, r.item_id) for r in got}


def test_the_checks_read_words_and_not_terms(spark, monkeypatch):
    """Words that share a term are told apart: with two terms in all, no document that has none of the item's words is found."""
    monkeypatch.setattr(decontaminate, "TERMS", 2)
    item, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = decontaminate.leaks(docs(spark, [(1, f"x {item} y", "a"), (2, f"x {other} y", "a")]), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert [r.doc_id for r in got.collect()] == [1]


# --- components ----------------------------------------------------------------------------------


@pytest.mark.parametrize("row_bytes", [components.ROW_BYTES, 1 << 40])
def test_components_are_those_of_a_search(spark, monkeypatch, row_bytes):
    """A star, a path, a ring and random links; the smallest neighbours broadcast, and joined by a shuffle."""
    monkeypatch.setattr(components, "ROW_BYTES", row_bytes)
    rng = random.Random(6)
    links = [(1000, 1001 + i) for i in range(200)] + [(3000 + i, 3001 + i) for i in range(40)] + [(5000 + i, 5000 + (i + 1) % 9) for i in range(9)] + [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(60)]
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        if start not in want:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = start
                    todo += near[x]
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"), "test")
    assert {r.node: r.component for r in got.collect()} == want and got.count() == len(want)


# --- language models -----------------------------------------------------------------------------


def test_losses_are_the_same_through_any_number_of_levels(spark, monkeypatch):
    """Keys cut into 2, 4, 8 slices and so on, a few lots merged at a time, against all of them counted at once."""
    rng = random.Random(13)
    rows = docs(spark, [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 90))), "a") for i in range(120)] + [(500, None, "a")]).repartition(5).cache()
    target = spark.createDataFrame([(i,) for i in range(0, 120, 4)], "doc_id long")
    scores = lambda: sorted((r.doc_id, r.n_words, r.target_loss, r.background_loss) for r in lm_score.cross_entropy_difference(rows, target).collect())
    whole = scores()
    monkeypatch.setattr(lm_score, "LOT", 300)
    for fan, size in ((2, 4096), (3, 2048)):
        monkeypatch.setattr(lm_score, "FAN", fan)
        monkeypatch.setattr(lm_score, "SLICE_BYTES", size)
        assert scores() == whole


# --- secrets -------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_the_cut_is_that_of_benjamini_and_hochberg(spark, seed):
    """But for the grid, which rounds p-values up by less than 1.1 %."""
    rng = random.Random(seed)
    p = [rng.random() ** (6 if rng.random() < 0.3 else 1) for _ in range(400)]

    def accepted(values, share=0.05):
        ordered = sorted(values)
        ranks = [k for k, v in enumerate(ordered, 1) if v * len(ordered) <= share * k]
        return len([v for v in values if ranks and v <= ordered[ranks[-1] - 1]])

    cut = secrets.discovery_cut(spark.createDataFrame([(v,) for v in p], "p double"), 0.05)
    found = sum(v <= cut for v in p)
    assert accepted([v * 2 ** (1 / 64) for v in p]) <= found <= accepted(p) and found
    assert secrets.discovery_cut(spark.createDataFrame([(1.0,), (0.9,)], "p double"), 0.05) == 0
    assert secrets.discovery_cut(spark.createDataFrame([], "p double"), 0.05) == 0


def test_three_scores_are_combined_by_their_weights():
    """Each test alone can move the p-value, the chi-squared one most; and writing with the null's coincidence is seldom taken for random."""
    base = secrets.ordinary_tail(60.0, 0.0, 0.0, 40, 64)
    assert base < secrets.ordinary_tail(60.0, 2.0, 0.0, 40, 64) < secrets.ordinary_tail(60.0, 2.0, 2.0, 40, 64)
    scores, weights = secrets.ordinary_scores(60.0, 1.0, -1.0, 40, 64)
    assert weights[0] > weights[1] == weights[2] > 0
    assert math.isclose(secrets.ordinary_tail(60.0, 1.0, -1.0, 40, 64), 0.5 * math.erfc(float((scores * weights).sum() / math.sqrt((weights**2).sum())) / math.sqrt(2)))
    rng = np.random.default_rng(2)
    shares = 1 / np.arange(1, 27) ** 0.75
    shares /= shares.sum()
    assert (shares**2).sum() >= secrets.COINCIDENCE
    letters = rng.permutation(26)
    p = [secrets.ordinary_tail(*secrets.battery(letters[rng.choice(26, 40, p=shares)], 26), 40, 26) for _ in range(1500)]
    assert np.mean(np.array(p) <= 0.01) <= 0.015


# --- quality -------------------------------------------------------------------------------------


def slow_statistics(text):
    """Word by word and line by line."""
    out = dict.fromkeys(quality.STATISTICS, 0.0)
    if not text:
        return list(out.values())
    share = lambda of: sum(c in of for c in text) / len(text)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    out |= {"log_chars": math.log1p(len(text)), "log_words": math.log1p(len(words)), "upper": share(range(65, 91)), "digits": share(range(48, 58)), "marks": share(marks), "bars": share(b"|"), "odd_marks": share(b"#$%&*@^~<>{}[]\\=+_"),
            "exclamations": share(b"!"), "stops": share(b"."), "commas": share(b","), "spaces": share(b" \t\n\x0b\x0c\r"), "beyond_ascii": share(range(128, 256)), "entropy": -sum(k / len(text) * math.log2(k / len(text)) for k in Counter(text).values())}
    if words:
        lengths, tally = [len(w) for w in words], Counter(words)
        of = lambda test: sum(map(test, words)) / len(words)
        out |= {"word_length": np.mean(lengths), "word_length_spread": np.std(lengths), "distinct_words": len(tally) / len(words) ** 0.8, "top_word": max(tally.values()) / len(words), "short_words": of(lambda w: len(w) <= 3),
                "shouted_words": of(lambda w: len(w) > 1 and w.isupper()), "marked_words": of(lambda w: w[-1:] in [bytes([c]) for c in b"#$%&*@^~!|=+<>"]), "barred_words": of(lambda w: w == b"|")}
    if lines:
        out |= {"repeated_lines": 1 - len(set(lines)) / len(lines), "log_line_length": math.log1p(len(text) / len(lines))}
    return list(out.values())


def test_statistics_counted_together_are_those_of_each_text():
    rng = random.Random(5)
    parts = ["a", "Ab", "ABC", "x!", "|", "||", "9#", "é", "ÉÀ", "\n", "\n\n", " ", "\t \n", "same line\n", "\r\n", "\x0b", "w" * 70_000]
    texts = ["".join(rng.choice(parts[:-1]) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 60))).encode() for _ in range(120)] + [b"", b" \n", (parts[-1] + " " + parts[-1] + "q\nz").encode()]
    got = quality.statistics_of(texts)
    assert np.allclose(got, [slow_statistics(t) for t in texts], atol=1e-9)
    assert np.allclose(got[::7], [quality.statistics(t) for t in texts[::7]], atol=1e-12) and not quality.statistics(None).any()
    assert quality.statistics_of([]).shape == (0, len(quality.STATISTICS))


def test_quality_scores_are_those_of_a_plain_cross_fit(spark):
    rng = random.Random(9)
    rows = [(d, " ".join(rng.choice("ab") * rng.randint(1, 9) + ("!!" if d % 3 == 0 and rng.random() < 0.7 else "") for _ in range(rng.randint(5, 40))), "a") for d in range(120)] + [(500, None, "a"), (501, "", "a")]
    labels = [(d, int(d % 3 > 0)) for d in range(0, 120) if d % 5]
    df = docs(spark, rows)
    got = {r.doc_id: r.score for r in quality.score_documents(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    stats = {d: quality.statistics((t or "").encode()) for d, t, _ in rows}
    folds = {r.d: r.fold for r in spark.createDataFrame([(d, s.tolist()) for d, s in stats.items()], "d long, stats array<double>").select("d", F.pmod(F.xxhash64("stats"), F.lit(quality.FOLDS)).alias("fold")).collect()}
    x, y = np.stack([stats[d] for d, _ in labels]), np.array([float(v) for _, v in labels])
    fold = np.array([folds[d] for d, _ in labels])
    draw = np.random.default_rng(quality.SEED)
    mean, spread = x.mean(0), np.sqrt(np.maximum((x**2).mean(0) - x.mean(0) ** 2, 1e-8))
    frequencies, phases = draw.normal(size=(x.shape[1], quality.COSINES)) / np.sqrt(2 * x.shape[1]), draw.uniform(0, 2 * np.pi, quality.COSINES)
    features = lambda s: np.hstack([np.ones((len(s), 1)), np.sqrt(2 / quality.COSINES) * np.cos(np.clip((s - mean) / spread, -6, 6) @ frequencies + phases)])

    def ridge(keep):
        f = features(x[keep])
        return np.linalg.solve(f.T @ f + np.diag([1e-9] + [quality.RIDGE * keep.sum() / (quality.COSINES + 1) + 1e-6] * quality.COSINES), f.T @ y[keep])

    unseen = np.zeros(len(x))
    for k in range(quality.FOLDS):
        unseen[fold == k] = features(x[fold == k]) @ ridge(fold != k)
    cell = np.clip(((unseen - quality.LOW) / (quality.HIGH - quality.LOW) * quality.GRID).astype(int), 0, quality.GRID - 1)
    cells = np.unique(cell)
    values = [y[cell == c].mean() for c in cells]
    weights = [float((cell == c).sum()) for c in cells]
    # The largest lower mean over all stretches that contain a cell: the minimax form of the isotonic fit.
    block = lambda i, j: np.average(values[i : j + 1], weights=weights[i : j + 1])
    fitted = [max(min(block(i, j) for j in range(k, len(cells))) for i in range(k + 1)) for k in range(len(cells))]
    at = [unseen[cell == c].mean() for c in cells]
    want = np.interp(features(np.stack([stats[d] for d, _, _ in rows])) @ ridge(np.ones(len(x), bool)), at, fitted)
    assert np.allclose([got[d] for d, _, _ in rows], want, atol=1e-6)
    assert 0.0 < np.mean([(got[d] >= 0.5) == (d % 3 > 0) for d in range(120) if d % 5 == 0]) <= 1
