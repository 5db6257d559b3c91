import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from safelens.llm import chat, mixing, near_dup, neighbours, quality, secrets, sharding, url_filter

DOCS = "doc_id long, text string, source string, lang string, size long, shard string, kept int, score double"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "en", -1, "x", 7, 0.5) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"), (None, "one", None), (6, "word " * 30_000, "a"), (7, "naïve 😀 text", "c")]


# --- sharding ------------------------------------------------------------------------------------


def slow_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)
    for n in (1, 2, 40, 41, 1000):
        assert [slow_jump(int(k) % 2**64, n) for k in keys] == sharding.jump_hash(keys, n).tolist()


def test_sharding_odd_rows(spark):
    rows = sharding.shard_documents(docs(spark, ODD), rows_per_block=1).collect()
    assert len(rows) == len(ODD)
    text = {i: t for i, t, _ in ODD}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert r.grown_shard in (r.shard, 40)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def test_sharding_moves_only_into_the_new_shard(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard_documents(ids).toPandas()
    assert (rows.grown_shard[rows.shard != rows.grown_shard] == 40).all()
    assert rows["shard"].value_counts().between(400, 600).all()
    assert 0.01 < (rows.shard != rows.grown_shard).mean() < 0.04


# --- mixing --------------------------------------------------------------------------------------


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 100, 5000]) for s in ["b", "a", "Z", None, "é", "10", "9"]}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)


def test_mixing_odd_rows(spark):
    rows = mixing.pareto_mix(docs(spark, ODD))[0].collect()
    assert len(rows) == len(ODD)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in ODD}
    assert all(r["size"] == sizes[r.doc_id] and 0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mixing.pareto_mix(docs(spark, []))[0].count() == 0


def test_mixing_comes_near_its_targets_and_repeats(spark):
    rng = random.Random(2)
    data = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice("aaaab") + rng.choice(["", "1"])) for i in range(3000)]
    df = docs(spark, data + [(9999, "same words here", "a")] * 300)
    first = sorted(map(tuple, mixing.pareto_mix(df, bins=16)[0].select("doc_id", "taken").collect()))
    again = sorted(map(tuple, mixing.pareto_mix(df.repartition(7), bins=999)[0].select("doc_id", "taken").collect()))
    assert first == again
    by = mixing.pareto_mix(df)[0].groupBy("key").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(by) == 4 and all(abs(r.taken - r.target) <= 61 for r in by)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = mixed.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert words == sum(t for _, t in first)


def slow_mix(sizes, left, draws):
    """Sizes and random numbers by doc: which get the copy that ``left`` words are spent on, in Pareto's order, and in that of the draws."""
    certain, rest = set(), {d for d in sizes if sizes[d]}
    while True:
        factor = max(0.0, left - sum(sizes[d] for d in certain)) / sum(sizes[d] ** 2 for d in rest)
        over = {d for d in rest if factor * sizes[d] > 1}
        if not over:
            break
        most = max(sizes[d] for d in over)
        certain |= {d for d in rest if sizes[d] == most}
        rest -= certain
    odds = {d: (u / (1 - u)) / (factor * sizes[d] / (1 - factor * sizes[d])) for d, u in draws.items() if d in rest}
    out = []
    for order in (sorted(certain) + sorted(rest, key=odds.get), sorted(certain) + sorted(rest, key=draws.get)):
        taken, words = set(), 0
        for d in order:
            if words + sizes[d] / 2 <= left:
                taken.add(d)
            words += sizes[d]
        out.append(taken)
    return *out, certain


@pytest.mark.parametrize("seed,bins", [(1, 256), (2, 8)])
def test_pareto_order_is_the_brute_force_one_and_not_that_of_the_draws(spark, seed, bins, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 4)  # several levels of bins
    rng = random.Random(seed)
    sizes = {d: rng.choice([0, 1, 2, 5, 20, 20, 100, 50]) for d in range(300)} | {1: 6000, 2: 7000, 3: 9000}
    df = docs(spark, [(d, " ".join(f"w{d}" for _ in range(n)), "a" if d % 3 else "b") for d, n in sizes.items()])
    rows, plan = mixing.pareto_mix(df, weights=(1, 1), share=0.7, bins=bins)
    copies, plan = {r.doc_id: r.copies for r in rows.collect()}, {r["__key"]: r for r in plan.collect()}
    certain_ones = 0
    for key in ("a", "b"):
        own = {d: n for d, n in sizes.items() if ("a" if d % 3 else "b") == key}
        text = lambda d: " ".join(f"w{d}" for _ in range(sizes[d]))  # noqa: E731, B023
        draw = lambda d: (int(hashlib.md5(f"{mixing.SEED}:{d}:{hashlib.md5(text(d).encode()).hexdigest()}:1".encode()).hexdigest()[:12], 16) + 0.5) / 2**48  # noqa: E731, B023
        p = plan[f"s{key}"]
        pareto, by_draw, certain = slow_mix(own, p["__left"], {d: draw(d) for d in own})
        assert {d for d in own if sizes[d] and copies[d] > p["__whole"]} == pareto != by_draw
        certain_ones += len(certain)
    assert certain_ones


# --- near duplicates -----------------------------------------------------------------------------


def slow_near(rows, width, similarity):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= similarity * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize(("width", "similarity", "block"), [(3, 85, 128), (5, 80, 3)])
def test_near_duplicates_are_the_brute_force_ones(spark, monkeypatch, width, similarity, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(400)]
    data = []
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 40, 120, 300]))]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            data.append(" ".join(words).upper() if rng.random() < 0.2 else "\n".join(words))
    data += ["", None, "a b", "A  b", "a"]
    rows = list(enumerate(data))
    rng.shuffle(rows)
    got = near_dup.near_duplicates(docs(spark, [(i, t, None) for i, t in rows]), width, similarity)
    assert {tuple(r) for r in got.collect()} == slow_near(rows, width, similarity)


@pytest.mark.parametrize("large,most", [(8, 1024), (1000, 5), (1000, 1024)])
def test_variants_of_a_text_that_is_not_the_smallest(spark, monkeypatch, large, most):
    """Each variant is linked to the text and to no other variant; by hubs, by many blocks, and by few."""
    monkeypatch.setattr(near_dup, "LARGE", large)
    monkeypatch.setattr(near_dup, "MOST", most)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = random.Random(19)
    rows = []
    for base in range(2):
        text = [f"t{base}w{i}" for i in range(100)]
        rows += [(100 * base + 50, " ".join(text))]
        for k in range(40):
            own = list(text)
            own[rng.randint(0, 45)], own[rng.randint(52, 99)] = f"x{base}{k}", f"y{base}{k}"
            rows.append((100 * base + k + (k >= 30) * 30, " ".join(own)))
    got = near_dup.near_duplicates(docs(spark, [(i, t, None) for i, t in rows]), 5, 80)
    assert sorted(tuple(r) for r in got.collect()) == sorted(slow_near(rows, 5, 80)) and {r.component_id for r in got.collect()} == {0, 100}


def test_near_duplicates_odd_rows(spark):
    rows = near_dup.near_duplicates(docs(spark, ODD), 3, 85).collect()
    assert len(rows) == len(ODD)
    by = {(r.doc_id, r.component_id, r.kept) for r in rows}
    assert {(1, 1, True), (4, 4, True), (5, 4, False), (None, None, True), (6, 6, True)} <= by
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0
    twice = docs(spark, [(8, "one two three four five six", None)] * 3 + [(9, "other words", None), (9, "one two three four five six", None)])
    assert {r.component_id for r in near_dup.near_duplicates(twice).collect()} == {8}
    kept = near_dup.one_of_each(docs(spark, ODD + [(8, "x", None)] * 3))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8] and kept.columns == docs(spark, []).columns


def test_index_keys_keep_the_promise():
    rng = np.random.default_rng(0)
    for errors in (1, 2):
        places, radius = 4 * near_dup.CHUNK, (errors + 1) * 4 - 1
        for _ in range(200):
            a = rng.integers(0, 2**16, places).astype("<u2")
            b = a.copy()
            b[rng.choice(places, radius, replace=False)] ^= 1
            with np.errstate(over="ignore"):
                keys = near_dup.index_keys(np.stack([a, b]), errors=errors)
            assert (keys[0] == keys[1]).any()


# --- urls ----------------------------------------------------------------------------------------


def slow_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def test_urls(spark):
    urls = ["http://A.Example.COM/en/71?x", "https://com/en/1", "http://xcom/en/", "http://n.example.net/de/8", "http://b.net/de/9#y", "http://org/es/", "http://orgs/es/", "x", None, "", "a://", "http://h?p/de/", "http://É.net/de/1", "a://b://c/d", "http://h/" + "q" * 50_000, "http://a\nb/c\nd?e"]
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)] + [(0, urls[0], "y", 2.0)], "page_id long, url string, verdict string, score double")
    rows = url_filter.filter_urls(pages).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert (r.host, r.path) == slow_url(urls[r.page_id])
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert r.rule == (max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_markov_model_is_a_distribution_and_learns():
    model = url_filter.MarkovModel()
    for u in ("good/page/1", "good/page/2"):
        model.add(u.encode())
    for context in (b"", b"good", b"zzzz", b"ood/"):
        assert math.isclose(sum(model.probability(context[-4:] + bytes([c])) for c in range(256)), 1.0)
    bad = url_filter.MarkovModel()
    bad.add(b"casino/win/1")
    ratio = url_filter.RatioModel(model, bad)
    assert ratio.score("good/page/7") > 0 > ratio.score("casino/win/7")
    assert url_filter.best_threshold([(0.1, False), (0.2, False), (0.4, True)]) == pytest.approx(0.3)


# --- secrets -------------------------------------------------------------------------------------


def slow_base(text):
    spans = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def test_base_spans_are_the_plain_patterns():
    rng = random.Random(4)
    parts = ["token", "secret", "PASSWD", "api_key", "ApiKey", "=", ": ", "'", '"', "abcdef0123456789", "x", "AKIA", "ABCDEFGHIJKLMN", "é", " ", "secret=short", "ſecret=abcdefghijklmnop", "toKen=abcdefghijklmnop", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(12))
        assert secrets.base_spans(text) == slow_base(text)


def test_battery_tells_random_from_ordinary():
    rng = random.Random(1)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    b64 = dict(secrets.ENCODINGS)["base64"]
    keys = [secrets.p_value(draw(b64, 40)) for _ in range(300)]
    assert sum(k is not None and k[1] < 1e-3 for k in keys) > 285
    words = ["_".join(rng.choice(["configuration", "management", "documentation", "service", "internationalization"]) for _ in range(3)) for _ in range(200)]
    assert sum((p := secrets.p_value(w)) is not None and p[1] < 1e-3 for w in words) == 0
    assert secrets.p_value("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") is None
    assert secrets.p_value("1234567890" * 3) is None


def test_no_encoding_is_left_untested():
    rng = random.Random(21)
    draw = lambda name, n: "".join(rng.choice(dict(secrets.ENCODINGS)[name]) for _ in range(n))
    for name, n in (("letters", 64), ("lower", 160), ("upper", 160), ("decimal", 600)):
        key = draw(name, n)
        (start, end, p), = secrets.candidates(f"see {key}.", [])
        assert (start, end) == (4, 4 + n) and p < 1e-3


def test_keys_in_tokens_that_fit_no_encoding():
    rng = random.Random(22)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    core = dict(secrets.ENCODINGS)["base62"]
    for before, key, after in (("a/my-site/", f"{draw(core, 20)}-{draw(core, 12)}_{draw(core, 16)}", ""), ("some_name-", f"{draw(core, 20)}/{draw(core, 12)}+{draw(core, 16)}", ""), ("v1/a-b/", draw(core, 48), "/c_d")):
        token = before + key + after
        assert secrets.infer(token) is None
        found = secrets.candidates(token, [])
        assert [key in token[s:e] for s, e, p in found if p < 1e-3] == [True]
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_secrets_odd_rows(spark):
    rng = random.Random(9)
    key = "".join(rng.choice(dict(secrets.ENCODINGS)["base62"]) for _ in range(48))
    rows = [*ODD, (10, f'😀 token = "0123456789abcdef01" and {key}.', "z"), (11, "AKIA" + "B7" * 9, "z")]
    got = secrets.find_secrets(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in got:
        assert r.base_sha256 == secrets.base_sha256(text[r.doc_id])
        base = slow_base(text[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert set(filter(None, secrets.joined(base).split(","))) <= set(r.spans.split(","))
    ten = next(r for r in got if r.doc_id == 10)
    assert ten.spans == f"assign:2:30,hex:11:29,random:{text[10].index(key)}:{text[10].index(key) + 48}".replace("assign:2:30", ten.spans.split(",")[0])
    assert hashlib.sha256(b"").hexdigest() == next(r for r in got if r.doc_id == 1).base_sha256
    assert secrets.find_secrets(docs(spark, [])).count() == 0


# --- quality -------------------------------------------------------------------------------------


def test_isotonic_is_the_monotone_least_squares_fit():
    assert quality.isotonic(np.array([1.0, 0.0, 2.0, 1.0, 3.0]), np.ones(5)).tolist() == [0.5, 0.5, 1.5, 1.5, 3.0]
    assert quality.isotonic(np.array([3.0, 0.0]), np.array([1.0, 2.0])).tolist() == [1.0, 1.0]


def test_normal_equations_are_ridge(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, len(quality.STATISTICS)))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "stats array<double>, y double").repartition(3)
    model = quality.fit(rows, cosines=32)
    f = model.features(x)
    want = np.linalg.solve(f.T @ f + np.diag([0] + [quality.RIDGE * 300 / 33 + 1e-6] * 32), f.T @ y)
    assert np.allclose(model.weights, want)
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.75


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (7, 0), (6, 0), (None, 1), (99, 1), (4, None), (4, 5)], "doc_id long, quality int")
    rows = quality.score_documents(docs(spark, ODD), labels, F.col("doc_id") == 6).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.held_out for r in rows) == 1
    assert {r.score for r in quality.score_documents(docs(spark, ODD), labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(docs(spark, []), labels).count() == 0
    assert quality.good_documents(docs(spark, ODD), labels.limit(0)).count() == len(ODD)


# --- neighbours ----------------------------------------------------------------------------------


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = neighbours.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(2 ** (bits * d)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        near = {}
        for i, w in rows:
            if i != q:
                near[i] = min(near.get(i, math.inf), float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())))
        out[q] = sorted((s, i) for i, s in near.items())[:k]
    return out


def test_neighbours_small_and_odd(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(30)]
    odd = [(200, None), (300, [0.0] * 8), (400, [float("nan")] + [1.0] * 7), (500, [None] + [1.0] * 7), (600, [1.0] * 3), (700, [float("inf")] * 8), (None, [1.0] * 8), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 9, 1.0) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int, score double")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(rows, [(i, v) for i, v in rows if i % 100 == 0], 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, [(i, v) for i, v in rows if i % 100 == 0], 10)
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.9 * 10 * len(want)


# --- chat ----------------------------------------------------------------------------------------


def slow_format(a, b):
    a, b = [[((r or ""), (t or "")) for r, t in (c or [])] for c in (a, b)]
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    show = lambda turn: f"<|{turn[0]}|>\n{turn[1]}\n"

    def rest(c):
        text, spans = "", []
        for turn in c[n:]:
            if turn[0] == "assistant":
                spans.append((len(text) + len(turn[0]) + 5, len(text) + len(show(turn))))
            text += show(turn)
        return text, spans

    return (n, "".join(map(show, a[:n])), *rest(a), *rest(b))


def test_preferences(spark):
    u, s = ("user", "hi 😀"), ("assistant", "yes")
    pairs = [([u, s], [u, ("assistant", "no")]), ([u, s], [u, s]), ([u], [u, s]), ([s], [u]), (None, [u]), ([], []), ([(None, None), u], [("", ""), s]), ([u, s] * 3, [u, s] * 2 + [u, ("assistant", "")])]
    df = spark.createDataFrame([(i, a, b, "x") for i, (a, b) in enumerate(pairs)], f"pair_id int, chosen {chat.TURNS}, rejected {chat.TURNS}, prompt string")
    for r in chat.format_preferences(df).collect():
        n, prompt, c, cs, j, js = slow_format(*pairs[r.pair_id])
        assert (r.prompt_turns, r.prompt, r.chosen, [tuple(x) for x in r.chosen_spans], r.rejected, [tuple(x) for x in r.rejected_spans]) == (n, prompt, c, cs, j, js)
    assert chat.format_preferences(df.limit(0)).count() == 0


def test_borrowed_pairs(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 1, "assistant", "y"), (2, 0, "user", "x"), (3, 0, "user", "only"), (None, None, None, None), (4, 0, "assistant", "b"), (4, 0, "assistant", "b")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, reply string")
    got = {r.pair_id: r for r in chat.borrowed_pairs(df).collect()}
    assert set(got) == {1, 2, 4}
    assert tuple(got[4].rejected[-1]) == ("assistant", "y")  # past 1, which ends in the same words
    assert [tuple(t) for t in got[1].chosen] == [("user", "a"), ("assistant", "b")] and [tuple(t) for t in got[1].rejected] == [("user", "a"), ("assistant", "y")]
    assert chat.borrowed_pairs(df.limit(0)).count() == 0
    assert chat.borrowed_pairs(df.filter("conv_id IN (1, 4)")).count() == 0  # one reply only


@pytest.mark.parametrize("seed", range(3))
def test_the_next_different_reply_is_borrowed(spark, seed):
    rng = random.Random(seed)
    replies = {c: rng.choice("aaab" if seed else "abc") for c in range(40)}
    df = spark.createDataFrame([(c, 0, "assistant", r) for c, r in replies.items()] + [(None, 0, "assistant", "null")], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r.rejected[0].text for r in chat.borrowed_pairs(df, group=100).collect()}
    assert got == {c: next(replies[(c + k) % 40] for k in range(1, 40) if replies[(c + k) % 40] != r) for c, r in replies.items()}


def test_very_long_turns_are_formatted_whole(spark):
    long = "é " * 200_000
    pair = spark.createDataFrame([(1, [("user", long), ("assistant", long)], [("user", long), ("assistant", "no")])], f"pair_id int, chosen {chat.TURNS}, rejected {chat.TURNS}")
    row = chat.format_preferences(pair).first()
    assert row.prompt == f"<|user|>\n{long}\n" and row.chosen == f"<|assistant|>\n{long}\n" and tuple(row.chosen_spans[0]) == (14, 15 + len(long))
