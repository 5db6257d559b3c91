import random

import pytest
from pyspark.sql import functions as F

from safelens.operators import calibrate as G
from safelens.operators import metrics as A


def prf(tp, fp, fn, digits=4):
    p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return tuple(round(x, digits) for x in (p, r, 2 * p * r / (p + r) if p + r else 0.0))


def counts(gold, pred):
    return sum(g and p for g, p in zip(gold, pred, strict=True)), sum(not g and p for g, p in zip(gold, pred, strict=True)), sum(g and not p for g, p in zip(gold, pred, strict=True))


def fold_label(gold, scores, least, beta):
    """The search as a fold in grid order, where an infeasible incumbent may be kept."""
    best = None
    for t in G.LABEL_GRID:
        p, r, f = prf(*counts(gold, [s >= t for s in scores]))
        fb = round((1 + beta**2) * p * r / (beta**2 * p + r), 4) if p + r else 0.0
        if r >= least:
            if best is None or (p, fb) > (best[1], best[4]):
                best = (t, p, r, f, fb)
        elif best is None:
            best = (t, p, r, f, fb)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_label_threshold_is_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.random() < 0.4, rng.choice(G.LABEL_GRID) if rng.random() < 0.5 else rng.random()) for _ in range(60)]
    if seed == 3:
        rows = [(False, s) for _, s in rows]
    df = spark.createDataFrame(rows, "g boolean, s double")
    least = (0.85, 0.5, 1.0, 0.85)[seed]
    assert tuple(G.choose_label_threshold(df, F.col("g"), F.col("s"), min_recall=least).first()) == fold_label(*zip(*rows, strict=True), least, 1.5)


def scored(spark, seed, n=80):
    rng = random.Random(seed)
    pick = lambda grid: rng.choice(grid) if rng.random() < 0.6 else rng.random()
    rows = [(["harmful_content"] if rng.random() < 0.4 else [], rng.choice([[], [], [], ["attack"], ["moderation"]]), (pick(G.ROUTE_GRID), pick(G.ROUTE_GRID), pick(G.SAFE_GRID))) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "gold array<string>, force_route array<string>, router struct<attack:double,moderation:double,safe:double>")


@pytest.mark.parametrize(("seed", "least"), [(0, 0.97), (1, 0.5), (2, 1.01)])
def test_joint_routes_are_the_fold(spark, seed, least):
    rows, df = scored(spark, seed)
    best = None
    for a in G.ROUTE_GRID:
        for m in G.ROUTE_GRID:
            ra, rm = [("attack" in f) or r[0] >= a for _, f, r in rows], [("moderation" in f) or r[1] >= m for _, f, r in rows]
            p, r, _ = prf(*counts([bool(g) for g, _, _ in rows], [x or y for x, y in zip(ra, rm, strict=True)]))
            c = (a, m, p, r, sum(ra) + sum(rm))
            if r >= least:
                if best is None or (c[4], -p) < (best[4], -best[2]):
                    best = c
            elif best is None or r > best[3]:
                best = c
    got = G.choose_joint_routes(df, min_recall=least).first()
    assert (got.attack_route, got.moderation_route, got.route_precision, got.route_recall, got.bert_calls) == best


@pytest.mark.parametrize(("seed", "most"), [(0, 1.0), (1, 60.0), (2, -1.0)])
def test_direct_safe_and_fast_allow(spark, seed, most):
    rows, df = scored(spark, seed)
    unsafe = sum(bool(g) for g, _, _ in rows)

    def choice(candidates):
        ok = [c for c in candidates if c[-1] <= most]
        return max(ok, key=lambda c: (c[-3], -c[-2])) if ok else min(candidates, key=lambda c: (c[-1], -c[-3]))

    def measure(hit):
        n, f = sum(map(hit, rows)), sum(bool(r[0]) and hit(r) for r in rows)
        return n, f, round(100 * f / unsafe, 2)

    want = choice([(s, m, *measure(lambda r, s=s, m=m: not r[1] and r[2][2] >= s and r[2][0] < m and r[2][1] < m)) for s in G.SAFE_GRID for m in G.SAFE_ROUTE_GRID])
    got = G.choose_direct_safe(df, max_false_pass_pct=most).first()
    assert (got.score, got.max_route, got.passed_rows, got.unsafe_false_pass_rows) == want[:4]
    want = choice([(t, *measure(lambda r, t=t: not r[1] and r[2][0] < t and r[2][1] < t)) for t in G.FAST_ALLOW_GRID])
    got = G.choose_fast_allow(df, max_false_pass_pct=most).first()
    assert (got.fast_allow, got.passed_rows, got.unsafe_false_pass_rows) == want[:3]


@pytest.mark.parametrize(("seed", "least"), [(0, 0.95), (1, 0.3)])
def test_direct_label(spark, seed, least):
    rows, df = scored(spark, seed)
    candidates = []
    for s in G.DIRECT_GRID:
        for m in G.DIRECT_OTHER_GRID:
            hits = [bool(g) for g, f, r in rows if not f and r[1] >= s and r[0] <= m]
            candidates.append((s, m, len(hits), round(sum(hits) / len(hits), 4) if hits else 0.0))
    ok = [c for c in candidates if c[3] >= least and c[2]]
    want = max(ok, key=lambda c: (c[2], c[3])) if ok else max(candidates, key=lambda c: (c[3], c[2]))
    got = G.choose_direct_label(df, "harmful_content", F.col("router.moderation"), F.col("router.attack"), min_precision=least).first()
    assert (got.score, got.max_other, got.rows, got.precision, got.enabled) == (*want, bool(ok))


def test_counts_add_up_and_sweeps_are_monotone(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.random() < 0.5, rng.random()) for _ in range(100)], "g boolean, s double")
    rows = G.sweep(df, F.col("g"), F.col("s"), G.LABEL_GRID).orderBy("threshold").collect()
    assert all(r.tp + r.fp + r.fn + r.tn == 100 for r in rows)
    assert all(a.tp >= b.tp and a.fp >= b.fp for a, b in zip(rows, rows[1:], strict=False))


def test_best_f1_keeps_the_middle_on_ties(spark):
    df = spark.createDataFrame([(True, 0.9), (False, 0.1)], "g boolean, s double")
    assert G.best_f1(df, F.col("g"), F.col("s")).first().threshold == 0.5


def test_temperature_of_overconfident_margins(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        z = rng.gauss(0, 2)
        rows.append((3.0 * z, int(rng.random() < 1 / (1 + 2.718281828 ** -z))))
    df = spark.createDataFrame(rows, "z double, y int")
    assert 2.0 < G.fit_temperature(df, F.col("z"), F.col("y")) < 4.5
    assert G.fit_temperature(df.limit(0), F.col("z"), F.col("y")) == 1.0


def test_percentile_is_inclusive(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "v double")
    row = A.latency(df, "v").first()
    assert (row.p50, row.p95, row.max) == (2.5, 8.95, 10.0)
    assert A.latency(df.limit(0), "v").first().p50 == 0.0
