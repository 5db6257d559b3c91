import json

import pytest
from pyspark.sql import functions as F

from safelens.config import PROFILES
from safelens.functions.scoring import ArrowScorer
from safelens.operators import diagnostics as X
from safelens.operators import metrics as A
from safelens.operators import reports as R
from safelens.operators.cascade import classify
from safelens.sources import readers as S


def test_probes(spark):
    rows = X.probe_report(spark, PROFILES["default"]).collect()
    assert len(rows) == len(X.PROBES) and all(r.ok == (r.kind == r.predicted) for r in rows)
    assert all(r.ok for r in rows if r.kind in ("safe", "harmful_content"))


def test_bakeoff_ranks_models(spark):
    rows = spark.createDataFrame([(i, "bad" if i % 2 else "good", i % 2) for i in range(20)], "id int, text string, gold int")
    right = lambda: lambda texts: [{"toxic": 0.9 if t == "bad" else 0.1} for t in texts]
    wrong = lambda: lambda texts: [{"toxic": 0.4} for _ in texts]
    board = X.bakeoff(rows, {"wrong": (wrong, "toxic_multi"), "right": (right, "toxic_binary")}, "id").collect()
    assert [r.model for r in board] == ["right", "wrong"] and board[0].f1 == 1.0


def test_sweep_writes_a_report_a_setting(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"text": t, "label": g}) for t, g in (("you idiot", "toxic"), ("fine", "safe"))))
    ranked = X.sweep_settings(S.read_corpora(spark, [str(tmp_path / "a.jsonl")]), PROFILES["default"], [32, 128], [16], None, str(tmp_path / "s.json"))
    assert sorted(r.place for r in ranked.collect()) == [1, 2]
    assert (tmp_path / "s.32-16.json").exists() and len(json.loads((tmp_path / "s.json").read_text())["settings"]) == 2


def test_temperature_report(spark):
    rows = spark.createDataFrame([(i, 4.0 if i % 2 else -4.0, i % 2 if i % 10 else 1 - i % 2) for i in range(100)], "id int, z double, y int")
    out = X.calibrate_temperature(rows, F.col("z"), F.col("y"), "id", 60)
    assert out["temperature"] > 1 and out["after"]["f1"] > 0.8


def test_sweep_over_threads(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"text": "you idiot", "label": "toxic"}))
    seen = []
    load = lambda: lambda texts: [{"toxic": 0.9} for _ in texts]

    def make(batch, threads):
        seen.append((batch, threads))
        return ArrowScorer(None, load, load, batch)

    ranked = X.sweep_settings(S.read_corpora(spark, [str(tmp_path / "a.jsonl")]), PROFILES["default"], [32], [4, 8], make, str(tmp_path / "s.json"), threads=(1, 2))
    assert sorted((r.batch, r.threads) for r in ranked.collect()) == sorted(seen) == [(4, 1), (4, 2), (8, 1), (8, 2)] and (tmp_path / "s.32-8-2.json").exists()


def test_batching_and_pipeline_probes(spark):
    steady = lambda: lambda texts: [{"INJECTION": 0.9 if "disregard" in t.lower() else 0.1} for t in texts]
    padded = lambda: lambda texts: [{"INJECTION": min(1.0, 0.2 * len(texts))} for _ in texts]
    assert all(r.flagged == 0 for r in X.batching_report(spark, ArrowScorer(None, steady, steady)).collect())
    assert sum(r.flagged for r in X.batching_report(spark, ArrowScorer(None, padded, padded)).collect()) == len(X.BATCHING_PROBES)
    rows = X.pipeline_report(spark, PROFILES["default"]).collect()
    assert len(rows) == len(X.PIPELINE_PROBES) and all(r.ok for r in rows if r.expected in ("safe", "harmful_content"))


def test_models_read_cut_texts_and_are_timed(spark):
    load = lambda: lambda texts: [{"INJECTION": len(t.split()) / 100} for t in texts]
    row = classify(spark.createDataFrame([("word " * 50,)], "text string"), PROFILES["default"], ArrowScorer(None, load, load, max_length=12)).first()
    assert row.pi == 0.12 and row.prompt_tokens == 12 and row.prompt_ms >= 0 and row.router_loaded is False


def test_tables_for_the_console(spark):
    board = spark.createDataFrame([("a", 0.5, 0.9, 0.8, 0.847), ("b", 0.25, 1.0, 1.0, 1.0)], "model string, threshold double, precision double, recall double, f1 double")
    flags = spark.createDataFrame([("a", "d", True), ("b", "d", False)], "model string, dataset string, contaminated boolean")
    lines = R.leaderboard_table(board, flags, "d").splitlines()
    assert lines[0] == "dataset=d" and lines[3].split()[:3] == ["b", "clean", "1.000"] and lines[4].split()[:2] == ["a", "TRAIN!"]
    assert R.shown(spark.createDataFrame([("é" * 100,)], "text string")).first().text == "é" * 70


def test_label_thresholds_on_routed_rows_only(spark):
    rows = [(["harmful_content"] if i % 4 == 0 else [], [], {"attack": 0.0, "moderation": 0.9 if i % 2 == 0 else 0.0, "safe": 0.1}, 0.0, 0.9 if i % 4 == 0 else 0.95 if i % 2 else 0.1, 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "gold array<string>, force_route array<string>, router struct<attack:double,moderation:double,safe:double>, pi double, harmful double, sexual double").cache()
    every, routed = (R.calibrate_all(df, score_scope=s, veto=False)["labels"]["harmful_content"] for s in ("all", "routed"))
    assert routed["precision"] == 1.0 > every["precision"]


def test_held_out_sets_choose_their_split(spark):
    one = lambda text: spark.createDataFrame([(text, 1)], "text string, label int")
    assert S.held_out("xTRam1/safe-guard-prompt-injection", {"test": one("t"), "train": one("u")}).first().text == "u"
    assert S.held_out("xTRam1/safe-guard-prompt-injection", {"b": one("x"), "a": one("y")}).first().text == "x"
    assert S.chosen_split({"train": one("u"), "test": one("t")}).first().text == "t" and S.chosen_split({"dev": one("d")}).first().text == "d"
    with pytest.raises(ValueError):
        S.held_out("other", {})


def test_modes(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.2)], "id int, a double, b double")
    assert X.compare_modes(rows, {"single": F.col("a"), "batch": F.col("b")}, "id").first().batch_inconsistent
    assert A.disagreement(rows, "a", "b").first().flagged == 1
