import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from safelens.llm import decontaminate, lm_score
from safelens.llm import words as hashes
from test_small_ops import ODD, docs


def words(rng, n, kind="w"):
    return [f"{kind}{rng.randint(0, 3000)}" for _ in range(n)]


# --- decontamination -----------------------------------------------------------------------------


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = [np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 40))]) for _ in range(2)]
        assert decontaminate.common_subsequence(a, b) == slow_lcs(a.tolist(), b.tolist())


def test_leaks_and_paraphrases_are_found_and_clean_documents_left(spark):
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, n)).capitalize() + ".") for i, n in enumerate([14, 20, 30, 36, 45, 59, 70, 130] * 3)]
    held, rows = set(), []
    for d in range(300):
        text = words(rng, rng.randint(30, 400))
        if d % 10 == 0:
            item, passage = rng.choice(items)
            passage = passage.split()
            if d % 20 == 0:  # a paraphrase: an eighth of the words replaced
                for k in rng.sample(range(len(passage)), len(passage) // 8):
                    passage[k] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() if d % 30 == 0 else w for w in passage]
            held.add((d, item))
        rows.append((d, " ".join(text), "a"))
    got = decontaminate.leaks(docs(spark, rows + ODD), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == held
    clean = decontaminate.clean_documents(docs(spark, rows + ODD), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.count() == len(rows) + len(ODD) - len({d for d, _ in held})


def test_whatever_the_shares_accept_is_found(spark):
    """Paraphrases that keep 60 to 75 % of items that are mostly common words, against reading every window word by word."""
    rng = random.Random(17)
    usual, odd = [f"u{i}" for i in range(60)], lambda: f"o{rng.randint(0, 10**6)}"
    write = lambda n: [rng.choice(usual) if rng.random() < 0.6 else odd() for _ in range(n)]
    items, rows = [(i, write(n)) for i, n in enumerate([14, 20, 30, 45, 59] * 4)], []
    for d in range(120):
        passage = list(rng.choice(items)[1])
        share = rng.choice([0.6, 0.65, 0.7, 0.75])
        for k in rng.sample(range(len(passage)), int(len(passage) * (1 - share))):
            passage[k] = odd()
        text = write(rng.randint(40, 150))
        at = rng.randint(0, len(text))
        rows.append((d, " ".join(text[:at] + passage + text[at:])))
    want = set()
    for item, passage in items:
        text = " ".join(passage)
        piece, answer = decontaminate.terms(text), decontaminate.terms(decontaminate.answer_of(text))
        scale = next(s for s in decontaminate.SCALES if len(piece) <= s * 3 // 4)
        more = max(scale // 2, len(piece) // 2)
        for d, text in rows:
            ids = decontaminate.terms(text)
            for start in range(0, max(1, len(ids) - 3 * (scale // 4)), scale // 4):
                region = ids[max(0, start - more) : start + scale + more]
                share, of_answer = (decontaminate.common_subsequence(x, region) / len(x) for x in (piece, answer))
                if share >= decontaminate.ALONE or (share >= decontaminate.PASSAGE_SHARE and of_answer >= decontaminate.ANSWER_SHARE):
                    want.add((d, item))
    assert len(want) > 100
    got = decontaminate.leaks(docs(spark, [(d, t, "a") for d, t in rows]), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(0 <= r.cosine <= 1 for r in got)


def test_the_end_of_a_long_item_is_found(spark):
    rng = random.Random(23)
    items = [(n, words(rng, n)) for n in (91, 107, 179, 250)]
    for n, passage in items:
        pieces = decontaminate.Passages([(n, " ".join(passage))], np.ones(decontaminate.TERMS, np.float32)).words
        assert set(decontaminate.terms(" ".join(passage))) == set(np.concatenate(pieces))
    text = [*words(rng, 100, "x"), *items[1][1][-60:], *words(rng, 100, "x")]
    got = decontaminate.leaks(docs(spark, [(1, " ".join(text), "a")]), spark.createDataFrame([(n, " ".join(t)) for n, t in items], "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in got.collect()] == [(1, 107)]


def test_blocks_of_the_benchmark_agree(spark, monkeypatch):
    rng = random.Random(3)
    items = spark.createDataFrame([(i, " ".join(words(rng, 30))) for i in range(20)] + [(None, "x"), (50, None), (51, "")], "item_id long, text string")
    rows = docs(spark, [(r.item_id, f"{' '.join(words(rng, 40))} {r.text}", "a") for r in items.filter("item_id < 20").collect()])
    whole = {(r.doc_id, r.item_id) for r in decontaminate.leaks(rows, items).collect()}
    monkeypatch.setattr(decontaminate, "BENCHMARK_BLOCK", 7)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(rows, items).collect()} == whole == {(i, i) for i in range(20)}
    assert decontaminate.leaks(rows, items.limit(0)).count() == 0 and decontaminate.leaks(rows.limit(0), items).count() == 0


def test_latent_space_spans_the_passages(spark):
    rng = random.Random(5)
    idf = np.ones(decontaminate.TERMS, np.float32)
    passages = decontaminate.Passages([(i, " ".join(words(rng, 30))) for i in range(40)], idf)
    drawn = spark.createDataFrame([(bytearray(decontaminate.terms(" ".join(words(rng, 500))).tobytes()),) for _ in range(20)], "payload binary")
    space = decontaminate.latent_space(passages, drawn, idf)
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-4)
    assert np.allclose((passages.matrix @ space) @ (passages.matrix @ space).T, passages.matrix @ passages.matrix.T, atol=0.05)


def test_pair_sums_are_those_of_all_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FIT_WORDS", 64)
    monkeypatch.setattr(decontaminate, "FIT_PAIRS", 50)
    rng = random.Random(6)
    weight = np.random.default_rng(1).uniform(0.1, 3, decontaminate.TERMS).astype(np.float32)
    passages = decontaminate.Passages([(i, " ".join(words(rng, 30))) for i in range(5)], weight)
    texts = [decontaminate.terms(" ".join(words(rng, n))) for n in (500, 31, 32, 33, 1, 200, 64)]
    got = decontaminate.pair_sums(passages, spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "payload binary").repartition(2), weight)
    size = len(passages.vocabulary)
    want = np.zeros((size, size))
    for text in texts:
        for s in range(0, len(text), 32):
            window = np.unique(text[s : s + 32])
            row, own = np.zeros(size), window[passages.column[window] >= 0]
            row[passages.column[own]] = weight[own] / np.linalg.norm(weight[window].astype(float))
            want += np.outer(row, row)
    sums = np.zeros((size, size))
    for r in got.collect():
        sums[divmod(r.key, size)] = r.value / decontaminate.ONE
    assert np.allclose(sums, np.triu(want), atol=1e-6) and want.any()


def test_the_latent_space_is_fitted_on_all_documents(spark, monkeypatch):
    fitted, space = [], decontaminate.latent_space
    monkeypatch.setattr(decontaminate, "latent_space", lambda passages, texts, weight: fitted.append(texts.count()) or space(passages, texts, weight))
    rng = random.Random(7)
    texts = [" ".join(words(rng, 12)) for _ in range(3000)]
    items = spark.createDataFrame([(1, texts[8]), (2, " ".join(words(rng, 12)))], "item_id long, text string")
    got = decontaminate.leaks(docs(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(3000, None, "a"), (3001, " ", "a")]), items).collect()
    assert fitted == [3000] and [(r.doc_id, r.item_id) for r in got] == [(8, 1)]


def test_answers():
    assert decontaminate.answer_of("Q: what? A: forty two") == "forty two"
    assert decontaminate.answer_of("First. Second one.") == "Second one."
    assert decontaminate.answer_of("") == ""


def test_word_hashes_by_any_grouping(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab É_-.\né9ß") for _ in range(rng.randint(0, 200))) for _ in range(50)]
    alone = [hashes.word_hashes(hashes.folded(t.encode()))[1].tolist() for t in texts]
    split = ["".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split() for t in texts]
    assert [len(a) for a in alone] == [len(s) for s in split]
    seen = {}
    for a, s in zip(alone, split, strict=True):
        for h, w in zip(a, s, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    for size in (1, 300, 10**6):
        got = [h[at[k] : at[k + 1]].tolist() for numbers, h, at in hashes.grouped([t.encode() for t in texts], size) for k in range(len(numbers))]
        assert got == alone
    monkeypatch.setattr(hashes, "PIECE", 64)
    assert [hashes.word_hashes(hashes.folded(t.encode()))[1].tolist() for t in texts if max(map(len, t.split() or [""])) < 30] == [a for a, t in zip(alone, texts, strict=True) if max(map(len, t.split() or [""])) < 30]


def test_words_of_any_length_are_hashed_whole(monkeypatch):
    """Words longer than a piece, beside short ones, between any white space: as many as ``split`` finds, equal where these are equal."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abÉx") for _ in range(rng.choice([1, 3, 30, 64, 65, 200, 700])))
    known = [word() for _ in range(40)]
    texts = [rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", "\r\n", "\x0b \x0c"]).join(rng.choice(known) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    want = {}
    for piece in (hashes.PIECE, 64):
        monkeypatch.setattr(hashes, "PIECE", piece)
        for text in texts:
            words = text.encode().lower().split()
            starts, found = hashes.word_hashes(hashes.plain(text.encode()))
            assert len(found) == len(words) and all(text.encode().lower()[s : s + len(w)] == w for s, w in zip(starts.tolist(), words, strict=True))
            for w, h in zip(words, found.tolist(), strict=True):
                assert want.setdefault(w, h) == h
    assert len(set(want.values())) == len(want)


# --- language models -----------------------------------------------------------------------------


def keys_of(text):
    return lm_score.word_ids(hashes.word_hashes(hashes.plain(text.encode()))[1])


def slow_losses(texts, target, which):
    """The same model with dictionaries, without the document itself."""
    uni, pair, total = [{}, {}], [{}, {}], [0, 0]

    def add(text, side, sign):
        ids = keys_of(text)
        if len(ids) > 1:
            for x in ids.tolist():
                uni[side][x] = uni[side].get(x, 0) + sign
                total[side] += sign
            for x in lm_score.pair_ids(ids).tolist():
                pair[side][x] = pair[side].get(x, 0) + sign

    for i, t in texts.items():
        add(t, int(i in target), 1)
    scale = [min(total) / n for n in total]
    add(texts[which], int(which in target), -1)
    ids = keys_of(texts[which])
    pairs, out = lm_score.pair_ids(ids).tolist(), []
    for side in (1, 0):
        loss = 0.0
        for a, b, p in zip(ids[:-1].tolist(), ids[1:].tolist(), pairs, strict=True):
            shared = (uni[0].get(b, 0) + uni[1].get(b, 0) + 0.1) / (sum(total) + 0.1 * lm_score.WORDS)
            u = (uni[side].get(b, 0) * scale[side] + lm_score.UNIGRAM_PRIOR * shared) / (total[side] * scale[side] + lm_score.UNIGRAM_PRIOR)
            before = uni[side].get(a, 0) * scale[side]
            loss -= math.log((min(pair[side].get(p, 0) * scale[side], before) + lm_score.PAIR_PRIOR * u) / (before + lm_score.PAIR_PRIOR))
        out.append(loss / len(pairs))
    return out


def test_losses_are_the_model_s(spark):
    rng = random.Random(11)
    texts = {i: " ".join(f"{'t' if i % 3 == 0 else 'b'}{rng.randint(0, 60)}" for _ in range(rng.randint(1, 80))) for i in range(40)}
    target = {i for i in texts if i % 3 == 0}
    ids = spark.createDataFrame([(i, 1) for i in target] + [(0, 1), (None, 1)], "doc_id long, text int")
    rows = lm_score.cross_entropy_difference(docs(spark, [(i, t, None) for i, t in texts.items()]).repartition(3), ids).collect()
    assert len(rows) == 40
    for r in rows:
        want = slow_losses(texts, target, r.doc_id)
        assert r.of_target == (r.doc_id in target) and (r.target_loss, r.background_loss) == pytest.approx(tuple(want), rel=1e-4)
    mean = lambda of: np.mean([r.difference for r in rows if r.of_target == of])
    assert mean(True) < mean(False)


def test_scores_odd_rows(spark):
    rows = lm_score.cross_entropy_difference(docs(spark, ODD), spark.createDataFrame([(4,)], "doc_id long")).collect()
    assert len(rows) == len(ODD)
    assert all((r.difference is None) == (r.n_words == 0) for r in rows)
    assert lm_score.cross_entropy_difference(docs(spark, []), spark.createDataFrame([], "doc_id long")).count() == 0
    assert lm_score.cross_entropy_difference(docs(spark, ODD), spark.createDataFrame([], "doc_id long")).filter(F.isnan("difference")).count() == 0


def test_no_words_or_pairs_share_counts(spark, monkeypatch):
    """More distinct words than 2^16 and pairs than 2^20 would leave apart; cut into several lots and slices."""
    monkeypatch.setattr(lm_score, "SLICE_BYTES", 1 << 20)
    rng = random.Random(12)
    texts = {i: " ".join(f"{rng.randint(0, 10**6):x}" for _ in range(3000)) for i in range(100)}
    texts[100] = "never seen before"
    ids = {w: keys_of(w)[1] for t in texts.values() for w in t.split()}
    assert len(set(ids.values())) == len(ids) > 200_000
    target = spark.createDataFrame([(i,) for i in range(0, 100, 3)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs(spark, [(i, t, None) for i, t in texts.items()]).repartition(3), target).collect()}
    n = [sum(3001 if i < 100 else 4 for i in texts if (i % 3 == 0 and i < 100) == side) for side in (False, True)]
    least = min(n)
    vocabulary = len(ids) + 1
    for k, side in enumerate(("background_loss", "target_loss")):
        unseen = lm_score.UNIGRAM_PRIOR * 0.1 / (sum(n) - 4 + 0.1 * vocabulary) / ((n[k] - (0 if k else 4)) * least / n[k] + lm_score.UNIGRAM_PRIOR)
        start = (n[k] // 3001) * least / n[k]
        want = -(math.log(lm_score.PAIR_PRIOR * unseen / (start + lm_score.PAIR_PRIOR)) + 2 * math.log(unseen)) / 3
        assert got[100][side] == pytest.approx(want, rel=1e-6)


def test_copies_don_t_teach_the_models_that_score_them(spark):
    """A document scores as if its copies, of whichever side, weren't there; one that has none meets them all."""
    rng = random.Random(17)
    texts = {i: " ".join(f"{'t' if i % 3 == 0 else 'b'}{rng.randint(0, 60)}" for _ in range(rng.randint(5, 80))) for i in range(30)}
    target = [i for i in texts if i % 3 == 0]
    copies = {100: 7, 101: 7, 102: 7, 103: 7, 104: 7, 105: 9, 106: 9}  # of a background text three in the target and two outside; of a target text one on either side
    more = target + [100, 101, 102, 105]

    def scores(rows, ids):
        of = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        return {r.doc_id: r for r in lm_score.cross_entropy_difference(docs(spark, rows).repartition(3), of).collect()}

    plain = scores([(i, t, None) for i, t in texts.items()], target)
    every = scores([(i, t, None) for i, t in texts.items()] + [(i, texts[k], None) for i, k in copies.items()] + [(200, None, None), (201, "", None), (202, "", None)], more)
    # What is copied besides is in the models, so each is held against a corpus with the other's copies only.
    others = {7: [(i, texts[9], None) for i in (105, 106)], 9: [(i, texts[7], None) for i in range(100, 105)]}
    for i in (7, 9):
        plain[i] = scores([(k, t, None) for k, t in texts.items()] + others[i], more)[i]
        assert (every[i].target_loss, every[i].background_loss) == pytest.approx((plain[i].target_loss, plain[i].background_loss), abs=1e-9)
    # A copy on the other side scores as its text would there, alone: what other texts are copied is the same in both.
    alone = scores([(i, t, None) for i, t in texts.items() if i != 7] + [(100, texts[7], None)] + [(i, texts[9], None) for i in (105, 106)], [*target, 100, 105])
    assert every[100].of_target and every[103].difference == every[104].difference and alone[100].difference == pytest.approx(every[100].difference, abs=1e-9)
    assert every[1].difference != pytest.approx(plain[1].difference, abs=1e-9) and every[202].difference is None
