"""All-lag runs, WARC archives and vector codes against plain versions, and their odd rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from safelens.llm import periodic, vector_codes, warc

# --- periodic runs -------------------------------------------------------------------------------


def slow_runs(words):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if (length := j - i + q) >= max(12, 2 * q) and not any(words[i : i + length - r] == words[i + r : i + length] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_document(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and words:
        n, g = len(words), h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def some_texts(rng, n):
    for _ in range(n):
        words = [rng.choice("abcde")[: rng.randint(0, 1)] + rng.choice(["x", "y", "ż", " "]) for _ in range(rng.randint(0, 70))]
        if len(words) > 24:
            p = rng.randint(1, len(words) // 3)
            at = rng.randint(0, len(words) - 2 * p)
            for i in range(at + p, min(len(words), at + p * rng.randint(2, 6))):
                words[i] = words[i - p]
        yield rng.choice([" ", "\n", "\t \x0b"]).join(words)


@pytest.mark.parametrize("lot", [periodic.LOT, 300])
def test_runs_are_those_of_every_lag(spark, lot):
    rng = random.Random(lot)
    rows = list(enumerate(some_texts(rng, 120))) + [(1000, None), (1001, ""), (1002, " \n "), (None, "a b " * 20), (1003, "w " * 200), (1004, " ".join("ab"[i % 2] + "c" * (i % 3) for i in range(60)))]
    rows += rows[-2:]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, h string, start int, digest string")
    got = sorted(map(tuple, periodic.find_runs(docs, lot=lot).collect()), key=str)
    assert got == sorted((slow_document(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 40


def test_steps_and_ranges_of_lags_change_nothing(monkeypatch):
    rng = random.Random(3)
    ids = np.array([rng.randint(0, 3) for _ in range(900)], np.int32)
    ids[300:700] = np.tile(ids[300:340], 10)
    ids[100:160] = 1
    want = periodic.runs_of(periodic.stretches(ids)).tolist()
    assert [list(r) for r in slow_runs(ids.tolist())] == want and any(q == 40 for _, _, q in want)
    for step, cuts in ((50, [1, 7, 20, 300, 451]), (4000, [1, 451]), (1 << 19, [1, 2, 3, 451])):
        monkeypatch.setattr(periodic, "STEP", step)
        assert periodic.runs_of(np.concatenate([periodic.stretches(ids, a, b) for a, b in zip(cuts, cuts[1:], strict=False)])).tolist() == want


def test_no_documents_have_no_runs(spark):
    assert periodic.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- archives ------------------------------------------------------------------------------------

EVIL = "before WARC/1.1\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n after"


def slow_pages(rows, least=0):
    """Of repeated rows any may be the response, so rows are compared sorted."""
    groups, out = {}, []
    for i, (page_id, _, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((page_id is not None, page_id or 0, i))
    for payload, own in groups.items():
        digest, best = base64.b32encode(hashlib.sha1(payload).digest()).decode(), max(own)
        for there, page_id, i in own:
            again = (there, page_id, i) != best and len(payload) >= least
            out.append((page_id if there else None, len(payload), digest, "revisit" if again else "response", (best[1] if best[0] else None) if again else None))
    return sorted(out, key=str)


PAGES = [
    (1, "http://a", "xxxxx"), (2, "b\r\nWARC-Type: bad", "xxxxx"), (2, "b\r\nWARC-Type: bad", "xxxxx"), (2, "c", "xxxxx"), (None, None, None), (3, None, ""), (4, "u", EVIL), (5, "u", "é☃\r\n\r\nx"), (6, "u", "WARC/1.1\r\n"),
    (7, "v", "WARC/1.1\r\n"), (8, "v", EVIL), (9, "w", "\r\n\r\n"), (10, "w", "z" * 300_000), (11, "w", "z" * 300_000), (None, "q", "alone"), (None, "q", "alone"),
]


@pytest.mark.parametrize("least", [0, 10, 10**6])
def test_pages_come_back_from_archives(spark, least):
    pages = spark.createDataFrame([(*r, "x", "y") for r in PAGES], "page_id long, url string, html string, payload string, record_type string")
    assert sorted(map(tuple, warc.archived(pages, least).collect()), key=str) == slow_pages(PAGES, least)
    assert warc.archived(pages.limit(0)).collect() == []


def test_archives_hold_each_payload_once_and_read_back_in_any_split(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(2)
    records = warc.records_of(pages).withColumns({"payload_digest": warc.payload_digest(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    warc.write_archive(records, f"{tmp_path}/raw", "none")
    warc.deduplicated(spark, f"{tmp_path}/raw", f"{tmp_path}/out", compression="none")
    stored = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert stored.count(b"z" * 300_000) == 1 and stored.count(b"WARC-Type: revisit") == 8 and stored.startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert stored.count(warc.PROFILE.encode()) == 8 and b"\r\nWARC-Type: bad" not in stored
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted((r.page_id or -1, bytes(r.payload or b"-"), r.record_type) for r in warc.read_archive(spark, f"{tmp_path}/out").collect())
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        assert sorted((r.page_id or -1, bytes(r.payload or b"-"), r.record_type) for r in warc.read_archive(spark, f"{tmp_path}/out").collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_foreign_archives(spark, tmp_path):
    """Other record types stay, an archive's own revisits find the response that stays, those without one stay as they are."""
    block = lambda payload: f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = lambda payload: base64.b32encode(hashlib.sha1(payload).digest()).decode()

    def record(kind, i, body, more=(), http=True):
        lines = [f"warc-type: {kind}", f"WARC-Record-ID: <urn:uuid:{i}>", *more, *(["Content-Type: application/http; msgtype=response"] if http else []), f"Content-Length: {len(body)}"]
        return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    payload = b"\xff\x00binary\r\n\r\nWARC/1.1\r\n"
    seen = lambda p: [f"WARC-Payload-Digest: sha1:{digest(p)}"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(
        record("warcinfo", 0, b"software: x", http=False) + record("response", 1, block(payload) + payload, ["Page-Id: 5"]) + record("response", 2, block(payload) + payload, ["Page-Id: 9"])
        + record("revisit", 3, block(payload), [*seen(payload), "WARC-Refers-To: <urn:uuid:1>", "Page-Id: 12"]) + record("revisit", 4, block(b"gone"), [*seen(b"gone"), "WARC-Refers-To: <urn:uuid:77>", "Page-Id: 13"])
    )
    records = warc.read_archive(spark, f"{tmp_path}/in")
    rows = {r.record_id: r for r in warc.resolved(records).collect()}
    assert [rows[f"urn:uuid:{i}"].record_type for i in range(5)] == ["warcinfo", "revisit", "response", "revisit", "revisit"]
    assert [rows[f"urn:uuid:{i}"].refers_to for i in range(5)] == [None, "urn:uuid:2", None, "urn:uuid:2", "urn:uuid:77"]
    assert bytes(rows["urn:uuid:2"].payload) == payload and bytes(rows["urn:uuid:0"].payload) == b"software: x"
    found = {r.page_id: tuple(r)[1:] for r in warc.looked_up(warc.resolved(records)).filter("page_id IS NOT NULL").collect()}
    assert found[12] == found[5] == (len(payload), digest(payload), "revisit", 9) and found[13] == (4, digest(b"gone"), "revisit", None)


# --- vector codes --------------------------------------------------------------------------------


def slow_codes(rows, entries, rounds=4):
    """Plain Lloyd with Python's integers."""
    import math

    good = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    sizes = [len(v) for _, v, _ in good]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    good = [r for r in good if len(r[1]) == size]
    width = -(-size // 4)
    whole = lambda v: [max(-(1 << 25), min(1 << 25, math.floor(c * 1024))) for c in v] + [0] * (4 * width - size)
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[whole(v)[p * width : (p + 1) * width] for p in range(4)] for _, v, _ in good]
    books = [[v[p] for v in x[:entries]] for p in range(4)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    nearest = lambda: [[min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(4)] for v in x]
    for _ in range(rounds):
        codes = nearest()
        for p in range(4):
            for e in range(len(books[p])):
                if own := [v[p] for v, c in zip(x, codes, strict=True) if c[p] == e]:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = nearest()
    errors = [sum(far(v[p], books[p][c[p]]) for p in range(4)) for v, c in zip(x, codes, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    by = {}
    for (_, _, label), error in zip(good, errors, strict=True):
        by[label] = by.get(label, 0) + error
    return sorted([(i, "".join(f"{e:02x}" for e in c), error, by[label], digest) for (i, _, label), c, error in zip(good, codes, errors, strict=True)], key=str)


def vectors(rng, n, size, spread=3.0):
    return [(i, [rng.choice([-spread, 0.0, spread]) + rng.gauss(0, 0.2) for _ in range(size)], rng.choice([None, 0, 1])) for i in range(n)]


@pytest.mark.parametrize(("size", "entries", "block"), [(8, 5, 16), (8, 256, 8192), (10, 7, 33), (3, 1, 10)])
def test_codes_are_those_of_plain_rounds(spark, size, entries, block):
    rng = random.Random(size * entries)
    rows = vectors(rng, 150, size)
    rows += [(200, None, 1), (201, [float("nan")] * size, 1), (202, [None] * size, None), (203, [float("inf")] * size, 1), (204, [], 2), (205, [1.0], 2), (0, [9.0] * size, 3), (0, [0.0] * size, 3), (None, [1.0] * size, None)]
    rows += rows[3:5] * 4
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, error string, part int")
    got = vector_codes.encode(df, entries=entries, block=block)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == slow_codes(rows, entries)


def test_large_components_and_ties(spark):
    rows = [(i, [float(x)] * 4, i % 2) for i, x in enumerate([1e30, -1e30, 30000.5, -30000.5, 0, 0, 2, 1, 1, 1, 1e5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, vector_codes.encode(df, entries=4).collect()), key=str) == slow_codes(rows, 4)


def test_no_vectors_have_no_codes(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.encode(df).collect() == [] and vector_codes.encode(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vector_codes.encode(df, entries=257)


def test_only_overtaken_parts_are_measured_again():
    rng = np.random.default_rng(5)
    x = vector_codes.parted(np.repeat(rng.integers(-9000, 9000, (6, 8)), 50, axis=0) + rng.integers(-40, 40, (300, 8)))
    books, drift = x[:, ::50].copy(), np.zeros((4, 6))
    entry, key, heap = np.full((4, 300), -1), np.zeros((4, 300)), np.tile(np.arange(300), (4, 1))
    entry, key, heap, first = vector_codes.advanced(x, entry, key, heap, books, drift)
    sums = np.zeros((4, 6, 3), np.int64)
    for p, e, j, c in vector_codes.moved_sums(x, np.full((4, 300), -1), entry, 6):
        sums[p, e, j + 1] += c
    books, grown = vector_codes.stepped(books, sums[..., 0], sums[..., 1:])
    _, _, _, again = vector_codes.advanced(x, entry, key, heap, books, drift + grown)
    assert first == 1200 and again < 300  # well parted groups: nearly all keys hold
    assert sorted(vector_codes.popped(heap[0], entry[0], key[0], np.full(6, key[0][7]))) == sorted(np.flatnonzero(key[0] <= key[0][7]))
