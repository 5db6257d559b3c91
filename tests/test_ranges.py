"""JSON arrays and CSV files read in ranges, against the standard library over whole files."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from safelens.operators import sampling as W
from safelens.sources import ranges as R
from safelens.sources import readers as S


def cut_in_ranges(text, kind, rng):
    """What the two passes make of a text that is dealt out in ranges of whole pieces, without Spark."""
    pieces = text.split(kind.separator)
    if pieces[-1] == "":
        pieces.pop()
    cuts = sorted(rng.randrange(len(pieces) + 1) for _ in range(rng.randint(0, 6)))
    blocks = [b for b in (pieces[a:b] for a, b in zip([0, *cuts], [*cuts, len(pieces)], strict=True)) if b]
    state, out, chain = kind.first, [], None
    for block in blocks:
        effects = {}
        for start in kind.starts:
            effect = kind.begun(start)
            for piece in block:
                effect = kind.stepped(effect, piece)
            effects[start] = kind.told(effect)
        for record, _, goes_on in kind.records(iter(block), state):
            if chain is None:
                out.append(record)
            else:
                out[-1] += kind.glue + record
            chain = True if goes_on else None
        state = kind.after(state, effects)
    assert kind.finished(state)
    return out


def some_json(rng, depth=0):
    k = rng.randint(0, 9 if depth < 3 else 4)
    if k < 5:
        return [rng.randint(-9, 9), None, True, rng.choice(['"rows": [', "a}b", "\\", '\\"}', "[{", "é\n", "", '{"rows":[']), 1.5][k]
    if k < 7:
        return [some_json(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["rows", "a", "}", '"']): some_json(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def some_file(rng):
    rows = [some_json(rng, 1) if rng.random() < 0.3 else {"text": some_json(rng, 2), "n": i} for i in range(rng.randint(0, 12))]
    dump = lambda x: json.dumps(x, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
    if rng.random() < 0.5:
        return rows, dump(rows) + rng.choice(["", "\n"])
    data = {k: some_json(rng, 1) for k in ("meta", "x}") if rng.random() < 0.6}
    data |= {"rows": rows} if rng.random() < 0.9 else {}
    data |= {"after": some_json(rng, 1)} if rng.random() < 0.5 else {}
    return data.get("rows", []), dump(data) + rng.choice(["", "\n"])


def test_elements_of_json_in_any_ranges():
    rng = random.Random(1)
    for _ in range(3000):
        rows, text = some_file(rng)
        got = [x for record in cut_in_ranges(text, R.JsonArray(), rng) if record.strip(" \n,") for x in json.loads(f"[{record.strip(' \n,')}]")]
        assert got == rows, text


def some_csv(rng, after_quotes=True):
    cell = lambda: rng.choice(["a", "", "two words", 'q"q', '"', ",", "x\ny", "\n", '",\n"', 'end"\n', "é"])
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    writer.writerow(["text", 'la"bel', "n\nm"])
    for i in range(rng.randint(0, 12)):
        writer.writerow([cell(), cell(), i])
    return out.getvalue() + rng.choice(["", 'stray " quote,5" pipe,1\n', '"closed" after,b,2\n"x",y,3' if after_quotes else "a,b"])


def test_records_of_csv_in_any_ranges():
    rng = random.Random(2)
    for _ in range(3000):
        text = some_csv(rng)
        got = [next(csv.reader(io.StringIO(r + "\n", newline=""))) for r in cut_in_ranges(text, R.CsvRecords(), rng)]
        assert got == list(csv.reader(io.StringIO(text, newline=""))), text


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "8"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plain(df):
    return [json.loads(r.v) for r in df.orderBy("ord").select(F.to_json("row").alias("v")).collect()]


def test_json_files_in_ranges(spark, tmp_path, small_splits):
    rng = random.Random(3)
    (tmp_path / "a.json").mkdir()
    want = []
    for i in range(6):
        rows, text = some_file(rng)
        want += rows
        (tmp_path / "a.json" / f"part-{i}.json").write_text(text, encoding="utf-8")
    big = {"rows": [{"text": f"{i} }}{{ \" [ \\", "deep": [[{"a": i}], "]"]} for i in range(60)], "n": 1}
    (tmp_path / "b.json").write_text(json.dumps(big, indent=1))
    read = S.read_rows(spark, str(tmp_path / "b.json"))
    assert plain(read) == big["rows"] and read.select("ord.block").distinct().count() > 10
    assert plain(S.read_rows(spark, str(tmp_path / "a.json"))) == want
    (tmp_path / "c.json").write_text('[{"text": "a"}, {"text": "b"')
    with pytest.raises(Exception, match="ends within a record"):
        S.read_rows(spark, str(tmp_path / "c.json")).collect()
    (tmp_path / "d.json").write_text('[{"text": "a"}, {"text": broken}, {"text": "c"}]')
    with pytest.raises(Exception, match="broken"):
        S.read_rows(spark, str(tmp_path / "d.json")).collect()
    assert plain(S.read_rows(spark, str(tmp_path / "d.json"), strict=False)) == [{"text": "a"}, {"text": "c"}]
    for name, text in (("e.json", '{"other": [1]}'), ("f.json", "[]"), ("g.json", "")):
        (tmp_path / name).write_text(text)
        assert plain(S.read_rows(spark, str(tmp_path / name))) == []


def test_csv_files_in_ranges(spark, tmp_path, small_splits):
    rng = random.Random(4)
    (tmp_path / "a.csv").mkdir()
    want = []
    for i in range(5):
        text = some_csv(rng, after_quotes=False)  # Spark keeps such quotes, the standard library drops them
        (tmp_path / "a.csv" / f"part-{i}.csv").write_text(text, encoding="utf-8", newline="")
        want += list(csv.DictReader(io.StringIO(text, newline=""), restval=""))
    read = S.read_rows(spark, str(tmp_path / "a.csv"))
    assert [{k: v for k, v in r.items() if k} for r in plain(read)] == [{k: v for k, v in r.items() if k} for r in want]
    (tmp_path / "b.csv").write_text('text,label\n"' + "line\n" * 100 + '",toxic\n\n\nlast,' + "x" * 100)
    assert plain(S.read_rows(spark, str(tmp_path / "b.csv"))) == [{"text": "line\n" * 100, "label": "toxic"}, {"text": "last", "label": "x" * 100}]


def test_folders_are_read_in_file_order(spark, tmp_path, small_splits):
    """Spark deals out the largest parts first; rows are still in the order of paths, ranges and lines."""
    (tmp_path / "a.jsonl").mkdir()
    n, want = 0, []
    for part, rows in enumerate((3, 300, 40)):
        lines = [{"text": f"t{(n + i) % 50}", "id": n + i} for i in range(rows)]
        n += rows
        want += lines
        (tmp_path / "a.jsonl" / f"part-{part}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in lines))
    read = S.read_rows(spark, str(tmp_path / "a.jsonl"))
    assert plain(read) == want
    firsts = W.first_of_each(read.withColumn("text", F.expr("row:text::string")), F.col("text"), "ord").selectExpr("row:id::int AS id").collect()
    assert sorted(r.id for r in firsts) == list(range(50))


def test_quarantine_numbers_lines_of_their_file(spark, tmp_path, small_splits):
    (tmp_path / "a.jsonl").mkdir()
    for part in range(2):
        lines = ["{broken" if i % 40 == part else "" if i % 7 == 3 else '{"text": "x"}' for i in range(120)]
        (tmp_path / "a.jsonl" / f"part-{part}.jsonl").write_text("\n".join(lines))
    rows = S.quarantine(spark, str(tmp_path / "a.jsonl")).orderBy("ord").collect()
    assert [(r.ord.file[-7], r.line) for r in rows] == [(str(p), i + 1) for p in range(2) for i in range(120) if i % 40 == p]
