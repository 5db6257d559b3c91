"""Files whose records don't end where lines end, read in many tasks: JSON arrays, and CSV with line ends inside quotes.

Spark's text source cuts a file into pieces (at ``}`` or at line ends) and deals out byte ranges of it. What a piece means depends on all that
stands before it, but only by a small state: inside a string or not, and which brackets are open. So a first pass runs each range from every state
that it could begin in, the ranges' results are put together in file order, and a second pass, its start known, cuts records. Only records that lie
across ranges are shuffled.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where a row stands: rows of a path are in the order of this struct, however Spark deals out files and ranges.
ORD = "struct<file:string,block:bigint,place:bigint,part:int>"


def place() -> Column:
    """``ord`` of the rows of a file source. Ids rise within a range; which task has which range says nothing, so ranges go by path and start."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.lit(0).alias("part"))


def numbered(rows: DataFrame, name: str = "number") -> DataFrame:
    """Add gapless numbers from 0 within each file, in the order of ``ord``.

    ``rows`` must be all rows of a source, before any filter. Rows of a range are counted, not sorted.
    """
    counted = rows.groupBy(F.col("ord.file").alias("__file"), F.col("ord.block").alias("__block")).agg(F.count(F.lit(1)).alias("__n"), F.min("ord.place").alias("__least"))
    before = F.sum("__n").over(Window.partitionBy("__file").orderBy("__block")) - F.col("__n")
    offsets = counted.select("__file", "__block", "__least", before.alias("__before"))
    out = rows.join(offsets, (F.col("ord.file") == F.col("__file")) & (F.col("ord.block") == F.col("__block")))
    return out.withColumn(name, F.col("__before") + F.col("ord.place") - F.col("__least")).drop(*offsets.columns)


# --- JSON: what a piece does -----------------------------------------------------------------------

_STRING = r'(?:[^"\\]|\\.)*(?P<end>"|\Z)'
_TOKEN = re.compile(rf'(?P<rows>"rows"\s*:\s*\[)|"{_STRING}|(?P<bracket>[\[\]{{}}])', re.DOTALL)
_REST = re.compile(_STRING, re.DOTALL)


def tokens(piece: str, inside: bool) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end) of the brackets outside strings, R for the array that follows a key "rows"; last, s or an empty kind: inside a string or not."""
    at = 0
    if inside:
        rest = _REST.match(piece)
        if not rest["end"]:
            yield "s", 0, 0
            return
        at = rest.end()
    for m in _TOKEN.finditer(piece, at):
        if kind := m["bracket"] or (m["rows"] and "R"):
            yield kind, m.start(), m.end()
        elif not m["end"]:
            yield "s", 0, 0
            return
    yield "", 0, 0


class JsonArray:
    """Elements of a top-level array, or of the array ``rows`` of a top-level object. Pieces end before ``}``."""

    separator, glue = "}", ""
    starts = ("", "s")  # outside a string, or inside one
    first = ":"
    header = False

    def begun(self, start: str) -> tuple:
        return start == "s", 0, ""

    def stepped(self, effect: tuple, piece: str) -> tuple:
        """What a range does, one piece further: inside a string, how many brackets it closes that were open before, and those it leaves open."""
        inside, closed, opened = effect
        *found, (string, _, _) = tokens(piece, inside)
        for kind in [k for k, _, _ in found] + ([] if string else ["}"]):
            if kind not in "]}":
                opened += kind
            elif opened:
                opened = opened[:-1]
            else:
                closed += 1
        return string == "s", closed, opened

    def told(self, effect: tuple) -> str:
        return f"{'s' if effect[0] else ''},{effect[1]},{effect[2]}"

    def after(self, state: str, effects: dict[str, str]) -> str:
        """States are ``s`` if inside a string, a colon, and the brackets that are open."""
        string, stack = state.split(":")
        inside, closed, opened = effects[string].split(",")
        kept = stack[: max(0, len(stack) - int(closed))]
        return f"{inside}:{kept}{opened}"

    def finished(self, state: str) -> bool:
        return state == ":"

    def records(self, pieces: Iterable[str], state: str) -> Iterator[tuple[str, bool, bool]]:
        """(text, begun before, goes on): what stands between one element that is an object and the next, in the array that is read."""
        string, stack = state.split(":")
        inside, stack = string == "s", list(stack)
        reading = lambda: stack == ["["] or stack == ["{", "R"]
        within = lambda: stack[:1] == ["["] or stack[:2] == ["{", "R"]
        held: list[str] = []
        before = within()
        for piece in pieces:
            begin = 0
            for kind, first, last in tokens(piece, inside):
                if kind in ("s", ""):
                    inside = kind == "s"
                elif kind in "]}":
                    if reading():  # the array ends here
                        yield "".join([*held, piece[begin:first]]), before, False
                        held, before = [], False
                    if stack:
                        stack.pop()
                else:
                    stack.append(kind)
                    if reading():
                        begin = last
            if within():
                held.append(piece[begin:] + "}")
            if not inside:
                if stack:
                    stack.pop()
                if reading():
                    yield "".join(held), before, False
                    held, before = [], False
        if within() and (held or before):
            yield "".join(held), before, True


# --- CSV: what a line does -------------------------------------------------------------------------


class CsvRecords:
    """Records of a CSV file with comma, double quote, and doubled quotes inside quotes. Pieces end before line ends."""

    separator = glue = "\n"
    starts = ("", "s")  # outside quotes, or inside
    first = ""
    header = True

    def _line(self, line: str, inside: bool) -> bool:
        """Inside quotes or not at the end of a line. A quote opens only at the begin of a cell; elsewhere it is a character."""
        at, cell = 0, not inside
        while True:
            if inside:
                at = line.find('"', at)
                if at < 0:
                    return True
                if line.startswith('""', at):
                    at += 2
                    continue
                inside, at = False, at + 1
            elif cell and line.startswith('"', at):
                inside, cell, at = True, False, at + 1
            else:
                cell, at = False, line.find(',"', at)
                if at < 0:
                    return False
                inside, at = True, at + 2

    def begun(self, start: str) -> bool:
        return start == "s"

    def stepped(self, effect: bool, piece: str) -> bool:
        return self._line(piece, effect) if '"' in piece else effect

    def told(self, effect: bool) -> str:
        return "s" if effect else ""

    def after(self, state: str, effects: dict[str, str]) -> str:
        return effects[state]

    def finished(self, state: str) -> bool:
        return True  # an open quote at the end of a file ends there

    def records(self, pieces: Iterable[str], state: str) -> Iterator[tuple[str, bool, bool]]:
        inside = before = state == "s"
        held: list[str] = []
        for piece in pieces:
            held.append(piece)
            inside = self.stepped(inside, piece)
            if not inside:
                yield "\n".join(held), before, False
                held, before = [], False
        if held:
            yield "\n".join(held), before, True


# --- both ------------------------------------------------------------------------------------------


def _by_range(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(values of the columns, pieces) of each range of a task, which holds ranges whole and in order."""
    rows = ((keys, v) for batch in batches for *keys, v in zip(*[batch[c] for c in columns], batch.value, strict=True))
    for keys, own in itertools.groupby(rows, key=lambda r: r[0]):
        yield tuple(keys), (v for _, v in own)


def cut_records(spark: SparkSession, path: str, kind: JsonArray | CsvRecords, strict: bool = True) -> DataFrame:
    """(ord, text): the records of all files of a path, without those that are a file's header. With ``strict`` a file that ends within one raises."""
    text = spark.read.option("lineSep", kind.separator).text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, block), own in _by_range(batches, "file", "block"):
            effects = {s: kind.begun(s) for s in kind.starts}
            for piece in own:
                effects = {s: kind.stepped(e, piece) for s, e in effects.items()}
            yield pd.DataFrame({"of": [file], "at": [block], "effects": [{s: kind.told(e) for s, e in effects.items()}]})

    def joined(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks, states = blocks.sort_values("at"), [kind.first]
        for effects in blocks["effects"]:
            states.append(kind.after(states[-1], dict(effects)))
        if strict and not kind.finished(states[-1]):
            raise ValueError(f"{blocks['of'].iat[0]} ends within a record")
        return blocks.assign(state=states[:-1])[["of", "at", "state"]]

    effects = pieces.mapInPandas(run, "of string, at long, effects map<string,string>")
    states = effects.groupBy("of").applyInPandas(joined, "of string, at long, state string")

    def cut(fragments: bool) -> DataFrame:
        def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for (file, block, state), own in _by_range(batches, "file", "block", "state"):
                lead, out = kind.header and block == 0, []
                for i, (record, before, goes_on) in enumerate(kind.records(own, state)):
                    lead, is_header = lead and not record.strip(), lead and record.strip() != ""
                    if (before or goes_on) == fragments and not (is_header and not fragments):
                        out.append((file, block, i, record, before, goes_on, is_header))
                    if len(out) == 4096:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                yield pd.DataFrame(out, columns=names)

        # A row for each range of a file: small beside the files, and a broadcast leaves the pieces in their order.
        here = pieces.join(F.broadcast(states), (F.col("file") == F.col("of")) & (F.col("block") == F.col("at")))
        return here.select("file", "block", "state", "value").mapInPandas(of_task, "file string, block long, place long, text string, before boolean, goes_on boolean, lead boolean")

    names = ["file", "block", "place", "text", "before", "goes_on", "lead"]
    in_file = Window.partitionBy("file").orderBy("block", "place")
    chained = cut(fragments=True).withColumn("begins", F.when(F.coalesce(F.lag("goes_on").over(in_file), F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("begins").over(in_file))
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "text")))
    across = chained.groupBy("file", "chain").agg(parts.alias("parts"), F.max("lead").alias("lead")).filter("NOT lead")
    across = across.select("file", "parts", F.array_join(F.transform("parts", lambda p: p["text"]), kind.glue).alias("text"))
    at = lambda *c: F.struct("file", *[F.col(x).alias(x.split(".")[-1]) for x in c], F.lit(0).alias("part")).alias("ord")
    across = across.withColumn("p", F.element_at("parts", 1)).select(at("p.block", "p.place"), "text")
    return cut(fragments=False).select(at("block", "place"), "text").unionByName(across)


def json_rows(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(ord, row VARIANT): the elements of JSON files that are an array, or an object whose ``rows`` is one; other objects have none."""
    parse = F.parse_json if strict else F.try_parse_json
    cut = cut_records(spark, path, JsonArray(), strict).withColumn("text", F.regexp_replace("text", r"^[\s,]+|[\s,]+$", "")).filter("text <> ''")
    each = cut.select("ord", parse(F.concat(F.lit("["), F.col("text"), F.lit("]"))).alias("v")).filter("v IS NOT NULL").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return each.select(F.struct("ord.file", "ord.block", "ord.place", F.col("pos").cast("int").alias("part")).alias("ord"), F.col("value").alias("row"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(ord, row VARIANT) of CSV files with a header each: all cells are strings, and an empty cell is an empty string, so that a column that exists counts as given."""
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    cut = cut_records(spark, path, CsvRecords()).withColumn("text", F.regexp_replace("text", "\r$", "")).filter("text <> ''")
    cells = cut.select("ord", F.from_csv("text", ddl, {"escape": '"', "multiLine": "true"}).alias("c"))
    filled = F.struct(*[F.coalesce(F.col("c").getField(n), F.lit("")).alias(n) for n in names])
    return cells.select("ord", F.parse_json(F.to_json(filled)).alias("row"))
