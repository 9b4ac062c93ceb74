"""Workbooks (``.xlsx``) as tables, read file by file.

``path`` is whatever Spark's ``binaryFile`` reader takes: a file, a folder or a pattern. Shared
strings are a table of their own that cells join, so no task holds those of another workbook.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..values import CELL_TYPE

# Fixed names of the package format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE_LINK = "http://schemas.openxmlformats.org/package/2006/relationships"
_MAIN, _LINK, _RELATION = f"{{{MAIN}}}", f"{{{LINK}}}", f"{{{PACKAGE_LINK}}}Relationship"

_BATCH = 5000


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"(?i)\.xlsx$")).select("path", "content")


def _scan(rows: DataFrame, read: Callable[..., Iterator[tuple]], schema: str, kinds: list[tuple[str, pa.DataType]]) -> DataFrame:
    """What ``read`` makes of each row, a dictionary with an open archive as ``archive``."""
    out = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                with zipfile.ZipFile(io.BytesIO(row.pop("content"))) as row["archive"]:
                    for found in read(**row):
                        held.append(found)
                        if len(held) >= _BATCH:
                            yield pa.RecordBatch.from_pylist([dict(zip(out.names, x, strict=True)) for x in held], schema=out)
                            held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, x, strict=True)) for x in held], schema=out)

    return rows.mapInArrow(run, schema)


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Kind and target part of each relationship of ``part``, by id; none if it has no such list."""
    folder, name = posixpath.split(part)
    try:
        data = archive.read(posixpath.join(folder, "_rels", name + ".rels"))
    except KeyError:
        return {}
    out = {}
    for r in ElementTree.fromstring(data).iter(_RELATION):
        target = r.get("Target", "")
        place = target if r.get("TargetMode") == "External" else target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], place)
    return out


def _workbook_part(archive: zipfile.ZipFile) -> str:
    found = [target for kind, target in _relations(archive, "").values() if kind == "officeDocument"]
    return found[0] if found else "xl/workbook.xml"


def listed_sheets(archive: zipfile.ZipFile) -> list[tuple[int, str, str, str | None]]:
    """Position, name, state and part of each sheet."""
    book = _workbook_part(archive)
    links = _relations(archive, book)
    listed = ElementTree.fromstring(archive.read(book)).iter(_MAIN + "sheet")
    return [(i, s.get("name", ""), s.get("state", "visible"), links.get(s.get(_LINK + "id", ""), (None, None))[1]) for i, s in enumerate(listed, 1)]


def relationships(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``part``, ``id``, ``kind``, ``target``: of the workbook, its sheets and their drawings."""

    def read(path, archive):
        for name in archive.namelist():
            folder, file = posixpath.split(name)
            if file.endswith(".rels") and posixpath.basename(folder) == "_rels":
                part = posixpath.join(posixpath.dirname(folder), file.removesuffix(".rels"))
                for key, (kind, target) in _relations(archive, part).items():
                    yield path, part, key, kind, target

    names = ["path", "part", "id", "kind", "target"]
    return _scan(_files(spark, path), read, ", ".join(f"{c} string" for c in names), [(c, pa.string()) for c in names])


def sheet_list(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``position`` (from 1), ``sheet``, ``state``, ``part`` of each sheet."""

    def read(path, archive):
        for position, *rest in listed_sheets(archive):
            yield path, position, *rest

    return _scan(_files(spark, path), read, "path string, position int, sheet string, state string, part string", [("path", pa.string()), ("position", pa.int32()), ("sheet", pa.string()), ("state", pa.string()), ("part", pa.string())])


_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def _plain_text(item: ElementTree.Element) -> str:
    """The text of a string item, its runs put together; phonetic runs don't count. _xHHHH_ stands for a
    character that XML can't hold."""
    return _shown("".join(t.text or "" for x in item if x.tag in (_MAIN + "t", _MAIN + "r") for t in x.iter(_MAIN + "t")))


def _shown(text: str | None) -> str | None:
    return text and _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


def read_strings(archive: zipfile.ZipFile) -> Iterator[str]:
    """Shared strings in their order; none where the workbook names no part for them, or a missing one."""
    parts = [target for kind, target in _relations(archive, _workbook_part(archive)).values() if kind == "sharedStrings"]
    for part in parts[:1]:
        if part not in archive.namelist():
            return
        with archive.open(part) as data:
            for _, item in ElementTree.iterparse(data):
                if item.tag == _MAIN + "si":
                    yield _plain_text(item)
                    item.clear()


def shared_strings(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``idx`` (from 0), ``text``."""

    def read(path, archive):
        for idx, text in enumerate(read_strings(archive)):
            yield path, idx, text

    return _scan(_files(spark, path), read, "path string, idx long, text string", [("path", pa.string()), ("idx", pa.int64()), ("text", pa.string())])


def _place(ref: str) -> tuple[int, int]:
    """Row and column, from 1, of a reference as A1."""
    letters, digits = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters.upper():
        col = col * 26 + ord(c) - 64
    return int(digits), col


def _in_sheets(read: Callable[..., Iterator[tuple]]) -> Callable[..., Iterator[tuple]]:
    """``read(archive, part)`` for every sheet of a file in turn, its rows after path and sheet. Nothing
    is shuffled; ``workbooks`` reads large files by a task a sheet."""

    def rows(path, archive):
        names = set(archive.namelist())
        for _, sheet, _, part in listed_sheets(archive):
            for found in read(archive, part) if part in names else ():
                yield path, sheet, *found

    return rows


def scan_cells(archive: zipfile.ZipFile, part: str) -> Iterator[tuple]:
    """Row, column, kind, stored text, formula, its share and range, and style of each cell of a sheet."""
    row = col = 0
    with archive.open(part) as data:
        for event, x in ElementTree.iterparse(data, events=("start", "end")):
            if event == "start" and x.tag == _MAIN + "row":
                row, col = int(x.get("r", row + 1)), 0
            elif event == "end" and x.tag == _MAIN + "c":
                row, col = _place(x.get("r")) if x.get("r") else (row, col + 1)
                f, inline = x.find(_MAIN + "f"), x.find(_MAIN + "is")
                text = _plain_text(inline) if inline is not None else x.findtext(_MAIN + "v")
                if x.get("t") == "str":
                    text = _shown(text)
                share = (None, None) if f is None else (f.get("si"), f.get("ref"))
                yield row, col, x.get("t", "n"), text, None if f is None else _shown(f.text), *share, int(x.get("s", 0))
            elif event == "end" and x.tag == _MAIN + "row":
                x.clear()


def _raw_cells(spark: SparkSession, path: str) -> DataFrame:
    kinds = [("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("t", pa.string()), ("raw", pa.string()), ("formula", pa.string()), ("shared", pa.string()), ("shared_ref", pa.string()), ("style", pa.int32())]
    schema = "path string, sheet string, row int, col int, t string, raw string, formula string, shared string, shared_ref string, style int"
    return _scan(_files(spark, path), _in_sheets(scan_cells), schema, kinds)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``sheet``, ``row``, ``col``, ``v`` (a tagged cell, cached results of formulas
    included), ``formula``, ``shared`` and ``shared_ref`` (of a formula that several cells share) and
    ``style`` of every cell that is written in a sheet.

    Cells without a reference follow the one before. A file that is no archive raises.
    """
    raw = _raw_cells(spark, path)
    strings = shared_strings(spark, path).select(F.col("path").alias("_path"), F.col("idx").alias("_idx"), F.col("text").alias("_text"))
    at = F.when(F.col("t") == "s", F.col("raw").try_cast("long"))
    named = raw.join(strings, (F.col("path") == F.col("_path")) & (at == F.col("_idx")), "left")
    t = F.col("t")
    text = F.when(t == "s", F.col("_text")).when(t.isin("str", "inlineStr", "d"), F.col("raw"))
    # a cached result of a formula without a value shows as empty text
    tag = F.when(t == "e", "e").when(t == "b", "b").when(text.isNotNull(), "s").when((t == "n") & F.col("raw").isNotNull(), "n").otherwise("empty")
    value = F.struct(
        tag.alias("t"),
        F.when(tag == "n", F.col("raw").try_cast("double")).alias("n"),
        F.when(tag == "s", text).alias("s"),
        F.when(tag == "b", F.col("raw") == "1").alias("b"),
        F.when(tag == "e", F.col("raw")).alias("e"),
    )
    return named.select("path", "sheet", "row", "col", value.cast(CELL_TYPE).alias("v"), "formula", "shared", "shared_ref", "style")


def merged_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``sheet``, ``r1``, ``c1``, ``r2``, ``c2`` of merged cells, as ``grid.unmerged`` takes them."""

    def read(archive, part):
        with archive.open(part) as data:
            for _, x in ElementTree.iterparse(data):
                if x.tag == _MAIN + "mergeCell":
                    first, _, last = x.get("ref").partition(":")
                    yield *_place(first), *_place(last or first)
                elif x.tag == _MAIN + "row":
                    x.clear()

    kinds = [("path", pa.string()), ("sheet", pa.string()), *((c, pa.int32()) for c in ("r1", "c1", "r2", "c2"))]
    return _scan(_files(spark, path), _in_sheets(read), "path string, sheet string, r1 int, c1 int, r2 int, c2 int", kinds)


def column_styles(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``sheet``, ``first``, ``last`` (columns), ``width``, ``hidden``, ``style``."""

    def read(archive, part):
        with archive.open(part) as data:
            for _, x in ElementTree.iterparse(data):
                if x.tag == _MAIN + "col":
                    yield int(x.get("min")), int(x.get("max")), float(x.get("width")) if x.get("width") else None, x.get("hidden") in ("1", "true"), int(x.get("style", 0))
                elif x.tag == _MAIN + "sheetData":
                    break

    kinds = [("path", pa.string()), ("sheet", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("width", pa.float64()), ("hidden", pa.bool_()), ("style", pa.int32())]
    return _scan(_files(spark, path), _in_sheets(read), "path string, sheet string, first int, last int, width double, hidden boolean, style int", kinds)


#: A constant of a rule's formula: a number, a text in quotes, or a logical value.
_CONSTANT = re.compile(r'=?\s*(?:(?P<plain>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|TRUE|FALSE)|"(?P<text>(?:[^"]|"")*)")\s*', re.IGNORECASE)


def _constant(formula: str | None) -> str | None:
    m = _CONSTANT.fullmatch(formula or "")
    return None if m is None else m["plain"] or m["text"].replace('""', '"')


def _number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


_RULE_TEXTS, _RULE_FLAGS = ("rule", "kind", "style", "operator", "v1", "v2"), ("stop_if_true", "percent", "bottom", "below", "equal")


def conditional_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of conditional formats as ``operators.rule_tables`` takes them, with ``path``, ``sheet``,
    ``formulas`` (as they are stated) and ``areas`` (r1, c1, r2, c2 of each target; ``rule_targets``).

    ``rule`` is the sheet's name and the rule's number in it, ``style`` the number of a
    differential style. Values are constants; a formula that is none leaves them null.
    """

    def read(archive, part):
        count = 0
        with archive.open(part) as data:
            for _, x in ElementTree.iterparse(data):
                if x.tag == _MAIN + "row":
                    x.clear()
                elif x.tag == _MAIN + "conditionalFormatting":
                    areas = []
                    for area in (x.get("sqref") or "").split():
                        first, _, last = area.partition(":")
                        (r1, c1), (r2, c2) = _place(first), _place(last or first)
                        areas.append({"r1": min(r1, r2), "c1": min(c1, c2), "r2": max(r1, r2), "c2": max(c1, c2)})
                    for r in x.findall(_MAIN + "cfRule"):
                        count += 1
                        yield _rule(r, count, areas)

    texts, flags = [(c, pa.string()) for c in _RULE_TEXTS], [(c, pa.bool_()) for c in _RULE_FLAGS]
    area = pa.struct([(c, pa.int32()) for c in ("r1", "c1", "r2", "c2")])
    stop = pa.struct([("kind", pa.string()), ("value", pa.float64()), ("over", pa.bool_())])
    kinds = [("path", pa.string()), ("sheet", pa.string()), *texts, *flags, ("priority", pa.int32()), ("rank", pa.int32()), ("stops", pa.list_(stop)), ("colors", pa.list_(pa.string())), ("formulas", pa.list_(pa.string())), ("areas", pa.list_(area))]
    schema = "path string, sheet string, " + ", ".join(f"{c} string" for c in _RULE_TEXTS) + ", " + ", ".join(f"{c} boolean" for c in _RULE_FLAGS)
    schema += ", priority int, rank int, stops array<struct<kind:string,value:double,over:boolean>>, colors array<string>, formulas array<string>, areas array<struct<r1:int,c1:int,r2:int,c2:int>>"
    found = _scan(_files(spark, path), _in_sheets(read), schema, kinds)
    return found.withColumn("rule", F.concat("sheet", F.lit("!"), "rule"))


def _rule(r: ElementTree.Element, number: int, areas: list[dict]) -> tuple:
    formulas = [f.text or "" for f in r.findall(_MAIN + "formula")]
    values = [_constant(f) for f in formulas[:2]] + [None, None]
    flag = lambda name, default="0": r.get(name, default) in ("1", "true")
    visual = next((v for v in (r.find(_MAIN + k) for k in ("colorScale", "dataBar", "iconSet")) if v is not None), None)
    stops = None if visual is None else [{"kind": v.get("type", "num"), "value": _number(v.get("val")), "over": v.get("gte") in ("0", "false")} for v in visual.findall(_MAIN + "cfvo")]
    colors = None if visual is None else [(c.get("rgb") or "")[-6:].upper() or None for c in visual.findall(_MAIN + "color")]
    whole = lambda name: int(r.get(name)) if (r.get(name) or "").lstrip("-").isdigit() else None
    style = None if r.get("dxfId") is None else r.get("dxfId")
    text = r.get("text")
    return (
        f"{number:06d}", r.get("type"), style, r.get("operator"), values[0] if text is None else text, values[1],
        flag("stopIfTrue"), flag("percent"), flag("bottom") or r.get("top") == "0", not flag("aboveAverage", "1"), flag("equalAverage"),
        whole("priority"), whole("rank"), stops, colors, formulas, areas,
    )


def rule_targets(rules: DataFrame) -> DataFrame:
    """``path``, ``rule``, ``sheet``, ``r1``, ``c1``, ``r2``, ``c2``: the targets of ``conditional_rules``."""
    return rules.select("path", "rule", "sheet", F.explode("areas").alias("_a")).select("path", "rule", "sheet", "_a.*")
