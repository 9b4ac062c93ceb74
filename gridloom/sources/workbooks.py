"""``spark.read.format("xlsx")`` and ``df.write.format("xlsx")``, and workbooks written from cells.

Reading: a task per file and sheet, which opens the parts it needs and no others; the option
``sheet`` chooses one, and columns that a given schema leaves out aren't made. (Filters aren't
pushed down: Spark 4.1 keeps one with the loaded table, where other queries then lose rows.) Writing: every task
deflates the rows that it holds as a segment beside the target, and the commit joins the segments,
still compressed, to the entries of one package. Call ``register(spark)`` once a session.

Paths are those of any store that pyarrow opens on driver and executors; ``xlsx.read_cells`` reads
workbooks in a store that only Spark opens.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..storage import written
from ..values import CELL_TYPE
from .package import PackageWriter, Piece, files_at, opened, piece
from .xlsx import LINK, MAIN, PACKAGE_LINK, listed_sheets, read_strings, scan_cells

_V = pa.struct([("t", pa.string()), ("n", pa.float64()), ("s", pa.string()), ("b", pa.bool_()), ("e", pa.string())])
_READ = {"path": pa.string(), "sheet": pa.string(), "row": pa.int32(), "col": pa.int32(), "v": _V, "formula": pa.string(), "shared": pa.string(), "shared_ref": pa.string(), "style": pa.int32()}
_BATCH = 5000


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(XlsxSource)


class XlsxSource(DataSource):
    """Cells of workbooks. Options: ``sheet`` of reading; those of writing are set by ``write_workbook``."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return f"path string, sheet string, row int, col int, v {CELL_TYPE}, formula string, shared string, shared_ref string, style int"

    def reader(self, schema):
        only = self.options.get("sheet")
        return XlsxReader(self.options["path"], schema.names, None if only is None else [only])

    def writer(self, schema, overwrite: bool):
        return XlsxWriter(self.options, overwrite)


@dataclass
class _Sheet(InputPartition):
    file: str
    sheet: str
    part: str


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], only: list[str] | None):
        unknown = [c for c in columns if c not in _READ]
        if unknown:
            raise ValueError(f"a cell has no {', '.join(unknown)}")
        self.path, self.columns, self.only = path, columns, only

    def partitions(self):
        out = []
        for file in files_at(self.path, ".xlsx"):
            store, place = opened(file)
            with store.open_input_file(place) as data, zipfile.ZipFile(data) as archive:
                names = set(archive.namelist())
                out += [_Sheet(file, sheet, part) for _, sheet, _, part in listed_sheets(archive) if part in names and (self.only is None or sheet in self.only)]
        return out

    def read(self, partition):
        if partition is None:  # no sheet at all
            return
        store, place = opened(partition.file)
        kinds = pa.schema([(c, _READ[c]) for c in self.columns])
        held: list[dict] = []
        with store.open_input_file(place) as data, zipfile.ZipFile(data) as archive:
            strings = list(read_strings(archive)) if "v" in self.columns else []
            for row, col, t, raw, formula, shared, shared_ref, style in scan_cells(archive, partition.part):
                every = {"path": partition.file, "sheet": partition.sheet, "row": row, "col": col, "formula": formula, "shared": shared, "shared_ref": shared_ref, "style": style}
                if "v" in self.columns:
                    every["v"] = _decoded(t, raw, strings)
                held.append({c: every[c] for c in self.columns})
                if len(held) >= _BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=kinds)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)


def _decoded(t: str, raw: str | None, strings: list[str]) -> dict:
    """The tagged cell of a stored one, as ``xlsx.read_cells`` makes it."""
    cell = dict.fromkeys(("t", "n", "s", "b", "e"))
    text = raw if t in ("str", "inlineStr", "d") else None
    if t == "s" and (raw or "").isdigit() and int(raw) < len(strings):
        text = strings[int(raw)]
    if t == "e":
        return cell | {"t": "e", "e": raw}
    if t == "b":
        return cell | {"t": "b", "b": raw == "1"}
    if text is not None:
        return cell | {"t": "s", "s": text}
    if t == "n" and raw is not None:
        try:
            return cell | {"t": "n", "n": float(raw)}
        except ValueError:
            return cell | {"t": "n"}
    return cell | {"t": "empty"}


# writing

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_SST, _SHEET = f'<sst xmlns="{MAIN}">', f'<worksheet xmlns="{MAIN}"><sheetData>'
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: Most columns of a sheet.
COLUMNS = 16384
_UNSAFE = re.compile(r"[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def stored(text: str) -> str:
    """Text as XML content; characters that XML can't hold are written as _xHHHH_."""
    return escape(_UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def letters(col: int) -> str:
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def cell_xml(row: int, col: int, v: dict, formula: str | None, sid: int | None) -> str:
    place, f = f'<c r="{letters(col)}{row}"', "" if formula is None else f"<f>{stored(formula.removeprefix('='))}</f>"
    t = v["t"]
    if t == "n" and (v["n"] is None or v["n"] != v["n"] or v["n"] in (float("inf"), float("-inf"))):
        t, v = "e", {"e": "#NUM!"}
    if t == "n":
        return f"{place}>{f}<v>{_number(v['n'])}</v></c>"
    if t == "b":
        return f'{place} t="b">{f}<v>{int(v["b"])}</v></c>'
    if t == "e":
        return f'{place} t="e">{f}<v>{stored(v["e"])}</v></c>'
    if t == "s" and sid is not None:
        return f'{place} t="s"><v>{sid}</v></c>'
    if t == "s":
        return f'{place} t="str">{f}<v xml:space="preserve">{stored(v["s"])}</v></c>'
    return f"{place}>{f}</c>" if f else f"{place}/>"


@dataclass
class _Segment:
    part: int
    first: int
    last: int
    piece: Piece


@dataclass
class _Segments(WriterCommitMessage):
    found: list[_Segment]


class XlsxWriter(DataSourceArrowWriter):
    """Rows (``part``, ``row``, ``col``, ``v``, ``formula``, ``sid``), dealt by range and sorted by part, row
    and column. Part 0 has the shared strings, the others are sheets."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.sheets, self.merges = json.loads(options["sheets"]), json.loads(options.get("merges", "{}"))
        self.folder = f"{self.path.rstrip('/')}.parts-{uuid.uuid4().hex}"
        store, place = opened(self.path)
        if not overwrite and store.get_file_info(place).is_file:
            raise FileExistsError(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Segments:
        from pyspark import TaskContext

        store, folder = opened(self.folder)
        store.create_dir(folder, recursive=True)
        task, out = TaskContext.get().taskAttemptId(), []
        now = None  # part, first row, current row, last column, file, stream, packer, checksum, size, packed size

        def put(data: str) -> None:
            raw = data.encode()
            packed = now["pack"].compress(raw)
            now["file"].write(packed)
            now["crc"], now["size"], now["packed"] = zlib.crc32(raw, now["crc"]), now["size"] + len(raw), now["packed"] + len(packed)

        def end() -> None:
            if now is None:
                return
            if now["part"] > 0:
                put("</row>")
            rest = now["pack"].flush(zlib.Z_FULL_FLUSH)
            now["file"].write(rest)
            now["file"].close()
            out.append(_Segment(now["part"], now["first"], now["row"], Piece(now["crc"], now["size"], now["packed"] + len(rest), path=now["path"])))

        for batch in iterator:
            for r in batch.to_pylist():
                part, row, col = r["part"], r["row"], r["col"]
                if row is None or col is None or row < 0 or not 1 <= col <= COLUMNS or (part > 0 and row < 1):
                    raise ValueError(f"no cell of a sheet: row {row}, column {col}")
                if now is None or now["part"] != part:
                    end()
                    path = f"{folder}/{part}-{task}"
                    now = {"part": part, "first": row, "row": None, "col": 0, "path": path, "file": store.open_output_stream(path), "pack": zlib.compressobj(6, zlib.DEFLATED, -15), "crc": 0, "size": 0, "packed": 0}
                if part == 0:
                    now["row"] = row
                    put(f'<si><t xml:space="preserve">{stored(r["v"]["s"])}</t></si>')
                    continue
                if now["row"] != row:
                    put(("</row>" if now["row"] is not None else "") + f'<row r="{row}">')
                    now["row"], now["col"] = row, 0
                if col <= now["col"]:
                    raise ValueError(f"row {row}, column {col} comes twice")
                now["col"] = col
                put(cell_xml(row, col, r["v"], r["formula"], r["sid"]))
        end()
        return _Segments(out)

    def commit(self, messages) -> None:
        store, place = opened(self.path)
        found: dict[int, list[_Segment]] = {i: [] for i in range(len(self.sheets) + 1)}
        for segment in (s for m in messages if m is not None for s in m.found):
            found[segment.part].append(segment)
        for part in found.values():
            part.sort(key=lambda s: s.first)
            if any(a.last >= b.first for a, b in zip(part, part[1:], strict=False)):
                raise ValueError("segments of a sheet overlap: rows have to be dealt by range")
        temporary = f"{place}.new-{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as stream:
            package = PackageWriter(stream)
            for name, text in _book(self.sheets).items():
                package.entry(name, [piece((_HEAD + text).encode())], None)
            read = lambda path: _chunks(store, path)
            package.entry("xl/sharedStrings.xml", [piece((_HEAD + _SST).encode()), *(s.piece for s in found[0]), piece(b"</sst>")], read)
            for i, sheet in enumerate(self.sheets, 1):
                merged = self.merges.get(sheet, [])
                foot = "</sheetData>" + (f'<mergeCells count="{len(merged)}">' + "".join(f'<mergeCell ref="{m}"/>' for m in merged) + "</mergeCells>" if merged else "") + "</worksheet>"
                package.entry(f"xl/worksheets/sheet{i}.xml", [piece((_HEAD + _SHEET).encode()), *(s.piece for s in found[i]), piece(foot.encode())], read)
            package.close()
        store.move(temporary, place)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = opened(self.folder)
        store.delete_dir_contents(folder, missing_dir_ok=True)
        if store.get_file_info(folder).type.name == "Directory":
            store.delete_dir(folder)


def _chunks(store, path: str) -> Iterator[bytes]:
    with store.open_input_stream(path) as data:
        while block := data.read(1 << 20):
            yield block


def _book(sheets: list[str]) -> dict[str, str]:
    """The small parts of a package."""
    override = lambda part, kind: f'<Override PartName="/{part}" ContentType="{_TYPES}.{kind}+xml"/>'
    relation = lambda i, kind, target: f'<Relationship Id="rId{i}" Type="{LINK}/{kind}" Target="{target}"/>'
    n = len(sheets)
    types = "".join(override(f"xl/worksheets/sheet{i}.xml", "worksheet") for i in range(1, n + 1)) + override("xl/workbook.xml", "sheet.main") + override("xl/sharedStrings.xml", "sharedStrings") + override("xl/styles.xml", "styles")
    return {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE_LINK}">{relation(1, "officeDocument", "xl/workbook.xml")}</Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE_LINK}">' + "".join(relation(i, "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, n + 1)) + relation(n + 1, "sharedStrings", "sharedStrings.xml") + relation(n + 2, "styles", "styles.xml") + "</Relationships>",
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="1"><xf/></cellXfs></styleSheet>',
    }


def numbered(df: DataFrame, order: list[Column | str], out: str = "idx") -> DataFrame:
    """``df`` with dense numbers from 0 in the given order, which has no ties. Rows are dealt to ranges
    and written; what comes before a range is the sum of the counts of those before it, one row a
    range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.select(F.struct("*").alias("_row"), F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_local")), "numbered")
    from pyspark.sql import Window

    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_before"))
    return placed.join(F.broadcast(starts), "_range").select("_row.*", (F.col("_before") + F.col("_local")).alias(out))


def shared_string_table(texts: DataFrame, text: str, position: list[str]) -> DataFrame:
    """``text`` and ``idx``: distinct texts numbered from 0 in the order in which ``position`` first
    shows them. Null texts have no number; of texts first seen at one place the lesser is first."""
    at = F.struct(*position)
    firsts = texts.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.min(at).alias("_at"))
    return numbered(firsts, ["_at", "text"]).select("text", "idx")


_BAD_NAME = re.compile(r"[\[\]:*?/\\]")


def checked_names(names: list[str]) -> list[str]:
    """Names of sheets: none blank, none twice (case doesn't count), no characters that references use."""
    if not names:
        raise ValueError("a workbook has a sheet at least")
    for name in names:
        if not name.strip() or _BAD_NAME.search(name):
            raise ValueError(f"no name for a sheet: {name!r}")
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("two sheets have one name")
    return names


def new_sheet_name(names: list[str]) -> str:
    """The first of Sheet1, Sheet2, ... that is free."""
    used = {n.lower() for n in names}
    return next(f"Sheet{i}" for i in range(1, len(names) + 2) if f"sheet{i}" not in used)


def renamed_sheet(cells: DataFrame, names: list[str], old: str, new: str) -> tuple[DataFrame, list[str]]:
    """Cells and names after a sheet got another name. Texts of formulas stay as they are."""
    if old not in names:
        raise ValueError(f"no sheet {old!r}")
    kept = checked_names([new if n == old else n for n in names])
    return cells.withColumn("sheet", F.when(F.col("sheet") == old, new).otherwise(F.col("sheet"))), kept


def removed_sheet(cells: DataFrame, names: list[str], name: str) -> tuple[DataFrame, list[str]]:
    if name not in names:
        raise ValueError(f"no sheet {name!r}")
    return cells.where(F.col("sheet") != name), checked_names([n for n in names if n != name])


def write_workbook(cells: DataFrame, path: str, sheets: list[str] | None = None, merges: dict[str, list[str]] | None = None, overwrite: bool = False) -> None:
    """Write ``cells`` (``sheet``, ``row``, ``col``, ``v`` and, if there is one, ``formula``) as a workbook.

    ``sheets`` names the sheets in their order, empty ones too; without it they are those of the
    cells, by code point. Cells of other sheets are left out. Texts become shared strings in
    first-seen order, results of formulas are stored with them. Blank cells without a formula
    aren't written. A place that comes twice, or lies outside a sheet, raises.
    """
    spark = cells.sparkSession
    register(spark)
    formula = F.col("formula") if "formula" in cells.columns else F.lit(None).cast("string")
    rows = cells.select("sheet", "row", "col", F.col("v").cast(CELL_TYPE).alias("v"), formula.alias("formula")).where((F.col("v.t") != "empty") | F.col("formula").isNotNull())
    rows = written(rows, "workbook")
    if sheets is None:
        sheets = sorted(r[0] for r in rows.select("sheet").distinct().collect())
    checked_names(sheets)
    part = F.element_at(F.create_map(*[x for i, s in enumerate(sheets, 1) for x in (F.lit(s), F.lit(i))]), F.col("sheet"))
    rows = rows.where(F.col("sheet").isin(sheets)).withColumn("part", part)
    plain = (F.col("v.t") == "s") & F.col("formula").isNull()
    strings = written(shared_string_table(rows.where(plain).select(F.col("v.s").alias("s"), "part", "row", "col"), "s", ["part", "row", "col"]), "strings")
    named = rows.withColumn("_text", F.when(plain, F.col("v.s"))).join(strings.withColumnRenamed("text", "_text"), "_text", "left")
    own = named.select("part", "row", "col", "v", "formula", F.col("idx").alias("sid"))
    null = F.lit(None)
    listed = strings.select(F.lit(0).alias("part"), F.col("idx").cast("int").alias("row"), F.lit(1).alias("col"), F.struct(F.lit("s").alias("t"), null.cast("double").alias("n"), F.col("text").alias("s"), null.cast("boolean").alias("b"), null.cast("string").alias("e")).cast(CELL_TYPE).alias("v"), null.cast("string").alias("formula"), null.cast("long").alias("sid"))
    ordered = own.unionByName(listed).repartitionByRange("part", "row").sortWithinPartitions("part", "row", "col")
    ordered.write.format("xlsx").option("sheets", json.dumps(sheets)).option("merges", json.dumps(merges or {})).mode("overwrite" if overwrite else "append").save(path)
