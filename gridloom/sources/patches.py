"""Edits written into an existing workbook: only the edited sheets are made anew.

A task takes the edits of a sheet in order and streams the sheet's XML past them, token by token;
everything that isn't an edited cell stays as it is written. All other entries of the package are
copied as the compressed bytes that they are. The chain of calculation goes, as it names cells.
"""

from __future__ import annotations

import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..values import CELL_TYPE
from .package import PackageWriter, Piece, opened, piece
from .workbooks import _chunks, cell_xml
from .xlsx import _place, _relations, _workbook_part, listed_sheets

_TAG = re.compile(r"<(/?)([\w.-]+:)?([\w.-]+)")
_SPANS = re.compile(r"""\s+spans\s*=\s*("[^"]*"|'[^']*')""")


def _attribute(tag: str, name: str) -> str | None:
    m = re.search(rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", tag)
    return None if m is None else m[1] if m[1] is not None else m[2]


def _prefixed(xml: str, prefix: str) -> str:
    return re.sub(r"<(/?)(?=[a-z])", rf"<\1{prefix}", xml) if prefix else xml


class Patched:
    """Filters the tokens of a sheet: ``feed`` takes them and gives what is written instead. ``edits``
    yields row, col, v and formula in order."""

    def __init__(self, edits: Iterator[tuple[int, int, dict, str | None]]):
        self.edits, self.next = edits, next(edits, None)
        self.inside, self.row, self.col, self.prefix, self.skipped, self.style = False, 0, 0, "", None, None

    def _cells(self, row: int, before: float, style: str | None = None) -> str:
        """The edits of a row up to a column, which isn't included."""
        out = ""
        while self.next is not None and self.next[0] == row and self.next[1] < before:
            out += self._made(None)
        return out

    def _made(self, style: str | None) -> str:
        row, col, v, formula = self.next
        self.next = next(self.edits, None)
        if self.next is not None and self.next[:2] <= (row, col):
            raise ValueError(f"edits of row {self.next[0]}, column {self.next[1]} come twice or out of order")
        if v["t"] == "empty" and formula is None:
            return f'<{self.prefix}c r="{_name(row, col)}" s="{style}"/>' if style else ""
        xml = cell_xml(row, col, v, formula, None)
        if v["t"] == "s" and formula is None:
            xml = re.sub(r' t="str"><v xml:space="preserve">(.*)</v></c>$', r' t="inlineStr"><is><t xml:space="preserve">\1</t></is></c>', xml, flags=re.DOTALL)
        return _prefixed(xml.replace("<c ", f'<c s="{style}" ' if style else "<c ", 1), self.prefix)

    def _rows(self, before: float) -> str:
        out = ""
        while self.next is not None and self.next[0] < before:
            row = self.next[0]
            cells = self._cells(row, float("inf"))
            out += f'<{self.prefix}row r="{row}">{cells}</{self.prefix}row>' if cells else ""
        return out

    def feed(self, token: str) -> str:
        m = _TAG.match(token)
        closing, prefix, name = (m[1] == "/", m[2] or "", m[3]) if m else (False, "", "")
        empty = token.endswith("/>")
        if self.skipped is not None:  # within a cell that is replaced
            if name == "f" and not closing and _attribute(token, "t") == "shared" and _attribute(token, "ref"):
                raise ValueError(f"row {self.row}, column {self.col} states a formula that other cells share; give those their own first (references.unshared)")
            if name == "c" and closing:
                self.skipped = None
                return self._made(self.style)
            return ""
        if name == "dimension" and not self.inside:
            return ""
        if name == "sheetData":
            self.prefix = prefix
            if empty:
                rows = self._rows(float("inf"))
                return f"<{prefix}sheetData>{rows}</{prefix}sheetData>"
            self.inside = not closing
            return (self._rows(float("inf")) if closing else "") + token
        if not self.inside:
            return token
        if name == "row" and not closing:
            self.row, self.col = int(_attribute(token, "r") or self.row + 1), 0
            out, token = self._rows(self.row), _SPANS.sub("", token)
            if empty:
                cells = self._cells(self.row, float("inf"))
                return out + (f"{token[:-2].rstrip()}>{cells}</{prefix}row>" if cells else token)
            return out + token
        if name == "row":
            return self._cells(self.row, float("inf")) + token
        if name == "c" and not closing:
            ref = _attribute(token, "r")
            self.col = _place(ref)[1] if ref else self.col + 1
            out = self._cells(self.row, self.col)
            if self.next is not None and self.next[:2] == (self.row, self.col):
                self.style = _attribute(token, "s")
                if empty:
                    return out + self._made(self.style)
                self.skipped = True
                return out
            return out + token
        return token


def _name(row: int, col: int) -> str:
    from .workbooks import letters

    return f"{letters(col)}{row}"


def patched(data: Iterator[bytes], edits: Iterator[tuple]) -> Iterator[bytes]:
    """A sheet's XML after its edits, piece by piece."""
    out: list[str] = []
    filter_ = Patched(edits)
    parser = expat.ParserCreate()
    parser.DefaultHandler = lambda token: out.append(filter_.feed(token))
    for block in data:
        parser.Parse(block, False)
        yield "".join(out).encode()
        out.clear()
    parser.Parse(b"", True)
    yield "".join(out).encode()


def _raw(stream, info: zipfile.ZipInfo) -> Iterator[bytes]:
    """The compressed bytes of an entry."""
    stream.seek(info.header_offset)
    head = stream.read(30)
    stream.seek(info.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
    left = info.compress_size
    while left:
        block = stream.read(min(left, 1 << 20))
        left -= len(block)
        yield block


def _without(xml: bytes, element: str, attribute: str, value: str) -> bytes:
    """XML without the empty elements of a name whose attribute ends with a value."""
    return re.sub(rf"""<(?:[\w.-]+:)?{element}\s[^>]*{attribute}\s*=\s*["'][^"']*{re.escape(value)}["'][^>]*/>""".encode(), b"", xml)


def merge_workbook(edits: DataFrame, source: str, target: str) -> None:
    """Write the workbook ``source`` with ``edits`` (``sheet``, ``row``, ``col``, ``v`` and, if there is one,
    ``formula``) as ``target``, which must not exist.

    An edit replaces a cell and keeps its style; an empty one without a formula clears it. Texts
    are stored in their cells, so the shared strings stay as they are. Unknown sheets, places
    that come twice, and cells that state a shared formula raise.
    """
    store, place = opened(target)
    if store.get_file_info(place).is_file:
        raise FileExistsError(target)
    own, at = opened(source)
    with own.open_input_file(at) as data, zipfile.ZipFile(data) as archive:
        parts = {sheet: part for _, sheet, _, part in listed_sheets(archive)}
        chain = [t for k, t in _relations(archive, _workbook_part(archive)).values() if k == "calcChain"]
        book = _workbook_part(archive)
    formula = F.col("formula") if "formula" in edits.columns else F.lit(None).cast("string")
    rows = edits.select("sheet", "row", "col", F.col("v").cast(CELL_TYPE).alias("v"), formula.alias("formula"))
    unknown = rows.where(~F.coalesce(F.col("sheet").isin(list(parts)), F.lit(False)) | (F.col("row") < 1) | (F.col("col") < 1)).limit(1).collect()
    if unknown:
        raise ValueError(f"no place in the workbook: {unknown[0]}")
    folder_uri = f"{target.rstrip('/')}.parts-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, folder = opened(folder_uri)
        own, at = opened(source)
        every = (r for batch in batches for r in batch.to_pylist())
        first = next(every, None)
        while first is not None:
            sheet, rest = first["sheet"], [None]

            def of_sheet(first=first, sheet=sheet, rest=rest):
                r = first
                while r is not None and r["sheet"] == sheet:
                    yield r["row"], r["col"], r["v"], r["formula"]
                    r = next(every, None)
                rest[0] = r

            store.create_dir(folder, recursive=True)
            path = f"{folder}/{list(parts).index(sheet)}-{TaskContext.get().taskAttemptId()}"
            crc = size = packed = 0
            pack = zlib.compressobj(6, zlib.DEFLATED, -15)
            with own.open_input_file(at) as data, zipfile.ZipFile(data) as archive, archive.open(parts[sheet]) as old, store.open_output_stream(path) as new:
                for block in patched(iter(lambda: old.read(1 << 20), b""), of_sheet()):
                    out = pack.compress(block)
                    new.write(out)
                    crc, size, packed = zlib.crc32(block, crc), size + len(block), packed + len(out)
                out = pack.flush(zlib.Z_FULL_FLUSH)
                new.write(out)
            yield pa.RecordBatch.from_pylist([{"part": parts[sheet], "path": path, "crc": crc, "size": size, "packed": packed + len(out)}], schema=kinds)
            first = rest[0]

    kinds = pa.schema([("part", pa.string()), ("path", pa.string()), ("crc", pa.int64()), ("size", pa.int64()), ("packed", pa.int64())])
    ordered = rows.repartition("sheet").sortWithinPartitions("sheet", "row", "col")
    try:
        # a row per sheet
        made = {r["part"]: Piece(r["crc"], r["size"], r["packed"], path=r["path"]) for r in ordered.mapInArrow(run, "part string, path string, crc long, size long, packed long").collect()}
        links = f"{book.rpartition('/')[0]}/_rels/{book.rpartition('/')[2]}.rels"
        temporary = f"{place}.new-{uuid.uuid4().hex}"
        with own.open_input_file(at) as data, zipfile.ZipFile(data) as archive, own.open_input_file(at) as raw, store.open_output_stream(temporary) as stream:
            package = PackageWriter(stream)
            for info in archive.infolist():
                if info.filename in made:
                    package.entry(info.filename, [made[info.filename]], lambda path: _chunks(store, path))
                elif info.filename in chain:
                    continue
                elif chain and info.filename in (links, "[Content_Types].xml"):
                    xml = archive.read(info)
                    xml = _without(xml, "Relationship", "Type", "/calcChain") if info.filename == links else _without(xml, "Override", "PartName", chain[0])
                    package.entry(info.filename, [piece(xml)], None)
                else:
                    package.copied(info.filename, info.compress_type, info.CRC, info.file_size, info.compress_size, _raw(raw, info))
            package.close()
        store.move(temporary, place)
    finally:
        _, folder = opened(folder_uri)
        store.delete_dir_contents(folder, missing_dir_ok=True)
        if store.get_file_info(folder).type.name == "Directory":
            store.delete_dir(folder)
