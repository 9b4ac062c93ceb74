"""Edits written into existing workbooks."""

import os
import zipfile

import pytest

from gridloom.sources import patches, workbooks, xlsx
from test_workbooks import cells_of
from test_xlsx import make


def raw(path):
    """Compressed bytes of every entry."""
    out = {}
    with zipfile.ZipFile(path) as z, open(path, "rb") as f:
        for info in z.infolist():
            out[info.filename] = b"".join(patches._raw(f, info))
    return out


def patch(xml, *edits):
    tag = lambda x: {"t": "empty"} if x is None else {"t": "n", "n": float(x)} if isinstance(x, int | float) else {"t": "s", "s": x}
    blocks = [xml[i : i + 7].encode() for i in range(0, len(xml), 7)]
    return b"".join(patches.patched(iter(blocks), iter([(r, c, tag(v), f) for r, c, v, f in edits]))).decode()


def test_tokens():
    sheet = '<?xml version="1.0"?>\n<w xmlns="m"><!-- a > b --><dimension ref="A1"/><sheetData><row r="2" spans="1:3" ht="9"><c r="A2" s="4"><v>1</v></c><c r="C2" x="a>b"><f>A1&gt;"x"</f><v>2</v></c></row><row r="5"/></sheetData><tail a=\'1\'/></w>'
    assert patch(sheet) == sheet.replace('<dimension ref="A1"/>', "").replace(' spans="1:3"', "")
    got = patch(sheet, (1, 2, 5, None), (2, 1, "t<", None), (2, 2, 7, "A1"), (2, 3, None, None), (5, 1, 1, None), (9, 9, 2.5, None))
    assert got == (
        '<?xml version="1.0"?>\n<w xmlns="m"><!-- a > b --><sheetData><row r="1"><c r="B1"><v>5</v></c></row><row r="2" ht="9"><c s="4" r="A2" t="inlineStr"><is><t xml:space="preserve">t&lt;</t></is></c><c r="B2"><f>A1</f><v>7</v></c></row>'
        '<row r="5"><c r="A5"><v>1</v></c></row><row r="9"><c r="I9"><v>2.5</v></c></row></sheetData><tail a=\'1\'/></w>'
    )
    assert patch('<x:w xmlns:x="m"><x:sheetData/></x:w>', (1, 1, 3, None)) == '<x:w xmlns:x="m"><x:sheetData><x:row r="1"><x:c r="A1"><x:v>3</x:v></x:c></x:row></x:sheetData></x:w>'
    assert patch("<w><sheetData><row><c><v>1</v></c><c/></row></sheetData></w>", (1, 2, 9, None)) == '<w><sheetData><row><c><v>1</v></c><c r="B1"><v>9</v></c></row></sheetData></w>'
    with pytest.raises(ValueError, match="share"):
        patch('<w><sheetData><row r="1"><c r="A1"><f t="shared" ref="A1:A3" si="0">B1</f></c></row></sheetData></w>', (1, 1, 3, None))
    with pytest.raises(ValueError, match="twice"):
        patch("<w><sheetData/></w>", (1, 1, 3, None), (1, 1, 4, None))


def test_merge(spark, tmp_path):
    first = '<sheetData><row r="1"><c r="A1" s="2"><v>1</v></c><c r="B1" t="s"><v>0</v></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells>'
    make(tmp_path / "a.xlsx", {"S": first, "T": '<sheetData><row r="1"><c r="A1"><v>5</v></c></row></sheetData>', "U": "<sheetData/>"}, ["<t>shared</t>"])
    with zipfile.ZipFile(tmp_path / "a.xlsx", "a", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/media/big.bin", os.urandom(5000) + b"a" * 100_000)
        z.writestr("xl/calcChain.xml", "<calcChain/>")
    book = {}
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        book = {i.filename: (i.compress_type, z.read(i)) for i in z.infolist()}
    rels = book["xl/_rels/workbook.xml.rels"]
    book["xl/_rels/workbook.xml.rels"] = (rels[0], rels[1].replace(b"</Relationships>", b'<Relationship Id="cc" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/calcChain" Target="calcChain.xml"/></Relationships>'))
    book["[Content_Types].xml"] = (zipfile.ZIP_DEFLATED, b'<Types><Override PartName="/xl/calcChain.xml" ContentType="x"/><Override PartName="/xl/workbook.xml" ContentType="y"/></Types>')
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        for name, (kind, data) in book.items():
            z.writestr(name, data, kind)
    edits = cells_of(spark, [("S", 3, 2, "new", None), ("S", 1, 1, 7, None), ("U", 2, 2, True, "=A1=A2"), ("S", 1, 2, None, None)])
    source, target = str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx")
    patches.merge_workbook(edits.repartition(3), source, target)
    assert sorted(os.listdir(tmp_path)) == ["a.xlsx", "b.xlsx"]
    old, new = raw(source), raw(target)
    changed = {"xl/worksheets/s1.xml", "xl/worksheets/s3.xml", "xl/_rels/workbook.xml.rels", "[Content_Types].xml"}
    assert set(old) - set(new) == {"xl/calcChain.xml"} and {n for n in new if new[n] != old[n]} == changed
    with zipfile.ZipFile(target) as z:
        assert z.testzip() is None and b"calcChain" not in z.read("xl/_rels/workbook.xml.rels") + z.read("[Content_Types].xml") and b"workbook.xml" in z.read("[Content_Types].xml")
    rows = {(r.sheet, r.row, r.col): r for r in xlsx.read_cells(spark, target).collect()}
    assert rows["S", 1, 1].v.n == 7 and rows["S", 1, 1].style == 2 and rows["S", 3, 2].v.s == "new" and rows["T", 1, 1].v.n == 5
    assert rows["U", 2, 2].v.b is True and rows["U", 2, 2].formula == "A1=A2" and ("S", 1, 2) not in rows
    assert xlsx.merged_ranges(spark, target).count() == 1
    with pytest.raises(FileExistsError):
        patches.merge_workbook(edits, source, target)
    with pytest.raises(ValueError):
        patches.merge_workbook(cells_of(spark, [("no", 1, 1, 1, None)]), source, str(tmp_path / "c.xlsx"))
    patches.merge_workbook(edits.limit(0), source, str(tmp_path / "same.xlsx"))
    assert raw(str(tmp_path / "same.xlsx")).keys() == new.keys()
