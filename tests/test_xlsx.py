"""Workbooks made here by hand, read back as tables."""

import zipfile

from gridloom.operators import grid, rule_tables
from gridloom.sources import xlsx

_M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_P = "http://schemas.openxmlformats.org/package/2006/relationships"


def make(path, sheets, strings):
    """``sheets``: name to the inner XML of its worksheet."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_P}"><Relationship Id="r1" Type="{_R}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_M}" xmlns:r="{_R}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{_R}/worksheet" Target="{"/xl/" if i == 1 else ""}worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_P}">{links}<Relationship Id="x" Type="{_R}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_M}">{"".join(f"<si>{s}</si>" for s in strings)}</sst>')
        for i, inner in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{_M}">{inner}</worksheet>')


def test_cells(spark, tmp_path):
    first = """<cols><col min="1" max="2" width="9.5" style="3"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1" s="2"><v>2.5</v></c><c><v>7</v></c></row>
    <row r="3"><c r="AB3" t="b"><v>1</v></c><c r="AC3" t="e"><v>#DIV/0!</v></c><c r="AD3" t="str"><f t="shared" ref="AD3:AD9" si="0">A1&amp;"x"</f><v>ax</v></c><c r="AE3"/></row></sheetData>
    <mergeCells><mergeCell ref="A1:B2"/></mergeCells>"""
    second = '<sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>in</t></is></c><c r="B1" t="s"><v>0</v></c></row></sheetData>'
    make(tmp_path / "one.xlsx", {"Data": first, "More &amp; more": second}, ["<t>zero</t>", "<r><t>o</t></r><r><t>ne</t></r><rPh><t>no</t></rPh>"])
    make(tmp_path / "two.xlsx", {"Data": second}, ["<t>other</t>"])
    cells = {(r.path[-8:], r.sheet, r.row, r.col): r for r in xlsx.read_cells(spark, str(tmp_path)).collect()}
    value = lambda *at: next((x for x in (cells[at].v.n, cells[at].v.s, cells[at].v.b, cells[at].v.e) if x is not None), None)
    one = "one.xlsx"
    assert [value(one, "Data", 1, c) for c in (1, 2, 3)] == ["one", 2.5, 7.0] and cells[one, "Data", 1, 2].style == 2
    assert [value(one, "Data", 3, c) for c in (28, 29, 30, 31)] == [True, "#DIV/0!", "ax", None]
    shared = cells[one, "Data", 3, 30]
    assert (shared.formula, shared.shared, shared.shared_ref) == ('A1&"x"', "0", "AD3:AD9")
    assert [value(one, "More & more", 1, c) for c in (1, 2)] == ["in", "zero"] and value("two.xlsx", "Data", 1, 2) == "other"
    assert [(r.position, r.sheet, r.part) for r in xlsx.sheet_list(spark, str(tmp_path / "one.xlsx")).orderBy("position").collect()] == [(1, "Data", "xl/worksheets/s1.xml"), (2, "More & more", "xl/worksheets/s2.xml")]
    assert xlsx.relationships(spark, str(tmp_path / "two.xlsx")).count() == 3
    assert [tuple(r)[1:] for r in xlsx.column_styles(spark, str(tmp_path / "one.xlsx")).collect()] == [("Data", 1, 2, 9.5, False, 3)]
    merges = xlsx.merged_ranges(spark, str(tmp_path / "one.xlsx"))
    assert [tuple(r)[1:] for r in merges.collect()] == [("Data", 1, 1, 2, 2)]
    read = xlsx.read_cells(spark, str(tmp_path / "one.xlsx")).select("sheet", "row", "col", "v")
    assert grid.unmerged(read.where("row = 1 and col = 1 and sheet = 'Data'"), merges.drop("path")).where("v.s = 'one'").count() == 4


def test_conditional_rules(spark, tmp_path):
    inner = '''<sheetData><row r="1"><c r="A1"><v>1</v></c><c r="B1"><v>5</v></c><c r="C1"><v>9</v></c></row></sheetData>
    <conditionalFormatting sqref="A1:C1 E5"><cfRule type="cellIs" dxfId="3" priority="2" operator="greaterThan" stopIfTrue="1"><formula>4</formula></cfRule>
    <cfRule type="cellIs" dxfId="1" priority="1" operator="equal"><formula>"a ""b"""</formula></cfRule><cfRule type="expression" dxfId="0" priority="4"><formula>A1&gt;2</formula></cfRule></conditionalFormatting>
    <conditionalFormatting sqref="B1:A1"><cfRule type="colorScale" priority="3"><colorScale><cfvo type="min"/><cfvo type="percentile" val="50" gte="0"/><color rgb="FFff0000"/><color theme="4"/></colorScale></cfRule>
    <cfRule type="top10" dxfId="2" priority="5" rank="1" bottom="1"/></conditionalFormatting>'''
    make(tmp_path / "one.xlsx", {"S": inner, "T": "<sheetData/>"}, [])
    rules = xlsx.conditional_rules(spark, str(tmp_path))
    got = {r.rule: r for r in rules.collect()}
    assert [(r.kind, r.operator, r.v1, r.style, r.priority, r.stop_if_true, r.rank, r.bottom) for _, r in sorted(got.items())] == [
        ("cellIs", "greaterThan", "4", "3", 2, True, None, False),
        ("cellIs", "equal", 'a "b"', "1", 1, False, None, False),
        ("expression", None, None, "0", 4, False, None, False),
        ("colorScale", None, None, None, 3, False, None, False),
        ("top10", None, None, "2", 5, False, 1, True),
    ]
    scale = got["S!000004"]
    assert [(s.kind, s.value, s.over) for s in scale.stops] == [("min", None, False), ("percentile", 50.0, True)] and scale.colors == ["FF0000", None] and got["S!000003"].formulas == ["A1>2"]
    targets = xlsx.rule_targets(rules)
    assert sorted(tuple(r)[1:] for r in targets.where("rule in ('S!000001', 'S!000005')").collect()) == [("S!000001", "S", 1, 1, 1, 3), ("S!000001", "S", 5, 5, 5, 5), ("S!000005", "S", 1, 1, 1, 2)]
    out = rule_tables.formatted(xlsx.read_cells(spark, str(tmp_path)), rules, targets)
    assert {r.col: [f.rule[-1] for f in r.formats] for r in out.collect()} == {1: ["5"], 2: ["1"], 3: ["1"]}
