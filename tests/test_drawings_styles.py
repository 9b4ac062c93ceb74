"""Charts, pictures and styles of a workbook made by hand."""

import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.sources import drawings, styles, xlsx
from test_xlsx import make

_D = "http://schemas.openxmlformats.org/drawingml/2006"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_P = "http://schemas.openxmlformats.org/package/2006/relationships"
_M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def cache(kind, points, literal=False):
    pts = "".join(f'<k:pt idx="{i}"><k:v>{v}</k:v></k:pt>' for i, v in points)
    return f"<k:{kind}Lit>{pts}</k:{kind}Lit>" if literal else f"<k:{kind}Ref><k:f>S!A1:A9</k:f><k:{kind}Cache>{pts}</k:{kind}Cache></k:{kind}Ref>"


def chart(inner, title="", axes=""):
    head = f"<k:title><k:tx><k:rich><z:p><z:r><z:t>{title}</z:t></z:r></z:p></k:rich></k:tx></k:title>" if title else ""
    return f'<k:chartSpace xmlns:k="{_D}/chart" xmlns:z="{_D}/main"><k:chart>{head}<k:plotArea>{inner}{axes}</k:plotArea></k:chart></k:chartSpace>'


CHARTS = [
    chart(
        '<k:barChart><k:barDir val="col"/>'
        f'<k:ser><k:tx>{cache("str", [(0, "North")])}</k:tx><k:spPr><z:solidFill><z:srgbClr val="AA0011"/></z:solidFill></k:spPr><k:cat>{cache("str", [(1, "Q2"), (0, "Q1"), (2, "Q3")])}</k:cat><k:val>{cache("num", [(0, 10), (1, 20.5)])}</k:val></k:ser>'
        f'<k:ser><k:tx><k:v>South</k:v></k:tx><k:val>{cache("num", [(0, "x"), (1, 3)])}</k:val></k:ser></k:barChart>',
        " Sales ",
        "<k:catAx><k:axId val='1'/><k:title><k:tx><k:rich><z:p><z:r><z:t>Quarter</z:t></z:r></z:p></k:rich></k:tx></k:title></k:catAx><k:valAx/>",
    ),
    chart(f'<k:scatterChart><k:ser><k:xVal>{cache("num", [(0, 1.5), (1, 2)])}</k:xVal><k:yVal>{cache("num", [(0, 7), (1, 8)])}</k:yVal></k:ser></k:scatterChart>'),
    chart(f'<k:doughnutChart><k:ser><k:cat>{cache("str", [(0, "a"), (1, "b")], True)}</k:cat><k:val>{cache("num", [(0, 1), (1, 2)], True)}</k:val></k:ser></k:doughnutChart>'),
    chart('<k:bar3DChart><k:barDir val="bar"/></k:bar3DChart>'),
    chart(""),
]


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    path = tmp_path_factory.mktemp("book") / "book.xlsx"
    make(path, {"S": '<sheetData><row r="1"><c r="A1" s="1"><v>1</v></c><c r="B1"><v>2</v></c><c r="C1" s="2"><v>3</v></c></row></sheetData>', "T": "<sheetData/>"}, [])
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n).decode() for n in z.namelist()}
    links = lambda *rows: f'<Relationships xmlns="{_P}">' + "".join(f'<Relationship Id="{i}" Type="{_R}/{k}" Target="{t}"/>' for i, k, t in rows) + "</Relationships>"
    corner = lambda n, r, c: f"<x:{n}><x:col>{c}</x:col><x:row>{r}</x:row></x:{n}>"
    frame = lambda i: f'<x:graphicFrame><z:graphic><z:graphicData uri="{_D}/chart"><k:chart r:id="c{i}"/></z:graphicData></z:graphic></x:graphicFrame>'
    picture = '<x:pic><x:blipFill><z:blip r:embed="p1"/></x:blipFill></x:pic>'
    parts["xl/worksheets/_rels/s1.xml.rels"] = links(("d", "drawing", "../drawings/d1.xml"))
    parts["xl/drawings/d1.xml"] = (
        f'<x:wsDr xmlns:x="{_D}/spreadsheetDrawing" xmlns:z="{_D}/main" xmlns:k="{_D}/chart" xmlns:r="{_R}">'
        + "".join(f"<x:twoCellAnchor>{corner('from', i, 2)}{corner('to', i + 9, 8)}{frame(i)}</x:twoCellAnchor>" for i in range(len(CHARTS)))
        + f"<x:oneCellAnchor>{corner('from', 4, 5)}{picture}</x:oneCellAnchor><x:twoCellAnchor>{corner('from', 0, 0)}{corner('to', 1, 1)}</x:twoCellAnchor></x:wsDr>"
    )
    parts["xl/drawings/_rels/d1.xml.rels"] = links(("p1", "image", "../media/i.png"), *((f"c{i}", "chart", f"../charts/c{i}.xml") for i in range(len(CHARTS))))
    parts["xl/media/i.png"] = "png bytes"
    parts |= {f"xl/charts/c{i}.xml": c for i, c in enumerate(CHARTS)}
    parts["xl/_rels/workbook.xml.rels"] = parts["xl/_rels/workbook.xml.rels"].replace("</Relationships>", f'<Relationship Id="y" Type="{_R}/styles" Target="styles.xml"/><Relationship Id="z" Type="{_R}/theme" Target="theme/theme1.xml"/></Relationships>')
    parts["xl/theme/theme1.xml"] = f'<a:theme xmlns:a="{_D}/main"><a:themeElements><a:clrScheme name="x"><a:dk1><a:sysClr val="windowText" lastClr="000000"/></a:dk1><a:lt1><a:srgbClr val="ffffff"/></a:lt1><a:accent1><a:srgbClr val="4472C4"/></a:accent1></a:clrScheme></a:themeElements></a:theme>'
    parts["xl/styles.xml"] = f"""<styleSheet xmlns="{_M}"><numFmts><numFmt numFmtId="164" formatCode="0.0%"/></numFmts>
    <fonts><font><sz val="11"/><name val="Base"/></font><font><b/><color theme="4" tint="-0.5"/></font><font><i val="0"/><strike/><sz val="9"/><color indexed="10"/></font></fonts>
    <fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF112233"/></patternFill></fill><fill><patternFill><bgColor rgb="FFABCDEF"/></patternFill></fill></fills>
    <borders><border><left/><right/></border><border><left style="thin"><color rgb="FF0000FF"/></left><top style="thick"/></border></borders>
    <cellStyleXfs><xf fontId="0" fillId="1" borderId="1" numFmtId="0"/></cellStyleXfs>
    <cellXfs><xf fontId="0" xfId="0"/><xf fontId="1" fillId="0" borderId="0" numFmtId="164" xfId="0"/><xf fontId="2" fillId="2" xfId="0" applyFont="1" applyFill="0" numFmtId="9" applyBorder="0" borderId="1"/></cellXfs>
    <dxfs><dxf><font><color rgb="FF9C0006"/></font><fill><patternFill><bgColor theme="0"/></patternFill></fill></dxf></dxfs></styleSheet>"""
    with zipfile.ZipFile(path, "w") as z:
        for n, data in parts.items():
            z.writestr(n, data)
    return str(path)


def test_charts(spark, book):
    kinds = {r.part[-6:-4]: (r.kind, r.title, r.category_axis, r.value_axis) for r in drawings.charts(spark, book).collect()}
    assert kinds == {"c0": ("col", "Sales", "Quarter", ""), "c1": ("scatter", "", None, None), "c2": ("doughnut", "", None, None), "c3": ("bar", "", None, None), "c4": ("unknown", "", None, None)}
    points = sorted((r.part[-6:-4], r.series, r.name, r.point, r.category, r.value) for r in drawings.chart_points(spark, book).collect())
    assert points == [
        *[("c0", 0, "North", i, c, v) for i, (c, v) in enumerate([("Q1", 10.0), ("Q2", 20.5), ("Q3", 0.0)])],
        *[("c0", 1, "South", i, c, v) for i, (c, v) in enumerate([("1", 0.0), ("2", 3.0)])],
        *[("c1", 0, "Series 1", i, c, v) for i, (c, v) in enumerate([("1.5", 7.0), ("2", 8.0)])],
        *[("c2", 0, "Series 1", i, c, v) for i, (c, v) in enumerate([("a", 1.0), ("b", 2.0)])],
    ]
    assert {r.name: r.color for r in drawings.chart_series(spark, book).collect()} == {"North": "AA0011", "South": None, "Series 1": None}


def test_anchors(spark, book):
    rows = drawings.anchors(spark, book).collect()
    assert sorted((r.kind, r.id, r.target, r.from_row, r.from_col, r.to_row, r.to_col) for r in rows) == [*[("chart", f"c{i}", f"xl/charts/c{i}.xml", i + 1, 3, i + 10, 9) for i in range(len(CHARTS))], ("image", "p1", "xl/media/i.png", 5, 6, 1, 1)]
    (picture,) = drawings.pictures(spark, book).collect()
    assert bytes(picture.content) == b"png bytes" and picture.url == "data:image/png;base64,cG5nIGJ5dGVz"


def test_styles(spark, book):
    tables = styles.style_tables(spark, book)
    got = {(r.row, r.col): r for r in styles.cell_styles(xlsx.read_cells(spark, book), tables).collect()}
    a, b, c = got[1, 1], got[1, 2], got[1, 3]
    assert (a.font, a.size, a.bold, a.color, a.fill, a.number_format) == ("Base", 11, True, "223962", "112233", "0.0%")
    assert (b.font, b.bold, b.color, b.fill, b.number_format) == ("Base", False, None, "112233", "#0")
    assert (c.font, c.size, c.italic, c.strike, c.color, c.fill, c.number_format) == ("Base", 9, False, True, "FF0000", "112233", "#9")
    for x in (a, b, c):
        assert {k: (v.line, v.color) for k, v in x.borders.items()} == {"left": ("thin", "0000FF"), "top": ("thick", None)}
    (dxf,) = tables["differential"].collect()
    assert dxf.color.rgb == "FF9C0006" and dxf.fill.theme == 0
    assert {r.idx: r.rgb for r in tables["theme"].collect()} == {0: "FFFFFF", 1: "000000", 4: "4472C4"}
    one = spark.range(1).select(F.struct(F.lit("zz").alias("rgb"), F.lit(None).cast("int").alias("theme"), F.lit(None).cast("int").alias("indexed"), F.lit(None).cast("double").alias("tint")).alias("c"), F.create_map(F.lit(1), F.lit("000000")).alias("t"))
    assert one.select(styles.resolved(F.col("c"), F.col("t"))).first()[0] is None


def test_books_without_parts(spark, tmp_path):
    make(tmp_path / "a.xlsx", {"S": '<sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData>'}, [])
    path = str(tmp_path)
    assert [f(spark, path).count() for f in (drawings.charts, drawings.chart_points, drawings.anchors, drawings.pictures)] == [0, 0, 0, 0]
    (row,) = styles.cell_styles(xlsx.read_cells(spark, path), styles.style_tables(spark, path)).collect()
    assert row.fill is None and row.v.n == 1
