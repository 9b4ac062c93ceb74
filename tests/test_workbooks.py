"""Workbooks written and read back, as tables and by the zip library."""

import os
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.operators import grid
from gridloom.sources import package, workbooks, xlsx
from test_xlsx import make


def cells_of(spark, rows):
    tag = lambda x: ("empty", None, None, None, None) if x is None else ("b", None, None, x, None) if isinstance(x, bool) else ("n", float(x), None, None, None) if isinstance(x, int | float) else ("e", None, None, None, x) if x.startswith("#") else ("s", None, x, None, None)
    return spark.createDataFrame([(s, r, c, tag(v), f) for s, r, c, v, f in rows], grid.CELLS + ", formula string")


def content(df):
    return sorted((r.sheet, r.row, r.col, r.v.t, r.v.n, r.v.s, r.v.b, r.v.e, r.formula) for r in df.collect())


HARD = ["plain", " spaces ", "a<b>&\"c'", "é日本🎈", "line\nbreak\ttab", "bell\x07 and return\r", "_x0041_ stays", "", "#text", "1e5", "ends_", "]]>"]


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [("One", r, c, rng.choice([1, -2.5, 1e300, 1e-7, 123456789012345678.0, True, False, "#DIV/0!", "x", "y"]), None) for r in rng.sample(range(1, 3000), 300) for c in rng.sample(range(1, 900), 3)]
    rows += [("A & b", i, 2, t, None) for i, t in enumerate(HARD, 1) if t != "#text"] + [("A & b", 50, 16384, 7, "=A1&\"<\""), ("A & b", 51, 1, "txt\x07", "=B1"), ("A & b", 52, 1, None, "A1"), ("A & b", 53, 1, None, None), ("A & b", 1_048_576, 1, 1, None)]
    cells = cells_of(spark, rows).repartition(5)
    path = str(tmp_path / "out.xlsx")
    workbooks.write_workbook(cells, path, ["A & b", "Empty", "One"], {"One": ["A1:B2"]})
    assert sorted(os.listdir(tmp_path)) == ["out.xlsx"]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
    want = content(cells.where("sheet <> 'A & b' or row <> 53").withColumn("formula", F.regexp_replace("formula", "^=", "")))
    read = xlsx.read_cells(spark, path)
    assert content(read) == want
    found = spark.read.format("xlsx").load(path)
    assert content(found) == want
    assert [(r.position, r.sheet) for r in xlsx.sheet_list(spark, path).orderBy("position").collect()] == [(1, "A & b"), (2, "Empty"), (3, "One")]
    assert [tuple(r)[1:] for r in xlsx.merged_ranges(spark, path).collect()] == [("One", 1, 1, 2, 2)]
    firsts = {}
    for _, _, _, v, f in sorted((x for x in rows if isinstance(x[3], str) and not x[3].startswith("#") and x[4] is None), key=lambda x: (x[0] != "A & b", x[1], x[2])):
        firsts.setdefault(v, len(firsts))
    assert {r.text: r.idx for r in xlsx.shared_strings(spark, path).collect()} == firsts
    with pytest.raises(Exception, match="FileExists"):
        workbooks.write_workbook(cells, path)
    workbooks.write_workbook(cells.where("sheet = 'One'"), path, overwrite=True)
    assert xlsx.sheet_list(spark, path).count() == 1


def test_plan_of_the_source(spark, tmp_path):
    """No exchange, and a chosen sheet is opened alone."""
    sheet = lambda n: f'<sheetData><row r="1"><c r="A1"><v>{n}</v></c></row></sheetData>'
    make(tmp_path / "a.xlsx", {"S": sheet(1), "T": "<sheetData><row r='1'><c r='A1'><v>broken</row></sheetData>"}, ["<t>x</t>"])
    make(tmp_path / "b.xlsx", {"S": sheet(2), "U": sheet(3)}, [])
    workbooks.register(spark)
    every = spark.read.format("xlsx").load(str(tmp_path))
    one = spark.read.format("xlsx").option("sheet", "S").load(str(tmp_path)).where("row > 0")
    assert sorted(r.v.n for r in one.collect()) == [1, 2] and one.rdd.getNumPartitions() == 2
    assert "Exchange" not in one._jdf.queryExecution().toString()
    assert [tuple(r) for r in spark.read.format("xlsx").schema("sheet string, row int").load(str(tmp_path / "b.xlsx")).collect()] == [("S", 1), ("U", 1)]
    good = spark.read.format("xlsx").load(str(tmp_path / "b.xlsx"))
    assert [good.where(f"sheet = '{s}'").count() for s in "SUV"] == [1, 1, 0] and good.count() == 2
    with pytest.raises(Exception):
        every.collect()


def test_missing_parts(spark, tmp_path):
    make(tmp_path / "a.xlsx", {"S": '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row></sheetData>'}, [])
    parts = {}
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        parts = {n: z.read(n) for n in z.namelist() if "sharedStrings" not in n}
    os.mkdir(tmp_path / "b")
    with zipfile.ZipFile(tmp_path / "b/b.xlsx", "w") as z:
        for n, data in parts.items():
            z.writestr(n, data)
    assert [r.v.s for r in xlsx.read_cells(spark, str(tmp_path / "b")).collect()] == [None]
    workbooks.register(spark)
    assert [r.v.s for r in spark.read.format("xlsx").load(str(tmp_path / "b")).collect()] == [None]


def test_what_cannot_be_written(spark, tmp_path):
    twice = cells_of(spark, [("S", 1, 1, 5, None), ("S", 1, 1, 6, None)])
    for bad in (twice, cells_of(spark, [("S", 0, 1, 5, None)]), cells_of(spark, [("S", 1, 20000, 5, None)])):
        with pytest.raises(Exception):
            workbooks.write_workbook(bad, str(tmp_path / "bad.xlsx"))
    assert os.listdir(tmp_path) == []
    for names in ([], ["a", "A"], [" "], ["a/b"]):
        with pytest.raises(ValueError):
            workbooks.checked_names(names)


def test_dense_numbers(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcdefgh") * rng.randrange(1, 4), rng.randrange(500), i) for i in range(2000)] + [(None, 0, 0)]
    want = {}
    for t, a, i in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1:]):
        want.setdefault(t, len(want))
    found = workbooks.shared_string_table(spark.createDataFrame(rows, "s string, a int, i int").repartition(7), "s", ["a", "i"])
    assert {r.text: r.idx for r in found.collect()} == want
    assert workbooks.shared_string_table(spark.createDataFrame([], "s string, a int"), "s", ["a"]).count() == 0


def test_sheets_by_name(spark):
    cells = cells_of(spark, [("S", 1, 1, 5, "=T!A1"), ("T", 1, 1, 6, None)])
    moved, names = workbooks.renamed_sheet(cells, ["S", "T"], "T", "New")
    assert names == ["S", "New"] and {r.sheet for r in moved.collect()} == {"S", "New"}
    assert workbooks.new_sheet_name(["Sheet1", "sheet3"]) == "Sheet2" and workbooks.new_sheet_name([]) == "Sheet1"
    left, names = workbooks.removed_sheet(cells, ["S", "T"], "S")
    assert names == ["T"] and left.count() == 1
    for bad in (lambda: workbooks.renamed_sheet(cells, ["S", "T"], "S", "t"), lambda: workbooks.removed_sheet(cells, ["S"], "S"), lambda: workbooks.removed_sheet(cells, ["S"], "T")):
        with pytest.raises(ValueError):
            bad()


def test_joined_checksums_and_long_archives(tmp_path, monkeypatch):
    rng = random.Random(2)
    for _ in range(30):
        a, b = rng.randbytes(rng.randrange(0, 300)), rng.randbytes(rng.randrange(0, 3000))
        assert package.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    for limit in (0xFFFFFFFF, 50):  # the long form, forced by a low limit
        monkeypatch.setattr(package, "_BIG", limit)
        with open(tmp_path / "z.zip", "wb") as f:
            z = package.PackageWriter(f)
            z.entry("a é.xml", [package.piece(b"one " * 50), package.piece(b""), package.piece(b"two" * 9)], None)
            z.entry("empty", [], None)
            z.close()
        if limit == 0xFFFFFFFF:
            with zipfile.ZipFile(tmp_path / "z.zip") as z:
                assert z.read("a é.xml") == b"one " * 50 + b"two" * 9 and z.read("empty") == b"" and z.testzip() is None
