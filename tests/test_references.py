"""References in formula texts."""

import pytest

from gridloom.operators import grid, references
from gridloom.operators.tiles import LAST

CASES = {
    "A1+B2*C3": [(None, 1, 1, 1, 1), (None, 2, 2, 2, 2), (None, 3, 3, 3, 3)],
    "SUM(A1:A3)": [(None, 1, 1, 3, 1)],
    "Sheet2!A1+B1": [("Sheet2", 1, 1, 1, 1), (None, 1, 2, 1, 2)],
    "": [],
    "'My Sheet'!$B$2:D9": [("My Sheet", 2, 2, 9, 4)],
    "'It''s'!A1&\"B2 and \"\"C3\"\"\"&D4": [("It's", 1, 1, 1, 1), (None, 4, 4, 4, 4)],
    "LOG10(A1)+ATAN2(B1,C1)+A1B+TRUE": [(None, 1, 1, 1, 1), (None, 1, 2, 1, 2), (None, 1, 3, 1, 3)],
    "VLOOKUP(A1,Cars!$A:F,2)": [(None, 1, 1, 1, 1), ("Cars", 1, 1, LAST, 6)],
    "STDEV.S(C9:A2)*1e5+x.A1": [(None, 2, 1, 9, 3)],
    "Umsätze!B3+2024!A1": [("Umsätze", 3, 2, 3, 2), ("2024", 1, 1, 1, 1)],
    "XFD1+XFE1+A0+ABCD1": [(None, 1, 16384, 1, 16384)],
    "a1:b2": [(None, 1, 1, 2, 2)],
}


@pytest.mark.parametrize("formula", CASES)
def test_ranges(formula):
    assert references.ranges_of(formula) == CASES[formula]


def test_moved():
    move = references.moved
    assert move("A1+$A1+A$1+$A$1", 2, 1) == "B3+$A3+B$1+$A$1"
    assert move("SUM(A$1:A5)&\"A1\"&LOG10(B2)", 1, 1) == "SUM(B$1:B6)&\"A1\"&LOG10(C3)"
    assert move("'My Sheet'!A2:B3+A:$C", -1, 0) == "'My Sheet'!A1:B2+A:$C"
    assert move("A1+Sheet2!A1:B9+A2", -1, 0) == "#REF!+Sheet2!#REF!+A1" and move("B1+A1", 0, -1) == "A1+#REF!"
    assert move("A:B", 5, 1) == "B:C" and move("no refs", 1, 1) == "no refs" and move("XFD1", 0, 1) == "#REF!"


def test_edges_of_a_sheet(spark):
    rows = [("S", 1, 2, "SUM(A1:A9)"), ("S", 1, 3, "'T t'!B2+$B1"), ("T t", 2, 2, "SUM(S!A:A)"), ("S", 5, 5, None), ("S", 6, 6, "7")]
    formulas = spark.createDataFrame(rows, "sheet string, row int, col int, formula string")
    edges = references.edges(formulas)
    assert {tuple(r) for r in edges.collect()} == {("S", 1, 2, "S", 1, 1, 9, 1), ("S", 1, 3, "T t", 2, 2, 2, 2), ("S", 1, 3, "S", 1, 2, 1, 2), ("T t", 2, 2, "S", 1, 1, LAST, 1)}
    changed = spark.createDataFrame([("S", 3_000_000, 1)], "sheet string, row int, col int")
    assert {tuple(r) for r in grid.reached(edges, changed).collect()} == {("T t", 2, 2), ("S", 1, 3)}


def test_unshared(spark):
    rows = [("p", "S", 3, 4, 'A1&"A1"', "0", "D3:D5"), ("p", "S", 4, 4, None, "0", None), ("p", "S", 5, 5, "", "0", None), ("p", "S", 9, 9, "B1", None, None), ("p", "T", 1, 1, None, "0", None)]
    cells = spark.createDataFrame(rows, "path string, sheet string, row int, col int, formula string, shared string, shared_ref string")
    got = {(r.sheet, r.row, r.col): r.formula for r in references.unshared(cells).collect()}
    assert got == {("S", 3, 4): 'A1&"A1"', ("S", 4, 4): 'A2&"A1"', ("S", 5, 5): 'B3&"A1"', ("S", 9, 9): "B1", ("T", 1, 1): None}
