"""Recalculation of templates that read themselves or each other, cell by cell against Python."""

import pytest

from gridloom.functions.maths import add, multiply
from gridloom.operators import grid


def sheet(spark, values):
    rows = [("S", r, c, ("n", float(v), None, None, None)) for (r, c), v in values.items()]
    return spark.createDataFrame(rows, grid.CELLS)


def shown(cells):
    out = cells.collect()
    assert len({(r.row, r.col) for r in out}) == len(out)
    return {(r.row, r.col): r.v.e if r.v.t == "e" else r.v.n for r in out}


@pytest.mark.parametrize("block", [1024, 7])
def test_filled_down(spark, monkeypatch, block):
    monkeypatch.setattr(grid, "FILL_ROWS", block)
    cells = sheet(spark, {(r, 1): r * r for r in range(1, 31)} | {(1, 2): 100})
    balance = grid.Template("S", (2, 30), (2, 2), {"up": grid.Cell(-1, 0), "x": grid.Cell(0, -1)}, lambda up, x: add(up, x))
    twice = grid.Template("S", (2, 30), (3, 3), {"b": grid.Cell(0, -1)}, lambda b: multiply(b, 2))
    got = shown(grid.recalculated(cells, [twice, balance]))
    want = 100
    for r in range(2, 31):
        want += r * r
        assert got[r, 2] == want and got[r, 3] == 2 * want


def test_filled_up_by_two(spark, monkeypatch):
    monkeypatch.setattr(grid, "FILL_ROWS", 4)
    cells = sheet(spark, {(11, 1): 1, (12, 1): 1})
    back = grid.Template("S", (1, 10), (1, 1), {"a": grid.Cell(1, 0), "b": grid.Cell(2, 0)}, lambda a, b: add(a, b))
    got = shown(grid.recalculated(cells, [back]))
    assert [got[r, 1] for r in range(12, 0, -1)] == [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]


def test_each_other_without_a_cycle(spark):
    cells = sheet(spark, {(1, 1): 3})
    one = grid.Template("S", (2, 5), (1, 1), {"x": grid.Cell(-1, 1)}, lambda x: add(x, 1))
    other = grid.Template("S", (1, 4), (2, 2), {"x": grid.Cell(0, -1)}, lambda x: multiply(x, 2))
    got = shown(grid.recalculated(cells, [one, other]))
    a = 3
    for r in range(1, 5):
        assert (got[r, 1], got[r, 2]) == (a, 2 * a)
        a = 2 * a + 1
    assert got[5, 1] == a


def test_only_cells_on_a_cycle_are_stuck(spark):
    cells = sheet(spark, {(2, 3): 5})
    # A1 and B1 read each other, A2 reads B2 = C2; D reads A
    one = grid.Template("S", (1, 2), (1, 1), {"x": grid.Cell(0, 1)}, lambda x: add(x, 1))
    b1 = grid.Template("S", (1, 1), (2, 2), {"x": grid.Cell(0, -1)}, lambda x: add(x, 1))
    b2 = grid.Template("S", (2, 2), (2, 2), {"x": grid.Cell(0, 1)}, lambda x: add(x, 1))
    d = grid.Template("S", (1, 2), (4, 4), {"x": grid.Cell(0, -3)}, lambda x: multiply(x, 2))
    got = shown(grid.recalculated(cells, [one, b1, b2, d]))
    assert got == {(1, 1): "#CYCLE!", (1, 2): "#CYCLE!", (1, 4): "#CYCLE!", (2, 1): 7, (2, 2): 6, (2, 3): 5, (2, 4): 14}
    kept = shown(grid.recalculated(cells, [one, b1, b2, d], sheet(spark, {(1, 1): 8, (1, 2): 9})))
    assert kept[1, 1] == 8 and kept[1, 2] == 9 and kept[1, 4] == 16


EDGES = "sheet string, row int, col int, src_sheet string, r1 int, c1 int, r2 int, c2 int"


def test_reached_over_a_long_chain(spark):
    edges = [("S", r, 1, "S", r - 1, 1, r - 1, 1) for r in range(2, 1502)] + [("S", r, 2, "S", r, 1, r, 1) for r in range(1400, 1502)]
    edges += [("T", 1, 1, "S", 1450, 2, 1460, 2), ("T", 2, 1, "T", 1, 1, 1, 1), ("T", 1, 2, "T", 2, 2, 2, 2), ("T", 2, 2, "T", 1, 2, 1, 2)]
    changed = spark.createDataFrame([("S", 300, 1)], "sheet string, row int, col int")
    got = [tuple(r) for r in grid.reached(spark.createDataFrame(edges, EDGES), changed).collect()]
    want = {("S", r, 1) for r in range(301, 1502)} | {("S", r, 2) for r in range(1400, 1502)} | {("T", 1, 1), ("T", 2, 1)}
    assert len(got) == len(want) and set(got) == want


def test_reached_by_ranges_and_rings(spark):
    edges = [("S", 1, 2, "S", 1, 1, 9, 1), ("S", 1, 3, "S", 1, 2, 2, 3), ("S", 2, 3, "S", 1, 3, 1, 3), ("S", 1, 2, "S", 2, 3, 2, 3), ("S", 5, 5, "S", 6, 6, 6, 6)]
    table = spark.createDataFrame(edges, EDGES)
    for place, want in [(("S", 4, 1), {("S", 1, 2), ("S", 1, 3), ("S", 2, 3)}), (("S", 10, 1), set())]:
        got = grid.reached(table, spark.createDataFrame([place], "sheet string, row int, col int")).collect()
        assert {tuple(r) for r in got} == want
