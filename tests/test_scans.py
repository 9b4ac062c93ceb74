"""Moving ranges, composed columns and tile joins against plain Python."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from gridloom.affine import Affine
from gridloom.functions import call, over
from gridloom.functions.maths import add, divide, multiply, negate, subtract
from gridloom.operators import grid, scans, tiles
from gridloom.operators.scans import Sliding
from gridloom.values import number


def sheet(spark, values):
    tag = lambda x: ("n", float(x), None, None, None) if isinstance(x, int | float) else ("e", None, None, None, x) if x.startswith("#") else ("s", None, x, None, None)
    return spark.createDataFrame([("S", r, c, tag(v)) for (r, c), v in values.items()], grid.CELLS)


def shown(cells):
    out = cells.collect()
    assert len({(r.row, r.col) for r in out}) == len(out)
    return {(r.row, r.col): r.v.e or (r.v.s if r.v.t == "s" else r.v.n) for r in out}


def by_hand(values, total, rows, cols):
    if rows[0] < 1:
        return "#REF!"
    seen = [values.get((r, c)) for r in range(rows[0], rows[1] + 1) for c in range(cols[0], cols[1] + 1)]
    if total == "COUNTA":
        return float(sum(x is not None for x in seen))
    xs = [0.0 if x is None else float(x) for x in seen if x is None or not isinstance(x, str) or x == "7"]
    product = 1.0
    for x in xs:
        product *= x
    got = {"SUM": sum(xs), "SUMSQ": sum(x * x for x in xs), "COUNT": float(len(xs)), "MIN": min(xs, default=0.0), "MAX": max(xs, default=0.0), "PRODUCT": product if xs else 0.0}
    return got[total] if total in got else sum(xs) / len(xs) if xs else "#DIV/0!"


def close(a, b):
    return a == b if isinstance(a, str) or isinstance(b, str) else abs(a - b) <= 1e-9 * max(1, abs(a))


RANGES = [
    Sliding("SUM", (-1, -1), last=0, start=1),
    Sliding("AVERAGE", (-1, -1), first=-2, last=0),
    Sliding("MIN", (-2, -1), first=-6, last=-1),
    Sliding("MAX", (1, 2), first=0, last=9, fixed_cols=True),
    Sliding("COUNT", (-1, -1), first=1, end=40),
    Sliding("COUNTA", (-1, -1), last=3, start=20),
    Sliding("PRODUCT", (-1, -1), first=-1, last=1),
    Sliding("SUMSQ", (-1, -1), first=-40, last=40),
    Sliding("AVERAGE", (1, 1), last=-5, start=10, fixed_cols=True),
]


@pytest.mark.parametrize("block", [1024, 8])
def test_moving_ranges(spark, monkeypatch, block):
    monkeypatch.setattr(scans, "BLOCK_ROWS", block)
    rng = random.Random(1)
    values = {(r, c): rng.choice([rng.randrange(-9, 9), 0.5, "x", "7", "#N/A"]) for r in range(1, 60) for c in (1, 2) if rng.random() < 0.7}
    cells = sheet(spark, values).cache()
    made = [grid.computed(cells, grid.Template("S", (3, 50), (3, 4), {"x": ref}, lambda x: x)).withColumn("sheet", F.lit(str(i))) for i, ref in enumerate(RANGES)]
    got = {(int(r.sheet), r.row, r.col): r.v.e or r.v.n for r in reduce(lambda a, b: a.union(b), made).collect()}
    assert len(got) == 48 * 2 * len(RANGES)
    for (i, row, col), v in got.items():
        ref = RANGES[i]
        a, b = sorted(ref.rows_of(row))
        cols = ref.cols if ref.fixed_cols else (col + ref.cols[0], col + ref.cols[1])
        assert close(v, by_hand(values, ref.total, (a, b), cols)), (ref, row, col)


def test_moving_ranges_of_an_empty_sheet(spark):
    t = grid.Template("S", (1, 5), (2, 2), {"a": Sliding("SUM", (-1, -1), last=0, start=1), "b": Sliding("AVERAGE", (-1, -1), first=0, last=2)}, lambda a, b: add(a, b))
    assert shown(grid.computed(sheet(spark, {(1, 9): 1}), t)) == {(r, 2): 0.0 for r in range(1, 6)}
    with pytest.raises(ValueError):
        Sliding("SUM", (1, 1), start=1, end=2)
    with pytest.raises(ValueError):
        Sliding("MEDIAN", (1, 1), first=1, last=2)


def test_a_column_of_its_own_running_sums(spark):
    """B5 = SUM(B$1:B4) + A5 reads itself, cell by cell."""
    cells = sheet(spark, {(r, 1): r for r in range(1, 5)} | {(1, 2): 1})
    t = grid.Template("S", (2, 4), (2, 2), {"above": Sliding("SUM", (0, 0), last=-1, start=1), "x": grid.Cell(0, -1)}, lambda above, x: add(above, x))
    got, want = shown(grid.recalculated(cells, [t])), [1.0]
    for r in range(2, 5):
        want.append(sum(want) + r)
    assert [got[r, 2] for r in range(1, 5)] == want


def test_moving_ranges_on_a_cycle(spark):
    """A5 = SUM(B4:B6) and B = A of its row: each waits for the other; only the stuck ones are cycles."""
    cells = sheet(spark, {(9, 2): 3, (20, 2): 4})
    a = grid.Template("S", (5, 6), (1, 1), {"x": Sliding("SUM", (1, 1), first=-1, last=1)}, lambda x: x)
    b = grid.Template("S", (5, 5), (2, 2), {"x": grid.Cell(0, -1)}, lambda x: x)
    c = grid.Template("S", (19, 19), (1, 1), {"x": Sliding("SUM", (1, 1), first=-1, last=1)}, lambda x: x)
    got = shown(grid.recalculated(cells, [a, b, c]))
    # A6 reads B5, which waits for A5, but nothing on the ring reads A6
    assert got[5, 1] == got[5, 2] == "#CYCLE!" and got[6, 1] == 0.0 and got[19, 1] == 4.0


def fold(values, rows, start, step):
    out = {}
    for r in rows:
        out[r] = start = step(start, values, r)
    return out


@pytest.mark.parametrize("most", [128, 5])
def test_balance(spark, monkeypatch, most):
    monkeypatch.setattr(scans, "MAPS", most)
    monkeypatch.setattr(grid, "_filled", None)  # by maps, not by folds
    values = {(r, 1): (r * 37) % 11 - 5 for r in range(1, 41)} | {(1, 2): 100, (1, 5): 0.1}
    t = grid.Template("S", (2, 40), (2, 2), {"up": grid.Cell(-1, 0), "x": grid.Cell(0, -1), "rate": grid.Cell(1, 5, fixed=True)}, lambda up, x, rate: add(multiply(up, add(1, rate)), x))
    got = shown(grid.recalculated(sheet(spark, values), [t]))
    want = fold(values, range(2, 41), 100.0, lambda up, v, r: up * 1.1 + v[r, 1])
    assert all(close(got[r, 2], want[r]) for r in want)


BUILDS = [
    lambda up, x, y: divide(subtract(x, up), y),
    lambda up, x, y: add(negate(multiply(0.5, up)), divide(x, y)),
    lambda up, x, y: subtract(add(up, x), multiply(up, y)),
]


@pytest.mark.parametrize("start,build,way", [("word", 0, "down"), ("#N/A", 1, "up"), (None, 2, "two"), ("3", 1, "down")])
def test_composed_as_folded(spark, monkeypatch, start, build, way):
    """Errors, texts, blanks and zeros of divisors give what the fold gives, also upwards and by two."""
    monkeypatch.setattr(scans, "MAPS", 4)
    rng = random.Random(2)
    values = {(r, 1): rng.choice([1, 2, -3, 0.5]) for r in range(1, 40)} | {(r, 3): 1 for r in range(1, 40)}
    values |= {(30, 3): 0, (20, 1): "text", (33, 1): "#REF!", (36, 3): "#NUM!"}
    if start is not None:
        values |= {(3, 2): start, (38, 4): start}
    t = {
        "down": grid.Template("S", (4, 38), (2, 2), {"up": grid.Cell(-1, 0), "x": grid.Cell(0, -1), "y": grid.Cell(0, 1)}, BUILDS[build]),
        "up": grid.Template("S", (1, 37), (4, 4), {"up": grid.Cell(1, 0), "x": grid.Cell(0, -3), "y": grid.Cell(0, -1)}, BUILDS[build]),
        "two": grid.Template("S", (5, 38), (2, 2), {"up": grid.Cell(-2, 0), "x": grid.Cell(0, -1), "y": grid.Cell(0, 1)}, BUILDS[build]),
    }[way]
    cells, own = sheet(spark, values), grid._own_cells(t)
    one, other = shown(grid._composed(cells, t, own)), shown(grid._filled(cells, t, own))
    assert one.keys() == other.keys()
    for k in one:
        assert one[k] == other[k] or close(one[k], other[k]), k


def test_what_is_not_affine():
    x = Affine(F.lit(1.0), F.lit(0.0))
    for build in (lambda: multiply(x, x), lambda: divide(1, x), lambda: call("ROUND", x, 2), lambda: call("IF", x, 1, 2), lambda: grid.as_map(number(1))):
        with pytest.raises(TypeError):
            build()


def test_clipped_at_zero_is_folded(spark):
    """MAX(0, up + x) is no affine function; the fold computes it."""
    values = {(r, 1): (-1) ** r * r for r in range(1, 30)}
    t = grid.Template("S", (1, 29), (2, 2), {"up": grid.Cell(-1, 0), "x": grid.Cell(0, -1)}, lambda up, x: call("MAX", 0, add(up, x)))
    got = shown(grid.recalculated(sheet(spark, values), [t]))
    want = fold(values, range(1, 30), 0.0, lambda up, v, r: max(0.0, up + v[r, 1]))
    assert all(got[r, 2] == want[r] for r in want)


def test_edits_below_the_usual_last_row(spark):
    """An open range has no last row: an edit far below changes its total."""
    cells = sheet(spark, {(1, 1): 1})
    t = grid.Template("S", (1, 1), (2, 2), {"all": grid.Range(None, 1, None, 1, lambda v: over("SUM", v))}, lambda all: all)
    edits = spark.createDataFrame([("S", 2_000_000, 1, ("n", 4.0, None, None, None), 1)], grid.CELLS + ", version long")
    assert shown(grid.edited(grid.recalculated(cells, [t]), [t], edits))[1, 2] == 5.0
    assert grid.affected([t], [("S", 2_000_000, 1)]) == [t]
    far = spark.createDataFrame([("S", 2_000_000, 1)], "sheet string, row int, col int")
    assert grid.reached(grid.edges(spark, [t]), far).count() == 1


def test_covers(spark):
    rng = random.Random(4)
    pairs = [(0, 0), (0, 1), (5, 5), (3, 17), (1, 2**31 - 2), (0, 2**20 - 1)] + [tuple(sorted((rng.randrange(5000), rng.randrange(5000)))) for _ in range(60)]
    for a, b, found in spark.createDataFrame(pairs, "a long, b long").select("a", "b", tiles.cover(F.col("a"), F.col("b"))).collect():
        parts = sorted((t.tile << t.level, (t.tile + 1 << t.level) - 1) for t in found)
        assert parts[0][0] == a and parts[-1][1] == b and all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:], strict=False)), (a, b)
        assert len(parts) <= 62


def test_in_ranges(spark):
    rng = random.Random(6)
    cells = [(rng.choice("ST"), rng.randrange(1, 30000), rng.randrange(1, 40), i) for i in range(800)] + [("S", None, 1, -1), (None, 1, 1, -2)]
    size = lambda: rng.choice([0, 1, 7, 200, 20000])
    boxes = [(rng.choice("ST"), r, c, r + size(), c + rng.choice([0, 1, 20]), i) for i in range(60) for r, c in [(rng.randrange(1, 30000), rng.randrange(1, 40))]]
    boxes += [("S", 1, 3, tiles.LAST, 3, 1000), ("S", 9, 9, 8, 9, 1001), ("S", None, 1, 2, 2, 1002), ("T", 1, 1, tiles.LAST, 16384, 1003)]
    left = spark.createDataFrame(cells, "sheet string, row int, col int, id int")
    right = spark.createDataFrame(boxes, "sheet string, r1 int, c1 int, r2 int, c2 int, id int")
    want = sorted((i, k) for s, r, c, i in cells for t, r1, c1, r2, c2, k in boxes if None not in (s, r, r1) and s == t and r1 <= r <= r2 and c1 <= c <= c2)
    got = sorted((x.cell.id, x.range.id) for x in tiles.in_ranges(left, right).collect())
    assert got == want and want
    inside = {i for i, _ in want}
    assert {x.id for x in tiles.in_ranges(left, right, how="left_semi").collect()} == inside
    assert {x.id for x in tiles.in_ranges(left, right, how="left_anti").collect()} == {c[3] for c in cells} - inside
    assert tiles.in_ranges(left, right.limit(0)).count() == 0 and tiles.in_ranges(left, right.limit(0), how="left_anti").count() == len(cells)


def test_a_cell_is_sent_once_for_ranges_of_like_sizes(spark):
    cells = spark.range(1, 4001).select(F.lit("S").alias("sheet"), F.col("id").cast("int").alias("row"), F.lit(2).alias("col"))
    ranges = spark.range(40).select(F.lit("S").alias("sheet"), (F.col("id") * 100).cast("int").alias("r1"), F.lit(1).alias("c1"), (F.col("id") * 100 + 9 + F.col("id") % 50).cast("int").alias("r2"), F.lit(3).alias("c2"))
    assert tiles.in_ranges(cells, ranges).count() == sum(10 + i % 50 for i in range(40)) - 1  # no cell is in row 0
    for low, high, sizes in [("r1", "r2", 1), ("c1", "c2", 1)]:
        assert ranges.select(F.explode(tiles.touched(F.col(low), F.col(high))).alias("t")).select("t.level").distinct().count() == sizes


def test_merged_cells_show_their_anchor(spark):
    cells = sheet(spark, {(1, 1): 5, (2, 2): 6, (9, 9): 7, (4, 3): 8, (1_500_000, 3): 9})
    merges = spark.createDataFrame([("S", 1, 1, 2, 2), ("S", 4, 3, tiles.LAST, 3), ("S", 20, 20, 30, 30)], "sheet string, r1 int, c1 int, r2 int, c2 int")
    places = spark.createDataFrame([("S", 1, 2), ("S", 2, 2), ("S", 9, 9), ("S", 25, 25), ("S", 1_000_000, 3), ("S", 1, 3)], "sheet string, row int, col int")
    got = {(r.row, r.col): r.v and r.v.n for r in grid.shown_at(places, cells, merges).collect()}
    assert got == {(1, 2): 5, (2, 2): 5, (9, 9): 7, (25, 25): None, (1_000_000, 3): 8, (1, 3): None}
    assert shown(grid.unmerged(cells, merges.where("r2 < 100"))) == {(1, 1): 5, (1, 2): 5, (2, 1): 5, (2, 2): 5, (9, 9): 7, (4, 3): 8, (1_500_000, 3): 9}
