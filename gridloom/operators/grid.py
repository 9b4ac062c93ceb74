"""Sheets as one sparse table of cells, and recalculation over it.

``cells``: sheet, row, col (from 1) and ``v``, a tagged struct (``gridloom.values.CELL_TYPE``). A
formula is a ``Template``: an area of target cells, named references relative to a target or
ranges, and a builder of the value. All targets of a template are computed by one plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..affine import Affine, NotAffine
from ..storage import Grown, written
from ..values import CELL_TYPE, CYCLE, Value, as_cell, cell
from .scans import Sliding, as_map, followed, sliding_totals
from .tiles import LAST, in_ranges

CELLS = f"sheet string, row int, col int, v {CELL_TYPE}"
_EMPTY = "struct('empty' as t, cast(null as double) as n, cast(null as string) as s, cast(null as boolean) as b, cast(null as string) as e)"


def infer(text: Column) -> Column:
    """The cell that an entered text becomes: empty, number, boolean, error or text."""
    number = F.when(F.trim(text) != "", text.try_cast("double"))
    plain = F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    tag = F.when(text.isNull() | (text == ""), "empty").when(plain, "n").when(F.lower(text).isin("true", "false"), "b").when(text.rlike(r"^#.*!$"), "e").otherwise("s")
    return F.struct(
        tag.alias("t"),
        F.when(tag == "n", number).alias("n"),
        F.when(tag == "s", text).alias("s"),
        F.when(tag == "b", F.lower(text) == "true").alias("b"),
        F.when(tag == "e", text).alias("e"),
    )


def number_cell(value: Column) -> Column:
    """The cell of a number; null is a blank one."""
    return as_cell(Value("number", value.cast("double"), blank=True))


def with_edits(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """``cells`` after ``edits`` (sheet, row, col, v, version): the last version of a cell counts, and an
    empty one removes it."""
    both = cells.withColumn("version", F.lit(-1).cast("long")).unionByName(edits.withColumn("version", F.col("version").cast("long")))
    last = both.groupBy("sheet", "row", "col").agg(F.max_by("v", "version").alias("v"))
    return last.where(F.col("v.t") != "empty")


def area(cells: DataFrame, sheet: str, r1: int | None, c1: int, r2: int | None, c2: int) -> DataFrame:
    """The filled cells of a range; rows of None leave it open (whole columns)."""
    inside = (F.col("sheet") == sheet) & F.col("col").between(c1, c2)
    if r1 is not None:
        inside &= F.col("row").between(r1, r2)
    return cells.where(inside)


def blanks(count: int | None, filled: Column) -> Column:
    """Blank cells of a range of ``count`` cells, which aggregates see as zeros, without making them."""
    return F.lit(0) if count is None else F.lit(count) - filled


def anchored(places: DataFrame, merges: DataFrame) -> DataFrame:
    """``places`` (sheet, row, col and others) with ``anchor_row`` and ``anchor_col``: the first cell of
    the merged range (sheet, r1, c1, r2, c2) that covers the place, or the place itself. Merged
    ranges don't overlap; where they do, the least anchor counts."""
    found = in_ranges(places.select("sheet", "row", "col").distinct(), merges.select("sheet", "r1", "c1", "r2", "c2"))
    least = found.groupBy(*[F.col(f"cell.{c}").alias(c) for c in ("sheet", "row", "col")]).agg(F.min(F.struct("range.r1", "range.c1")).alias("_a"))
    own = [F.col("_row").getField(c).alias(c) for c in places.columns]
    keyed = places.select(F.struct("*").alias("_row"), "sheet", "row", "col").join(least, ["sheet", "row", "col"], "left")
    return keyed.select(*own, F.coalesce("_a.r1", "row").alias("anchor_row"), F.coalesce("_a.c1", "col").alias("anchor_col"))


def shown_at(places: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    """``places`` (sheet, row, col) with ``v``, what a reference to them reads: covered cells of merged
    ranges show their anchor's value; null where that is blank. No row is made for other cells."""
    values = cells.select("sheet", F.col("row").alias("anchor_row"), F.col("col").alias("anchor_col"), "v")
    return anchored(places.select("sheet", "row", "col"), merges).join(values, ["sheet", "anchor_row", "anchor_col"], "left").select("sheet", "row", "col", "v")


def unmerged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """``cells`` with covered cells of merged ranges (sheet, r1, c1, r2, c2) showing their anchor's value.
    The result has a row for every cell that a filled anchor covers; ``shown_at`` answers for given
    places only."""
    ranges = merges.select("sheet", "r1", "c1", "r2", "c2").distinct()
    rest = in_ranges(cells.select("sheet", "row", "col", "v"), ranges, how="left_anti")
    anchors = cells.select("sheet", F.col("row").alias("r1"), F.col("col").alias("c1"), "v")
    filled = ranges.join(anchors, ["sheet", "r1", "c1"])
    shown = filled.withColumn("row", F.explode(F.sequence("r1", "r2"))).withColumn("col", F.explode(F.sequence("c1", "c2")))
    return rest.select("sheet", "row", "col", "v").unionByName(shown.select("sheet", "row", "col", "v"))


def as_table(cells: DataFrame, sheet: str, columns: dict[int, tuple[str, str]], first_row: int = 2) -> DataFrame:
    """Rows of a sheet as a typed table: ``columns`` maps a column number to its name and type
    (double, string or boolean)."""
    part = {"double": "n", "string": "s", "boolean": "b"}
    rows = cells.where((F.col("sheet") == sheet) & (F.col("row") >= first_row) & F.col("col").isin(list(columns)))
    pick = [F.max(F.when(F.col("col") == c, F.col("v")[part[kind]])).alias(name) for c, (name, kind) in columns.items()]
    return rows.groupBy("row").agg(*pick)


def from_table(df: DataFrame, sheet: str, row: Column, names: list[str], first_col: int = 1) -> DataFrame:
    """Columns of a table as cells."""
    kinds = dict(df.dtypes)
    made = []
    for i, name in enumerate(names):
        kind = "logical" if kinds[name] == "boolean" else "text" if kinds[name] == "string" else "number"
        made.append(F.struct(F.lit(first_col + i).alias("col"), as_cell(Value(kind, F.col(name) if kind != "number" else F.col(name).cast("double"), blank=True)).alias("v")))
    return df.select(F.lit(sheet).alias("sheet"), row.cast("int").alias("row"), F.explode(F.array(*made)).alias("c")).select("sheet", "row", "c.col", "c.v").where(F.col("v.t") != "empty")


@dataclass(frozen=True)
class Cell:
    """A cell at a distance from the target, or (``fixed``) at a place."""

    row: int
    col: int
    sheet: str | None = None
    fixed: bool = False


@dataclass(frozen=True)
class Range:
    """A fixed range whose aggregate is ``total(value)``; rows of None mean whole columns."""

    r1: int | None
    c1: int
    r2: int | None
    c2: int
    total: Callable[[Value], Value]
    sheet: str | None = None


@dataclass(frozen=True)
class Template:
    """A formula that fills ``rows`` x ``cols`` of a sheet."""

    sheet: str
    rows: tuple[int, int]
    cols: tuple[int, int]
    inputs: dict[str, Cell | Range | Sliding]
    build: Callable[..., Value]
    name: str = field(default="")


def targets(spark: SparkSession, t: Template) -> DataFrame:
    rows = spark.range(t.rows[0], t.rows[1] + 1).select(F.col("id").cast("int").alias("row"))
    return rows.withColumn("col", F.explode(F.sequence(F.lit(t.cols[0]), F.lit(t.cols[1])))).select(F.lit(t.sheet).alias("sheet"), "row", "col")


def outside(cells: DataFrame, t: Template) -> DataFrame:
    """The cells that are no targets of a template."""
    inside = (F.col("sheet") == t.sheet) & F.col("row").between(*t.rows) & F.col("col").between(*t.cols)
    return cells.where(~F.coalesce(inside, F.lit(False)))


def edges(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """What each target reads, at range granularity: sheet, row, col, and the source's sheet, r1, c1, r2, c2."""
    out = None
    for t in templates:
        for ref in t.inputs.values():
            if isinstance(ref, Cell):
                r = F.lit(ref.row) if ref.fixed else F.col("row") + ref.row
                c = F.lit(ref.col) if ref.fixed else F.col("col") + ref.col
                box = (r, c, r, c)
            elif isinstance(ref, Sliding):
                ends = [F.lit(x) if isinstance(x, int) else x for x in ref.rows_of(F.col("row"))]
                cols = [F.lit(c) if ref.fixed_cols else F.col("col") + c for c in ref.cols]
                box = (F.greatest(F.least(*ends), F.lit(1)), cols[0], F.greatest(*ends), cols[1])
            else:
                box = (F.lit(ref.r1 or 1), F.lit(ref.c1), F.lit(ref.r2 or LAST), F.lit(ref.c2))
            one = targets(spark, t).select("*", F.lit(ref.sheet or t.sheet).alias("src_sheet"), *[x.cast("int").alias(n) for x, n in zip(box, ("r1", "c1", "r2", "c2"), strict=True)])
            out = one if out is None else out.unionByName(one)
    return out


def _reads(one: Template, other: Template) -> bool:
    """Whether some target of ``one`` reads a target of ``other``."""
    for ref in one.inputs.values():
        if (ref.sheet or one.sheet) != other.sheet:
            continue
        if isinstance(ref, Range):
            rows, cols = (ref.r1 or 1, ref.r2 or math.inf), (ref.c1, ref.c2)
        elif isinstance(ref, Sliding):
            rows, cols = ref.span(one.rows), ref.cols if ref.fixed_cols else (one.cols[0] + ref.cols[0], one.cols[1] + ref.cols[1])
        elif ref.fixed:
            rows, cols = (ref.row, ref.row), (ref.col, ref.col)
        else:
            rows, cols = (one.rows[0] + ref.row, one.rows[1] + ref.row), (one.cols[0] + ref.col, one.cols[1] + ref.col)
        if rows[0] <= other.rows[1] and other.rows[0] <= rows[1] and cols[0] <= other.cols[1] and other.cols[0] <= cols[1]:
            return True
    return False


def levels(templates: list[Template]) -> list[tuple[list[Template], bool]]:
    """Templates in groups, each of which reads only earlier ones and, where it says so, itself: the
    least sets of templates that read each other or themselves. Whether their cells do, ``recalculated``
    sees."""
    waiting, out = list(templates), []
    while waiting:
        free = [t for t in waiting if not any(_reads(t, o) for o in waiting)]
        if free:
            out.append((free, False))
        else:
            n = len(waiting)
            reach = [{j for j in range(n) if _reads(waiting[i], waiting[j])} for i in range(n)]
            for k in range(n):
                for r in reach:
                    if k in r:
                        r |= reach[k]
            # the set that reaches fewest others reaches nothing but itself
            free = [waiting[j] for j in sorted(min(reach, key=len))]
            out.append((free, True))
        waiting = [t for t in waiting if not any(t is f for f in free)]
    return out


def _with_inputs(cells: DataFrame, t: Template, out: DataFrame, inputs: dict[str, Cell | Range | Sliding]) -> DataFrame:
    """Target cells ``out`` beside the values of ``inputs``: one equi-join for each cell, one aggregate
    of a single row for each fixed range, one scan for each that moves."""
    for name, ref in inputs.items():
        source = cells.where(F.col("sheet") == (ref.sheet or t.sheet))
        if isinstance(ref, Range):
            total = area(cells, ref.sheet or t.sheet, ref.r1, ref.c1, ref.r2, ref.c2).agg(as_cell(ref.total(cell("v"))).alias(f"_{name}"))
            out = out.crossJoin(F.broadcast(total))  # one row
        elif isinstance(ref, Sliding):
            totals = sliding_totals(cells, ref, t.sheet, out.select("row", "col"), t.rows, t.cols)
            out = out.join(totals.withColumnRenamed("v", f"_{name}"), ["row", "col"], "left")
        elif ref.fixed:
            one = source.where((F.col("row") == ref.row) & (F.col("col") == ref.col)).agg(F.first("v").alias(f"_{name}"))
            out = out.crossJoin(F.broadcast(one))  # one row
        else:
            moved = source.select((F.col("row") - ref.row).alias("row"), (F.col("col") - ref.col).alias("col"), F.col("v").alias(f"_{name}"))
            out = out.join(moved, ["row", "col"], "left")
    return out


def computed(cells: DataFrame, t: Template, out: DataFrame | None = None) -> DataFrame:
    """The target cells of a template, or those of them in ``out``."""
    out = _with_inputs(cells, t, targets(cells.sparkSession, t) if out is None else out, t.inputs)
    values = {name: cell(F.coalesce(F.col(f"_{name}"), F.expr(_EMPTY))) for name in t.inputs}
    return out.select("sheet", "row", "col", as_cell(t.build(**values)).alias("v"))


_PLACE = ["sheet", "row", "col"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: Rows of a filled-down template that one job computes.
FILL_ROWS = 1024


def _own_cells(t: Template) -> dict[str, Cell]:
    """The inputs by which a template reads itself, if it only reads cells above it in the same column
    or only cells below; else nothing."""
    own = {name: ref for name, ref in t.inputs.items() if _reads(Template(t.sheet, t.rows, t.cols, {name: ref}, t.build), t)}
    steps = [ref.row if isinstance(ref, Cell) and not ref.fixed and ref.col == 0 else 0 for ref in own.values()]
    return own if all(s < 0 for s in steps) or all(s > 0 for s in steps) else {}


def _composed(cells: DataFrame, t: Template, own: dict[str, Cell]) -> DataFrame:
    """A template whose value is affine in the one cell above (or below) that it reads, by composed maps
    (``scans.followed``); raises ``NotAffine`` for any other."""
    if len(own) != 1:
        raise NotAffine("several cells")
    ((name, ref),) = own.items()
    back, down = abs(ref.row), ref.row < 0
    others = {n: r for n, r in t.inputs.items() if n != name}
    values = {n: cell(F.coalesce(F.col(f"_{n}"), F.expr(_EMPTY))) for n in others} | {name: Affine(F.lit(1.0), F.lit(0.0))}
    made = as_map(t.build(**values))
    at = (F.col("row") - t.rows[0]) if down else (t.rows[1] - F.col("row"))
    chain = lambda place: F.struct("col", F.pmod(place, F.lit(back)).alias("k")).alias("_chain")
    inputs = _with_inputs(cells, t, targets(cells.sparkSession, t), others)
    maps = inputs.select(chain(at), F.floor(at / back).alias("_at"), made.alias("_map"))
    # chains start from the cells before the first targets, blank or not
    before = replace(t, rows=(t.rows[0] - back, t.rows[0] - 1) if down else (t.rows[1] + 1, t.rows[1] + back))
    known = cells.where(F.col("sheet") == t.sheet).select("row", "col", "v")
    starts = targets(cells.sparkSession, before).join(known, ["row", "col"], "left").select(chain(at + back), F.coalesce("v", F.expr(_EMPTY).cast(CELL_TYPE)).alias("v"))
    done = followed(maps, starts, -(-(t.rows[1] - t.rows[0] + 1) // back))
    place = F.col("_at") * back + F.col("_chain.k")
    row = (place + t.rows[0]) if down else (F.lit(t.rows[1]) - place)
    return done.select(F.lit(t.sheet).alias("sheet"), row.cast("int").alias("row"), "_chain.col", F.col("v").cast(CELL_TYPE).alias("v"))


def _filled(cells: DataFrame, t: Template, own: dict[str, Cell]) -> DataFrame:
    """A template whose cells read those above (or below) them: its other inputs are joined at once,
    and each column is folded over ``FILL_ROWS`` rows a job, which start from the values before them."""
    spark, back = cells.sparkSession, max(abs(ref.row) for ref in own.values())
    down = next(iter(own.values())).row < 0
    others = [name for name in t.inputs if name not in own]
    inputs = written(_with_inputs(cells, t, targets(spark, t), {name: t.inputs[name] for name in others}), "inputs")
    at = (F.col("row") - t.rows[0]) if down else (t.rows[1] - F.col("row"))
    columns = Grown(cells.where((F.col("sheet") == t.sheet) & F.col("col").between(*t.cols) & at.between(-back, -1)).select(*_PLACE, F.col("v").cast(CELL_TYPE).alias("v")), "filled")
    made = columns.table()

    def step(done: Column, x: Column) -> Column:
        values = {name: F.element_at(done, -abs(ref.row)) for name, ref in own.items()} | {name: F.coalesce(x[f"_{name}"], F.expr(_EMPTY)) for name in others}
        return F.concat(done, F.array(as_cell(t.build(**{name: cell(v) for name, v in values.items()})).cast(CELL_TYPE)))

    empty = F.expr(_EMPTY).cast(CELL_TYPE)
    for first in range(0, t.rows[1] - t.rows[0] + 1, FILL_ROWS):
        known = made.where(at.between(first - back, first - 1)).groupBy("col").agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int"), "v"))).alias("_known"))
        rows = inputs.where(at.between(first, first + FILL_ROWS - 1)).groupBy("col").agg(F.array_sort(F.collect_list(F.struct(at.cast("int").alias("_at"), "row", *[f"_{name}" for name in others]))).alias("_rows"))
        start = F.transform(F.sequence(F.lit(first - back), F.lit(first - 1)), lambda k: F.coalesce(F.col("_known")[k], empty))
        folded = rows.join(known, "col", "left").select("col", "_rows", F.slice(F.aggregate("_rows", start, step), back + 1, FILL_ROWS).alias("_v"))
        out = folded.select("col", F.explode(F.arrays_zip(F.col("_rows.row").alias("row"), F.col("_v").alias("v"))).alias("_c"))
        made = columns.add(out.select(F.lit(t.sheet).alias("sheet"), "_c.row", "col", "_c.v"))
    return made.where(at >= 0)


_SEEN = "struct('n' as t, 1.0D as n, cast(null as string) as s, cast(null as boolean) as b, cast(null as string) as e)"


def _of(t: Template, ref: Cell | Range | Sliding, places: DataFrame, own: DataFrame) -> tuple[DataFrame, bool]:
    """Those of the targets ``own`` that read some of ``places`` by ``ref``: row and col, or any row where
    all targets read the same cells."""
    there = places.where(F.col("sheet") == (ref.sheet or t.sheet))
    if isinstance(ref, Sliding):
        counted = sliding_totals(there.withColumn("v", F.expr(_SEEN)), replace(ref, total="COUNTA"), t.sheet, own, t.rows, t.cols, clipped=True)
        return counted.where("v.n > 0").select("row", "col"), True
    if isinstance(ref, Range):
        return area(there, ref.sheet or t.sheet, ref.r1, ref.c1, ref.r2, ref.c2).limit(1), False
    if ref.fixed:
        return there.where((F.col("row") == ref.row) & (F.col("col") == ref.col)).limit(1), False
    return there.select((F.col("row") - ref.row).alias("row"), (F.col("col") - ref.col).alias("col")), True


def _read_by(t: Template, own: DataFrame, places: DataFrame) -> DataFrame:
    """Those of ``places`` that cells ``own`` of a template read."""
    out = places.limit(0)
    for ref in t.inputs.values():
        there = places.where(F.col("sheet") == (ref.sheet or t.sheet))
        if isinstance(ref, Sliding):
            out = out.unionByName(_read_by_sliding(t, ref, own, there))
            continue
        if isinstance(ref, Cell) and not ref.fixed:
            read = there.join(own.select((F.col("row") + ref.row).alias("row"), (F.col("col") + ref.col).alias("col")), ["row", "col"], "left_semi").select(*_PLACE)
        else:
            box = Range(ref.row, ref.col, ref.row, ref.col, None) if isinstance(ref, Cell) else ref
            read = area(there, ref.sheet or t.sheet, box.r1, box.c1, box.r2, box.c2).join(own.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_semi")
        out = out.unionByName(read)
    return out.distinct()


def _read_by_sliding(t: Template, ref: Sliding, own: DataFrame, there: DataFrame) -> DataFrame:
    """Those of the places ``there`` that lie in a moving range of some of the targets ``own``: the same
    count, seen from the place."""
    low, high = ref.cols
    across = {"cols": t.cols, "fixed_cols": True} if ref.fixed_cols else {"cols": (-high, -low)}
    there = there.where(F.col("col").between(low, high)) if ref.fixed_cols else there
    if ref.start is None and ref.end is None:
        views = [(there, Sliding("COUNTA", first=-max(ref.first, ref.last), last=-min(ref.first, ref.last), **across))]
    else:
        fixed, move = (ref.start, ref.last) if ref.start is not None else (ref.end, ref.first)
        # a place below the fixed row is read by targets from it on, one above by those up to it
        views = [(there.where(F.col("row") >= fixed), Sliding("COUNTA", first=-move, end=t.rows[1], **across)), (there.where(F.col("row") <= fixed), Sliding("COUNTA", start=t.rows[0], last=-move, **across))]
    seen = own.withColumn("v", F.expr(_SEEN))
    rows = ref.span(t.rows)
    cols = (low, high) if ref.fixed_cols else (t.cols[0] + low, t.cols[1] + high)
    inside = F.col("row").between(*rows) & F.col("col").between(*cols)
    found = []
    for places, view in views:
        near = places.where(inside)
        if view.end is not None:
            near = near.where(F.col("row") + view.first <= view.end)
        if view.start is not None:
            near = near.where(F.col("row") + view.last >= view.start)
        counted = sliding_totals(seen, replace(view, sheet=t.sheet), t.sheet, near.select("row", "col"), rows, cols, clipped=True).where("v.n > 0").select("row", "col")
        found.append(near.join(counted, ["row", "col"], "left_semi").select(*_PLACE))
    return _union(found)


def _cell_by_cell(cells: DataFrame, group: list[Template], cached: DataFrame | None) -> DataFrame:
    """Templates that read each other or themselves: wave by wave the cells that wait for no other,
    written in between. Where all wait, those on cycles (or between two) get their value first."""
    spark = cells.sparkSession
    mine = []
    for i, t in enumerate(group):
        own = targets(spark, t)
        for later in group[i + 1 :]:
            own = outside(own, later)
        mine.append(own)
    waves = Grown(cells.select(*_PLACE, F.col("v").cast(CELL_TYPE).alias("v")).limit(0), "waves")
    done = waves.table()
    count, total = 0, sum(own.count() for own in mine)
    while count < total:
        left = [own.join(done, _PLACE, "left_anti") for own in mine]
        still = _union(left)
        now, ready = cells.select(*_PLACE, "v").unionByName(done), []
        for t, own in zip(group, left, strict=True):
            for ref in t.inputs.values():
                busy, by_place = _of(t, ref, still, own.select("row", "col"))
                own = own.join(busy, ["row", "col"] if by_place else F.lit(True), "left_anti")
            ready.append(computed(now, t, own.select(*_PLACE)))
        done = waves.add(_union(ready))
        before, count = count, done.count()
        if count == before:
            ring, size = [written(own, "ring") for own in left], -1
            while size != (size := sum(own.count() for own in ring)):
                every = _union(ring)
                read = _union([_read_by(t, own, every) for t, own in zip(group, ring, strict=True)]).distinct()
                ring = [written(own.join(read, _PLACE, "left_semi"), "ring") for own in ring]
            done = waves.add(_stuck(_union(ring), cached))
            count = done.count()
    return done


def _stuck(places: DataFrame, cached: DataFrame | None) -> DataFrame:
    code = F.expr(f"struct('e' as t, cast(null as double) as n, cast(null as string) as s, cast(null as boolean) as b, '{CYCLE}' as e)")
    if cached is None:
        return places.withColumn("v", code)
    return places.join(cached.select(*_PLACE, F.col("v").alias("_v")), _PLACE, "left").select(*_PLACE, F.coalesce("_v", code).alias("v"))


def recalculated(cells: DataFrame, templates: list[Template], cached: DataFrame | None = None) -> DataFrame:
    """``cells`` with all templates computed, group by group. Cells on a cycle keep the value that the
    file had (``cached``) or become #CYCLE!; cells that read them are computed from that."""
    for group, loops in levels(templates):
        if loops:
            base = cells
            for t in group:
                base = outside(base, t)
            base = written(base.select(*_PLACE, "v"), "base")
            own = _own_cells(group[0]) if len(group) == 1 else {}
            try:
                made = _composed(base, group[0], own) if own else _cell_by_cell(base, group, cached)
            except TypeError:  # not affine
                made = _filled(base, group[0], own)
            cells = base.unionByName(made)
            continue
        made = [computed(cells, t) for t in group]
        for t, new in zip(group, made, strict=True):
            cells = outside(cells, t).select("sheet", "row", "col", "v").unionByName(new)
    return cells


def affected(templates: list[Template], changed: list[tuple[str, int, int]]) -> list[Template]:
    """The templates that an edit of some cells reaches, directly or through others."""
    points = [Template(s, (r, r), (c, c), {}, lambda: None) for s, r, c in changed]
    hit: list[Template] = []
    front = points
    while front:
        front = [t for t in templates if t not in hit and any(_reads(t, p) for p in front)]
        hit += front
    return hit


def edited(cells: DataFrame, templates: list[Template], edits: DataFrame) -> DataFrame:
    """Apply edits and compute again only what they reach. The edited places, a user's input, are
    read on the driver."""
    places = [(r["sheet"], r["row"], r["col"]) for r in edits.select("sheet", "row", "col").distinct().collect()]
    return recalculated(with_edits(cells, edits), affected(templates, places))


def _jumps(edge_table: DataFrame) -> list[DataFrame]:
    """For every cell one cell that it reads (a corner of a range, which reads others itself), and those
    2, 4, 8, ... such steps away, as far as there are any: sheet, row, col and a_sheet, a_row, a_col."""
    ends = [F.struct(F.col("src_sheet").alias("sheet"), F.col(f"r{k}").alias("row"), F.col(f"c{k}").alias("col")) for k in (1, 2)]
    cells = edge_table.select(*_PLACE).distinct()
    corners = edge_table.select(F.struct(*_PLACE).alias("me"), F.explode(F.array(*ends)).alias("a")).where(~F.col("a").eqNullSafe(F.col("me")))
    targets = cells.select(F.struct(*_PLACE).alias("a"))
    one = corners.join(targets, "a", "left_semi").groupBy("me").agg(F.max("a").alias("a"))
    names = [f"a_{c}" for c in _PLACE]
    flat = [*[F.col(f"me.{c}").alias(c) for c in _PLACE], *[F.col(f"a.{c}").alias(n) for c, n in zip(_PLACE, names, strict=True)]]
    out = [written(one.select(*flat), "jumps")]
    # longer than all cells in a row are only rings
    for _ in range(max(0, out[0].count() - 1).bit_length()):
        last = out[-1]
        on = last.select(*[F.col(c).alias(f"a_{c}") for c in _PLACE], *[F.col(n).alias(f"b{n}") for n in names])
        longer = written(last.join(on, names).select(*_PLACE, *[F.col(f"b{n}").alias(n) for n in names]), "jumps")
        if longer.isEmpty():
            break
        out.append(longer)
    return out


def reached(edge_table: DataFrame, changed: DataFrame) -> DataFrame:
    """Cells (sheet, row, col) that depend on ``changed`` ones, for dependency tables that are data
    rather than templates. All edges of the newest cells are joined until there are none; in between,
    chains are followed by jumps of doubled length, so that a long one takes a few rounds."""
    edge_table = written(edge_table, "edges")
    jumps = _jumps(edge_table)
    seen = front = written(changed.select(*_PLACE).distinct(), "reached")
    boxes = edge_table.select(F.col("src_sheet").alias("sheet"), "r1", "c1", "r2", "c2", F.struct(*_PLACE).alias("reader"))
    while not front.isEmpty():
        hit = in_ranges(front, boxes).select("range.reader.*")
        front = written(hit.select(*_PLACE).distinct().join(seen, _PLACE, "left_anti"), "front")
        if front.isEmpty():
            break
        new = front
        for jump in jumps:
            there = new.select(*[F.col(c).alias(f"a_{c}") for c in _PLACE])
            far = jump.join(there, [f"a_{c}" for c in _PLACE], "left_semi").select(*_PLACE)
            new = written(new.unionByName(far).distinct(), "chain")
        front = written(new.join(seen, _PLACE, "left_anti"), "front")
        seen = written(seen.unionByName(front), "reached")
    return seen.join(changed.select(*_PLACE), _PLACE, "left_anti")
