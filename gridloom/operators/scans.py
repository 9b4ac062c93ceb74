"""Ranges that move with their target, and columns whose cells read the one above, as scans.

A running range (SUM(A$1:A5) filled down) is folded block by block, the totals of blocks are
carried, and each block is finished from what was carried into it. A sliding one (AVERAGE(A3:A5))
is put together from the end of one block and the start of the next, blocks being as long as the
range; nothing is subtracted, so sums don't lose digits and MIN and MAX go the same way.

A cell that is a * (cell above) + b is a map, and maps compose. They are composed in blocks, and
blocks of blocks, until one is left; then values go back down. All of it is one plan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..affine import Affine, NotAffine
from ..storage import written
from ..values import DIV0, REF, Value, as_cell, cell, num, result

#: Rows of a block at least; blocks of a running range grow with the square root of its rows.
BLOCK_ROWS = 1024
#: Maps that are composed in one array.
MAPS = 128


@dataclass(frozen=True)
class Sliding:
    """A range whose rows move with the target. It begins ``first`` rows from it or at the fixed row
    ``start``, and ends ``last`` rows from it or at the fixed row ``end``; of these one end at most is
    fixed. ``cols`` are its first and last column, from the target's or (``fixed_cols``) as they are.

    ``total`` is SUM, SUMSQ, PRODUCT, COUNT, COUNTA, AVERAGE, MIN or MAX. Blank cells count as
    zeros, as they do wherever a range is read cell by cell. A target whose range would begin above
    the first row is #REF!.
    """

    total: str
    cols: tuple[int, int]
    first: int | None = None
    last: int | None = None
    start: int | None = None
    end: int | None = None
    fixed_cols: bool = False
    sheet: str | None = None

    def __post_init__(self):
        if (self.first is None) == (self.start is None) or (self.last is None) == (self.end is None) or (self.start is not None and self.end is not None):
            raise ValueError("each end of a moving range is either fixed or at a distance, and one of them is at a distance")
        if self.total not in _MERGE:
            raise ValueError(f"no scan for {self.total}")

    def rows_of(self, row):
        """First and last row, in either order, for a target row (a number or a column)."""
        return (row + self.first if self.start is None else self.start), (row + self.last if self.end is None else self.end)

    def span(self, rows: tuple[int, int]) -> tuple[int, int]:
        """Rows that targets in ``rows`` read."""
        ends = [x for r in rows for x in self.rows_of(r)]
        return min(ends), max(ends)


_MERGE = {"SUM": F.sum, "SUMSQ": F.sum, "PRODUCT": F.product, "COUNT": F.sum, "COUNTA": F.sum, "AVERAGE": F.sum, "MIN": F.min, "MAX": F.max}
_STATE = ("_filled", "_n", "_acc")


def _merged(total: str) -> dict[str, Column]:
    return {"_filled": F.sum("_filled"), "_n": F.sum("_n"), "_acc": _MERGE[total]("_acc")}


def _finished(total: str, size: Column) -> Value:
    """The value of a range of ``size`` cells from its state."""
    filled, n, acc = F.coalesce("_filled", F.lit(0)), F.coalesce("_n", F.lit(0)), F.col("_acc")
    blank = size - filled
    numbers = (n + blank).cast("double")
    if total == "COUNT":
        return Value("number", numbers)
    if total == "COUNTA":
        return Value("number", filled.cast("double"))
    if total == "AVERAGE":
        return result("number", F.coalesce(acc, F.lit(0.0)) / F.when(numbers > 0, numbers), (numbers == 0, DIV0))
    zero = F.when(blank > 0, F.lit(0.0))
    if total in ("MIN", "MAX"):
        return Value("number", F.coalesce((F.least if total == "MIN" else F.greatest)(acc, zero), F.lit(0.0)))
    if total == "PRODUCT":
        return Value("number", F.coalesce(zero, acc, F.lit(0.0)))
    return Value("number", F.coalesce(acc, F.lit(0.0)))


def _elements(cells: DataFrame, ref: Sliding, sheet: str, cols: tuple[int, int]) -> DataFrame:
    """``_row``, ``_col`` (of the targets that read it) and the state of each filled row of the range."""
    low, high = ref.cols
    inside = F.col("col").between(low, high) if ref.fixed_cols else F.col("col").between(cols[0] + low, cols[1] + high)
    readers = F.sequence(F.lit(cols[0]), F.lit(cols[1])) if ref.fixed_cols else F.sequence(F.greatest(F.lit(cols[0]), F.col("col") - high), F.least(F.lit(cols[1]), F.col("col") - low))
    x = num(cell("v"))
    source = cells.where((F.col("sheet") == sheet) & inside & (F.col("v.t") != "empty"))
    each = source.select(F.col("row").alias("_row"), F.explode(readers).alias("_col"), F.lit(1).cast("long").alias("_filled"), x.isNotNull().cast("long").alias("_n"), (x * x if ref.total == "SUMSQ" else x).alias("_acc"))
    if low == high:
        return each
    return each.groupBy("_row", "_col").agg(*[c.alias(n) for n, c in _merged(ref.total).items()])




def _running(elements: DataFrame, asks: DataFrame, total: str, rows: int) -> DataFrame:
    """State of ``_place`` 0 to each asked place (``_row``, ``_col``, ``_place``)."""
    block = max(BLOCK_ROWS, 1 << (max(1, rows).bit_length() + 1) // 2)
    null = [F.lit(None).cast(k).alias(c) for c, k in zip(_STATE, ("long", "long", "double"), strict=True)]
    kept = elements.select("_col", F.lit(None).cast("int").alias("_row"), "_place", F.lit(1).alias("_kind"), *_STATE)
    asked = asks.select("_col", "_row", "_place", F.lit(2).alias("_kind"), *null)
    events = written(kept.unionByName(asked).withColumn("_block", F.floor(F.col("_place") / block)), "scan")
    totals = events.groupBy("_col", "_block").agg(*[c.alias(n) for n, c in _merged(total).items()])
    before = Window.partitionBy("_col").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_col", F.lit(None).cast("int").alias("_row"), (F.col("_block") * block).alias("_place"), F.lit(0).alias("_kind"), *[c.over(before).alias(n) for n, c in _merged(total).items()], "_block")
    inside = Window.partitionBy("_col", "_block").orderBy("_place", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return events.unionByName(carried).select("_col", "_row", "_kind", *[c.over(inside).alias(n) for n, c in _merged(total).items()]).where("_kind = 2").drop("_kind")


def _slid(elements: DataFrame, asks: DataFrame, total: str, width: int) -> DataFrame:
    """State of ``width`` places up to each asked one. Places are dealt to parts of several blocks; a
    part also gets the block before it."""
    part = width * max(1, -(-BLOCK_ROWS // width))
    null = [F.lit(None).cast(k).alias(c) for c, k in zip(_STATE, ("long", "long", "double"), strict=True)]
    at = F.floor(F.col("_place") / part)
    late = F.pmod(F.col("_place"), F.lit(part)) >= part - width
    kept = elements.select("_col", F.lit(None).cast("int").alias("_row"), "_place", F.lit(0).alias("_kind"), *_STATE, F.explode(F.when(late, F.array(at, at + 1)).otherwise(F.array(at))).alias("_part"))
    # up to the last place by what its block has before it, and from the first place on by what follows in its own block
    begin = F.col("_place") - (width - 1)
    two = F.when(F.pmod(begin, F.lit(width)) == 0, F.array(F.struct(F.col("_place").alias("p"), F.lit(1).alias("k")))).otherwise(F.array(F.struct(F.col("_place").alias("p"), F.lit(1).alias("k")), F.struct(begin.alias("p"), F.lit(2).alias("k"))))
    asked = asks.select("_col", "_row", F.explode(two).alias("_two"), at.alias("_part")).select("_col", "_row", F.col("_two.p").alias("_place"), F.col("_two.k").alias("_kind"), *null, "_part")
    events = kept.unionByName(asked).withColumn("_block", F.floor(F.col("_place") / width)).repartition("_col", "_part")
    own = Window.partitionBy("_col", "_part", "_block")
    down, up = (own.orderBy(order, (F.col("_kind") > 0)).rowsBetween(Window.unboundedPreceding, 0) for order in (F.col("_place").asc(), F.col("_place").desc()))
    both = events.select("_col", "_part", "_row", "_kind", *[c.over(down).alias(f"{n}_down") for n, c in _merged(total).items()], *[c.over(up).alias(f"{n}_up") for n, c in _merged(total).items()])
    halves = both.where("_kind > 0").select("_col", "_part", "_row", *[F.when(F.col("_kind") == 1, F.col(f"{n}_down")).otherwise(F.col(f"{n}_up")).alias(n) for n in _STATE])
    return halves.groupBy("_col", "_part", "_row").agg(*[c.alias(n) for n, c in _merged(total).items()]).drop("_part")


def sliding_totals(cells: DataFrame, ref: Sliding, sheet: str, targets: DataFrame, rows: tuple[int, int], cols: tuple[int, int], clipped: bool = False) -> DataFrame:
    """``row``, ``col``, ``v``: the range's value for each of ``targets`` (``row``, ``col``), which lie
    within ``rows`` and ``cols``. ``clipped``: rows above the first are blank, and no error."""
    elements = _elements(cells, ref, ref.sheet or sheet, cols)
    asks = targets.select(F.col("row").alias("_row"), F.col("col").alias("_col"), *[(F.lit(x) if isinstance(x, int) else x).cast("long").alias(n) for x, n in zip(ref.rows_of(F.col("row")), ("_a", "_b"), strict=True)])
    good = asks if clipped else asks.where(F.least("_a", "_b") >= 1)
    parts = []
    if ref.start is None and ref.end is None:
        width = abs(ref.last - ref.first) + 1
        parts.append(_slid(elements.withColumn("_place", F.col("_row").cast("long") - 1).drop("_row"), good.withColumn("_place", F.greatest("_a", "_b") - 1), ref.total, width))
    else:
        fixed, moving = (ref.start, "_b") if ref.start is not None else (ref.end, "_a")
        low, high = ref.span(rows)
        # down from the fixed row, and up from it where some targets end there
        for sign, needed in ((1, high > fixed or low == high), (-1, low < fixed)):
            if needed:
                place = lambda c, sign=sign: (F.col(c).cast("long") - fixed) * sign
                own = good.where(place(moving) >= 0) if sign > 0 else good.where(place(moving) > 0) if high > fixed else good.where(place(moving) >= 0)
                parts.append(_running(elements.withColumn("_place", place("_row")).where("_place >= 0").drop("_row"), own.withColumn("_place", place(moving)), ref.total, high - low))
    found = reduce(DataFrame.unionByName, parts)
    size = (F.abs(F.col("_b") - F.col("_a")) + 1) * (ref.cols[1] - ref.cols[0] + 1)
    named = found.select(F.col("_row").alias("row"), F.col("_col").alias("col"), *_STATE)
    lost = asks.where(F.lit(not clipped) & (F.least("_a", "_b") < 1)).select(F.col("_row").alias("row"), F.col("_col").alias("col"), as_cell(result("number", F.lit(0.0), (F.lit(True), REF))).alias("v"))
    ends = dict(zip(("_a", "_b"), ref.rows_of(F.col("row").cast("long")), strict=True))
    placed = named.select("*", *[(F.lit(x).cast("long") if isinstance(x, int) else x).alias(n) for n, x in ends.items()])
    return placed.select("row", "col", as_cell(_finished(ref.total, size)).alias("v")).unionByName(lost)


# ``text`` is what the map makes of a text that is no number; NaN stands for the text itself
_MAP = "struct<a:double,b:double,text:double,before:string,after:string>"


def as_map(value: Affine | Value) -> Column:
    """A map as a struct."""
    none = F.lit(None).cast("string")
    if isinstance(value, Affine):
        return F.struct(value.a.alias("a"), value.b.alias("b"), F.lit(None).cast("double").alias("text"), (none if value.before is None else value.before).alias("before"), (none if value.after is None else value.after).alias("after")).cast(_MAP)
    raise NotAffine("the cell above has no part in it")


def _then(f: Column, g: Column) -> Column:
    """g after f."""
    text = F.when(F.isnan(f["text"]), g["text"]).otherwise(g["a"] * F.coalesce(f["text"], F.lit(0.0)) + g["b"])
    return F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * F.coalesce(f["b"], F.lit(0.0)) + g["b"]).alias("b"), text.alias("text"), F.coalesce(g["before"], f["before"]).alias("before"), F.coalesce(f["after"], g["after"]).alias("after")).cast(_MAP)


def _applied(f: Column, x: Column) -> Column:
    """The number or error (``n``, ``e``) that a map makes of one."""
    e = F.coalesce(f["before"], x["e"], f["after"])
    # zero times a slope beyond doubles is zero here, as it is step by step
    n = F.when(F.isnan(x["n"]), f["text"]).when(F.coalesce(x["n"], F.lit(0.0)) == 0, f["b"]).otherwise(f["a"] * x["n"] + f["b"])
    return F.struct(F.when(e.isNull(), n).alias("n"), e.alias("e")).cast("struct<n:double,e:string>")


def _entered(maps: DataFrame, starts: DataFrame, longest: int) -> DataFrame:
    """``maps`` (``_chain``, ``_at`` from 0, ``_map``) with ``_x``: what enters each, where ``starts``
    (``_chain``, ``_x``) enter the first ones."""
    grouped = maps.groupBy("_chain", F.floor(F.col("_at") / MAPS).alias("_group")).agg(F.array_sort(F.collect_list(F.struct("_at", "_map"))).alias("_maps"))
    if longest <= MAPS:
        entered = grouped.join(starts, "_chain").select("_chain", "_maps", "_x")
    else:
        identity = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("nan")).alias("text"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")).cast(_MAP)
        grouped = written(grouped, "maps")
        whole = grouped.select("_chain", F.col("_group").alias("_at"), F.aggregate("_maps", identity, lambda f, g: _then(f, g["_map"])).alias("_map"))
        upper = _entered(whole, starts, -(-longest // MAPS)).select("_chain", F.col("_at").alias("_group"), "_x")
        entered = grouped.join(upper, ["_chain", "_group"]).select("_chain", "_maps", "_x")
    walk = F.aggregate("_maps", F.array(F.col("_x")), lambda done, m: F.concat(done, F.array(_applied(m["_map"], F.element_at(done, -1)))))
    steps = entered.select("_chain", F.explode(F.arrays_zip(F.col("_maps").alias("m"), F.slice(walk, 1, F.size("_maps")).alias("x"))).alias("_s"))
    return steps.select("_chain", F.col("_s.m._at").alias("_at"), F.col("_s.m._map").alias("_map"), F.col("_s.x").alias("_x"))


def followed(maps: DataFrame, starts: DataFrame, longest: int) -> DataFrame:
    """``_chain``, ``_at`` and ``v``, the cell that each of ``maps`` gives, where every chain starts from
    the cell ``v`` of ``starts`` (a blank one counts 0; of a text that is no number the first cell is
    blank)."""
    begin = F.coalesce(num(cell("v")), F.lit(float("nan")))
    x = F.struct(begin.alias("n"), F.col("v.e").alias("e")).cast("struct<n:double,e:string>")
    done = _entered(maps, starts.select("_chain", x.alias("_x")), longest).select("_chain", "_at", _applied(F.col("_map"), F.col("_x")).alias("_y"))
    return done.select("_chain", "_at", as_cell(Value("number", F.col("_y.n"), e=F.col("_y.e"))).alias("v"))
