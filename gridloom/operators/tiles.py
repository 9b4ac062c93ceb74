"""Joins of cells with the ranges that hold them.

Tiles of a side are intervals whose length is a power of ``1 << STEP`` and whose start is a multiple
of it. A range is listed in the tiles that it touches of the least size that is no shorter than
itself: one or two a side, so four at most. A cell lies in one tile of each size, so both sides
meet by equality, every pair of a cell and its range once, and what the range doesn't hold is
dropped there. A cell is sent once for each size that occurs, which are as a rule one or two;
no row is made for a cell that isn't there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The last row and column of an open range; cells lie below.
LAST = (1 << 31) - 2
#: Tiles of so many rows (a power of two) and more are dealt to ``SALTS`` tasks, by row.
LARGE, SALTS = 12, 32
#: Sizes of tiles are this power of two apart.
STEP = 3


def cover(low: Column, high: Column) -> Column:
    """Tiles of the whole numbers from ``low`` to ``high`` (0 and more): structs of ``level`` and ``tile``."""

    def at(level: Column) -> Column:
        a, b = F.call_function("shiftright", low.cast("long") + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level), F.call_function("shiftright", high.cast("long") + 1, level)
        one = lambda tile: F.struct(level.cast("int").alias("level"), tile.alias("tile"))
        return F.filter(F.array(F.when((a % 2 == 1) & (a < b), one(a)), F.when((b % 2 == 1) & (a < b), one(b - 1))), lambda t: t.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), at))


def touched(low: Column, high: Column) -> Column:
    """Tiles of the least size from ``high - low + 1`` on that hold a part of these whole numbers: structs of
    ``level`` and ``tile``, one or two."""
    sizes = F.sequence(F.lit(0), F.lit(33), F.lit(STEP))
    fits = lambda level: F.call_function("shiftleft", F.lit(1).cast("long"), level) >= high.cast("long") - low.cast("long") + 1
    at = lambda level, place: F.call_function("shiftright", place.cast("long"), level)
    both = lambda level: F.transform(F.sequence(at(level, low), at(level, high)), lambda tile: F.struct(level.cast("int").alias("level"), tile.alias("tile")))
    return F.element_at(F.transform(F.slice(F.filter(sizes, fits), 1, 1), both), 1)


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def in_ranges(cells: DataFrame, ranges: DataFrame, *, sheet: str | None = "sheet", how: str = "inner") -> DataFrame:
    """Every cell (``row``, ``col``) with every range (``r1``, ``c1``, ``r2``, ``c2``, ends included) that
    holds it, as structs ``cell`` and ``range`` of all their columns; with ``how`` left_semi or
    left_anti the cells that some or no range holds, as they are.

    Both sides share the column ``sheet`` unless it is None. Open ranges end at ``LAST``. A range
    whose ends are swapped, or null, holds nothing, nor is a cell without a place in any.
    """
    span = lambda a, b: touched(F.greatest(F.col(f"range.{a}").cast("long"), F.lit(0)), F.col(f"range.{b}").cast("long"))
    tiles = ranges.select(F.struct("*").alias("range")).where("range.r1 <= range.r2 and range.c1 <= range.c2 and range.r2 >= 0 and range.c2 >= 0")
    tiles = tiles.select("range", F.explode(span("r1", "r2")).alias("_r")).select("range", "_r", F.explode(span("c1", "c2")).alias("_c"))
    tiles = tiles.select("range", "_r", "_c", F.explode(F.when(F.col("_r.level") >= LARGE, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))).alias("_salt"))
    # pairs of sizes that occur: at most 12 times 12, as a rule a few
    sizes = [(r[0], r[1]) for r in tiles.select("_r.level", F.col("_c.level").alias("other")).distinct().collect()]
    points = cells.select(F.struct("*").alias("cell"))
    row, col = F.col("cell.row").cast("long"), F.col("cell.col").cast("long")
    if not sizes:
        return cells.limit(0) if how == "left_semi" else cells if how == "left_anti" else points.join(tiles, F.lit(False)).select("cell", "range")
    size = F.explode(F.array(*[F.struct(F.lit(r).alias("rl"), F.lit(c).alias("cl")) for r, c in sizes])).alias("_p")
    part = lambda place, level: F.call_function("shiftright", place, F.col(level))
    salt = F.when(F.col("_p.rl") >= LARGE, F.pmod(row, F.lit(SALTS)).cast("int")).otherwise(F.lit(-1))
    placed = points.where(row.isNotNull() & col.isNotNull()).select("cell", size).select("cell", F.struct("_p.rl", part(row, "_p.rl").alias("rt"), "_p.cl", part(col, "_p.cl").alias("ct"), salt.alias("salt")).alias("_p"))
    held = row.between(F.col("range.r1"), F.col("range.r2")) & col.between(F.col("range.c1"), F.col("range.c2"))
    keys = [held, F.col("_p.rl") == F.col("_r.level"), F.col("_p.rt") == F.col("_r.tile"), F.col("_p.cl") == F.col("_c.level"), F.col("_p.ct") == F.col("_c.tile"), F.col("_p.salt") == F.col("_salt")]
    if sheet is not None:
        keys.append(F.col(f"cell.{sheet}") == F.col(f"range.{sheet}"))
    if how == "inner":
        return placed.join(tiles, _all(*keys)).select("cell", "range")
    found = placed.join(tiles, _all(*keys), "left_semi").select("cell.row", "cell.col", *([F.col(f"cell.{sheet}").alias(sheet)] if sheet else [])).distinct()
    return cells.join(found, [*([sheet] if sheet else []), "row", "col"], how)
