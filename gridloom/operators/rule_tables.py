"""Conditional formats whose rules and targets are tables.

``rules``: ``rule`` (its name), ``kind``, ``priority``, ``stop_if_true``, ``style`` and what the kind takes:

- cellIs: ``operator``, ``v1``, ``v2`` (texts of constants)
- containsText, notContainsText, beginsWith, endsWith: ``v1``
- expression: ``v1``, a constant; others don't hold, as formulas aren't evaluated here
- top10: ``rank``, ``percent``, ``bottom``
- aboveAverage: ``below``, ``equal``
- colorScale, dataBar, iconSet: ``stops`` (structs of ``kind``, ``value`` and ``over``: must be exceeded)
  and ``colors`` (RRGGBB)

``targets``: ``rule``, ``sheet`` and the range ``r1``, ``c1``, ``r2``, ``c2``; a rule may have several.

All rules are evaluated together: one join of cells with ranges, one aggregate for the figures of all
rules and one for their order statistics. Blank cells of a target count as zeros in these, by
number; only filled cells get formats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..storage import written
from ..values import cell, num, number, parsed, text_of
from .formats import _byte
from .ranking import value_counts
from .tiles import in_ranges

RULES = "rule string, kind string, priority int, stop_if_true boolean, style string, operator string, v1 string, v2 string, rank int, percent boolean, bottom boolean, below boolean, equal boolean, stops array<struct<kind:string,value:double,over:boolean>>, colors array<string>"
TARGETS = "rule string, sheet string, r1 int, c1 int, r2 int, c2 int"
#: At most so many ranges of values order a rule's values.
RANGES = 256
_LAST_PRIORITY = (1 << 31) - 1


@F.arrow_udf(LongType())
def _cells_of(areas: pa.Array) -> pa.Array:
    """How many cells areas of sheets cover together, overlaps once."""
    return pa.array([covered(x) for x in areas.to_pylist()], pa.int64())


def covered(areas: list[dict]) -> int:
    """Cells that areas (sheet, r1, c1, r2, c2) cover together: rows are swept from one edge to the next."""
    total = 0
    for sheet in {a["sheet"] for a in areas}:
        own = [a for a in areas if a["sheet"] == sheet and a["r1"] <= a["r2"] and a["c1"] <= a["c2"]]
        edges = sorted({a["r1"] for a in own} | {a["r2"] + 1 for a in own})
        for top, below in zip(edges, edges[1:], strict=False):
            spans = sorted((a["c1"], a["c2"] + 1) for a in own if a["r1"] <= top < a["r2"] + 1)
            if spans:
                begins, ends = np.array(spans).T
                reach = np.maximum.accumulate(ends)
                gaps = np.maximum(begins[1:] - reach[:-1], 0).sum()
                total += int(reach[-1] - begins[0] - gaps) * (below - top)
    return total


def _order_statistics(values: DataFrame, asked: DataFrame) -> DataFrame:
    """``rule``, ``ask``, ``value``: the value at a place (from 0) among a rule's ``values`` (``rule``, ``x``,
    ``n``, how often)."""
    parts = min(RANGES, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = value_counts(values, number("x"), ["rule"], F.col("n"), parts)
    reached = (F.col("place") >= F.col("below")) & (F.col("place") < F.col("below") + F.col("n"))
    return counts.join(asked, "rule").where(reached).select("rule", "ask", F.col("v").alias("value"))


def with_figures(pairs: DataFrame, rules: DataFrame, targets: DataFrame) -> DataFrame:
    """``rules`` with what their targets' numbers give: ``n``, ``low``, ``high``, ``mean``, ``edge`` (of top10)
    and ``at``, the values of stops; and with the numbers of their constants (``a``, ``b``) and
    colours (``rgb``)."""
    sizes = targets.groupBy("rule").agg(_cells_of(F.collect_list(F.struct("sheet", "r1", "c1", "r2", "c2"))).alias("cells"))
    summed = pairs.groupBy("rule").agg(F.count("*").alias("filled"), F.count("x").alias("numbers"), F.sum("x").alias("sum"), F.min("x").alias("low"), F.max("x").alias("high"))
    blank = F.greatest(F.col("cells") - F.coalesce("filled", F.lit(0)), F.lit(0))
    zero = F.when(F.col("blank") > 0, F.lit(0.0))
    n = F.coalesce("numbers", F.lit(0)) + F.col("blank")
    figures = written(
        sizes.join(summed, "rule", "left")
        .withColumn("blank", blank)
        .select("rule", "blank", n.alias("n"), F.least("low", zero).alias("low"), F.greatest("high", zero).alias("high"), (F.coalesce("sum", F.lit(0.0)) / F.when(n > 0, n)).alias("mean")),
        "rule-figures",
    )
    known = rules.join(figures, "rule", "left").where("n > 0")
    count = F.least(F.greatest(F.when(F.coalesce("percent", F.lit(False)), F.ceil(F.col("n") * F.coalesce("rank", F.lit(10)) / 100)).otherwise(F.coalesce("rank", F.lit(10))), F.lit(1)), F.col("n"))
    tops = known.where("kind = 'top10'").select("rule", F.lit(-1).alias("ask"), F.when(F.coalesce("bottom", F.lit(False)), count - 1).otherwise(F.col("n") - count).alias("place"))
    stops = known.where(F.col("kind").isin("colorScale", "dataBar", "iconSet")).select("rule", "n", F.posexplode("stops").alias("ask", "stop")).where("stop.kind = 'percentile'")
    place = F.ceil((F.col("n") - 1) * F.coalesce("stop.value", F.lit(0.0)) / 100)
    asked = tops.unionByName(stops.select("rule", "ask", F.least(F.greatest(place, F.lit(0)), F.col("n") - 1).alias("place")))
    wanted = pairs.where(F.col("x").isNotNull()).join(asked.select("rule").distinct(), "rule", "left_semi")
    zeros = figures.where("blank > 0").join(asked.select("rule").distinct(), "rule", "left_semi").select("rule", F.lit(0.0).alias("x"), F.col("blank").cast("long").alias("n"))
    found = _order_statistics(wanted.groupBy("rule", "x").agg(F.count("*").alias("n")).unionByName(zeros), asked)
    map_of = found.groupBy("rule").agg(F.map_from_entries(F.collect_list(F.struct("ask", "value"))).alias("_places"))
    stop = lambda s, i: (
        F.when(s["kind"] == "min", F.col("low"))
        .when(s["kind"] == "max", F.col("high"))
        .when(s["kind"] == "percent", F.col("low") + (F.col("high") - F.col("low")) * F.coalesce(s["value"], F.lit(0.0)) / 100)
        .when(s["kind"] == "percentile", F.try_element_at("_places", i))
        .otherwise(s["value"])
    )
    joined = rules.join(figures, "rule", "left").join(map_of, "rule", "left")
    part = lambda c, i: F.conv(F.substring(c, 2 * i + 1, 2), 16, 10).cast("double")
    constants = {"a": parsed(F.coalesce("v1", F.lit(""))), "b": parsed(F.coalesce("v2", F.lit(""))), "rgb": F.transform("colors", lambda c: F.array(*[part(c, i) for i in range(3)]))}
    return joined.withColumns({"edge": F.try_element_at("_places", F.lit(-1)), "at": F.transform("stops", stop)} | constants).drop("_places")


def _holds(x: Column, s: Column) -> Column:
    a, b, text = F.col("a"), F.col("b"), F.coalesce("v1", F.lit(""))
    by_number = x.isNotNull() & a.isNotNull()
    operator, kind = F.col("operator"), F.col("kind")
    compared = (
        F.when(operator == "equal", F.when(by_number, x == a).otherwise(s == text))
        .when(operator == "notEqual", F.when(by_number, x != a).otherwise(s != text))
        .when(~by_number, False)
        .when(operator == "greaterThan", x > a)
        .when(operator == "lessThan", x < a)
        .when(operator == "greaterThanOrEqual", x >= a)
        .when(operator == "lessThanOrEqual", x <= a)
        .when(operator == "between", x.between(a, b))
    )
    beyond = F.when(F.coalesce("below", F.lit(False)), x < F.col("mean")).otherwise(x > F.col("mean"))
    tests = {
        "cellIs": compared,
        "containsText": s.contains(text),
        "notContainsText": ~s.contains(text),
        "beginsWith": s.startswith(text),
        "endsWith": s.endswith(text),
        "expression": F.when(F.upper(text) == "TRUE", True).when(F.upper(text) == "FALSE", False).otherwise(a != 0) & (text != ""),
        "top10": F.when(F.coalesce("bottom", F.lit(False)), x <= F.col("edge")).otherwise(x >= F.col("edge")),
        "aboveAverage": beyond | (F.coalesce("equal", F.lit(False)) & (x == F.col("mean"))),
    }
    out = F.lit(None).cast("boolean")
    for name, test in tests.items():
        out = F.when(kind == name, test).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _share(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / F.when(high != low, high - low)))


def _color(x: Column) -> Column:
    """Between the outer colours, or by the middle stop where there are three colours and stops."""
    at, colors, rgb, last = F.col("at"), F.col("colors"), F.col("rgb"), F.size("at")
    low, middle, high = F.get(at, F.lit(0)), F.get(at, F.lit(1)), F.get(at, last - 1)
    mix = lambda p, q, t: F.concat(*[_byte(p[i] + t * (q[i] - p[i])) for i in range(3)])
    c = [F.get(rgb, F.lit(i)) for i in range(3)]
    three = (last >= 3) & (F.size(colors) >= 3)
    on = F.coalesce
    lower, upper = mix(c[0], c[1], on(_share(x, low, middle), F.lit(1.0))), mix(c[1], c[2], on(_share(x, middle, high), F.lit(1.0)))
    color = F.when(low == high, F.element_at(colors, -1)).when(three, F.when(x <= middle, lower).otherwise(upper)).otherwise(mix(c[0], c[1], _share(x, low, high)))
    return F.when((last >= 2) & (F.size(colors) >= 2) & ~F.exists(at, lambda v: v.isNull()), color)


def formatted(cells: DataFrame, rules: DataFrame, targets: DataFrame) -> DataFrame:
    """``sheet``, ``row``, ``col`` and ``formats``, of every filled cell that some rule's target holds: the
    rules that hold, by priority and then name, up to the first that stops; structs of ``rule``,
    ``style``, ``color`` (colorScale), ``bar`` (dataBar, 0 to 100) and ``icon`` (iconSet, from 0).

    Other columns of the tables are ignored; of several workbooks each is formatted by itself.
    A rule without targets formats nothing, a null priority comes last, and numbers are what
    texts spell too. ``cells`` are sheet, row, col and v.
    """
    areas = targets.select("rule", "sheet", "r1", "c1", "r2", "c2")
    rules = rules.select(*[c.split()[0] for c in RULES.split(", ")])
    v = cell("v")
    # small files hold many cells: their texts and numbers are all tasks' work
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = cells.where("v.t <> 'empty'").repartition(parts, "sheet", "row", "col").select("sheet", "row", "col", num(v).alias("x"), text_of(v).alias("s"))
    pairs = written(in_ranges(filled, areas).select("cell.*", "range.rule").distinct(), "rule-pairs")
    known = written(with_figures(pairs, rules, areas), "rules")
    x, s, at = F.col("x"), F.col("s"), F.col("at")
    each = pairs.join(known, "rule")
    whole = x.isNotNull() & (F.size(at) >= 1) & ~F.exists(at, lambda a: a.isNull())
    low, high = F.get(at, F.lit(0)), F.get(at, F.size(at) - 1)
    bar = F.when(whole & (F.size(at) >= 2), F.when(low == high, F.lit(100.0)).otherwise(_share(x, low, high) * 100))
    reached = F.transform(at, lambda a, i: F.when(F.coalesce(F.get("stops", i)["over"], F.lit(False)), x > a).otherwise(x >= a))
    icon = F.when(whole, F.coalesce(F.array_max(F.transform(reached, lambda r, i: F.when(r, i))), F.lit(0)))
    kind = F.col("kind")
    each = each.select(
        "sheet", "row", "col", "rule", F.coalesce("priority", F.lit(_LAST_PRIORITY)).alias("priority"), F.coalesce("stop_if_true", F.lit(False)).alias("stops_here"), "style",
        F.when(kind == "colorScale", F.when(x.isNotNull(), _color(x))).alias("color"), F.when(kind == "dataBar", bar).alias("bar"), F.when(kind == "iconSet", icon.cast("int")).alias("icon"), _holds(x, s).alias("holds"),
    )
    held = each.where("holds or color is not null or bar is not null or icon is not null")
    one = F.struct("priority", "rule", "stops_here", "style", "color", "bar", "icon")
    listed = held.groupBy("sheet", "row", "col").agg(F.array_sort(F.collect_list(one)).alias("all"))
    first = F.array_position(F.transform("all", lambda f: f["stops_here"]), True)
    kept = F.when(first > 0, F.slice("all", 1, first.cast("int"))).otherwise(F.col("all"))
    return listed.select("sheet", "row", "col", F.transform(kept, lambda f: F.struct(f["rule"].alias("rule"), f["style"].alias("style"), f["color"].alias("color"), f["bar"].alias("bar"), f["icon"].alias("icon"))).alias("formats"))
