"""Conditional formats, colours and chart figures as queries over cells or columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import spare
from ..values import Value, num, text_of, truthy
from .ranking import value_counts


def cell_is(v: Value, operator: str, a, b=None) -> Column:
    """The operators lessThan, lessThanOrEqual, equal, notEqual, greaterThanOrEqual, greaterThan and between."""
    x = num(v)
    tests = {
        "lessThan": lambda: x < a,
        "lessThanOrEqual": lambda: x <= a,
        "greaterThan": lambda: x > a,
        "greaterThanOrEqual": lambda: x >= a,
        "between": lambda: x.between(min(a, b or 0), max(a, b or 0)),
        "equal": lambda: text_of(v) == a if isinstance(a, str) else x == a,
        "notEqual": lambda: text_of(v) != a if isinstance(a, str) else x != a,
    }
    return F.coalesce(tests[operator](), F.lit(False)) if operator in tests else F.lit(False)


def text_is(v: Value, rule: str, part: str) -> Column:
    """containsText, notContainsText, beginsWith, endsWith; case counts."""
    s = text_of(v)
    return {"containsText": s.contains(part), "notContainsText": ~s.contains(part), "beginsWith": s.startswith(part), "endsWith": s.endswith(part)}[rule]


def _onto(df: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Columns of each row's group, a null group included; null where ``found`` lacks it."""
    own = dict(zip(by, spare(df, *[f"_by{i}" for i in range(len(by))]), strict=True))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in own.items()])
    return df.join(found.withColumnsRenamed(own), same, "left").drop(*own.values())


def _figures(df: DataFrame, by: list[str], *figures: Column) -> DataFrame:
    """Figures of each group of targets, joined back by the group."""
    if by:
        return _onto(df, df.groupBy(*by).agg(*figures), by)
    return df.crossJoin(F.broadcast(df.agg(*figures)))  # one row


def top(df: DataFrame, v: Value, out: str, k: int, *, percent: bool = False, bottom: bool = False, by: list[str] | None = None) -> DataFrame:
    """Marks the k largest (or least) values of each group, or k percent of them; ties with the last are in."""
    by = by or []
    n = F.col("_n")
    count = F.greatest(F.ceil(n * k / 100), F.lit(1)) if percent else F.least(F.lit(k), n)
    counts = value_counts(df, v, by).select(*by, F.col("v").alias("_v"), F.col("n").alias("_c"), "below", F.col("total").alias("_n"))
    counts = counts.withColumn("_ahead", F.col("below") if bottom else n - F.col("below") - F.col("_c"))
    (edge,) = spare(df, "_edge")
    last = counts.where(F.col("_ahead") < count).groupBy(*by).agg((F.max("_v") if bottom else F.min("_v")).alias(edge))
    joined = _onto(df, last, by) if by else df.crossJoin(F.broadcast(last))
    inside = num(v) <= F.col(edge) if bottom else num(v) >= F.col(edge)
    return joined.withColumn(out, F.coalesce(inside, F.lit(False))).drop(edge)


def against_average(df: DataFrame, v: Value, out: str, *, above: bool = True, equal: bool = False, by: list[str] | None = None) -> DataFrame:
    (mean,) = spare(df, "_mean")
    with_mean = _figures(df, by or [], F.avg(num(v)).alias(mean))
    x, m = num(v), F.col(mean)
    test = (x >= m if equal else x > m) if above else (x <= m if equal else x < m)
    return with_mean.withColumn(out, F.coalesce(test, F.lit(False))).drop(mean)


def stop_value(kind: str, given: float | Column | None, low: Column, high: Column) -> Column:
    """A threshold: num, min, max, percent of the span, or a formula's column; percentiles need all
    values (``_nearest_rank``)."""
    if kind == "percent":
        return low + (high - low) * (float(given or 0) / 100)
    return {"min": low, "max": high}[kind] if kind in ("min", "max") else F.lit(given).cast("double")


def _nearest_rank(df: DataFrame, v: Value, percent: float, out: str, by: list[str]) -> DataFrame:
    """Of each group, or of the table, the value at place ceil((n - 1) * percent / 100) from 0: a row
    each, made from counts of distinct values."""
    counts = value_counts(df, v, by)
    place = F.ceil((F.col("total") - 1) * min(max(float(percent), 0.0), 100.0) / 100)
    return counts.where((F.col("below") <= place) & (place < F.col("below") + F.col("n"))).groupBy(*by).agg(F.max("v").alias(out))


def _with_stops(df: DataFrame, v: Value, stops: list[tuple], by: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with the values of stops, which are pairs of a kind and what is given with it; the names
    of their columns, and of all that were added."""
    low, high, *names = spare(df, "_low", "_high", *[f"_stop{i}" for i in range(len(stops))])
    out = _figures(df, by, F.min(num(v)).alias(low), F.max(num(v)).alias(high))
    for name, (kind, given, *_) in zip(names, stops, strict=True):
        if kind == "percentile":
            found = _nearest_rank(df, v, given or 0, name, by)
            out = _onto(out, found, by) if by else out.crossJoin(F.broadcast(found))  # one row
        else:
            out = out.withColumn(name, stop_value(kind, given, F.col(low), F.col(high)))
    return out, names, [low, high, *names]


def _byte(c: Column) -> Column:
    return F.lpad(F.hex(F.floor(c + 0.5).cast("long")), 2, "0")


def _share(x: Column, low: str, high: str) -> Column:
    """Where x lies between two stops, from 0 to 1; 1 where they are equal."""
    span = F.col(high) - F.col(low)
    return F.when(span == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col(low)) / F.when(span != 0, span))))


def color_scale(df: DataFrame, v: Value, out: str, colors: list[str], by: list[str] | None = None, stops: list[tuple] | None = None) -> DataFrame:
    """RRGGBB between two or three colours at as many stops, by default spread evenly from the least
    to the largest value of the group. Equal outer stops give the last colour."""
    last = len(colors) - 1
    stops = stops or [("min", None), *(("percent", 100 * i / last) for i in range(1, last)), ("max", None)]
    placed, at, added = _with_stops(df, v, stops, by or [])
    part = lambda color, i: int(color[2 * i : 2 * i + 2], 16)
    between = lambda k, i: part(colors[k], i) + _share(num(v), at[k], at[k + 1]) * (part(colors[k + 1], i) - part(colors[k], i))
    shade = lambda i: reduce(lambda later, k: F.when(num(v) <= F.col(at[k + 1]), between(k, i)).otherwise(later), range(last - 2, -1, -1), between(last - 1, i))
    flat = F.col(at[0]) == F.col(at[last])
    color = F.when(flat, colors[-1]).otherwise(F.concat(*[_byte(shade(i)) for i in range(3)]))
    return placed.withColumn(out, F.when(num(v).isNotNull(), color)).drop(*added)


def data_bar(df: DataFrame, v: Value, out: str, by: list[str] | None = None, stops: list[tuple] | None = None) -> DataFrame:
    """Length of the bar from 0 to 100 between two stops, by default the least and the largest value."""
    stops = stops or [("min", None), ("max", None)]
    placed, at, added = _with_stops(df, v, stops, by or [])
    return placed.withColumn(out, F.coalesce(_share(num(v), at[0], at[-1]) * 100, F.lit(100.0))).drop(*added)


def icon_set(df: DataFrame, v: Value, out: str, percents: list[float] | None = None, by: list[str] | None = None, stops: list[tuple] | None = None) -> DataFrame:
    """Number, from 0, of the last threshold that the value reaches; one with a third part ``False`` must
    be exceeded. ``percents`` of the span are short for stops."""
    stops = stops or [("percent", p) for p in percents or ()]
    placed, at, added = _with_stops(df, v, stops, by or [])
    reached = [(num(v) > F.col(name)) if more == [False] else (num(v) >= F.col(name)) for name, (_, _, *more) in zip(at, stops, strict=True)]
    icon = F.greatest(F.lit(0), *[F.when(test, i).otherwise(0) for i, test in enumerate(reached)])
    return placed.withColumn(out, F.when(num(v).isNotNull(), icon)).drop(*added)


@dataclass(frozen=True)
class Rule:
    """A style where a test holds: any of the tests here, or an expression by ``expression``."""

    style: str
    test: Column
    priority: float = float("inf")
    stop_if_true: bool = False


def expression(v: Value) -> Column:
    """The test of an expression rule: its value is neither false, 0, blank nor the text FALSE."""
    return truthy(v)


def applied(df: DataFrame, rules: list[Rule], out: str) -> DataFrame:
    """Array of the styles whose rules hold for a row, by priority and then as given, up to the first
    that holds and stops."""
    going, styles = F.lit(True), []
    for rule in sorted(rules, key=lambda r: r.priority):
        holds = F.coalesce(rule.test, F.lit(False))
        styles.append(F.when(going & holds, rule.style))
        if rule.stop_if_true:
            going = going & ~holds
    return df.withColumn(out, F.filter(F.array(*styles).cast("array<string>"), lambda s: s.isNotNull()))


def tinted(color: Column, tint: Column) -> Column:
    """RRGGBB made lighter (tint above 0) or darker."""
    part = lambda i: F.conv(F.substring(color, 1 + 2 * i, 2), 16, 10).cast("double")
    move = lambda c: F.when(tint < 0, c * (1 + tint)).otherwise(c + (255 - c) * tint)
    return F.concat(*[_byte(move(part(i))) for i in range(3)])


def series(df: DataFrame, key: list[str], categories: str, values: str) -> DataFrame:
    """Points of chart series from arrays of categories and values, padded to the longer: a missing
    category is its index, a missing value 0."""
    n = F.greatest(F.size(categories), F.size(values))
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    point = lambda i: F.struct(i.alias("point"), F.coalesce(F.try_element_at(F.col(categories), i + 1), (i + 1).cast("string")).alias("category"), F.coalesce(F.try_element_at(F.col(values), i + 1), F.lit(0.0)).alias("value"))
    return df.where(n > 0).select(*key, F.explode(F.transform(at, point)).alias("p")).select(*key, "p.*")


def extents(points: DataFrame, key: list[str]) -> DataFrame:
    """Least and largest value of each chart, 0 included."""
    return points.groupBy(*key).agg(F.least(F.min("value"), F.lit(0.0)).alias("low"), F.greatest(F.max("value"), F.lit(0.0)).alias("high"))


def shares(points: DataFrame, key: list[str]) -> DataFrame:
    """Each point's share of the sum of absolute values of its chart; a null key is a chart."""
    (total,) = spare(points, "_total")
    joined = _onto(points, points.groupBy(*key).agg(F.sum(F.abs("value")).alias(total)), key)
    return joined.withColumn("share", F.when(F.col(total) > 0, F.abs("value") / F.col(total)).otherwise(0.0)).drop(total)


def axis_label(value: Column) -> Column:
    """A tick's text: thousands as K, millions as M, with one digit; whole numbers below as they are."""
    short = lambda c, mark: F.concat(F.format_string("%.1f", c), F.lit(mark))
    whole = F.when(value == 0, "0").otherwise(value.cast("long").cast("string"))
    return F.when(F.abs(value) >= 1e6, short(value / 1e6, "M")).when(F.abs(value) >= 1e3, short(value / 1e3, "K")).when(value == F.floor(value), whole).otherwise(short(value, ""))


def axis_ticks(charts: DataFrame, key: list[str], ticks: int = 5) -> DataFrame:
    """``tick`` (from 0), ``value`` and ``label`` for charts with ``low`` and ``high`` (``extents``): evenly
    spread, over a span of 1 where they are equal."""
    span = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise(F.col("high") - F.col("low"))
    each = charts.select(*key, "low", span.alias("_span"), F.explode(F.sequence(F.lit(0), F.lit(ticks))).alias("tick"))
    value = F.col("low") + F.col("_span") * F.col("tick") / ticks
    return each.select(*key, "tick", value.alias("value"), axis_label(value).alias("label"))
