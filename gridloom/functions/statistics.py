"""Statistics, conditional aggregates and distributions."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import DIV0, NA, NUM, VALUE, Value, finite, let, num, num0, or_error, result, text_of, truthy
from .maths import _fold, _listed, _total, counts, steps, sums
from .registry import CATALOG, aggregate, row

_C = "statistical"


def _number(c: Column, *cases) -> Value:
    return result("number", c, *cases)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


# criteria


def matches(value, criterion) -> Column:
    """Whether a value meets a criterion: a constant such as ``">=5"``, ``"a*"`` or 7, or a value of
    the row (compared for equality). Constants become plain predicates, which reach the scan."""
    if isinstance(criterion, bool):
        return F.coalesce(value.c == criterion, F.lit(False)) if value.kind == "logical" else F.coalesce(num(value) == float(criterion), F.lit(False))
    if isinstance(criterion, int | float):
        return F.coalesce(_plain(value) == float(criterion), F.lit(False))
    if isinstance(criterion, str):
        return F.coalesce(_meets(value, criterion), F.lit(False))
    if isinstance(criterion, Value):
        x, y = num(value), num(criterion)
        return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.lower(text_of(value)) == F.lower(text_of(criterion))), F.lit(False))
    raise TypeError(f"not a criterion: {criterion!r}")


def _plain(value: Value) -> Column:
    """A column that a comparison can push down; blanks match no number."""
    return value.c if value.kind == "number" else num(value)


def _blank(value: Value) -> Column:
    return value.c.isNull() if value.kind == "number" else text_of(value) == ""


def _meets(value: Value, criterion: str) -> Column:
    if criterion == "":
        return _blank(value)
    op = next((o for o in ("<>", ">=", "<=", ">", "<", "=") if criterion.startswith(o)), "")
    rest = criterion[len(op) :].strip() if op else criterion
    by = {"": lambda a, b: a == b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}[op]
    try:
        return by(_plain(value), float(rest)) if rest else by(text_of(value), F.lit(""))
    except ValueError:
        pass
    if op in (">", "<", ">=", "<="):
        return by(text_of(value), F.lit(rest))
    if any(c in rest for c in "*?"):
        found = text_of(value).rlike(_pattern(rest))
        return ~found if op == "<>" else found
    return by(F.lower(text_of(value)), F.lit(rest.lower()))


def _pattern(rest: str) -> str:
    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in rest) + "$"


def _all(pairs) -> Column:
    return reduce(lambda a, b: a & b, [matches(v, c) for v, c in pairs])


def _paired(args):
    if len(args) % 2:
        raise TypeError("criteria come in pairs of a value and a criterion")
    return list(zip(args[::2], args[1::2], strict=True))


def count_if(value, criterion) -> Value:
    """COUNTIF over rows."""
    return _number(F.count_if(matches(value, criterion)).cast("double"))


def count_ifs(*pairs) -> Value:
    return _number(F.count_if(_all(_paired(pairs))).cast("double"))


def sum_if(value, criterion, of=None) -> Value:
    return sum_ifs(value if of is None else of, value, criterion)


def sum_ifs(of, *pairs) -> Value:
    return _number(_zero(F.sum(F.when(_all(_paired(pairs)), num(of)))))


def average_if(value, criterion, of=None) -> Value:
    return average_ifs(value if of is None else of, value, criterion)


def average_ifs(of, *pairs) -> Value:
    out = F.avg(F.when(_all(_paired(pairs)), num(of)))
    return _number(out, (out.isNull(), DIV0))


def max_ifs(of, *pairs) -> Value:
    return _number(_zero(F.max(F.when(_all(_paired(pairs)), num(of)))))


def min_ifs(of, *pairs) -> Value:
    return _number(_zero(F.min(F.when(_all(_paired(pairs)), num(of)))))


for _name, _f, _args in (
    ("COUNTIF", count_if, "range, criteria"),
    ("COUNTIFS", count_ifs, "range, criteria, ..."),
    ("SUMIF", sum_if, "range, criteria, [sum_range]"),
    ("SUMIFS", sum_ifs, "sum_range, range1, criteria1, ..."),
    ("AVERAGEIF", average_if, "range, criteria, [avg_range]"),
    ("AVERAGEIFS", average_ifs, "avg_range, range1, criteria1, ..."),
    ("MAXIFS", max_ifs, "max_range, criteria_range1, criteria1, ..."),
    ("MINIFS", min_ifs, "min_range, criteria_range1, criteria1, ..."),
):
    aggregate(_name, category=_C, args=_args, mode="K")(_f)

# counting


def _there(v) -> Column:
    return F.when(v.error().isNotNull() | (text_of(v) != ""), 1)


@aggregate("COUNTA", category=_C, args="value1, [value2], ...")
def counta(*values):
    return _number(counts([_there(v) for v in values]))


@row("COUNTA", category=_C, args="value1, [value2], ...")
def counta_row(*values):
    return _number(reduce(lambda a, b: a + b, [(F.size(F.filter(v.c, lambda x: x.isNotNull() & (x.cast("string") != ""))) if v.kind == "array" else F.coalesce(_there(v), F.lit(0))) for v in values]).cast("double"))


@aggregate("COUNTBLANK", category=_C, args="range")
def countblank(value):
    return _number(F.count_if(_there(value).isNull()).cast("double"))


@row("COUNTBLANK", category=_C, args="range")
def countblank_row(value):
    items = value.c if value.kind == "array" else F.array(F.when(_there(value).isNotNull(), "x"))
    return _number(F.size(F.filter(items, lambda x: x.isNull() | (x.cast("string") == ""))).cast("double"))


def _one(cs) -> Column:
    """Several columns can't be folded into one without a row for each cell."""
    if len(cs) != 1:
        raise TypeError("over a table this takes one column; stack several first")
    return cs[0]


def _mean(xs: Column) -> Column:
    return _total(xs) / F.when(F.size(xs) > 0, F.size(xs))


def _spread(xs: Column, power: int) -> Column:
    m = _mean(xs)
    return _total(F.transform(xs, lambda x: F.pow(x - m, F.lit(float(power)))))


def _sorted_at(xs: Column, k: Column) -> Column:
    """Linear interpolation at a place counted from 0 in the sorted array."""
    s = F.array_sort(xs)
    low = F.floor(k).cast("int")
    a, b = F.try_element_at(s, low + 1), F.coalesce(F.try_element_at(s, low + 2), F.try_element_at(s, low + 1))
    return a + (b - a) * (k - low)


def _stat(names, in_row, in_table, empty=NUM, args="number1, [number2], ..."):
    for name in names:
        _fold(name, in_row, lambda cs: in_table(_one(cs)), args=args, empty=empty)
        CATALOG[name].category = _C


def _var(xs: Column, less: int) -> Column:
    return _spread(xs, 2) / F.when(F.size(xs) > less, F.size(xs) - less)


_stat(["MEDIAN"], lambda xs: _sorted_at(xs, (F.size(xs) - 1) / 2), F.median)


def _spreads(names, less, in_table, root):
    def of_row(*values):
        xs = _listed(values)
        out = _var(xs, less)
        return _number(F.sqrt(out) if root else out, (F.size(xs) <= less, DIV0))

    def of_table(*values):
        out = in_table(_one([num(v) for v in values]))
        return _number(out, (out.isNull() | F.isnan(out), DIV0))

    row(*names, category=_C, args="number1, [number2], ...")(of_row)
    aggregate(*names, category=_C, args="number1, [number2], ...")(of_table)


_spreads(["STDEV", "STDEV.S"], 1, F.stddev_samp, True)
_spreads(["STDEV.P", "STDEVP"], 0, F.stddev_pop, True)
_spreads(["VAR", "VAR.S"], 1, F.var_samp, False)
_spreads(["VAR.P", "VARP"], 0, F.var_pop, False)


def _checked(in_row, in_table):
    """Statistics that are undefined beside values of 0 or less."""

    def of_row(*values):
        xs = _listed(values)
        return _number(in_row(xs), (F.size(xs) == 0, NUM), (F.exists(xs, lambda x: x <= 0), NUM))

    def of_table(*values):
        c = _one([num(v) for v in values])
        return _number(in_table(c), (F.count(c) == 0, NUM), (F.min(c) <= 0, NUM))

    return of_row, of_table


for _name, (_r, _t) in {
    "GEOMEAN": _checked(lambda xs: F.exp(_mean(F.transform(xs, lambda x: F.ln(F.when(x > 0, x))))), lambda c: F.exp(F.avg(F.ln(F.when(c > 0, c))))),
    "HARMEAN": _checked(lambda xs: F.size(xs) / _total(F.transform(xs, lambda x: 1 / F.when(x > 0, x))), lambda c: F.count(c) / F.sum(1 / F.when(c > 0, c))),
}.items():
    row(_name, category=_C, args="number1, [number2], ...")(_r)
    aggregate(_name, category=_C, args="number1, [number2], ...")(_t)

_stat(["DEVSQ"], lambda xs: _spread(xs, 2), lambda c: F.var_pop(c) * F.count(c))
_stat(["AVEDEV"], lambda xs: _mean(F.transform(xs, lambda x: F.abs(x - _mean(xs)))), lambda c: _avedev(F.collect_list(c)))


def _avedev(xs: Column) -> Column:
    m = _mean(xs)
    return F.when(F.size(xs) > 0, _mean(F.transform(xs, lambda x: F.abs(x - m))))


def _moments(name, least, in_row, in_table):
    @row(name, category=_C, args="number1, [number2], ...")
    def of_row(*values):
        xs = _listed(values)
        n, s = F.size(xs), F.sqrt(_var(xs, 1))
        m = _mean(xs)
        z = F.transform(xs, lambda x: (x - m) / F.when(s > 0, s))
        return _number(in_row(n, z), (n < least, DIV0), (s == 0, DIV0))

    @aggregate(name, category=_C, args="number1, [number2], ...")
    def of_table(*values):
        c = _one([num(v) for v in values])
        n = F.count(c)
        return _number(in_table(F.when(n >= least, n), c), (n < least, DIV0), (F.min(c) == F.max(c), DIV0))


_moments("SKEW", 3, lambda n, z: n / F.when(n > 2, (n - 1) * (n - 2)) * _total(F.transform(z, lambda x: x * x * x)), lambda n, c: F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))
_moments(
    "KURT",
    4,
    lambda n, z: n * (n + 1) / F.when(n > 3, (n - 1) * (n - 2) * (n - 3)) * _total(F.transform(z, lambda x: x * x * x * x)) - 3 * (n - 1) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3)),
    lambda n, c: (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6),
)


def _a(v: Value) -> Column:
    """Text counts 0 and TRUE 1; blanks are left out."""
    if v.kind == "text":
        return F.when(text_of(v) != "", F.lit(0.0))
    if v.kind == "cell":
        return F.when(v.c["t"].isin("n", "b"), num(v)).when(v.c["t"].isin("s", "e") & (text_of(v) != ""), 0.0)
    return v.c.cast("double")


def _with_a(name, in_row, in_table, empty=None):
    @row(name, category=_C, args="value1, [value2], ...")
    def of_row(*values):
        xs = F.filter(F.array(*map(_a, values)), lambda x: x.isNotNull())
        return _number(in_row(xs), *([(F.size(xs) == 0, empty)] if empty else []))

    @aggregate(name, category=_C, args="value1, [value2], ...")
    def of_table(*values):
        cs = list(map(_a, values))
        return _number(in_table(cs), *([(counts(cs) == 0, empty)] if empty else []))


_with_a("AVERAGEA", _mean, lambda cs: sums(cs) / F.when(counts(cs) > 0, counts(cs)), DIV0)
_with_a("MAXA", lambda xs: _zero(F.array_max(xs)), lambda cs: _zero(F.greatest(*map(F.max, cs)) if len(cs) > 1 else F.max(cs[0])))
_with_a("MINA", lambda xs: _zero(F.array_min(xs)), lambda cs: _zero(F.least(*map(F.min, cs)) if len(cs) > 1 else F.min(cs[0])))


def _mode(xs: Column) -> Column:
    """The value that occurs most often, of several the one seen first; null if none occurs twice."""
    best = F.aggregate(
        xs,
        F.struct(F.lit(None).cast("double").alias("x"), F.lit(1).alias("n")),
        lambda a, x: F.when(F.size(F.filter(xs, lambda y: y == x)) > a["n"], F.struct(x.alias("x"), F.size(F.filter(xs, lambda y: y == x)).alias("n"))).otherwise(a),
    )
    return best["x"]


for _name in ("MODE", "MODE.SNGL"):

    @row(_name, category=_C, args="number1, [number2], ...")
    def mode(*values):
        out = _mode(_listed(values))
        return _number(out, (out.isNull(), NA))


# order statistics of an array of a row; over tables they are in gridloom.operators.ranking


def _array(v: Value) -> Column:
    return F.filter(F.transform(v.c, lambda x: x.cast("double")), lambda x: x.isNotNull())


def _nth(descending):
    def build(v, k):
        xs, n = F.sort_array(_array(v), asc=not descending), num0(k).cast("int")
        out = F.try_element_at(xs, F.when(n >= 1, n))
        return _number(out, ((n < 1) | (n > F.size(xs)), NUM))

    return build


row("LARGE", category=_C, args="array, k", mode="K")(_nth(True))
row("SMALL", category=_C, args="array, k", mode="K")(_nth(False))


def _rank(average):
    def build(v, ref, order=None):
        x, xs = num(v), _array(ref)
        up = F.lit(False) if order is None else num0(order) != 0
        ahead = F.size(F.filter(xs, lambda y: F.when(up, y < x).otherwise(y > x)))
        same = F.size(F.filter(xs, lambda y: y == x))
        return _number((ahead + 1 + ((same - 1) / 2 if average else 0)).cast("double"), (F.coalesce(same == 0, F.lit(True)), NA))

    return build


row("RANK", "RANK.EQ", category=_C, args="number, ref, [order]", mode="K")(_rank(False))
row("RANK.AVG", category=_C, args="number, ref, [order]", mode="K")(_rank(True))


def _percentile(v, share: Column) -> Value:
    xs = _array(v)
    ok = (share >= 0) & (share <= 1)
    return _number(_sorted_at(xs, F.when(ok, share) * (F.size(xs) - 1)), (~F.coalesce(ok, F.lit(False)), NUM), (F.size(xs) == 0, NUM))


def _percentile_over(v, share: Value) -> Value:
    out = F.percentile(num(v), share.c)
    return _number(out, (out.isNull(), NUM))


row("PERCENTILE", "PERCENTILE.INC", category=_C, args="array, k", mode="K")(lambda v, k: _percentile(v, num(k)))
aggregate("PERCENTILE", "PERCENTILE.INC", category=_C, args="array, k", mode="K")(_percentile_over)
row("QUARTILE", "QUARTILE.INC", category=_C, args="array, quart", mode="K")(lambda v, q: _percentile(v, num(q) / 4))
aggregate("QUARTILE", "QUARTILE.INC", category=_C, args="array, quart", mode="K")(lambda v, q: _percentile_over(v, Value("number", q.c / 4)))


@row("PERCENTILE.EXC", category=_C, args="array, k", mode="K")
def percentile_exc(v, k):
    xs, p = _array(v), num0(k)
    n = F.size(xs)
    bad = (p <= 1 / (n + 1)) | (p >= n / (n + 1))
    return _number(_sorted_at(xs, F.when(~bad, p * (n + 1) - 1)), (n == 0, NUM), (bad, NUM))


@row("FREQUENCY", category=_C, args="data_array, bins_array", mode="K")
def frequency(data, bins):
    xs, cuts = _array(data), F.array_sort(_array(bins))
    n = F.size(cuts)
    up_to = F.transform(cuts, lambda c: F.size(F.filter(xs, lambda x: x <= c)))
    inner = F.transform(up_to, lambda c, i: (c - F.when(i > 0, F.try_element_at(up_to, F.when(i > 0, i))).otherwise(0)).cast("double"))
    return Value("array", F.concat(inner, F.array((F.size(xs) - F.when(n > 0, F.try_element_at(up_to, F.when(n > 0, n))).otherwise(0)).cast("double"))))


@row("TRIMMEAN", category=_C, args="array, percent", mode="K")
def trimmean(v, percent):
    xs, p = F.array_sort(_array(v)), finite(percent)
    n = F.size(xs)
    cut = F.floor(n * p / 2).cast("int")
    kept = F.slice(xs, cut + 1, F.greatest(n - 2 * cut, F.lit(0)))
    return _number(_mean(kept), (F.coalesce((p < 0) | (p >= 1), F.lit(True)), NUM), (F.size(kept) == 0, NUM))


# pairs


def _both(a, b):
    x, y = num(a), num(b)
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def _pair_over(names, f, empty=DIV0, args="known_ys, known_xs"):
    @aggregate(*names, category=_C, args=args, mode="K")
    def build(a, b):
        out = f(*_both(a, b))
        return _number(out, (out.isNull() | F.isnan(out), empty))


_pair_over(["CORREL"], F.corr, args="array1, array2")
_pair_over(["COVARIANCE.P"], F.covar_pop, args="array1, array2")
_pair_over(["COVARIANCE.S"], F.covar_samp, args="array1, array2")
_pair_over(["SLOPE"], F.regr_slope)
_pair_over(["INTERCEPT"], F.regr_intercept)
_pair_over(["RSQ"], lambda y, x: F.pow(F.corr(y, x), F.lit(2.0)))


@aggregate("FORECAST", "FORECAST.LINEAR", category=_C, args="x, known_ys, known_xs", mode="K")
def forecast(x, ys, xs):
    y, k = _both(ys, xs)
    out = F.regr_intercept(y, k) + F.regr_slope(y, k) * num0(x)
    return _number(out, (out.isNull(), DIV0))


def _of_pairs(a, b, f) -> Column:
    """A struct of ``n``, how many pairs of two arrays of a row are numbers, and ``out``, what ``f`` makes of
    n, both means and the sums of products of deviations aa, bb and ab. Pairs, means and sums are
    each bound once."""
    size = F.least(F.size(a.c), F.size(b.c))
    pairs = F.filter(F.arrays_zip(F.slice(a.c, 1, size).alias("a"), F.slice(b.c, 1, size).alias("b")), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    pairs = F.transform(pairs, lambda p: F.struct(p["a"].cast("double").alias("a"), p["b"].cast("double").alias("b")))
    zero = lambda *names: F.struct(*[F.lit(0.0).alias(n) for n in names])

    def deviations(ps, m):
        sums = F.aggregate(ps, zero("aa", "bb", "ab"), lambda s, p: let(F.struct((p["a"] - m["a"]).alias("x"), (p["b"] - m["b"]).alias("y")), lambda d: F.struct((s["aa"] + d["x"] * d["x"]).alias("aa"), (s["bb"] + d["y"] * d["y"]).alias("bb"), (s["ab"] + d["x"] * d["y"]).alias("ab"))))
        n = F.size(ps)
        return let(sums, lambda s: F.struct(n.alias("n"), f(n, m["a"], m["b"], s["aa"], s["bb"], s["ab"]).cast("double").alias("out")))

    def means(ps):
        total = F.aggregate(ps, zero("a", "b"), lambda s, p: F.struct((s["a"] + p["a"]).alias("a"), (s["b"] + p["b"]).alias("b")))
        n = _nz(F.size(ps))
        return let(total, lambda t: let(F.struct((t["a"] / n).alias("a"), (t["b"] / n).alias("b")), lambda m: deviations(ps, m)))

    return let(pairs, means)


def _pair_row(names, f, least=1, args="known_ys, known_xs"):
    @row(*names, category=_C, args=args, mode="K")
    def build(a, b):
        s = _of_pairs(a, b, f)
        return or_error("number", let(s, lambda s: F.when(s["n"] >= least, s["out"])), DIV0)


def _nz(c: Column) -> Column:
    return F.when(c != 0, c)


_pair_row(["CORREL"], lambda n, ma, mb, aa, bb, ab: ab / _nz(F.sqrt(aa * bb)), args="array1, array2")
_pair_row(["COVARIANCE.P"], lambda n, ma, mb, aa, bb, ab: ab / _nz(n), args="array1, array2")
_pair_row(["COVARIANCE.S"], lambda n, ma, mb, aa, bb, ab: ab / _nz(n - 1), 2, args="array1, array2")
_pair_row(["SLOPE"], lambda n, my, mx, yy, xx, xy: xy / _nz(xx))
_pair_row(["INTERCEPT"], lambda n, my, mx, yy, xx, xy: my - xy / _nz(xx) * mx)
_pair_row(["RSQ"], lambda n, my, mx, yy, xx, xy: xy * xy / _nz(xx * yy))


@row("FORECAST", "FORECAST.LINEAR", category=_C, args="x, known_ys, known_xs", mode="K")
def forecast_row(x, ys, xs):
    s = _of_pairs(ys, xs, lambda n, my, mx, yy, xx, xy: my + xy / _nz(xx) * (num0(x) - mx))
    return or_error("number", s["out"], DIV0)


# distributions


@row("FISHER", category=_C, args="x")
def fisher(v):
    x = finite(v)
    bad = F.coalesce((x <= -1) | (x >= 1), F.lit(True))
    return _number(0.5 * F.ln((1 + F.when(~bad, x)) / (1 - F.when(~bad, x))), (bad, NUM))


@row("FISHERINV", category=_C, args="y")
def fisherinv(v):
    e = F.exp(2 * finite(v))
    return _number((e - 1) / (e + 1), (e.isNull(), NUM))


@row("STANDARDIZE", category=_C, args="x, mean, standard_dev")
def standardize(v, mean, sd):
    x, m, s = finite(v), finite(mean), finite(sd)
    return _number((x - m) / F.when(s > 0, s), (x.isNull() | m.isNull() | s.isNull(), VALUE), (s <= 0, NUM))


#: Coefficients of published approximations (fixed values): the error function's polynomial
#: (Abramowitz and Stegun 7.1.26), the normal quantile's (26.2.23) and the rational normal quantile.
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911
_TAIL_N, _TAIL_D = (2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308)
_MIDDLE_N = (2.506628277459239e00, -3.066479806614716e01, 1.383577518672690e02, -2.759285104469687e02, 2.209460984245205e02, -3.969683028665376e01)
_MIDDLE_D = (1.0, -1.328068155288572e01, 6.680131188771972e01, -1.556989798598866e02, 1.615858368580409e02, -5.447609879822406e01)
_OUTER_N = (2.938163982698783e00, 4.374664141464968e00, -2.549732539343734e00, -2.400758277161838e00, -3.223964580411365e-01, -7.784894002430293e-03)
_OUTER_D = (1.0, 3.754408661907416e00, 2.445134137142996e00, 3.224671290700398e-01, 7.784695709041462e-03)
_LOW = 0.02425


def _poly(coefficients, x: Column) -> Column:
    return reduce(lambda a, c: a * x + c, reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def normal_cdf(z: Column) -> Column:
    return let(z, _normal_cdf)


def _normal_cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + _ERF_P * x)
    return 0.5 * (1 + F.when(z < 0, -1).otherwise(1) * (1 - _poly(_ERF, t) * t * F.exp(-x * x)))


def normal_quantile(p: Column) -> Column:
    """Of a probability above 0 and below 1, else null."""
    return let(p, lambda p: F.when((p > 0) & (p < 1), _normal_quantile(p)))


def _normal_quantile(p: Column) -> Column:
    q = p - 0.5
    middle = _poly(_MIDDLE_N, q * q) * q / _poly(_MIDDLE_D, q * q)
    tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    outer = let(tail, lambda t: _poly(_OUTER_N, t) / _poly(_OUTER_D, t))
    return F.when(p < _LOW, outer).when(p <= 1 - _LOW, middle).otherwise(-outer)


def _cumulative(v) -> Column:
    return F.lit(True) if v is None else truthy(v)


def _bell(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


@row("NORM.S.DIST", category=_C, args="z, cumulative")
def norm_s_dist(v, cumulative=None):
    z = finite(v)
    return _number(F.when(_cumulative(cumulative), normal_cdf(z)).otherwise(_bell(z)), (z.isNull(), NUM))


@row("NORM.DIST", category=_C, args="x, mean, standard_dev, cumulative")
def norm_dist(v, mean, sd, cumulative=None):
    x, m, s = finite(v), finite(mean), finite(sd)
    s = F.when(s > 0, s)
    z = (x - m) / s
    return _number(F.when(_cumulative(cumulative), normal_cdf(z)).otherwise(_bell(z) / s), (z.isNull(), NUM))


@row("NORM.S.INV", category=_C, args="probability")
def norm_s_inv(v):
    return or_error("number", normal_quantile(finite(v)), NUM)


@row("NORM.INV", category=_C, args="probability, mean, standard_dev")
def norm_inv(v, mean, sd):
    m, s = finite(mean), finite(sd)
    return or_error("number", m + normal_quantile(finite(v)) * F.when(s > 0, s), NUM)


@row("CONFIDENCE.NORM", category=_C, args="alpha, standard_dev, size")
def confidence_norm(alpha, sd, size):
    a, s, n = finite(alpha), finite(sd), finite(size)
    bad = (a <= 0) | (a >= 1) | (s <= 0) | (n < 1)
    t = F.sqrt(-2 * F.ln(F.when(~bad, a) / 2))
    return _number((t - _poly(_TAIL_N, t) / _poly(_TAIL_D, t)) * s / F.sqrt(F.when(~bad, n)), (a.isNull() | s.isNull() | n.isNull(), VALUE), (bad, NUM))


def _terms(first: Column, factor, n: Column, all_: Column) -> Column:
    """The n-th term of a series that starts with ``first``, or the sum up to it; each term is the
    one before times ``factor(k)``."""
    end = F.aggregate(steps(1, n), F.struct(first.alias("t"), first.alias("s")), lambda a, k: F.struct((a["t"] * factor(k)).alias("t"), (a["s"] + a["t"] * factor(k)).alias("s")))
    return F.when(all_, end["s"]).otherwise(end["t"])


@row("POISSON.DIST", category=_C, args="x, mean, cumulative")
def poisson_dist(v, mean, cumulative=None):
    x, m = F.floor(finite(v)), finite(mean)
    bad = F.coalesce((x < 0) | (m < 0), F.lit(True))
    return _number(F.exp(-m) * _terms(F.lit(1.0), lambda k: m / k, F.when(~bad, x), _cumulative(cumulative)), (bad, NUM))


@row("BINOM.DIST", category=_C, args="number_s, trials, probability_s, cumulative")
def binom_dist(successes, trials, probability, cumulative=None):
    k, n, p = F.floor(finite(successes)), F.floor(finite(trials)), finite(probability)
    bad = F.coalesce((k < 0) | (n < 0) | (k > n) | (p < 0) | (p > 1), F.lit(True))
    term = lambda i: F.aggregate(steps(1, i), F.lit(1.0), lambda a, j: a * (n - i + j) / j) * F.pow(p, i) * F.pow(1 - p, n - i)
    total = F.aggregate(F.transform(steps(0, F.when(~bad, k)), term), F.lit(0.0), lambda a, x: a + x)
    return _number(F.when(_cumulative(cumulative), total).otherwise(term(F.when(~bad, k).cast("double"))), (bad, NUM))


@row("WEIBULL.DIST", category=_C, args="x, alpha, beta, cumulative")
def weibull_dist(v, alpha, beta, cumulative=None):
    x, a, b = finite(v), finite(alpha), finite(beta)
    bad = F.coalesce((x < 0) | (a <= 0) | (b <= 0), F.lit(True))
    b = F.when(~bad, b)
    rest = F.exp(-F.pow(x / b, a))
    return _number(F.when(_cumulative(cumulative), 1 - rest).otherwise(a / b * F.pow(x / b, a - 1) * rest), (bad, NUM))


@row("EXPON.DIST", category=_C, args="x, lambda, cumulative")
def expon_dist(v, rate, cumulative=None):
    x, k = finite(v), finite(rate)
    rest = F.exp(-k * x)
    return _number(F.when(_cumulative(cumulative), 1 - rest).otherwise(k * rest), (F.coalesce((x < 0) | (k <= 0), F.lit(True)), NUM))


@row("LOGNORM.DIST", category=_C, args="x, mean, standard_dev, cumulative")
def lognorm_dist(v, mean, sd, cumulative=None):
    x, m, s = finite(v), finite(mean), finite(sd)
    bad = F.coalesce((x <= 0) | (s <= 0), F.lit(True)) | m.isNull()
    x, s = F.when(~bad, x), F.when(~bad, s)
    z = (F.ln(x) - m) / s
    return _number(F.when(_cumulative(cumulative), normal_cdf(z)).otherwise(_bell(z) / (x * s)), (bad, NUM))
