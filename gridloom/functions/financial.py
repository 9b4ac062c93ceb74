"""Time value of money, cash flows and depreciation. Roots are found for all rows of a batch at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..values import DIV0, NUM, VALUE, Value, finite, let, num, num0, result
from .maths import steps
from .registry import aggregate, row

_C = "financial"


def _none(*columns: Column) -> tuple[Column, str]:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns]), VALUE


def _or0(v) -> Column:
    return F.lit(0.0) if v is None else num0(v)


def _out(c: Column, *cases) -> Value:
    return result("number", c, *cases)


def _safe(c: Column) -> Column:
    return F.when(c != 0, c)


def _over(a: Column, b: Column) -> Column:
    """a / b, null where b is 0; b is stated once, so that long ones don't double."""
    return F.try_divide(a, b)


def _annuity(rate: Column, n: Column, kind: Column) -> tuple[Column, Column]:
    """Growth over n periods, and what payments of 1 are worth at the end."""
    growth = F.pow(1 + rate, n)
    return growth, F.when(rate == 0, n).otherwise((1 + rate * kind) * _over(growth - 1, rate))


def payment(rate, n, pv, fv, kind) -> Column:
    growth, worth = _annuity(rate, n, kind)
    return -_over(pv * growth + fv, worth)


@row("FV", category=_C, args="rate, nper, pmt, [pv], [type]")
def fv(rate, nper, pmt, pv=None, kind=None):
    r, n = finite(rate), finite(nper)
    growth, worth = _annuity(r, n, _or0(kind))
    return _out(-(_or0(pv) * growth + num0(pmt) * worth), _none(r, n))


@row("PV", category=_C, args="rate, nper, pmt, [fv], [type]")
def pv(rate, nper, pmt, fv=None, kind=None):
    r, n = finite(rate), finite(nper)
    growth, worth = _annuity(r, n, _or0(kind))
    return _out(-(_or0(fv) + num0(pmt) * worth) / growth, _none(r, n))


@row("PMT", category=_C, args="rate, nper, pv, [fv], [type]")
def pmt(rate, nper, pv, fv=None, kind=None):
    r, n, p = finite(rate), finite(nper), finite(pv)
    return _out(payment(r, n, p, _or0(fv), _or0(kind)), _none(r, n, p), (n == 0, NUM))


@row("NPER", category=_C, args="rate, pmt, pv, [fv], [type]")
def nper(rate, pmt, pv, fv=None, kind=None):
    r, m, p, f = finite(rate), finite(pmt), finite(pv), _or0(fv)
    each = m * (1 + r * _or0(kind))
    ratio = _over(each - f * r, p * r + each)
    flat = -_over(p + f, m)
    # the logarithm of what isn't above 0 is null
    out = F.when(r == 0, flat).otherwise(_over(F.ln(ratio), F.ln(1 + r)))
    return _out(out, _none(r, m, p), (F.when(r == 0, m == 0).otherwise(F.coalesce(ratio <= 0, F.lit(True))), NUM))


def newton(value, guess: np.ndarray, iterations: int, lowest: float | None = None) -> np.ndarray:
    """Roots by Newton's steps until two differ by less than 1e-10, of all rows at once; NaN where that
    isn't reached, the slope vanishes or a step falls to ``lowest`` or below. ``value(x, rows)`` gives
    the function and its slope at ``x`` for these rows; rows that have ended are left out."""
    x, root = guess.astype(np.float64), np.full(len(guess), np.nan)
    rows = np.flatnonzero(~np.isnan(x))
    with np.errstate(all="ignore"):
        for _ in range(iterations):
            if not len(rows):
                break
            f, d = value(x[rows], rows)
            failed = (np.abs(d) < 1e-15) | np.isnan(f) | np.isnan(d)
            if lowest is not None:
                failed |= x[rows] <= lowest
            after = x[rows] - f / d
            found = ~failed & (np.abs(after - x[rows]) < 1e-10)
            x[rows] = after
            root[rows[found]] = after[found]
            rows = rows[~failed & ~found]
    return root


def _double(a: pa.Array) -> np.ndarray:
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _roots(root: np.ndarray) -> pa.Array:
    return pa.array(root, pa.float64(), mask=np.isnan(root))


@F.arrow_udf(DoubleType())
def _rate(nper: pa.Array, pmt: pa.Array, pv: pa.Array, fv: pa.Array, kind: pa.Array, guess: pa.Array) -> pa.Array:
    columns = [_double(c) for c in (nper, pmt, pv, fv, kind)]

    def value(r, rows):
        n, m, p, f, k = (c[rows] for c in columns)
        growth, less, due = (1 + r) ** n, (1 + r) ** (n - 1), m * (1 + r * k)
        at = p * growth + due * (growth - 1) / r + f
        return at, p * n * less + due * (n * less * r - (growth - 1)) / (r * r) + m * k * (growth - 1) / r

    return _roots(newton(value, _double(guess), 100, -1.0))


@F.arrow_udf(DoubleType())
def _irr(flows: pa.Array, guess: pa.Array) -> pa.Array:
    """Rows with equally many flows are one table each; a null among flows counts as 0."""
    sizes = _double(pc.list_value_length(flows))
    guess, root = _double(guess), np.full(len(flows), np.nan)
    for size in np.unique(sizes[sizes > 0]):
        own = np.flatnonzero(sizes == size)
        table = np.nan_to_num(_double(pc.list_flatten(flows.take(pa.array(own)))), nan=0.0, posinf=np.inf, neginf=-np.inf).reshape(len(own), int(size))

        def value(r, rows, table=table):
            f, d = np.zeros(len(rows)), np.zeros(len(rows))
            for i in range(table.shape[1]):
                power = (1 + r) ** i
                f += table[rows, i] / power
                d -= i * table[rows, i] / (power * (1 + r))
            return f, d

        root[own] = newton(value, guess[own], 200)
    return _roots(root)


@row("RATE", category=_C, args="nper, pmt, pv, [fv], [type], [guess]")
def rate(nper, pmt, pv, fv=None, kind=None, guess=None):
    n, m, p, f, k = finite(nper), finite(pmt), finite(pv), _or0(fv), _or0(kind)
    root = _rate(n, m, p, f, k, F.lit(0.1) if guess is None else num0(guess))
    return _out(root, _none(n, m, p), (root.isNull(), NUM))


def _flows(values) -> Column:
    if len(values) == 1 and values[0].kind == "array":
        return F.transform(values[0].c, lambda x: x.cast("double"))
    return F.array(*[num(v) for v in values])


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


@row("NPV", category=_C, args="rate, value1, [value2], ...")
def npv(rate, *values):
    r = finite(rate)
    return _out(_sum(F.transform(_flows(values), lambda c, i: c / F.pow(1 + r, i + 1))), _none(r))


@aggregate("NPV", category=_C, args="rate, value1, period")
def npv_over(rate, flow, period):
    """Over rows; ``period`` counts from 1."""
    r = finite(rate)
    return _out(F.coalesce(F.sum(num(flow) / F.pow(1 + r, num(period))), F.lit(0.0)))


@row("IRR", category=_C, args="values, [guess]", mode="K")
def irr(values, guess=None):
    flows = _flows([values])
    root = _irr(flows, F.lit(0.1) if guess is None else num0(guess))
    return _out(root, (F.size(flows) < 2, NUM), (F.exists(flows, lambda c: c.isNull()), VALUE), (root.isNull(), NUM))


@row("MIRR", category=_C, args="values, finance_rate, reinvest_rate", mode="K")
def mirr(values, finance, reinvest):
    flows, a, b = _flows([values]), finite(finance), finite(reinvest)
    n = F.size(flows)
    spent = _sum(F.transform(flows, lambda c, i: F.when(c < 0, c / F.pow(1 + a, i))))
    earned = _sum(F.transform(flows, lambda c, i: F.when(c >= 0, c * F.pow(1 + b, n - 1 - i))))
    return _out(F.pow(-earned / _safe(spent), 1 / _safe(n - 1)) - 1, (n < 2, VALUE), _none(a, b), (spent == 0, DIV0))


@row("SLN", category=_C, args="cost, salvage, life")
def sln(cost, salvage, life):
    c, s, n = finite(cost), finite(salvage), finite(life)
    return _out((c - s) / _safe(n), _none(c, s, n), (n == 0, DIV0))


@row("SYD", category=_C, args="cost, salvage, life, per")
def syd(cost, salvage, life, per):
    c, s, n, p = finite(cost), finite(salvage), finite(life), finite(per)
    return _out((c - s) * (n - p + 1) * 2 / _safe(n * (n + 1)), _none(c, s, n, p), ((n <= 0) | (p <= 0) | (p > n), NUM))


@row("DB", category=_C, args="cost, salvage, life, period, [month]")
def db(cost, salvage, life, period, month=None):
    c, s, n, p = finite(cost), finite(salvage), finite(life), finite(period)
    m = F.lit(12.0) if month is None else num0(month)
    share = F.floor((1 - F.pow(s / _safe(c), 1 / _safe(n))) * 1000 + 0.5) / 1000
    used = lambda left, i: F.when(i == 1, c * share * m / 12).when(i == F.ceil(n) + 1, left * share * (12 - m) / 12).otherwise(left * share)
    state = F.aggregate(steps(1, p), F.struct(c.alias("left"), F.lit(0.0).alias("now")), lambda a, i: F.struct((a["left"] - used(a["left"], i)).alias("left"), used(a["left"], i).alias("now")))
    return _out(state["now"], _none(c, s, n, p), ((n <= 0) | (p <= 0) | (p > n + 1) | (c < 0) | (s < 0), NUM), (F.floor(p) != p, VALUE))


@row("DDB", category=_C, args="cost, salvage, life, period, [factor]")
def ddb(cost, salvage, life, period, factor=None):
    c, s, n, p = finite(cost), finite(salvage), finite(life), finite(period)
    k = F.lit(2.0) if factor is None else num0(factor)
    used = lambda book: F.least(book * k / _safe(n), book - s)
    state = F.aggregate(steps(1, p), F.struct(c.alias("book"), F.lit(0.0).alias("now")), lambda a, i: F.struct((a["book"] - used(a["book"])).alias("book"), used(a["book"]).alias("now")))
    return _out(F.when(F.floor(p) != p, 0.0).otherwise(F.greatest(state["now"], F.lit(0.0))), _none(c, s, n, p), ((n <= 0) | (p <= 0) | (p > n) | (c < 0) | (s < 0), NUM))


def _interest(r, per, pay, p, kind) -> Column:
    """Interest of a period: the rate on what is owed at its start."""
    growth, worth = _annuity(r, per - 1, kind)
    return F.when((kind == 1) & (per == 1), 0.0).otherwise((p * growth + pay * worth) * r)


def _period(name, principal: bool):
    @row(name, category=_C, args="rate, per, nper, pv, [fv], [type]")
    def build(rate, per, nper, pv, fv=None, kind=None):
        r, i, n, p, k = finite(rate), finite(per), finite(nper), finite(pv), _or0(kind)
        pay = payment(r, n, p, _or0(fv), k)
        interest = _interest(r, i, pay, p, k)
        return _out(pay - interest if principal else interest, _none(r, i, n, p), ((i < 1) | (i > n), NUM))


_period("IPMT", False)
_period("PPMT", True)


def _cumulative(name, principal: bool):
    @row(name, category=_C, args="rate, nper, pv, start_period, end_period, type")
    def build(rate, nper, pv, start, end, kind=None):
        r, n, p, a, b, k = finite(rate), finite(nper), finite(pv), F.floor(num0(start)), F.floor(num0(end)), _or0(kind)
        pay = payment(r, n, p, F.lit(0.0), k)
        each = F.transform(steps(a, b), lambda i: pay - _interest(r, i, pay, p, k) if principal else _interest(r, i, pay, p, k))
        return _out(_sum(each), _none(r, n, p), ((r <= 0) | (n <= 0) | (p <= 0) | (a < 1) | (b < a) | (b > n), NUM))


_cumulative("CUMIPMT", False)
_cumulative("CUMPRINC", True)


def _compound(name, args, f):
    @row(name, category=_C, args=args)
    def build(rate, periods):
        r, n = finite(rate), finite(periods)
        n = F.signum(n) * F.floor(F.abs(n))
        bad = (r <= 0) | (n < 1)
        return _out(f(r, F.when(~bad, n)), _none(r, n), (bad, NUM))


_compound("EFFECT", "nominal_rate, npery", lambda r, n: F.pow(1 + r / n, n) - 1)
_compound("NOMINAL", "effect_rate, npery", lambda r, n: n * (F.pow(r + 1, 1 / n) - 1))


def _fraction(name, args, f):
    @row(name, category=_C, args=args)
    def build(price, fraction):
        x, k = finite(price), finite(fraction)
        k = F.signum(k) * F.floor(F.abs(k))
        whole = F.signum(x) * F.floor(F.abs(x))
        return _out(whole + f(x - whole, F.when(k >= 1, k)), _none(x, k), (k < 1, DIV0))


_fraction("DOLLARDE", "fractional_dollar, fraction", lambda rest, k: rest * 10 / k)
_fraction("DOLLARFR", "decimal_dollar, fraction", lambda rest, k: rest * k / 10)
