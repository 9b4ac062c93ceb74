"""Arithmetic operators, mathematics and numbered aggregates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..affine import Affine, combined
from ..values import DIV0, NUM, VALUE, Value, finite, first_error, let, num, num0, or_error, result, text_of, wrap
from .registry import CATALOG, aggregate, row

_C = "math"


def _number(c: Column, *cases) -> Value:
    return result("number", c, *cases)


def _trunc(c: Column) -> Column:
    return F.signum(c) * F.floor(F.abs(c)).cast("double")


def _up(c: Column) -> Column:
    return F.ceil(c).cast("double")


def _down(c: Column) -> Column:
    return F.floor(c).cast("double")


def product(items: Column, start: float = 1.0) -> Column:
    return F.aggregate(items, F.lit(start), lambda a, x: a * x)


def steps(start, stop) -> Column:
    """Whole numbers from start to stop; none if stop is less."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (start, stop))
    return F.when(b >= a, F.transform(F.sequence(a, F.greatest(a, b)), lambda x: x.cast("double"))).otherwise(F.array().cast("array<double>"))


# operators


def _arithmetic(f, sign: str, zero: str | None = None):
    def operator(a, b) -> Value:
        if isinstance(a, Affine) or isinstance(b, Affine):
            return combined(sign, a, b)
        a, b = wrap(a), wrap(b)
        x, y = num(a), num(b)
        cases = first_error(a, b)
        if zero:
            cases.append((y == 0, zero))
        return result("number", f(x, F.when(y != 0, y) if zero else y), *cases)

    return operator


add = _arithmetic(lambda x, y: x + y, "+")
subtract = _arithmetic(lambda x, y: x - y, "-")
multiply = _arithmetic(lambda x, y: x * y, "*")
divide = _arithmetic(lambda x, y: x / y, "/", DIV0)
power = _arithmetic(F.pow, "^")


def negate(a) -> Value:
    if isinstance(a, Affine):
        return combined("*", a, -1.0)
    a = wrap(a)
    return result("number", -num(a), *first_error(a))


def join_text(a, b) -> Value:
    """The operator ``&``."""
    a, b = wrap(a), wrap(b)
    return result("text", F.concat(text_of(a), text_of(b)), *first_error(a, b))


def compare(a, operator: str, b) -> Value:
    """``= <> < > <= >=``: by number where both are numbers, else by text, case-sensitive."""
    a, b = wrap(a), wrap(b)
    x, y, s, t = num(a), num(b), text_of(a), text_of(b)
    by = {
        "=": lambda p, q: p == q,
        "<>": lambda p, q: p != q,
        "<": lambda p, q: p < q,
        ">": lambda p, q: p > q,
        "<=": lambda p, q: p <= q,
        ">=": lambda p, q: p >= q,
    }[operator]
    out = F.when(x.isNotNull() & y.isNotNull(), by(x, y)).otherwise(by(s, t))
    return result("logical", out, *first_error(a, b))


# one number in, one out


def _simple(name, f, args="number", strict=None, cases=()):
    """strict: the error where the number isn't finite; cases: conditions on the number and codes."""

    @row(name, category=_C, args=args)
    def build(v):
        x = finite(v) if strict else num0(v)
        if strict and not cases:
            return or_error("number", f(x), strict)
        return _number(f(x), *([(x.isNull(), strict)] if strict else []), *[(test(x), code) for test, code in cases])


_simple("ABS", F.abs)
_simple("INT", _down)
_simple("SQRT", lambda x: F.sqrt(F.when(x >= 0, x)), cases=[(lambda x: x < 0, NUM)])
_simple("LN", lambda x: F.ln(F.when(x > 0, x)), strict=VALUE, cases=[(lambda x: x <= 0, NUM)])
_simple("LOG10", lambda x: F.log10(F.when(x > 0, x)), strict=VALUE, cases=[(lambda x: x <= 0, NUM)])
_simple("EXP", F.exp, strict=VALUE)
_simple("SIGN", F.signum, strict=VALUE)
_simple("RADIANS", lambda x: x * math.pi / 180, strict=VALUE, args="angle")
_simple("DEGREES", lambda x: x * 180 / math.pi, strict=VALUE, args="angle")
for _name, _f in {"SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ATAN": F.atan, "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh}.items():
    _simple(_name, _f, strict=VALUE)
for _name, _f in {"ASIN": F.asin, "ACOS": F.acos}.items():
    _simple(_name, _f, strict=VALUE, cases=[(lambda x: F.abs(x) > 1, NUM)])
_simple("ACOT", lambda x: F.when(x == 0, F.lit(math.pi / 2)).otherwise(F.atan(1 / F.when(x != 0, x))), strict=VALUE)
_simple("COT", lambda x: 1 / F.when(F.tan(x) != 0, F.tan(x)), strict=DIV0, cases=[(lambda x: x == 0, DIV0)])
_simple("CSC", lambda x: 1 / F.when(F.sin(x) != 0, F.sin(x)), strict=DIV0, cases=[(lambda x: x == 0, DIV0)])
_simple("SEC", lambda x: 1 / F.when(F.cos(x) != 0, F.cos(x)), strict=DIV0, cases=[(lambda x: F.cos(x) == 0, DIV0)])
_simple("SQRTPI", lambda x: F.sqrt(F.when(x >= 0, x * math.pi)), strict=VALUE, cases=[(lambda x: x < 0, NUM)])
_simple("EVEN", lambda x: F.signum(x) * _up(F.abs(x) / 2) * 2, strict=VALUE)
_simple("ODD", lambda x: F.when(x == 0, F.lit(1.0)).otherwise(F.signum(x) * (_up((F.abs(x) - 1) / 2) * 2 + 1)), strict=VALUE)
_simple("FACT", lambda x: product(steps(2, F.when((x >= 0) & (x <= 170), _down(x)).otherwise(0))), strict=VALUE, cases=[(lambda x: (x < 0) | (x >= 171), NUM)])
_simple(
    "FACTDOUBLE",
    lambda x: F.when(x < 1, F.lit(1.0)).otherwise(product(F.transform(F.filter(steps(0, F.when((x >= 1) & (x < 301), _down(x)).otherwise(0)), lambda i: (F.floor(x) - i) % 2 == 0), lambda i: F.greatest(i, F.lit(1.0))))),
    strict=VALUE,
    cases=[(lambda x: x < -1, NUM)],
)


@row("PI", category=_C, args="")
def pi():
    return wrap(math.pi)


@row("RAND", category=_C, args="")
def rand():
    return Value("number", F.rand())


@row("RANDBETWEEN", category=_C, args="bottom, top")
def randbetween(bottom, top):
    a, b = _up(num0(bottom)), _down(num0(top))
    return _number(F.floor(F.rand() * (b - a + 1)).cast("double") + a, (a > b, NUM))


@row("POWER", category=_C, args="number, power")
def power_(a, b):
    return Value("number", F.pow(num0(a), num0(b)))


@row("MOD", category=_C, args="number, divisor")
def mod(a, b):
    x, y = num0(a), num0(b)
    return _number(x % F.when(y != 0, y), (y == 0, DIV0))


def _digits(round_):
    def build(v, digits=None):
        x, d = num(v), F.lit(0.0) if digits is None else num0(digits)
        p = F.pow(F.lit(10.0), d)
        return _number(round_(x, p), *first_error(v), (x.isNull(), VALUE))

    return build


row("ROUND", category=_C, args="number, num_digits")(_digits(lambda x, p: _down(x * p + 0.5) / p))
row("ROUNDUP", category=_C, args="number, num_digits")(_digits(lambda x, p: F.signum(x) * _up(F.abs(x) * p) / p))
row("ROUNDDOWN", category=_C, args="number, num_digits")(_digits(lambda x, p: F.signum(x) * _down(F.abs(x) * p) / p))
row("TRUNC", category=_C, args="number, [num_digits]")(_digits(lambda x, p: F.signum(x) * _down(F.abs(x) * p) / p))


@row("CEILING", category=_C, args="number, [significance]")
def ceiling(v, sig=None):
    x, s = num0(v), F.lit(1.0) if sig is None else num0(sig)
    return _number(F.when(s == 0, F.lit(0.0)).otherwise(_up(x / F.when(s != 0, s)) * s), ((x > 0) & (s < 0), NUM))


@row("FLOOR", category=_C, args="number, [significance]")
def floor(v, sig=None):
    x, s = num0(v), F.lit(1.0) if sig is None else num0(sig)
    return _number(_down(x / F.when(s != 0, s)) * s, (s == 0, DIV0), (((x > 0) & (s < 0)) | ((x < 0) & (s > 0)), NUM))


def _precise(f, other=None):
    def build(v, sig=None, mode=None):
        x, s = num0(v), F.abs(F.lit(1.0) if sig is None else num0(sig))
        q = x / F.when(s != 0, s)
        out = f(q) if other is None or mode is None else F.when((x < 0) & (num0(mode) != 0), other(q)).otherwise(f(q))
        return Value("number", F.when(s == 0, F.lit(0.0)).otherwise(out * s))

    return build


row("CEILING.PRECISE", category=_C, args="number, [significance]")(lambda v, sig=None: _precise(_up)(v, sig))
row("FLOOR.PRECISE", category=_C, args="number, [significance]")(lambda v, sig=None: _precise(_down)(v, sig))
row("CEILING.MATH", category=_C, args="number, [significance], [mode]")(_precise(_up, _down))
row("FLOOR.MATH", category=_C, args="number, [significance], [mode]")(_precise(_down, _up))


@row("MROUND", category=_C, args="number, multiple")
def mround(v, multiple):
    x, m = num0(v), num0(multiple)
    return _number(F.when(m == 0, F.lit(0.0)).otherwise(_down(x / F.when(m != 0, m) + 0.5) * m), (((x > 0) & (m < 0)) | ((x < 0) & (m > 0)), NUM))


@row("LOG", category=_C, args="number, [base]")
def log(v, base=None):
    x, b = num0(v), F.lit(10.0) if base is None else num0(base)
    bad = (x <= 0) | (b <= 0) | (b == 1)
    return _number(F.ln(F.when(~bad, x)) / F.ln(F.when(~bad, b)), (bad, NUM))


@row("QUOTIENT", category=_C, args="numerator, denominator")
def quotient(a, b):
    x, y = finite(a), finite(b)
    return _number(_trunc(x / F.when(y != 0, y)), (x.isNull() | y.isNull() | (y == 0), DIV0))


def _choose(n: Column, k: Column) -> Column:
    """Binomial coefficient, rounded; the factors alternate so that it stays small."""
    return F.round(F.aggregate(steps(1, k), F.lit(1.0), lambda a, i: a * (n - k + i) / i))


@row("COMBIN", category=_C, args="number, number_chosen")
def combin(a, b):
    n, k = _trunc(num0(a)), _trunc(num0(b))
    bad = (n < 0) | (k < 0) | (k > n)
    return _number(_choose(F.when(~bad, n), F.when(~bad, k)), (bad, NUM))


@row("COMBINA", category=_C, args="number, number_chosen")
def combina(a, b):
    n, k = _trunc(num0(a)), _trunc(num0(b))
    bad = (n < 0) | (k < 0)
    return _number(F.when(k == 0, F.lit(1.0)).otherwise(_choose(F.when(~bad, n + k - 1), F.when(~bad, k))), (bad, NUM))


@row("PERMUT", category=_C, args="number, number_chosen")
def permut(a, b):
    n, k = _trunc(num0(a)), _trunc(num0(b))
    bad = (n < 0) | (k < 0) | (k > n)
    return _number(product(steps(F.when(~bad, n - k + 1), F.when(~bad, n))), (bad, NUM))


def _numbers(values) -> Column:
    return F.array(*[num0(v) for v in values])


@row("MULTINOMIAL", category=_C, args="number1, [number2], ...")
def multinomial(*values):
    xs = F.transform(_numbers(values), _down)
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    ways = F.aggregate(xs, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("n")), lambda a, x: F.struct((a["p"] * _choose(a["n"] + x, x)).alias("p"), (a["n"] + x).alias("n")))
    return _number(F.round(ways["p"]), (F.exists(xs, lambda x: x < 0), NUM), (total > 170, NUM))


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps: as many as Fibonacci numbers up to the smaller number, of which doubles that hold
    whole numbers need at most 78."""
    least = F.least(a, b)
    most = F.when(least < 2.0**53, (F.log2(least + 1) * 1.4405).cast("int") + 4).otherwise(80)
    end = F.aggregate(
        F.sequence(F.lit(1), F.least(most, F.lit(80))),
        F.struct(a.alias("a"), b.alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b"))),
    )
    return end["a"]


@row("GCD", category=_C, args="number1, [number2], ...")
def gcd(*values):
    xs = F.transform(_numbers(values), _down)
    return _number(F.aggregate(xs, F.lit(0.0), _gcd), (F.exists(xs, lambda x: x < 0), NUM))


@row("LCM", category=_C, args="number1, [number2], ...")
def lcm(*values):
    xs = F.transform(_numbers(values), _down)
    return _number(F.aggregate(xs, F.lit(1.0), lambda a, x: F.when((a == 0) | (x == 0), F.lit(0.0)).otherwise(let(_gcd(a, x), lambda g: a / F.when(g != 0, g) * x))), (F.exists(xs, lambda x: x < 0), NUM))


@row("ATAN2", category=_C, args="x_num, y_num")
def atan2(x, y):
    a, b = finite(x), finite(y)
    return _number(F.atan2(b, a), (a.isNull() | b.isNull(), VALUE), ((a == 0) & (b == 0), DIV0))


@row("SERIESSUM", category=_C, args="x, n, m, coefficients", mode="K")
def seriessum(x, n, m, coefficients):
    if coefficients.kind != "array":
        return result("number", F.lit(None).cast("double"), (F.lit(True), VALUE))
    a, b, c = num0(x), num0(n), num0(m)
    terms = F.transform(coefficients.c, lambda k, i: k.cast("double") * F.pow(a, b + i * c))
    return Value("number", F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))


@row("BASE", category=_C, args="number, radix, [min_length]")
def base(v, radix, least=None):
    x, r = _down(num0(v)), num0(radix).cast("int")
    bad = (x < 0) | (r < 2) | (r > 36)
    width = F.lit(0) if least is None else num0(least).cast("int")
    digits = let(_digits_of(F.when(~bad, x), r), lambda s: F.lpad(s, F.greatest(width, F.length(s)), "0"))
    return result("text", digits, (bad, NUM))


def _digits_of(x: Column, radix: Column) -> Column:
    """Digits of a whole number in a radix that may differ by row."""
    return F.call_function("conv", x.cast("long").cast("string"), F.lit(10), radix)


@row("DECIMAL", category=_C, args="text, radix")
def decimal(v, radix):
    """The longest prefix that is made of the radix's digits."""
    s, r = F.upper(F.trim(text_of(v))), num0(radix).cast("int")
    digits = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    read = F.aggregate(
        digits,
        F.struct(F.lit(0.0).alias("n"), F.lit(0).alias("k"), F.lit(True).alias("open")),
        lambda a, d: F.when(a["open"] & (d >= 0) & (d < r), F.struct((a["n"] * r + d).alias("n"), (a["k"] + 1).alias("k"), F.lit(True).alias("open"))).otherwise(F.struct(a["n"].alias("n"), a["k"].alias("k"), F.lit(False).alias("open"))),
    )
    return or_error("number", let(read, lambda a: F.when((r >= 2) & (r <= 36) & (a["k"] > 0), a["n"])), NUM)


#: Roman digits (fixed values).
_ROMAN = [
    ["", "M", "MM", "MMM"],
    ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"],
    ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
    ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"],
]


@row("ROMAN", category=_C, args="number, [form]")
def roman(v, form=None):
    x = _trunc(finite(v)).cast("int")
    ok = F.when((x >= 0) & (x <= 3999), x)
    out = F.concat(*[F.element_at(F.array(*map(F.lit, d)), (F.floor(ok / 10 ** (3 - i)) % 10).cast("int") + 1) for i, d in enumerate(_ROMAN)])
    return result("text", out, (ok.isNull(), VALUE))


@row("ARABIC", category=_C, args="text")
def arabic(v):
    s = F.upper(F.trim(text_of(v)))
    worth = F.create_map(*[F.lit(x) for c, n in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in (c, float(n))])
    each = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: worth[c])

    def total(each):
        after = F.concat(F.slice(each, 2, F.greatest(F.size(each), F.lit(1))), F.array(F.lit(0.0)))
        return F.aggregate(F.zip_with(each, after, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0.0), lambda a, x: a + x)

    # another letter makes the total null, and so does no letter, which is no error
    out = let(each, total)
    return Value("number", out, e=F.when(out.isNull() & (s != ""), VALUE), null=True)


# over rows, or over the arguments of a row


def _each(values) -> list[Column]:
    return [num(v) for v in values]


def _listed(values) -> Column:
    """All numbers among the arguments of a row; arrays are laid out."""
    parts = [F.filter(F.transform(v.c, lambda x: x.cast("double")), lambda x: x.isNotNull()) if v.kind == "array" else F.filter(F.array(num(v)), lambda x: x.isNotNull()) for v in values]
    return reduce(F.concat, parts) if len(parts) > 1 else parts[0]


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _fold(name, in_row, in_table, args="number1, [number2], ...", empty=None):
    """in_row: of an array; in_table: of several columns; empty: the error where there is no number."""

    @row(name, category=_C, args=args)
    def of_row(*values):
        xs = _listed(values)
        return _number(in_row(xs), *([(F.size(xs) == 0, empty)] if empty else []))

    @aggregate(name, category=_C, args=args)
    def of_table(*values):
        cs = _each(values)
        out = in_table(cs)
        return _number(out, *([(out.isNull(), empty)] if empty else []))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def sums(cs):
    return reduce(lambda a, b: a + b, [_zero(F.sum(c)) for c in cs])


def counts(cs):
    return reduce(lambda a, b: a + b, [F.count(c) for c in cs]).cast("double")


_fold("SUM", _total, sums)
_fold("AVERAGE", lambda xs: _total(xs) / F.when(F.size(xs) > 0, F.size(xs)), lambda cs: sums(cs) / F.when(counts(cs) > 0, counts(cs)), empty=DIV0)
_fold("MIN", lambda xs: _zero(F.array_min(xs)), lambda cs: _zero(F.least(*map(F.min, cs)) if len(cs) > 1 else F.min(cs[0])))
_fold("MAX", lambda xs: _zero(F.array_max(xs)), lambda cs: _zero(F.greatest(*map(F.max, cs)) if len(cs) > 1 else F.max(cs[0])))
_fold("COUNT", lambda xs: F.size(xs).cast("double"), counts, args="value1, [value2], ...")
_fold("PRODUCT", lambda xs: F.when(F.size(xs) > 0, product(xs)).otherwise(0.0), lambda cs: F.when(counts(cs) > 0, reduce(lambda a, b: a * b, [F.coalesce(F.product(c), F.lit(1.0)) for c in cs])).otherwise(0.0))
_fold("SUMSQ", lambda xs: _total(F.transform(xs, lambda x: x * x)), lambda cs: sums([c * c for c in cs]))


def _pairs(f):
    """Of two arrays of a row, over the shorter length; pairs that aren't numbers are left out."""

    def of_row(a, b):
        n = F.least(F.size(a.c), F.size(b.c))
        terms = F.zip_with(F.slice(a.c, 1, n), F.slice(b.c, 1, n), lambda x, y: F.coalesce(f(x.cast("double"), y.cast("double")), F.lit(0.0)))
        return Value("number", _total(terms))

    def of_table(a, b):
        return Value("number", _zero(F.sum(f(num(a), num(b)))))

    return of_row, of_table


for _name, _f in {"SUMX2MY2": lambda x, y: x * x - y * y, "SUMX2PY2": lambda x, y: x * x + y * y, "SUMXMY2": lambda x, y: (x - y) * (x - y)}.items():
    _row, _table = _pairs(_f)
    row(_name, category=_C, args="array_x, array_y", mode="K")(_row)
    aggregate(_name, category=_C, args="array_x, array_y", mode="K")(_table)


@row("SUMPRODUCT", category=_C, args="array1, [array2], ...", mode="K")
def sumproduct(*arrays):
    if any(a.kind != "array" for a in arrays):
        return result("number", F.lit(None).cast("double"), (F.lit(True), VALUE))
    first = F.transform(arrays[0].c, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    terms = reduce(lambda done, a: F.zip_with(done, a.c, lambda x, y: x * F.coalesce(y.cast("double"), F.lit(0.0))), arrays[1:], first)
    uneven = reduce(lambda x, y: x | y, [F.size(a.c) != F.size(arrays[0].c) for a in arrays])
    return _number(_total(F.transform(terms, lambda x: F.coalesce(x, F.lit(0.0)))), (uneven, VALUE))


@aggregate("SUMPRODUCT", category=_C, args="array1, [array2], ...", mode="K")
def sumproduct_over(*columns):
    return Value("number", _zero(F.sum(reduce(lambda a, b: a * b, [num0(c) for c in columns]))))


#: Numbers of SUBTOTAL and AGGREGATE (fixed values).
_NUMBERED = {1: "AVERAGE", 2: "COUNT", 3: "COUNTA", 4: "MAX", 5: "MIN", 6: "PRODUCT", 7: "STDEV.S", 8: "STDEV.P", 9: "SUM", 10: "VAR.S", 11: "VAR.P", 12: "MEDIAN"}


def _by_number(form: str, number: int, last: int, values) -> Value:
    name = _NUMBERED.get(number - 100 if 101 <= number <= 111 else number) if number <= last or number > 100 else None
    if name is None:
        return result("number", F.lit(None).cast("double"), (F.lit(True), VALUE))
    return getattr(CATALOG[name], form)(*values)


def subtotal(number: int, *values, form: str = "aggregate") -> Value:
    """SUBTOTAL over the rows of a table (or, with form="row", over arguments)."""
    return _by_number(form, int(number), 11, [wrap(v) for v in values])


def aggregate_number(number: int, options: int, *values, form: str = "aggregate") -> Value:
    """AGGREGATE; the options have no effect."""
    return _by_number(form, int(number), 12, [wrap(v) for v in values])


for _name, _f, _constants in (("SUBTOTAL", subtotal, 1), ("AGGREGATE", aggregate_number, 2)):
    for _form, _put in (("row", row), ("aggregate", aggregate)):
        _put(_name, category=_C, args="function_num, " + "options, " * (_constants - 1) + "ref1, [ref2], ...")(lambda *args, f=_f, form=_form: f(*args, form=form))
    CATALOG[_name].plain = _constants
