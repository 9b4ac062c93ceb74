"""Literal cases through the row builders: (function, arguments, value or error code)."""

import math
import time

import pytest

from pyspark.sql import functions as F

from gridloom.functions import CATALOG, call, over
from gridloom.functions.maths import compare, divide, join_text, multiply, negate, power
from gridloom.functions.registry import _CUSTOM, _CUSTOM_OVER, register_function
from gridloom.values import DIV0, NA, NUM, VALUE, Value, array, num, number

CASES = [
    ("SUM", (1, 2, "x"), 3), ("AVERAGE", (1, 2, 6), 3), ("COUNT", (1, "", "x", True), 3), ("PRODUCT", (2, 3, 4), 24), ("ROUND", (-2.5, 0), -2), ("ROUND", ("x", 0), VALUE),
    ("MOD", (-7, 3), -1), ("MOD", (1, 0), DIV0), ("SQRT", (-1,), NUM), ("LN", (0,), NUM), ("FACT", (5,), 120), ("FACT", (171,), NUM), ("FACTDOUBLE", (7,), 105), ("COMBIN", (5, 2), 10),
    ("COMBIN", (2, 5), NUM), ("PERMUT", (5, 2), 20), ("GCD", (12, 18), 6), ("LCM", (4, 6), 12), ("ROMAN", (1994,), "MCMXCIV"), ("ARABIC", ("MCMXCIV",), 1994), ("BASE", (255, 16, 4), "00FF"), ("DECIMAL", ("FF", 16), 255),
    ("LEFT", ("Hello", 2), "He"), ("LEFT", ("Hello", 0), "H"), ("RIGHT", ("Hello", 3), "llo"), ("MID", ("Hello", 2, 3), "ell"), ("FIND", ("z", "Hello"), VALUE), ("FIND", ("l", "Hello"), 3), ("SEARCH", ("L*o", "Hello"), 3),
    ("SUBSTITUTE", ("a-b-c", "-", "+", 2), "a-b+c"), ("TEXTBEFORE", ("a-b-c", "-", 2), "a-b"), ("TEXTAFTER", ("abc", "-"), NA), ("PROPER", ("hello wORLD",), "Hello World"), ("DOLLAR", (-1234.567,), "($1,234.57)"),
    ("DATE", (2024, 1, 15), 45306), ("DATE", (1900, 2, 29), 60), ("DAY", (60,), 29), ("YEAR", (-1,), VALUE), ("WEEKDAY", (45306,), 2), ("WEEKDAY", (45306, 9), NUM), ("NETWORKDAYS", (45292, 45322), 23), ("WORKDAY", (45306, 5), 45313),
    ("EDATE", (45322, 1), 45351), ("EOMONTH", (45306, 0), 45322), ("DATEDIF", (45306, 45672, "Y"), 1), ("DATEDIF", (45306, 45672, "Q"), NUM), ("PMT", (0.05 / 12, 360, 200000), -1073.643246), ("RATE", (360, -1073.643246, 200000), 0.05 / 12),
    ("IRR", ([-100, 60, 60],), 0.130662386), ("MEDIAN", (1, 2, 3, 4), 2.5), ("STDEV", (1,), DIV0), ("PERCENTILE", ([1, 2, 3, 4], 0.3), 1.9), ("LARGE", ([1, 5, 3], 2), 3), ("LARGE", ([1], 2), NUM), ("RANK", (4, [1, 3, 5]), NA), ("RANK", (3, [1, 3, 5]), 2),
    ("NORM.S.DIST", (1.0, True), 0.8413447), ("NORM.S.INV", (0.975,), 1.959964), ("POISSON.DIST", (2, 3, True), 0.42319), ("BINOM.DIST", (2, 5, 0.5, False), 0.3125), ("MATCH", (25, [10, 20, 30], 1), 2), ("MATCH", (5, [10, 20, 30], 0), NA),
    ("XLOOKUP", (2, [1, 2, 3], [10, 20, 30]), 20), ("IFERROR", ("#N/A", 7), 7), ("IF", (True, 1, 2), 1), ("XOR", (True, True), False), ("ADDRESS", (2, 28, 1), "$AB$2"), ("VALUETOTEXT", (1e21,), "1e+21"), ("VALUETOTEXT", (12345678.5,), "12345678.5"),
    ("VALUE", ("0x10",), 16), ("LEN", ("😀a",), 3), ("UNICHAR", (8364,), "€"), ("TYPE", ("#N/A",), 16), ("ERROR.TYPE", ("#DIV/0!",), 2), ("FREQUENCY", ([1, 2, 3, 4, 5], [2, 4]), [2.0, 2.0, 1.0]), ("MODE", (1, 2, 3), NA), ("NOSUCH", (1,), "#NAME?"),
]


def same(got, want) -> bool:
    if isinstance(want, int | float) and not isinstance(want, bool) and isinstance(got, int | float):
        return abs(got - want) < 1e-5 * max(1, abs(want))
    return got == want


def shown(spark, v):
    r = spark.range(1).select(v.column().alias("v"), v.error().alias("e")).first()
    return r.v if r.e is None else r.e


def test_catalog_size():
    assert len(CATALOG) == 263


@pytest.mark.parametrize(("name", "args", "want"), CASES, ids=lambda x: str(x)[:20])
def test_case(spark, name, args, want):
    assert same(shown(spark, call(name, *args)), want)


def test_operators(spark):
    assert shown(spark, divide(1, 0)) == DIV0
    assert shown(spark, power(negate(2), 2)) == 4
    assert shown(spark, join_text(1, "a")) == "1a"
    assert shown(spark, compare("a", "=", "A")) is False
    assert shown(spark, multiply(divide(1, 0), 2)) == DIV0


def test_own_function(spark):
    register_function("twice", lambda v: multiply(v, 2), over=lambda v: Value("number", F.sum(num(v)) * 2))
    try:
        assert shown(spark, call("TWICE", 21)) == 42
        assert spark.range(4).agg(over("Twice", number("id")).column().alias("v")).first().v == 12
    finally:
        del _CUSTOM["TWICE"], _CUSTOM_OVER["TWICE"]


def test_minus_zero_keeps_its_sign_as_text(spark):
    rows = spark.createDataFrame([(-0.0,), (0.0,), (None,), (-1.5,)], "x double")
    shown = [call("DOLLAR", number("x")).column(), call("VALUETOTEXT", number("x")).column()]
    assert [tuple(r) for r in rows.select(*shown).collect()] == [("$-0.00", "-0"), ("$0.00", "0"), ("$0.00", ""), ("($1.50)", "-1.5")]


def test_roots_of_all_rows_at_once(spark):
    """Rows that end after different numbers of steps, or never, and flows of unequal length; rows far
    above a batch that a step for each row and iteration takes minutes for."""
    rows = spark.createDataFrame([(1, 10.0, -15.0, 100.0, [-100.0, 60.0, 60.0]), (2, 0.0, 5.0, 5.0, [1.0, 2.0]), (3, None, None, 7.0, [-5.0, None, 9.0]), (4, 20.0, -9.0, 100.0, [-10.0, 4.0, 4.0, 4.0, 4.0]), (5, 2.0, -1.0, 9.0, [3.0])], "k int, n double, m double, p double, f array<double>")
    some = rows.select("k", call("RATE", number("n"), number("m"), number("p")).column().alias("rate"), call("IRR", array("f")).column().alias("irr"), call("IRR", array("f")).error().alias("e"))
    got = {r.k: r for r in some.collect()}
    for k, n, m in ((1, 10, 15), (4, 20, 9)):
        assert abs(m * (1 - (1 + got[k].rate) ** -n) / got[k].rate - 100) < 1e-6
    assert abs(got[1].irr - 0.130662386) < 1e-8 and abs(sum(4 / (1 + got[4].irr) ** i for i in range(1, 5)) - 10) < 1e-6
    assert [got[k].e for k in (1, 3, 4, 5)] == [None, VALUE, None, NUM]
    many = spark.range(0, 40_000, 1, 1).select(call("IRR", array(F.array(-F.col("id") - 1.0, *[(F.col("id") + 1) * 0.3] * 5))).column().alias("x"))
    began = time.time()
    assert many.agg(F.max("x") - F.min("x")).first()[0] < 1e-9 and time.time() - began < 8


def test_whole_numbers_of_any_size(spark):
    pairs = [(a, b) for a in (0, 1, 2, 12, 36, 2**31, 2**52 + 2, 2**53 - 1) for b in (0, 1, 7, 36, 3**33, 2**53 - 2)]
    fibonacci = [1, 1]
    while fibonacci[-1] < 2**52:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    pairs += list(zip(fibonacci, fibonacci[1:], strict=False)) + list(zip(fibonacci[1:], fibonacci, strict=False))
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double")
    got = rows.select("a", "b", call("GCD", number("a"), number("b")).column().alias("g")).collect()
    assert all(r.g == math.gcd(int(r.a), int(r.b)) for r in got)
    assert shown(spark, call("BASE", 2.0**60, 2)) == "1" + "0" * 60  # all digits, not the last 53
    assert [shown(spark, call("BASE", n, r)) for n, r in ((0, 2), (35, 36), (255, 16), (-1, 2), (5, 40))] == ["0", "Z", "FF", NUM, NUM]
    assert [shown(spark, call("DECIMAL", *x)) for x in (("12", 2), ("z", 36), ("2", 2), ("", 2), ("1", 1))] == [1, 35, NUM, NUM, NUM]
    assert [shown(spark, call("ARABIC", x)) for x in ("mcmxciv", "AB", "")] == [1994, VALUE, None]


def test_long_parts_are_computed_once(spark):
    n = number(F.col("id") % 50 + 1)
    built = [call("GCD", n, 36), call("LCM", n, 12), call("DECIMAL", call("BASE", n, 2), 2)]
    few, many = (spark.range(0, k, 1, 4).select(*[v.column().alias(f"x{i}") for i, v in enumerate(built)]) for k in (10, 100_000))
    few.write.format("noop").mode("overwrite").save()
    began = time.time()
    many.write.format("noop").mode("overwrite").save()
    assert time.time() - began < 6


def test_long_parts_are_written_once(spark):
    """What a query shows of a function holds its long part once, not for the error too."""
    rows = spark.range(3)
    for v, part, most in ((call("FORECAST.LINEAR", 5, array(F.array("id", "id", F.col("id") + 3)), [1, 2, 3]), "arrays_zip(", 1), (call("NORM.INV", 0.5, number("id"), 2), "transform(array(", 2), (call("TANH", number("id")), "TANH(", 1)):
        plan = rows.select(v.column().alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count(part) <= most, part
