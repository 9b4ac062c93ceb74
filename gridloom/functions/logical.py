"""Conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..values import NA, Value, error, error_of, is_error, merged, text_of, truthy, wrap
from .registry import aggregate, row

_C = "logical"


@row("IF", category=_C, args="condition, value_if_true, [value_if_false]")
def if_(condition, yes=None, no=None):
    return merged(truthy(condition), wrap(True) if yes is None else yes, wrap(False) if no is None else no)


@row("AND", category=_C, args="logical1, [logical2], ...")
def and_(*tests):
    return Value("logical", reduce(lambda a, b: a & b, map(truthy, tests)))


@aggregate("AND", category=_C, args="logical1, [logical2], ...")
def and_over(*tests):
    return Value("logical", F.coalesce(F.bool_and(reduce(lambda a, b: a & b, map(truthy, tests))), F.lit(True)))


@row("OR", category=_C, args="logical1, [logical2], ...")
def or_(*tests):
    return Value("logical", reduce(lambda a, b: a | b, map(truthy, tests)))


@aggregate("OR", category=_C, args="logical1, [logical2], ...")
def or_over(*tests):
    return Value("logical", F.coalesce(F.bool_or(reduce(lambda a, b: a | b, map(truthy, tests))), F.lit(False)))


@row("NOT", category=_C, args="logical")
def not_(test):
    return Value("logical", ~truthy(test))


@row("TRUE", category=_C, args="")
def true():
    return wrap(True)


@row("FALSE", category=_C, args="")
def false():
    return wrap(False)


@row("IFERROR", category=_C, args="value, value_if_error")
def iferror(value, other):
    return merged(is_error(value), other, value) if error_of(value) is not None else value


@row("IFNA", category=_C, args="value, value_if_na")
def ifna(value, other):
    e = error_of(value)
    return value if e is None else merged(F.coalesce(e == NA, F.lit(False)), other, value)


@row("IFS", category=_C, args="logical_test1, value_if_true1, ...")
def ifs(*args):
    return reduce(lambda later, pair: merged(truthy(pair[0]), pair[1], later), reversed(list(zip(args[::2], args[1::2], strict=True))), error(NA))


@row("SWITCH", category=_C, args="expression, value1, result1, ..., [default]")
def switch(expression, *args):
    default = args[-1] if len(args) % 2 else error(NA)

    def same(a, b):
        if a.kind == b.kind == "text":
            return F.lower(text_of(a)) == F.lower(text_of(b))
        return F.coalesce(a.column() == b.column(), F.lit(False)) if a.kind == b.kind else F.lit(False)

    pairs = list(zip(args[: len(args) // 2 * 2 : 2], args[1::2], strict=True))
    return reduce(lambda later, pair: merged(same(expression, pair[0]), pair[1], later), reversed(pairs), default)


def _odd(tests):
    return reduce(lambda a, b: a + b, [truthy(t).cast("long") for t in tests])


@row("XOR", category=_C, args="logical1, [logical2], ...")
def xor(*tests):
    return Value("logical", _odd(tests) % 2 == 1)


@aggregate("XOR", category=_C, args="logical1, [logical2], ...")
def xor_over(*tests):
    return Value("logical", F.coalesce(F.sum(_odd(tests)), F.lit(0)) % 2 == 1)
