"""Values that are a * x + b of one other cell, x, kept as a and b.

A formula built with ``Affine`` for x, by the operators + - * / and the minus sign, is again one
(``gridloom.functions.maths`` calls ``combined``); any other use of it raises ``NotAffine``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import DIV0, Value, first_error, num, wrap


class NotAffine(TypeError):
    """A formula is no affine function of the cell."""


@dataclass(frozen=True)
class Affine:
    """``before`` is an error that counts before one of x, ``after`` one that counts after it. A null
    ``b`` stands for a result that is no number: a blank."""

    a: Column
    b: Column
    before: Column | None = None
    after: Column | None = None

    def __getattr__(self, name: str):
        raise NotAffine(name)


def _first(*codes: Column | None) -> Column | None:
    there = [c for c in codes if c is not None]
    return F.coalesce(*there) if len(there) > 1 else there[0] if there else None


def _error(v: Value) -> Column | None:
    return _first(*[F.when(condition, code) for condition, code in first_error(v)])


def combined(sign: str, x: Affine | Value, y: Affine | Value) -> Affine:
    """``x sign y`` where one of them, or for sums both, are affine."""
    if isinstance(x, Affine) and isinstance(y, Affine):
        if sign not in "+-":
            raise NotAffine(sign)
        join = (lambda p, q: p + q) if sign == "+" else (lambda p, q: p - q)
        return Affine(join(x.a, y.a), join(x.b, y.b), x.before, _first(x.after, y.before, y.after))
    if isinstance(x, Affine):
        v = wrap(y)
        n = num(v)
        slope = lambda c: F.when(n.isNotNull(), c).otherwise(F.lit(0.0))
        after = _first(x.after, _error(v))
        if sign == "/":
            by = F.when(n != 0, n)
            return Affine(slope(x.a / by), x.b / by, x.before, _first(after, F.when(n == 0, F.lit(DIV0))))
        made = {"+": (x.a, x.b + n), "-": (x.a, x.b - n), "*": (x.a * n, x.b * n)}.get(sign)
        if made is None:
            raise NotAffine(sign)
        return Affine(slope(made[0]), made[1], x.before, after)
    v = wrap(x)
    n = num(v)
    made = {"+": (y.a, n + y.b), "-": (-y.a, n - y.b), "*": (n * y.a, n * y.b)}.get(sign)
    if made is None:
        raise NotAffine(sign)
    return Affine(F.when(n.isNotNull(), made[0]).otherwise(F.lit(0.0)), made[1], _first(_error(v), y.before), y.after)
