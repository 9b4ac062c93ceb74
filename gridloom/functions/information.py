"""What a value is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..values import DIV0, NA, NAME, NULL, NUM, REF, VALUE, Value, error, error_of, finite, is_error, result, string, text_of, wrap
from .registry import row

_C = "information"


def _is(*kinds):
    tags = {"number": "n", "text": "s", "logical": "b"}

    def test(v):
        if v.kind == "cell":
            return v.c["t"].isin([tags[k] for k in kinds])
        return F.lit(v.kind in kinds) & ~is_error(v) & (v.c.isNotNull() if v.blank else F.lit(True))

    return test


def _test(name, f, args="value"):
    row(name, category=_C, args=args)(lambda v: Value("logical", f(v)))


def _blank(v):
    if v.kind == "cell":
        return (v.c["t"] == "empty") | F.coalesce(v.c["s"] == "", F.lit(False))
    empty = (v.c.isNull() if v.blank else F.lit(False)) | (F.coalesce(v.c == "", F.lit(False)) if v.kind == "text" else F.lit(False))
    return empty & ~is_error(v)


def _texty(v):
    return _is("text")(v) | _blank(v) | is_error(v)


def _said(v, *words):
    return text_of(v).isin(*words) if v.kind in ("text", "cell") else F.lit(False)


def _code(v, *codes):
    e = error_of(v)
    return F.lit(False) if e is None else F.coalesce(e.isin(*codes), F.lit(False))


_test("ISERROR", is_error)
_test("ISBLANK", _blank)
_test("ISNUMBER", _is("number"))
_test("ISTEXT", _texty)
_test("ISNONTEXT", lambda v: ~_texty(v))
_test("ISLOGICAL", lambda v: _is("logical")(v) | _said(v, "TRUE", "FALSE"))
_test("ISNA", lambda v: _code(v, NA))
_test("ISERR", lambda v: is_error(v) & ~_code(v, NA))
_test("ISREF", lambda v: F.lit(False))
_test("ISFORMULA", lambda v: F.lit(False), "reference")


def _parity(rest):
    def f(v):
        n = finite(v)
        whole = F.sign(n) * F.floor(F.abs(n))
        return result("logical", (F.abs(whole) % 2 == 0) == F.lit(rest == 0), (n.isNull(), VALUE))

    return f


row("ISEVEN", category=_C, args="number")(_parity(0))
row("ISODD", category=_C, args="number")(_parity(1))


@row("TYPE", category=_C, args="value")
def type_(v):
    return Value("number", F.when(is_error(v), 16).when(_is("logical")(v), 4).when(_is("number")(v), 1).otherwise(2).cast("double"))


@row("N", category=_C, args="value")
def n(v):
    if v.kind == "cell":
        out = F.when(v.c["t"] == "n", v.c["n"]).when(v.c["t"] == "b", v.c["b"].cast("double")).when(v.c["s"] == "TRUE", 1.0)
    elif v.kind == "text":
        out = F.when(v.c == "TRUE", 1.0)
    else:
        out = v.c.cast("double")
    return Value("number", F.coalesce(out, F.lit(0.0)), e=error_of(v))


@row("NA", category=_C, args="")
def na():
    return error(NA)


#: Numbers of the error codes (fixed values).
_NUMBERS = {NULL: 1, DIV0: 2, VALUE: 3, REF: 4, NAME: 5, NUM: 6, NA: 7}


@row("ERROR.TYPE", category=_C, args="error_val")
def error_type(v):
    e = error_of(v)
    if e is None:
        return error(NA)
    out = F.create_map(*[F.lit(x) for k, i in _NUMBERS.items() for x in (k, float(i))])[F.coalesce(e, F.lit(""))]
    return result("number", out, (out.isNull(), NA))


row("SHEET", category=_C, args="[value]")(lambda *_: wrap(1))
row("SHEETS", category=_C, args="[reference]")(lambda *_: wrap(1))
row("CELL", category=_C, args="info_type, [reference]")(lambda *_: string(""))


@row("INFO", category=_C, args="type_text")
def info(kind):
    s = F.lower(text_of(kind))
    return Value("text", F.when(s == "osversion", "Windows").when(s == "release", "16.0").when(s == "system", "pcdos").otherwise(""))
