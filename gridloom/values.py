"""Spreadsheet values as Spark columns.

A ``Value`` knows at build time what it holds, so that plain table columns stay plain
expressions. ``number``, ``text`` and ``logical`` wrap columns of those types (null is a blank
cell), ``cell`` wraps a tagged struct, and results carry an error code in ``e`` where they can
fail. Errors are values: nothing here raises at run time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error codes (fixed values).
VALUE, REF, NAME, DIV0, NULL, NUM, NA, CYCLE = "#VALUE!", "#REF!", "#NAME?", "#DIV/0!", "#NULL!", "#NUM!", "#N/A", "#CYCLE!"

#: A cell of a sheet: its tag (n, s, b, e or empty) and one filled field.
CELL_TYPE = "struct<t:string,n:double,s:string,b:boolean,e:string>"

_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


@dataclass(frozen=True)
class Value:
    kind: str  # number, text, logical, cell, array
    c: Column
    e: Column | None = None
    blank: bool = False  # null stands for an empty cell
    pure: bool = False  # nothing but an error
    null: bool = False  # ``c`` is null already where there is an error

    def column(self) -> Column:
        """The plain column; null where the value is an error."""
        return self.c if self.e is None or self.null else F.when(self.e.isNull(), self.c)

    def error(self) -> Column:
        if self.kind == "cell":
            return self.c["e"]
        return F.lit(None).cast("string") if self.e is None else self.e

    def shown(self) -> Column:
        """What a sheet shows: text of the value, or the error code."""
        return F.coalesce(self.error(), text_of(self))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, where it is long and used often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def number(x) -> Value:
    """A numeric column (by name or expression) or a Python number."""
    if isinstance(x, bool):
        return logical(x)
    if isinstance(x, int | float):
        return Value("number", F.lit(float(x)))
    return Value("number", _column(x).cast("double"), blank=True)


def text(x) -> Value:
    """A string column. Text that starts with ``#`` is an error, as it is in a sheet."""
    return Value("text", _column(x), blank=True)


def string(x: str) -> Value:
    return error(x) if x.startswith("#") else Value("text", F.lit(x))


def logical(x) -> Value:
    return Value("logical", F.lit(x)) if isinstance(x, bool) else Value("logical", _column(x), blank=True)


def array(x) -> Value:
    """A column that holds an array of numbers or strings."""
    return Value("array", _column(x))


def cell(x) -> Value:
    return Value("cell", _column(x))


def error(code: str) -> Value:
    return Value("text", F.lit(None).cast("string"), e=F.lit(code), pure=True)


def wrap(x) -> Value:
    """Python constants become values; values stay."""
    if isinstance(x, Value):
        return x
    if isinstance(x, bool):
        return logical(x)
    if isinstance(x, int | float):
        return number(x)
    if isinstance(x, str):
        return string(x)
    if isinstance(x, list | tuple):
        return Value("array", F.array(*[F.lit(float(v)) if isinstance(v, int | float) else F.lit(v) for v in x]))
    raise TypeError(f"not a value: {x!r}; wrap columns with number(), text(), logical(), array() or cell()")


def parsed(s: Column) -> Column:
    """Number that a text spells, 0 for an empty one, null for any other."""
    t = F.regexp_replace(s, r"^\s+|\s+$", "")
    radix = lambda p, r: F.conv(F.substring(t, 3, 64), r, 10).cast("double")
    return (
        F.when(t == "", F.lit(0.0))
        .when(t.rlike(_DECIMAL), t.try_cast("double"))
        .when(t.rlike(r"^0[xX][0-9a-fA-F]+$"), radix("x", 16))
        .when(t.rlike(r"^0[oO][0-7]+$"), radix("o", 8))
        .when(t.rlike(r"^0[bB][01]+$"), radix("b", 2))
        .when(t.isin("Infinity", "+Infinity"), F.lit(float("inf")))
        .when(t == "-Infinity", F.lit(float("-inf")))
    )


def _no_nan(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def num(v: Value) -> Column:
    """The number that a value coerces to; null if there is none (not a number, or an error)."""
    if v.kind == "number":
        out = F.coalesce(_no_nan(v.c), F.when(v.c.isNull(), F.lit(0.0))) if v.blank else _no_nan(v.c)
    elif v.kind == "logical":
        out = F.coalesce(v.c, F.lit(False)).cast("double") if v.blank else v.c.cast("double")
    elif v.kind == "text":
        out = parsed(F.coalesce(v.c, F.lit("")) if v.blank else v.c)
    elif v.kind == "cell":
        t = v.c["t"]
        out = F.when(t == "n", _no_nan(v.c["n"])).when(t == "b", v.c["b"].cast("double")).when(t == "s", parsed(v.c["s"])).when(t == "e", F.lit(None)).otherwise(F.lit(0.0))
    else:
        out = F.when(F.size(v.c) == 1, F.element_at(v.c, 1).cast("double"))
    return out if v.e is None or v.null and v.kind == "number" else F.when(v.e.isNull(), out)


def num0(v: Value) -> Column:
    return F.coalesce(num(v), F.lit(0.0))


def finite(v: Value) -> Column:
    """The number, null if it isn't finite."""
    n = num(v)
    return F.when(F.abs(n) < float("inf"), n)


def number_text(n: Column) -> Column:
    """Shortest decimal text of a double: no trailing zeros, exponents below 1e-6 and from 1e21."""
    plain = F.regexp_replace(F.regexp_replace(n.cast("string").cast("decimal(38,22)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    whole = n.cast("decimal(38,0)").cast("string")
    powers = F.regexp_replace(F.regexp_replace(n.cast("string"), r"(\.0)?E(\d)", "e+$2"), r"(\.0)?E-", "e-")
    size = F.abs(n)
    return (
        F.when(F.isnan(n), "NaN")
        .when(n == float("inf"), "Infinity")
        .when(n == float("-inf"), "-Infinity")
        .when(n == 0, "0")
        .when((size >= 1e21) | (size < 1e-6), powers)
        .when(F.floor(n).cast("double") == n, whole)
        .otherwise(plain)
    )


def text_of(v: Value) -> Column:
    """The text that a value coerces to; a blank is empty, an error its code."""
    if v.kind == "number":
        out = number_text(v.c)
    elif v.kind == "logical":
        out = F.when(v.c, "true").when(~v.c, "false")
    elif v.kind == "text":
        out = v.c
    elif v.kind == "cell":
        t = v.c["t"]
        out = F.when(t == "n", number_text(v.c["n"])).when(t == "b", F.when(v.c["b"], "true").otherwise("false")).when(t == "s", v.c["s"]).when(t == "e", v.c["e"])
    else:
        out = F.array_join(v.c, ",")
    if v.e is not None:
        out = F.coalesce(v.e, out)
    return F.coalesce(out, F.lit(""))


def error_of(v: Value) -> Column | None:
    """Error code column, or None where the value can't be one."""
    if v.kind == "cell":
        return v.c["e"]
    if v.kind == "text" and v.blank:
        return F.when(v.c.startswith("#"), v.c)
    return v.e


def is_error(v: Value) -> Column:
    e = error_of(v)
    return F.lit(False) if e is None else e.isNotNull()


def truthy(v: Value) -> Column:
    """Anything but false, 0, blank, not-a-number and the text FALSE; errors are true."""
    if v.kind == "logical":
        out = F.coalesce(v.c, F.lit(False))
    elif v.kind == "number":
        out = F.coalesce((v.c != 0) & ~F.isnan(v.c), F.lit(False))
    elif v.kind == "text":
        out = F.coalesce(~v.c.isin("", "FALSE"), F.lit(False))
    elif v.kind == "cell":
        t = v.c["t"]
        out = F.when(t == "n", (v.c["n"] != 0) & ~F.isnan(v.c["n"])).when(t == "b", v.c["b"]).when(t == "s", ~v.c["s"].isin("", "FALSE")).when(t == "e", F.lit(True)).otherwise(F.lit(False))
    else:
        out = F.lit(True)
    return out if v.e is None else F.when(v.e.isNull(), out).otherwise(F.lit(True))


def result(kind: str, c: Column, *cases: tuple[Column, str]) -> Value:
    """A value that is an error where a case holds (the first one counts), else ``c``."""
    if not cases:
        return Value(kind, c)
    e = reduce(lambda done, case: done.when(F.coalesce(case[0], F.lit(False)), case[1]), cases[1:], F.when(F.coalesce(cases[0][0], F.lit(False)), cases[0][1]))
    return Value(kind, F.when(e.isNull(), c), e=e, null=True)


def or_error(kind: str, c: Column, code: str) -> Value:
    """``c``, or the error where it is null; ``c`` is not written out twice for that."""
    return Value(kind, c, e=F.when(c.isNull(), code), null=True)


def first_error(*values: Value) -> list[tuple[Column, Column]]:
    return [(e.isNotNull(), e) for v in values if (e := error_of(v)) is not None]


def merged(condition: Column, yes: Value, no: Value) -> Value:
    """One of two values; a cell if they differ in kind."""
    if yes.pure and not no.pure:
        return Value(no.kind, F.when(~condition, no.c), e=F.when(condition, yes.e).otherwise(no.error()))
    if no.pure and not yes.pure:
        return Value(yes.kind, F.when(condition, yes.c), e=F.when(condition, yes.error()).otherwise(no.e))
    if yes.kind == no.kind and yes.kind != "cell":
        errors = None if yes.e is None and no.e is None else F.when(condition, yes.error()).otherwise(no.error())
        return Value(yes.kind, F.when(condition, yes.c).otherwise(no.c), e=errors, blank=yes.blank or no.blank)
    return Value("cell", F.when(condition, as_cell(yes)).otherwise(as_cell(no)))


def as_cell(v: Value) -> Column:
    """The tagged struct of a value."""
    if v.kind == "cell":
        return v.c
    n, s, b = (v.column() if v.kind == k else F.lit(None) for k in ("number", "text", "logical"))
    e = error_of(v)
    e = F.lit(None).cast("string") if e is None else e
    tag = F.when(e.isNotNull(), "e").when(v.column().isNull() if v.kind != "array" else F.lit(False), "empty").otherwise({"number": "n", "text": "s", "logical": "b"}.get(v.kind, "s"))
    if v.kind == "array":
        s = F.array_join(v.c, ",")
    if v.kind == "text":
        s = F.when(e.isNull(), s)
    return F.struct(tag.alias("t"), n.cast("double").alias("n"), s.cast("string").alias("s"), b.cast("boolean").alias("b"), e.alias("e"))
