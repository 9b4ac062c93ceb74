"""The function catalog: names, argument modes and builders.

A row builder takes values and returns a value for each row. An aggregate builder takes values
over a table and returns a value made of aggregate expressions, for ``groupBy().agg()``. Mode F
functions see ranges as separate arguments; mode K ones see whole arrays; mode L ones are
lookups, which are joins (``gridloom.operators.lookup``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..values import NAME, Value, error, wrap


@dataclass
class Function:
    name: str
    category: str
    syntax: str
    mode: str = "F"
    row: Callable[..., Value] | None = None
    aggregate: Callable[..., Value] | None = None
    plain: int = 0  # leading arguments that stay as they are: constants that choose what is built


CATALOG: dict[str, Function] = {}
_CUSTOM: dict[str, Callable[..., Value]] = {}
_CUSTOM_OVER: dict[str, Callable[..., Value]] = {}
_NAMES: dict[str, str] = {}


def _entry(name: str, category: str, syntax: str, mode: str) -> Function:
    return CATALOG.setdefault(name, Function(name, category, syntax, mode))


def row(*names: str, category: str, args: str, mode: str = "F"):
    """Register a row builder under one or more names."""

    def put(f):
        for name in names:
            _entry(name, category, f"{name}({args})", mode).row = f
        return f

    return put


def aggregate(*names: str, category: str, args: str, mode: str = "F"):
    def put(f):
        for name in names:
            _entry(name, category, f"{name}({args})", mode).aggregate = f
        return f

    return put


def register_function(name: str, builder: Callable[..., Value] | None = None, over: Callable[..., Value] | None = None) -> None:
    """A function of one's own, over the arguments of a row and, as ``over``, over the rows of a table;
    it shadows a built-in one of the same name."""
    for known, f in ((_CUSTOM, builder), (_CUSTOM_OVER, over)):
        if f is not None:
            known[name.upper()] = f


def register_names(names: dict[str, str]) -> None:
    """Names of functions in another language, each for the name here, as {"SUMME": "SUM"}. They are the
    user's, so that any language will do, and may hold any letters."""
    _NAMES.update({own.upper(): name.upper() for own, name in names.items()})


def _known(name: str) -> str:
    return _NAMES.get(name.upper(), name.upper())


def call(name: str, *args, **shape) -> Value:
    """The row value of a function. Unknown names give ``#NAME?``. ``columns=`` says how wide the
    row-major array of VLOOKUP, HLOOKUP or INDEX is."""
    name = _known(name)
    if name in _CUSTOM:
        return _CUSTOM[name](*map(wrap, args), **shape)
    if name not in CATALOG or CATALOG[name].row is None:
        return error(NAME)
    return CATALOG[name].row(*_values(name, args), **shape)


def over(name: str, *args) -> Value:
    """The value of an aggregate function over the rows of a table or group."""
    name = _known(name)
    if name in _CUSTOM_OVER:
        return _CUSTOM_OVER[name](*map(wrap, args))
    if name not in CATALOG or CATALOG[name].aggregate is None:
        return error(NAME)
    built = CATALOG[name].aggregate
    # criteria are constants that shape the predicate, so they stay as they are
    return built(*args) if name.endswith(("IF", "IFS")) else built(*_values(name, args))


def _values(name: str, args: tuple) -> list:
    n = CATALOG[name].plain
    return [*args[:n], *map(wrap, args[n:])]


def functions(spark: SparkSession) -> DataFrame:
    """The catalog as a table: name, category, syntax, mode, row_form, aggregate_form."""
    rows = [(f.name, f.category, f.syntax, f.mode, f.row is not None, f.aggregate is not None) for f in sorted(CATALOG.values(), key=lambda f: f.name)]
    return spark.createDataFrame(rows, "name string, category string, syntax string, mode string, row_form boolean, aggregate_form boolean")
