"""Dynamic arrays of a row, references and positions. Their forms over tables are joins and
windows in ``gridloom.operators``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import NA, REF, VALUE, Value, as_cell, error, finite, num, num0, result, text_of, truthy, wrap
from .registry import row
from .texts import wildcard

_C = "lookup"


def column_letters(n: Column) -> Column:
    """Letters of a column number from 1 to 18278."""
    digit = lambda k: F.char(F.lit(65) + k % 26)
    i = n.cast("long") - 1
    two, three = F.floor(i / 26) - 1, F.floor((F.floor(i / 26) - 1) / 26) - 1
    return F.concat(F.when(three >= 0, digit(three)).otherwise(""), F.when(two >= 0, digit(two)).otherwise(""), digit(i))


def column_number(letters: Column) -> Column:
    """Number of column letters."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)


def _same(items: Value, wanted: Value):
    """Whether an element equals the wanted value: by number, or by text without regard to case."""
    x, s = num(wanted), F.lower(text_of(wanted))

    def test(item: Column) -> Column:
        n = item.try_cast("double")
        return F.coalesce(F.when(n.isNotNull() & x.isNotNull(), n == x).otherwise(F.lower(item.cast("string")) == s), F.lit(False))

    return test


def _first_at(items: Column, test, last=False) -> Column:
    hits = F.filter(F.transform(items, lambda v, i: F.when(test(v), i + 1)), lambda i: i.isNotNull())
    return F.array_max(hits) if last else F.array_min(hits)


def _nearest(items: Column, x: Column, below: bool) -> Column:
    """Place of the largest element up to x, or of the least from x on; the first of equal ones."""
    numbers = F.transform(items, lambda v: v.try_cast("double"))
    fit = F.filter(numbers, lambda v: (v <= x) if below else (v >= x))
    best = F.array_max(fit) if below else F.array_min(fit)
    return F.array_position(numbers, best)


def place(wanted: Value, items: Value, mode: Column, last: Column | None = None, wild: bool = False) -> Column:
    """1-based place; mode 0 exact, 1 largest up to, -1 least from, 2 wildcards; 0 or null if none."""
    x = num(wanted)
    exact = _first_at(items.c, _same(items, wanted))
    final = exact if last is None else F.when(last, _first_at(items.c, _same(items, wanted), True)).otherwise(exact)
    out = F.when(mode == 0, final).when(mode == 1, _nearest(items.c, x, True)).when(mode == -1, _nearest(items.c, x, False))
    if wild:
        pattern = F.concat(F.lit("(?i)^"), wildcard(text_of(wanted)), F.lit("$"))
        out = F.when(mode == 2, _first_at(items.c, lambda v: F.regexp_like(v.cast("string"), pattern))).otherwise(out)
    return out.cast("double")


@row("MATCH", category=_C, args="lookup_value, lookup_array, [match_type]", mode="L")
def match(wanted, items, kind=None):
    at = place(wanted, items, F.lit(1.0) if kind is None else F.signum(num0(kind)))
    return result("number", at, (F.coalesce(at, F.lit(0.0)) == 0, NA))


@row("XMATCH", category=_C, args="lookup_value, lookup_array, [match_mode], [search_mode]", mode="L")
def xmatch(wanted, items, mode=None, order=None):
    m = F.lit(0.0) if mode is None else num0(mode)
    # here -1 asks for the next smaller and 1 for the next larger
    at = place(wanted, items, F.when(m.isin(-1, 1), -m).otherwise(m), None if order is None else num0(order) < 0)
    return result("number", at, (F.coalesce(at, F.lit(0.0)) == 0, NA))


def _picked(items: Value, at: Column, *cases) -> Value:
    """An element as a number; texts come back from ``array_text``."""
    found = F.try_element_at(items.c, F.when(at >= 1, at).cast("int"))
    return result("number", found.try_cast("double"), *cases)


@row("XLOOKUP", category=_C, args="lookup_value, lookup_array, return_array, [if_not_found], [match_mode], [search_mode]", mode="L")
def xlookup(wanted, items, returned, missing=None, mode=None, order=None):
    m = F.lit(0.0) if mode is None else num0(mode)
    at = place(wanted, items, F.when(m.isin(-1, 1), -m).otherwise(m), None if order is None else num0(order) < 0, wild=True)
    none = F.coalesce(at, F.lit(0.0)) == 0
    if missing is None:
        return _picked(returned, at, (none, NA))
    return Value("number", F.when(none, num(missing)).otherwise(_picked(returned, at).c))


@row("LOOKUP", category=_C, args="lookup_value, lookup_vector, [result_vector]", mode="L")
def lookup(wanted, items, returned=None):
    at = place(wanted, items, F.lit(1.0))
    return _picked(returned or items, at, (F.coalesce(at, F.lit(0.0)) == 0, NA))


def table_lookup(by_row: bool):
    def build(wanted, table, index, approximate=None, columns: int = 1):
        """``table`` is a row-major array of ``columns`` columns."""
        near = F.lit(True) if approximate is None else truthy(approximate)
        k = F.floor(num0(index)).cast("int")
        width = F.lit(columns)
        height = F.floor(F.size(table.c) / width).cast("int")
        if by_row:
            keys = F.transform(F.sequence(F.lit(0), F.greatest(height - 1, F.lit(0))), lambda i: F.try_element_at(table.c, (i * width + 1).cast("int")))
        else:
            keys = F.slice(table.c, 1, width)
        at = place(wanted, Value("array", keys), F.when(near, 1).otherwise(0)).cast("int")
        spot = (at - 1) * width + k if by_row else (k - 1) * width + at
        return _picked(table, spot, (k < 1, VALUE), (k > (width if by_row else height), REF), (F.coalesce(at, F.lit(0)) == 0, NA))

    return build


row("VLOOKUP", category=_C, args="lookup_value, table_array, col_index, [range_lookup]", mode="L")(table_lookup(True))
row("HLOOKUP", category=_C, args="lookup_value, table_array, row_index, [range_lookup]", mode="L")(table_lookup(False))


@row("INDEX", category=_C, args="array, row_num, [col_num]", mode="L")
def index(items, r, c=None, columns: int = 1):
    """Of a row-major array; 0 counts as 1."""
    a, b = F.floor(num0(r)), F.lit(1.0) if c is None else F.floor(num0(c))
    one = lambda x: F.when(x == 0, 1).otherwise(x)
    at = (one(a) - 1) * columns + one(b)
    return _picked(items, at, ((a < 0) | (b < 0), VALUE), (((a == 0) & (b == 0)) | (at > F.size(items.c)) | (one(b) > columns), REF))


row("ROW", category=_C, args="[reference]")(lambda *reference: error(VALUE) if reference else wrap(1))
row("COLUMN", category=_C, args="[reference]")(lambda *reference: error(VALUE) if reference else wrap(1))
row("ROWS", category=_C, args="array")(lambda *_: wrap(1))
row("COLUMNS", category=_C, args="array")(lambda *_: wrap(1))
row("FORMULATEXT", category=_C, args="reference", mode="L")(lambda *_: error(NA))
row("TRANSPOSE", category=_C, args="array", mode="K")(lambda items: items)


@row("AREAS", category=_C, args="reference")
def areas(*references):
    return wrap(max(1, len(references)))


@row("CHOOSE", category=_C, args="index_num, value1, [value2], ...")
def choose(i, *values):
    """A pick among values; they come back as a cell if they differ in kind."""
    n = F.floor(num0(i)).cast("int")
    bad = (n < 1) | (n > len(values))
    kinds = {v.kind for v in values}
    if len(kinds) == 1 and kinds <= {"number", "text", "logical"}:
        return result(kinds.pop(), F.try_element_at(F.array(*[v.column() for v in values]), F.when(~bad, n)), (bad, VALUE))
    return Value("cell", F.coalesce(F.try_element_at(F.array(*map(as_cell, values)), F.when(~bad, n)), as_cell(error(VALUE))))


@row("ADDRESS", category=_C, args="row_num, column_num, [abs_num], [a1], [sheet_text]")
def address(r, c, kind=None, a1=None, sheet=None):
    """Kind 2 fixes the column and 3 the row."""
    a, b = F.floor(finite(r)), F.floor(finite(c))
    k = F.lit(1) if kind is None else num0(kind).cast("int")
    dollar = lambda *kinds: F.when(k.isin(*kinds), "$").otherwise("")
    row_text, column_text = a.cast("long").cast("string"), b.cast("long").cast("string")
    shown = F.concat(dollar(1, 2), column_letters(F.when(b >= 1, b)), dollar(1, 3), row_text)
    if a1 is not None:
        around = lambda s, *kinds: F.when(k.isin(*kinds), s).otherwise(F.concat(F.lit("["), s, F.lit("]")))
        shown = F.when(truthy(a1), shown).otherwise(F.concat(F.lit("R"), around(row_text, 1, 2), F.lit("C"), around(column_text, 1, 3)))
    if sheet is not None:
        shown = F.concat(text_of(sheet), F.lit("!"), shown)
    return result("text", shown, (F.coalesce((a < 1) | (b < 1), F.lit(True)), VALUE))


@row("SORT", category=_C, args="array, [sort_index], [sort_order]", mode="K")
def sort(items, _index=None, order=None):
    up = F.lit(True) if order is None else num0(order) == 1
    return Value("array", F.when(up, F.sort_array(items.c)).otherwise(F.sort_array(items.c, asc=False)))


@row("UNIQUE", category=_C, args="array, [by_col], [exactly_once]", mode="K")
def unique(items, _by=None, once=None):
    kinds = F.array_distinct(items.c)
    if once is None:
        return Value("array", kinds)
    return Value("array", F.when(truthy(once), F.filter(kinds, lambda v: F.size(F.filter(items.c, lambda x: x.eqNullSafe(v))) == 1)).otherwise(kinds))


@row("FILTER", category=_C, args="array, include, [if_empty]", mode="K")
def filter_(items, include, empty=None):
    kept = F.filter(items.c, lambda v, i: F.coalesce(F.try_element_at(include.c, i + 1).cast("string").isin("true", "TRUE", "1", "1.0"), F.lit(False)))
    if empty is None:
        return result("array", kept, (F.size(kept) == 0, VALUE))
    return Value("array", F.when(F.size(kept) == 0, F.array(empty.column())).otherwise(kept))


@row("SORTBY", category=_C, args="array, by_array1, [sort_order1], ...", mode="K")
def sortby(items, by, order=None, *_):
    pairs = F.transform(F.arrays_zip(by.c.alias("k"), items.c.alias("v")), lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    up = F.array_sort(pairs)
    down = F.array_sort(pairs, lambda a, b: F.when(a["k"] > b["k"], -1).when(a["k"] < b["k"], 1).when(a["i"] < b["i"], -1).otherwise(1))
    return Value("array", F.transform(F.when(F.lit(True) if order is None else num0(order) == 1, up).otherwise(down), lambda p: p["v"]))


def array_text(items: Value, at: Column) -> Column:
    """Element of an array as text."""
    return F.try_element_at(items.c, F.when(at >= 1, at).cast("int")).cast("string")
