"""References in formula texts: which cells a formula reads, and its text where it is filled to.

A scanner finds references and nothing else: it knows texts in quotes, names of sheets (quoted or
plain, in any letters), ``$`` marks, ranges and whole columns, and tells references from names of
functions. Formulas aren't parsed or evaluated. References come out as ranges, also large ones
and whole columns, as ``grid.reached`` takes them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..values import REF
from .tiles import LAST

_CELL = r"\$?[A-Za-z]{1,3}\$?[0-9]{1,10}"
_COLUMN = r"\$?[A-Za-z]{1,3}"
_TOKEN = re.compile(
    r'"(?:[^"]|"")*"'  # a text
    r"|(?P<sheet>'(?:[^']|'')+'!|[^\W\d][\w.]*!|(?<![\w.$])\d\w*!)?"
    rf"(?:(?P<first>{_CELL})(?::(?P<last>{_CELL}))?|(?P<left>{_COLUMN}):(?P<right>{_COLUMN}))(?![\w.(!$])"
    r"|[^\W\d][\w.]*|[\d.]+\w*"  # other names and numbers
)
_PARTS = re.compile(r"(\$?)([A-Za-z]{1,3})(\$?)([0-9]*)")
#: The last column of a sheet.
COLUMNS = 16384


def column_number(letters: str) -> int:
    out = 0
    for c in letters.upper():
        out = 26 * out + ord(c) - 64
    return out


def column_letters(number: int) -> str:
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def _sheet(prefix: str | None) -> str | None:
    if prefix is None:
        return None
    name = prefix[:-1]
    return name[1:-1].replace("''", "'") if name.startswith("'") else name


def _corner(text: str) -> tuple[int, int | None]:
    """Column and row of a corner; no row for a whole column."""
    _, letters, _, digits = _PARTS.fullmatch(text).groups()
    return column_number(letters), int(digits) if digits else None


def scan(formula: str) -> Iterator[tuple[re.Match, list[str]]]:
    """Every reference of a formula, with the texts of its corners (one or two)."""
    for m in _TOKEN.finditer(formula):
        corners = [c for c in (m["first"], m["last"]) if c] or [c for c in (m["left"], m["right"]) if c]
        if corners and all(1 <= _corner(c)[0] <= COLUMNS and _corner(c)[1] != 0 for c in corners):
            yield m, corners


def ranges_of(formula: str) -> list[tuple[str | None, int, int, int, int]]:
    """Sheet (None: the formula's own), r1, c1, r2, c2 of each reference, in its order."""
    out = []
    for m, corners in scan(formula):
        (c1, r1), (c2, r2) = _corner(corners[0]), _corner(corners[-1])
        rows = (1, LAST) if r1 is None else (min(r1, r2), min(max(r1, r2), LAST))
        out.append((_sheet(m["sheet"]), rows[0], min(c1, c2), rows[1], max(c1, c2)))
    return out


def _moved(corner: str, rows: int, cols: int) -> str:
    fixed_col, letters, fixed_row, digits = _PARTS.fullmatch(corner).groups()
    col = column_number(letters) + (0 if fixed_col else cols)
    row = int(digits) + (0 if fixed_row else rows) if digits else None
    if not 1 <= col <= COLUMNS or (row is not None and row < 1):
        return REF
    return f"{fixed_col}{column_letters(col)}{fixed_row}{'' if row is None else row}"


def moved(formula: str, rows: int, cols: int) -> str:
    """A formula filled so many rows down and columns to the right: parts without ``$`` move, and what
    would leave the sheet becomes #REF!."""
    out, at = [], 0
    for m, corners in scan(formula):
        start = m.end("sheet") if m["sheet"] else m.start()
        new = [_moved(c, rows, cols) for c in corners]
        out += [formula[at:start], REF if REF in new else ":".join(new)]
        at = m.end()
    return "".join(out) + formula[at:]


class _Edges:
    def eval(self, formula):
        if formula is not None:
            for found in ranges_of(formula):
                yield found


#: A table function of a formula: ref_sheet (null: the formula's own), r1, c1, r2, c2 of each reference.
reference_ranges = F.udtf(_Edges, returnType="ref_sheet string, r1 int, c1 int, r2 int, c2 int")


def edges(formulas: DataFrame) -> DataFrame:
    """What each formula reads: ``sheet``, ``row``, ``col``, ``src_sheet``, ``r1``, ``c1``, ``r2``, ``c2``,
    as ``grid.reached`` takes them. ``formulas`` has sheet, row, col and formula; null formulas read
    nothing."""
    asked = formulas.where(F.col("formula").isNotNull()).select("sheet", "row", "col", "formula")
    found = asked.lateralJoin(reference_ranges(F.col("formula").outer()))
    return found.select("sheet", "row", "col", F.coalesce("ref_sheet", "sheet").alias("src_sheet"), "r1", "c1", "r2", "c2")


@F.arrow_udf(StringType())
def moved_column(formulas: pa.Array, rows: pa.Array, cols: pa.Array) -> pa.Array:
    return pa.array([None if f is None else moved(f, r or 0, c or 0) for f, r, c in zip(formulas.to_pylist(), rows.to_pylist(), cols.to_pylist(), strict=True)], pa.string())


def unshared(cells: DataFrame) -> DataFrame:
    """``cells`` as ``xlsx.read_cells`` gives them, where every cell of a shared formula has its own text:
    that of the cell which states it, moved. Those without one keep null."""
    keys = ["path", "sheet", "shared"] if "path" in cells.columns else ["sheet", "shared"]
    stated = cells.where(F.col("shared").isNotNull() & (F.coalesce("formula", F.lit("")) != ""))
    first = stated.groupBy(*keys).agg(F.min_by(F.struct("row", "col", "formula"), F.struct("row", "col")).alias("_from"))
    joined = cells.join(first, keys, "left")
    own = F.coalesce("formula", F.lit("")) != ""
    text = F.when(own | F.col("_from").isNull(), F.col("formula")).otherwise(moved_column(F.col("_from.formula"), F.col("row") - F.col("_from.row"), F.col("col") - F.col("_from.col")))
    return joined.select(*[c for c in cells.columns if c != "formula"], text.alias("formula"))
