"""Styles of workbooks as small tables, and the style that each cell shows.

``style_tables`` reads fonts, fills, formats of cells and of named styles, number formats and
theme colours, each numbered as references to it are. ``cell_styles`` joins them to cells.
"""

from __future__ import annotations

import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.formats import tinted
from .xlsx import _MAIN, _files, _relations, _scan, _workbook_part

_DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
#: Colours of a theme in the order of their numbers (fixed values).
THEME = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")
#: The indexed palette (fixed values); 0 to 7 come again as 8 to 15.
_FIRST_8 = ("000000", "FFFFFF", "FF0000", "00FF00", "0000FF", "FFFF00", "FF00FF", "00FFFF")
INDEXED = _FIRST_8 + _FIRST_8 + (
    "800000", "008000", "000080", "808000", "800080", "008080", "C0C0C0", "808080",
    "9999FF", "993366", "FFFFCC", "CCFFFF", "660066", "FF8080", "0066CC", "CCCCFF",
    "000080", "FF00FF", "FFFF00", "00FFFF", "800080", "800000", "008080", "0000FF",
    "00CCFF", "CCFFFF", "CCFFCC", "FFFF99", "99CCFF", "FF99CC", "CC99FF", "FFCC99",
    "3366FF", "33CCCC", "99CC00", "FFCC00", "FF9900", "FF6600", "666699", "969696",
    "003366", "339966", "003300", "333300", "993300", "993366", "333399", "333333",
)

_COLOR = pa.struct([("rgb", pa.string()), ("theme", pa.int32()), ("indexed", pa.int32()), ("tint", pa.float64())])
_COLOR_TYPE = "struct<rgb:string,theme:int,indexed:int,tint:double>"
_FONT = {"size": pa.float64(), "font": pa.string(), "bold": pa.bool_(), "italic": pa.bool_(), "underline": pa.bool_(), "strike": pa.bool_(), "color": _COLOR}
_FONT_TYPE = f"size double, font string, bold boolean, italic boolean, underline boolean, strike boolean, color {_COLOR_TYPE}"


def _int(text: str | None) -> int | None:
    return int(text) if (text or "").lstrip("-").isdigit() else None


def _color(x: ElementTree.Element | None) -> dict | None:
    if x is None:
        return None
    tint = x.get("tint")
    return {"rgb": x.get("rgb"), "theme": _int(x.get("theme")), "indexed": _int(x.get("indexed")), "tint": None if tint is None else float(tint)}


def _font(x: ElementTree.Element) -> tuple:
    size, name = x.find(_MAIN + "sz"), x.find(_MAIN + "name")
    marks = (x.find(_MAIN + m) for m in ("b", "i", "u", "strike"))
    on = (m is not None and m.get("val", "1") not in ("0", "false", "none") for m in marks)
    return None if size is None else float(size.get("val", 11)), None if name is None else name.get("val"), *on, _color(x.find(_MAIN + "color"))


def _fill(x: ElementTree.Element | None) -> tuple:
    pattern = None if x is None else x.find(_MAIN + "patternFill")
    if pattern is None:
        return None, None, None
    return pattern.get("patternType"), _color(pattern.find(_MAIN + "fgColor")), _color(pattern.find(_MAIN + "bgColor"))


def _styles(archive: zipfile.ZipFile) -> ElementTree.Element | None:
    for kind, target in _relations(archive, _workbook_part(archive)).values():
        if kind == "styles" and target in archive.namelist():
            return ElementTree.fromstring(archive.read(target))
    return None


def _listed(archive: zipfile.ZipFile, group: str, item: str) -> list[ElementTree.Element]:
    root = _styles(archive)
    found = None if root is None else root.find(_MAIN + group)
    return [] if found is None else found.findall(_MAIN + item)


def _table(spark: SparkSession, path: str, read, columns: str, kinds: dict[str, pa.DataType]) -> DataFrame:
    def rows(path, archive):
        for row in read(archive):
            yield path, *row

    return _scan(_files(spark, path), rows, f"path string, {columns}", [("path", pa.string()), *kinds.items()])


_XF = {"idx": pa.int32(), "font_id": pa.int32(), "fill_id": pa.int32(), "border_id": pa.int32(), "format_id": pa.int32(), "style_id": pa.int32(), "apply_font": pa.bool_(), "apply_fill": pa.bool_(), "apply_border": pa.bool_(), "apply_format": pa.bool_()}
_XF_TYPE = "idx int, font_id int, fill_id int, border_id int, format_id int, style_id int, apply_font boolean, apply_fill boolean, apply_border boolean, apply_format boolean"
#: Sides of a border (fixed values).
SIDES = ("left", "right", "top", "bottom", "diagonal")


def style_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``fonts``, ``fills``, ``borders``, ``cell_formats``, ``named_formats``, ``differential``,
    ``number_formats`` and ``theme``. All have ``path`` and ``idx``."""

    def numbered(group: str, item: str, make):
        return lambda archive: ((i, *make(x)) for i, x in enumerate(_listed(archive, group, item)))

    def xf(x: ElementTree.Element) -> tuple:
        flags = ("applyFont", "applyFill", "applyBorder", "applyNumberFormat")
        return *(_int(x.get(k)) for k in ("fontId", "fillId", "borderId", "numFmtId", "xfId")), *(None if x.get(k) is None else x.get(k) in ("1", "true") for k in flags)

    def border(archive):
        for i, x in enumerate(_listed(archive, "borders", "border")):
            for side in SIDES:
                found = x.find(_MAIN + side)
                if found is not None and found.get("style"):
                    yield i, side, found.get("style"), _color(found.find(_MAIN + "color"))

    def differential(archive):
        for i, x in enumerate(_listed(archive, "dxfs", "dxf")):
            font, fill = x.find(_MAIN + "font"), _fill(x.find(_MAIN + "fill"))
            yield i, *(_font(font) if font is not None else (None,) * 7), fill[1] or fill[2]

    def theme(archive):
        parts = [t for k, t in _relations(archive, _workbook_part(archive)).values() if k == "theme" and t in archive.namelist()]
        scheme = next(ElementTree.fromstring(archive.read(parts[0])).iter(_DRAWING + "clrScheme"), None) if parts else None
        for i, name in enumerate(THEME):
            own = None if scheme is None else scheme.find(_DRAWING + name)
            rgb, system = (None, None) if own is None else (own.find(_DRAWING + "srgbClr"), own.find(_DRAWING + "sysClr"))
            value = rgb.get("val") if rgb is not None else system.get("lastClr") if system is not None else None
            if value:
                yield i, value.upper()

    idx = {"idx": pa.int32()}
    formats = lambda archive: ((_int(x.get("numFmtId")), x.get("formatCode")) for x in _listed(archive, "numFmts", "numFmt"))
    return {
        "fonts": _table(spark, path, numbered("fonts", "font", _font), f"idx int, {_FONT_TYPE}", idx | _FONT),
        "fills": _table(spark, path, numbered("fills", "fill", _fill), f"idx int, pattern string, fore {_COLOR_TYPE}, back {_COLOR_TYPE}", idx | {"pattern": pa.string(), "fore": _COLOR, "back": _COLOR}),
        "borders": _table(spark, path, border, f"idx int, side string, line string, color {_COLOR_TYPE}", idx | {"side": pa.string(), "line": pa.string(), "color": _COLOR}),
        "cell_formats": _table(spark, path, numbered("cellXfs", "xf", xf), _XF_TYPE, _XF),
        "named_formats": _table(spark, path, numbered("cellStyleXfs", "xf", xf), _XF_TYPE, _XF),
        "differential": _table(spark, path, differential, f"idx int, {_FONT_TYPE}, fill {_COLOR_TYPE}", idx | _FONT | {"fill": _COLOR}),
        "number_formats": _table(spark, path, formats, "idx int, code string", idx | {"code": pa.string()}),
        "theme": _table(spark, path, theme, "idx int, rgb string", idx | {"rgb": pa.string()}),
    }


def resolved(color: Column, theme: Column) -> Column:
    """RRGGBB of a colour (rgb, theme, indexed, tint) by a map of theme colours; null where it names none.
    A tint changes colours by rgb and by theme."""
    raw = F.regexp_replace(color["rgb"], "^(0[xX]|#)", "")
    own = F.when(F.length(raw) == 8, F.substring(raw, 3, 6)).when(F.length(raw) == 6, raw)
    named = F.when(color["rgb"].isNotNull(), own).otherwise(F.try_element_at(theme, color["theme"]))
    palette = F.try_element_at(F.array(*map(F.lit, INDEXED)), F.when(color["indexed"] >= 0, color["indexed"] + 1))
    shown = F.when(color["tint"].isNotNull() & named.isNotNull(), tinted(named, color["tint"])).otherwise(named)
    return F.upper(F.when(color["rgb"].isNotNull(), shown).otherwise(F.coalesce(shown, palette)))


def _layer(tables: dict[str, DataFrame], name: str, colors: DataFrame) -> DataFrame:
    """``path``, ``idx``, ``style_id`` and ``own``: what a table of formats sets itself, by its flags."""
    on = lambda flag, id_: F.when(F.coalesce(F.col(flag), F.lit(True)), F.col(id_)).alias(id_)
    formats = tables[name].select("path", "idx", "style_id", on("apply_font", "font_id"), on("apply_fill", "fill_id"), on("apply_border", "border_id"), on("apply_format", "format_id"))
    theme = F.col("_theme")
    fonts = tables["fonts"].withColumnsRenamed({"idx": "font_id", "color": "_ink"})
    fills = tables["fills"].withColumnRenamed("idx", "fill_id")
    sides = tables["borders"].join(colors, "path", "left").groupBy("path", F.col("idx").alias("border_id")).agg(F.map_from_entries(F.collect_list(F.struct("side", F.struct("line", resolved(F.col("color"), theme).alias("color"))))).alias("borders"))
    codes = tables["number_formats"].select("path", F.col("idx").alias("format_id"), F.col("code").alias("_code"))
    joined = formats.join(colors, "path", "left").join(fonts, ["path", "font_id"], "left").join(fills, ["path", "fill_id"], "left").join(sides, ["path", "border_id"], "left").join(codes, ["path", "format_id"], "left")
    fill = F.when(~F.col("pattern").eqNullSafe("none"), resolved(F.col("fore"), theme)).alias("fill")
    code = F.coalesce("_code", F.concat(F.lit("#"), F.col("format_id").cast("string"))).alias("number_format")
    return joined.select("path", "idx", "style_id", F.struct("size", "font", "bold", "italic", "underline", "strike", resolved(F.col("_ink"), theme).alias("color"), fill, "borders", code).alias("own"))


def cell_formats(tables: dict[str, DataFrame]) -> DataFrame:
    """``path``, ``style`` and what it shows: ``size``, ``font``, ``bold``, ``italic``, ``underline``, ``strike``,
    ``color``, ``fill`` (RRGGBB), ``borders`` (a map of sides to line and colour) and ``number_format``; a
    row per format of a workbook.

    The named style comes first and the cell's own format over it, property by property: what the
    own one leaves unset, or doesn't apply, stays. A side of a border without a line is unset.
    """
    colors = tables["theme"].groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("idx", "rgb"))).alias("_theme"))
    base = _layer(tables, "named_formats", colors).select("path", F.col("idx").alias("style_id"), F.col("own").alias("base"))
    both = _layer(tables, "cell_formats", colors).join(base, ["path", "style_id"], "left")
    over = lambda c: F.coalesce(F.col(f"own.{c}"), F.col(f"base.{c}")).alias(c)
    mark = lambda c: (F.coalesce(F.col(f"own.{c}"), F.lit(False)) | F.coalesce(F.col(f"base.{c}"), F.lit(False))).alias(c)
    none = F.create_map().cast(dict(both.select("own.borders").dtypes)["borders"])
    mine, theirs = F.coalesce("own.borders", none), F.coalesce("base.borders", none)
    borders = F.map_concat(F.map_filter(theirs, lambda side, _: ~F.map_contains_key(mine, side)), mine).alias("borders")
    return both.select("path", F.col("idx").alias("style"), over("size"), over("font"), *map(mark, ("bold", "italic", "underline", "strike")), over("color"), over("fill"), borders, over("number_format"))


def cell_styles(cells: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``cells`` (with ``path`` and ``style``) and what their style shows. Built-in number formats, which
    have no code in a workbook, appear as # and their number."""
    return cells.join(cell_formats(tables), ["path", "style"], "left")
