"""Charts and pictures of workbooks as tables, read file by file.

A chart's points are what its part caches or states; series of unequal arrays are padded by
``formats.series``.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.formats import series
from .xlsx import _files, _relations, _scan, listed_sheets

# Fixed names of the format.
_CHART = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
_MAIN = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_PLACED = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Elements of charts and the kinds that they are (fixed values); of several the first listed counts.
CHART_KINDS = {"barChart": "bar", "bar3DChart": "bar", "lineChart": "line", "line3DChart": "line", "pieChart": "pie", "pie3DChart": "pie", "areaChart": "area", "area3DChart": "area", "scatterChart": "scatter", "doughnutChart": "doughnut", "radarChart": "radar", "ofPieChart": "pie"}
#: Kinds of pictures by the ending of their part (fixed values).
PICTURE_KINDS = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "emf": "image/emf", "wmf": "image/wmf"}


def _first(x: ElementTree.Element | None, *names: str) -> ElementTree.Element | None:
    """The first descendant by each name in turn."""
    for name in names:
        x = next(x.iter(name), None) if x is not None else None
    return x


def _parts(archive: zipfile.ZipFile, kind: str) -> Iterator[tuple[str, str]]:
    """Parts of a kind that sheets name, with their sheet; missing ones are left out."""
    names = set(archive.namelist())
    for _, sheet, _, part in listed_sheets(archive):
        for found, target in _relations(archive, part).values() if part in names else ():
            if found == kind and target in names:
                yield sheet, target


def _corner(anchor: ElementTree.Element, name: str, default: tuple[int, int]) -> tuple[int, int]:
    place = anchor.find(_PLACED + name)
    if place is None:
        return default
    return tuple(int(place.findtext(_PLACED + c) or 0) + 1 for c in ("row", "col"))


def anchors(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``sheet``, ``drawing``, ``anchor`` (twoCell or oneCell), ``kind`` (chart or image), ``id``,
    ``target``, and the corners ``from_row``, ``from_col``, ``to_row``, ``to_col`` from 1 (``to`` is 1, 1
    where a drawing states none)."""

    def read(path, archive):
        for sheet, drawing in _parts(archive, "drawing"):
            links = _relations(archive, drawing)
            for anchor in ElementTree.fromstring(archive.read(drawing)):
                way = anchor.tag.removeprefix(_PLACED).removesuffix("Anchor")
                if way not in ("twoCell", "oneCell"):
                    continue
                chart = _first(anchor, _PLACED + "graphicFrame", _MAIN + "graphic", _MAIN + "graphicData", _CHART + "chart")
                blip = _first(anchor, _PLACED + "pic", _MAIN + "blip")
                found = [("chart", chart.get(_LINK + "id"))] if chart is not None and way == "twoCell" else []
                found += [("image", blip.get(_LINK + "embed"))] if blip is not None else []
                for kind, key in found:
                    if key:
                        yield path, sheet, drawing, way, kind, key, links.get(key, (None, None))[1], *_corner(anchor, "from", (0, 0)), *_corner(anchor, "to", (1, 1))

    texts, places = ["path", "sheet", "drawing", "anchor", "kind", "id", "target"], ["from_row", "from_col", "to_row", "to_col"]
    schema = ", ".join([f"{c} string" for c in texts] + [f"{c} int" for c in places])
    return _scan(_files(spark, path), read, schema, [(c, pa.string()) for c in texts] + [(c, pa.int32()) for c in places])


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``part``, ``kind`` (a media type), ``content`` and ``url`` (a data URL) of what drawings embed."""

    def read(path, archive):
        seen = {target for _, drawing in _parts(archive, "drawing") for kind, target in _relations(archive, drawing).values() if kind == "image"}
        for part in sorted(seen & set(archive.namelist())):
            yield path, part, PICTURE_KINDS.get(part.rsplit(".", 1)[-1].lower(), "application/octet-stream"), archive.read(part)

    found = _scan(_files(spark, path), read, "path string, part string, kind string, content binary", [("path", pa.string()), ("part", pa.string()), ("kind", pa.string()), ("content", pa.binary())])
    return found.withColumn("url", F.concat(F.lit("data:"), "kind", F.lit(";base64,"), F.base64("content")))


def _text(x: ElementTree.Element | None) -> str:
    return "" if x is None else "".join(t.text or "" for t in x.iter(_MAIN + "t")).strip()


def _cached(x: ElementTree.Element | None) -> list[str] | None:
    """Texts of the points of a reference's cache or of literals, by index; none where there is neither."""
    if x is None:
        return None
    for ref, cache in (("strRef", "strCache"), ("numRef", "numCache"), ("strLit", None), ("numLit", None)):
        found = _first(x, _CHART + ref)
        if found is not None:
            points = found if cache is None else _first(found, _CHART + cache)
            listed = [] if points is None else [(int(p.get("idx", 0)), p.findtext(_CHART + "v") or "") for p in points.iter(_CHART + "pt")]
            texts = [t for _, t in sorted(listed, key=lambda p: p[0])]
            return [_plain(_number(t)) for t in texts] if ref.startswith("num") else texts
    return None


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return 0.0


def _plain(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x)


def _title(x: ElementTree.Element | None) -> str:
    title = None if x is None else x.find(_CHART + "title")
    tx = None if title is None else title.find(_CHART + "tx")
    rich = _first(tx, _CHART + "rich")
    if rich is not None:
        return _text(rich)
    return (_cached(tx) or [""])[0]


def _plot(data: bytes) -> tuple[ElementTree.Element | None, ElementTree.Element | None, str, ElementTree.Element | None]:
    """The chart, its plot area, kind, and the element that has its series."""
    root = ElementTree.fromstring(data)
    chart = root if root.tag == _CHART + "chart" else _first(root, _CHART + "chart")
    area = _first(chart if chart is not None else root, _CHART + "plotArea")
    for name, kind in CHART_KINDS.items():
        own = _first(area, _CHART + name)
        if own is not None:
            direction = _first(own, _CHART + "barDir")
            if kind == "bar" and (direction is None or direction.get("val", "col") != "bar"):
                kind = "col"
            return chart, area, kind, own
    return chart, area, "unknown", None


def charts(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``part``, ``kind``, ``title``, ``category_axis``, ``value_axis`` of each chart that a drawing shows."""

    def read(path, archive):
        for part in _chart_parts(archive):
            chart, area, kind, _ = _plot(archive.read(part))
            axes = [None if area is None else area.find(_CHART + a) for a in ("catAx", "valAx")]
            yield path, part, kind, _title(chart), *(None if a is None else _text(a.find(_CHART + "title")) for a in axes)

    names = ["path", "part", "kind", "title", "category_axis", "value_axis"]
    return _scan(_files(spark, path), read, ", ".join(f"{c} string" for c in names), [(c, pa.string()) for c in names])


def _chart_parts(archive: zipfile.ZipFile) -> list[str]:
    names = set(archive.namelist())
    return sorted({target for _, drawing in _parts(archive, "drawing") for kind, target in _relations(archive, drawing).values() if kind == "chart" and target in names})


def chart_series(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``part``, ``series`` (from 0), ``name``, ``color`` (RRGGBB, null where the part states none),
    ``categories`` and ``values`` of each series of each chart."""

    def read(path, archive):
        for part in _chart_parts(archive):
            _, _, kind, own = _plot(archive.read(part))
            across, up = ("xVal", "yVal") if kind == "scatter" else ("cat", "val")
            for i, s in enumerate(own.findall(_CHART + "ser") if own is not None else ()):
                tx = s.find(_CHART + "tx")
                name = (_cached(tx) or [""])[0] or (next((v.text for v in tx.iter(_CHART + "v")), "") if tx is not None else "") or f"Series {i + 1}"
                fill = _first(s.find(_CHART + "spPr"), _MAIN + "solidFill", _MAIN + "srgbClr")
                values = s.find(_CHART + up)
                # only numbers count as values, as only they are drawn
                numbers = [] if values is None or (_first(values, _CHART + "numRef") is None and _first(values, _CHART + "numLit") is None) else [_number(v) for v in _cached(values) or []]
                yield path, part, i, name, None if fill is None else fill.get("val"), _cached(s.find(_CHART + across)) or [], numbers

    kinds = [("path", pa.string()), ("part", pa.string()), ("series", pa.int32()), ("name", pa.string()), ("color", pa.string()), ("categories", pa.list_(pa.string())), ("values", pa.list_(pa.float64()))]
    return _scan(_files(spark, path), read, "path string, part string, series int, name string, color string, categories array<string>, values array<double>", kinds)


def chart_points(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``part``, ``series``, ``name``, ``point`` (from 0), ``category``, ``value``: points of all charts."""
    return series(chart_series(spark, path), ["path", "part", "series", "name"], "categories", "values")
