"""Contents of documents as Column structs that the package writer takes, and the lists of a header as XML columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliograph.functions.text import xml

_POINTS = "array<struct<x: int, y: int>>"
CONTROL = f"struct<kind: string, width: int, height: int, detail: string, hint: string, text: string, points: {_POINTS}>"
#: Extent of an equation without one of its own, and of a page of the format A4.
EQUATION, PAGE = (8779, 2600), (59528, 84188)


def _control(kind: str, width: Column | int = 0, height: Column | int = 0, detail: Column | None = None, hint: Column | None = None, text: Column | None = None, points: Column | None = None) -> Column:
    none = F.lit(None)
    size = [x if isinstance(x, Column) else F.lit(x) for x in (width, height)]
    rest = [none if x is None else x for x in (detail, hint, text)]
    own = F.struct(F.lit(kind).alias("kind"), *[c.cast("int").alias(n) for c, n in zip(size, ("width", "height"), strict=True)], *[c.cast("string").alias(n) for c, n in zip(rest, ("detail", "hint", "text"), strict=True)], (none if points is None else points).cast(_POINTS).alias("points"))
    return own.cast(CONTROL)


def _extent(points: Column, axis: str) -> Column:
    values = F.transform(points, lambda p: p[axis])
    return F.array_max(values) - F.array_min(values)


def text_box(text: Column, width: Column | int, height: Column | int) -> Column:
    return _control("TextBox", width, height, text=text)


def footnote(text: Column) -> Column:
    return _control("Footnote", text=text)


def endnote(text: Column) -> Column:
    return _control("Endnote", text=text)


def memo(text: Column) -> Column:
    return _control("Memo", text=text)


def header(text: Column) -> Column:
    """A header of all pages."""
    return _control("Header", text=text)


def footer(text: Column) -> Column:
    """A footer of all pages."""
    return _control("Footer", text=text)


def page_number(position: str = "BOTTOM_CENTER") -> Column:
    return _control("PageNumber", detail=F.lit(position))


def page(width: Column | int = PAGE[0], height: Column | int = PAGE[1], masters: Column | None = None) -> Column:
    """Page settings, with the number of master pages that the section takes."""
    return _control("Page", width, height, detail=masters)


def bookmark(name: Column) -> Column:
    return _control("Bookmark", detail=name)


def index_mark(name: Column) -> Column:
    return _control("IndexMark", detail=name)


def hyperlink(text: Column, url: Column) -> Column:
    return _control("Hyperlink", detail=url, hint=text)


def field(kind: Column, hint: Column) -> Column:
    return _control("Field", detail=kind, hint=hint)


def cross_reference(target: Column, kind: Column) -> Column:
    return _control("CrossRef", detail=target, hint=kind)


def equation(script: Column, width: Column | int = EQUATION[0], height: Column | int = EQUATION[1]) -> Column:
    return _control("Equation", width, height, detail=script)


def chart(path: Column, width: Column | int, height: Column | int) -> Column:
    return _control("Chart", width, height, detail=path)


def dutmal(main: Column, sub: Column) -> Column:
    return _control("Dutmal", detail=main, hint=sub)


def compose(text: Column) -> Column:
    return _control("Compose", detail=text)


def image(key: Column) -> Column:
    return _control("Image", detail=key)


def ellipse(width: Column | int, height: Column | int, text: Column | None = None) -> Column:
    return _control("Ellipse", width, height, text=text)


def polygon(points: Column, text: Column | None = None) -> Column:
    """A polygon as large as the box of its corners; null with fewer than three."""
    return F.when(F.size(points) >= 3, _control("Polygon", _extent(points, "x"), _extent(points, "y"), text=text, points=points))


def curve(points: Column) -> Column:
    """A curve as large as the box of its points, one unit at least; null with fewer than two."""
    return F.when(F.size(points) >= 2, _control("Curve", F.greatest(_extent(points, "x"), F.lit(1)), F.greatest(_extent(points, "y"), F.lit(1)), points=points))


# -- lists of the header ----------------------------------------------------------------------------------------
def _xml(*pieces: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])


def char_shape(idx: Column, size: Column, colour: Column, bold: Column, italic: Column, underline: Column) -> Column:
    """A character shape; ``colour`` is #RRGGBB and ``underline`` a type or NONE."""
    flags = F.concat(F.when(bold, "<hh:bold/>").otherwise(""), F.when(italic, "<hh:italic/>").otherwise(""), F.when(underline != "NONE", _xml('<hh:underline type="', underline, '"/>')).otherwise(""))
    return _xml('<hh:charPr id="', idx, '" height="', size, '" textColor="', colour, '">', flags, "</hh:charPr>")


def para_shape(idx: Column, alignment: Column, heading: Column, level: Column, indent: Column, spacing: Column) -> Column:
    """A paragraph shape; justified paragraphs are written as BOTH."""
    align = F.when(alignment == "JUSTIFY", "BOTH").otherwise(alignment)
    head = F.when(heading != "NONE", _xml('<hh:heading type="', heading, '" idRef="0" level="', level, '"/>')).otherwise("")
    return _xml('<hh:paraPr id="', idx, '"><hh:align horizontal="', align, '"/>', head, '<hh:margin><hh:left value="', indent, '"/></hh:margin><hh:lineSpacing type="PERCENT" value="', spacing, '"/></hh:paraPr>')


def style(idx: Column, name: Column, english: Column, para: Column, char: Column) -> Column:
    return _xml('<hh:style id="', idx, '" type="PARA" name="', xml(name), '" engName="', xml(english), '" paraPrIDRef="', para, '" charPrIDRef="', char, '"/>')


def border_fill(idx: Column, sides: dict[str, Column], colour: Column, picture: Column) -> Column:
    """A border fill: types of its sides, and a colour, else a picture, else nothing inside; an absent type is none."""
    lines = F.concat(*[F.coalesce(_xml(f'<hh:{side}Border type="', kind, '"/>'), F.lit(f"<hh:{side}Border/>")) for side, kind in sides.items()])
    brush = lambda inner: _xml('<hc:fillBrush xmlns:hc="http://www.hancom.co.kr/hwpml/2011/core">', inner, "</hc:fillBrush>")
    filled = brush(_xml('<hc:winBrush faceColor="', colour, '"/>'))
    tiled = brush(_xml('<hc:imgBrush mode="TILE"><hc:img binaryItemIDRef="', xml(picture), '"/></hc:imgBrush>'))
    return _xml('<hh:borderFill id="', idx, '">', lines, F.coalesce(filled, tiled, F.lit("")), "</hh:borderFill>")


def tab_stops(idx: Column, stops: Column) -> Column:
    """Tab properties of stops (position, type, leader)."""
    items = F.transform(stops, lambda s: _xml('<hh:tabItem pos="', s["position"], '" type="', s["type"], '" leader="', s["leader"], '"/>'))
    return _xml('<hh:tabPr id="', idx, '" autoTabLeft="0" autoTabRight="0">', F.array_join(items, ""), "</hh:tabPr>")


def numbering(idx: Column, start: Column, levels: Column) -> Column:
    """A numbering of levels (level, format, text)."""
    heads = F.transform(levels, lambda h: _xml('<hh:paraHead level="', h["level"], '" numFormat="', h["format"], '">', xml(h["text"]), "</hh:paraHead>"))
    return _xml('<hh:numbering id="', idx, '" start="', start, '">', F.array_join(heads, ""), "</hh:numbering>")


def bullet(idx: Column, mark: Column, checked: Column) -> Column:
    return _xml('<hh:bullet id="', idx, '" char="', mark, '"', F.coalesce(_xml(' checkedChar="', checked, '"'), F.lit("")), "/>")
