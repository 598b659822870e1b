"""Chart parts: categories or point series, titles, and the kind of chart."""

from __future__ import annotations

from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from foliograph.schema import LIMITS

#: Chart elements whose series have x and y values.
POINTS = {"scatterChart", "bubbleChart"}


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _values(e: ElementTree.Element | None) -> list[str]:
    """Cached values in order; formulas are no values."""
    if e is None:
        return []
    out = [v.text or "" for v in e.iter() if _name(v) == "v"]
    if len(out) > LIMITS["points"]:
        raise ValueError("too many points")
    return out


def _numbers(e: ElementTree.Element | None) -> list[float]:
    out = []
    for v in _values(e):
        try:
            out.append(float(v))
        except ValueError:
            out.append(0.0)
    return out


def stock_kind(series: int, volume: bool) -> str:
    if volume:
        return "Vohlc" if series >= 4 else "Vhlc"
    return "Ohlc" if series >= 4 else "Hlc"


def parse(xml: bytes) -> dict[str, Any]:
    """kind, title, categories and series (name, values or x and y) of a chart part."""
    root = ElementTree.fromstring(xml)
    plots = [e for e in root.iter() if _name(e).endswith("Chart") and any(_name(k) == "ser" for k in e)]
    title = next((e for e in root.iter() if _name(e) == "title"), None)
    categories: list[str] = []
    series: list[dict[str, Any]] = []
    for plot in plots:
        for ser in (k for k in plot if _name(k) == "ser"):
            kids = {_name(k): k for k in ser}
            name = "".join(_values(kids.get("tx"))) or "".join(t.text or "" for t in kids["tx"].iter() if _name(t) == "t") if "tx" in kids else ""
            if _name(plot) in POINTS:
                series.append({"name": name, "x": _numbers(kids.get("xVal")), "y": _numbers(kids.get("yVal"))})
            else:
                categories = categories or _values(kids.get("cat"))
                series.append({"name": name, "values": _numbers(kids.get("val"))})
            if len(series) > LIMITS["series"]:
                raise ValueError("too many series")
    names = [_name(p) for p in plots]
    kind = names[0] if names else "none"
    if "stockChart" in names:
        own = next(p for p in plots if _name(p) == "stockChart")
        kind = "stock" + stock_kind(sum(_name(k) == "ser" for k in own), "barChart" in names)
    shown = "".join(t.text or "" for t in title.iter() if _name(t) == "t") if title is not None else ""
    return {"kind": kind, "title": shown or None, "categories": categories, "series": series}


def write(kind: str, title: str | None, categories: list[str], series: list[tuple[str, list[float]]]) -> bytes:
    """A chart part of category series, as ``parse`` reads it."""

    def cached(tag: str, values: list[Any]) -> str:
        points = "".join(f'<c:pt idx="{i}"><c:v>{escape(str(v))}</c:v></c:pt>' for i, v in enumerate(values))
        return f"<c:{tag}><c:strRef><c:strCache>{points}</c:strCache></c:strRef></c:{tag}>"

    shown = f"<c:title><c:tx><c:rich><a:p><a:r><a:t>{escape(title)}</a:t></a:r></a:p></c:rich></c:tx></c:title>" if title else ""
    own = "".join(f'<c:ser><c:idx val="{n}"/>{cached("tx", [name])}{cached("cat", categories)}{cached("val", values)}</c:ser>' for n, (name, values) in enumerate(series))
    names = 'xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    return f"<c:chartSpace {names}><c:chart>{shown}<c:plotArea><c:{kind}>{own}</c:{kind}></c:plotArea></c:chart></c:chartSpace>".encode()
