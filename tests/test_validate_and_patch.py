import io
import zipfile

import pytest

from foliograph.operators.validate import issues, validate
from foliograph.sources import packages, patching

HEAD = "<head/>"


def package(*sections):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as out:
        out.writestr("mimetype", "application/hwp+zip")
        out.writestr("Contents/header.xml", HEAD)
        for i, s in enumerate(sections):
            out.writestr(f"Contents/section{i}.xml", f"<sec>{s}</sec>")
    return box.getvalue()


def cell(inner="<subList><p><run><t>x</t></run></p></subList>", header=0, span=1):
    return f'<tc header="{header}">{inner}<cellSpan colSpan="{span}" rowSpan="1"/></tc>'


def p(inner):
    return f"<p><run>{inner}</run></p>"


CASES = {
    "good": (package(p("<t>a</t>") + p(f'<tbl><tr>{cell(header=1)}</tr><tr>{cell()}</tr></tbl>')), None),
    "none": (package(), 2000),
    "section": (package(p("<t>a</t>"), ""), 2001),
    "paragraph": (package(p("<t>a</t>") + "<p/>"), 2002),
    "table": (package(p("<tbl/>")), 2003),
    "row": (package(p(f"<tbl><tr>{cell()}</tr><tr/></tbl>")), 2004),
    "span": (package(p(f"<tbl><tr>{cell(span=0)}</tr></tbl>")), 2005),
    "box": (package(p("<rect><drawText/></rect>")), 2006),
    "rect": (package(p("<rect/>")), None),
    "polygon": (package(p('<polygon><sz width="5" height="5"/><pt x="0" y="0"/><pt x="1" y="1"/></polygon>')), 2010),
    "chart": (package(p('<chart chartIDRef="Chart/none.xml"><sz width="5" height="5"/></chart>')), 2013),
    "note": (package(p("<ctrl><footNote/></ctrl>")), 2007),
    "cell": (package(p(f"<tbl><tr>{cell(inner='')}</tr></tbl>")), 2008),
    "endnote": (package(p("<ctrl><endNote/></ctrl>")), 2009),
    "shape": (package(p('<ellipse><sz width="0" height="5"/></ellipse>')), 2011),
    "equation": (package(p('<equation><sz width="5" height="5"/><script> </script></equation>')), 2012),
    "header": (package(p(f"<tbl><tr>{cell()}</tr><tr>{cell(header=1)}</tr></tbl>")), 2016),
}


def test_rules(spark):
    files = spark.createDataFrame([(k, bytearray(v)) for k, (v, _) in CASES.items()], "path string, content binary")
    nested = packages.decode(files).cache()
    frames = {n: packages.frame(nested, n).cache() for n in packages.PARTS}
    found = {r.doc_id: (r.valid, r.code, r.error) for r in validate(nested.select("doc_id"), frames).collect()}
    assert found == {k: (code is None, code, None if code is None else f"E{code}") for k, (_, code) in CASES.items()}
    assert issues(nested.select("doc_id"), frames).filter("doc_id = 'good'").count() == 0


def test_patches_change_nothing_else(spark):
    data = packages.build([[{"text": "one & two"}, {"text": "line\nbreak"}], [{"text": "other", "cells": [{"row": 0, "column": 0, "text": "cell"}]}]])
    out = patching.export(data, 0)
    first, second = out["slots"]
    assert first["text"] == "one & two" and first["path"] == "paragraphs[0].runs[0].text[0]"
    assert patching.patch(data, 0, out["sha256"], {first["path"]: "one & two"}) == data
    new = patching.patch(data, 0, out["sha256"], {first["path"]: "<three> é"})
    before, after = (zipfile.ZipFile(io.BytesIO(x)) for x in (data, new))
    assert [n for n in before.namelist() if before.read(n) != after.read(n)] == ["Contents/section0.xml"]
    assert [r["text"] for r in packages.parse(new)["runs"] if r["kind"] == "text"][:2] == ["<three> é", "line\nbreak"]
    assert {s["text"] for s in patching.export(data, 1)["slots"]} == {"other", "cell"}
    for section, sha, texts, why in ((5, "", {}, "range"), (0, "0", {}, "changed"), (0, out["sha256"], {"x": ""}, "no slot"), (0, out["sha256"], {first["path"]: "a\nb"}, "markup"), (0, out["sha256"], {second["path"]: "b"}, "markup")):
        with pytest.raises(patching.Refused, match=why):
            patching.patch(data, section, sha, texts)
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data)), ("c", bytearray(data))], "path string, content binary")
    changes = spark.createDataFrame([("a", 0, out["sha256"], first["path"], "new"), ("b", 0, "0", first["path"], "new")], "doc_id string, section int, sha256 string, path string, text string")
    made = {r.doc_id: (bytes(r.content) == data, r.error) for r in patching.apply(files, changes).collect()}
    assert made == {"a": (False, None), "b": (True, "base has changed"), "c": (True, None)}
