import struct

import pytest

from foliograph.schema import LANGUAGES
from foliograph.sources import charts, compound, layouts, packages

U16 = lambda s: struct.pack("<H", len(s)) + s.encode("utf-16-le")


def a_cell(column, row, header=False, old=False):
    flags = (layouts.HEADER_CELL if header else 0) | 1 << 5
    head = struct.pack("<HI", 1, flags) if old else struct.pack("<II", 1, flags)
    return head + struct.pack("<4H2i4h", column, row, 0, 2, 100, 50, 1, 2, 3, 4) + (b"" if old else struct.pack("<H", 7))


def test_info_records():
    shape = struct.pack("<7H", *range(7)) + bytes(28) + struct.pack("<iI", 1200, 3) + bytes(2) + struct.pack("<I", 0x0102FF)
    rows, problems = layouts.read_info(
        [
            (17, struct.pack("<8i", 1, 1, 1, 0, 0, 0, 0, 0)),
            (18, struct.pack("<HH", 1, 10) + U16("png")),
            (19, b"\0" + U16("바탕")),
            (19, b"\0" + U16("Arial")),
            (21, shape),
            (25, struct.pack("<Iii", 3 << 2 | 1 << 23 | 4 << 25, 10, 20)),
            (26, U16("본문") + U16("Body") + struct.pack("<BBhHH", 0, 0, -1, 5, 6)),
            (21, b"short"),
            (999, b""),
        ]
    )
    assert rows["BinData"] == [{"idx": 0, "kind": "Embedding", "id": 10, "extension": "png", "storage_name": "BIN000A.png"}]
    assert rows["CharShape"][0] | {"fonts": 0} == {"idx": 0, "fonts": 0, "size": 1200, "italic": True, "bold": True, "underline": 0, "strikeout": False, "color": 0x0102FF}
    assert rows["ParaShape"][0] == {"idx": 0, "alignment": "CENTER", "heading": "OUTLINE", "level": 4, "left": 10, "right": 20}
    assert rows["Style"][0] == {"idx": 0, "name": "본문", "english": "Body", "kind": "PARA", "next": 0, "language": 1042, "para_shape": 5, "char_shape": 6}
    assert problems == ["CharShape: record has 5 of 56 bytes"]
    sliced = layouts.fonts(rows, LANGUAGES)
    assert [(f["language"], f["face"]) for f in sliced] == [("HANGUL", "바탕"), ("LATIN", "Arial")]
    rows["IdMappings"] = []
    assert len(layouts.fonts(rows, LANGUAGES)) == 14
    assert {f["face"] for f in layouts.fonts({"FaceName": [], "IdMappings": []}, LANGUAGES)} == {"함초롬바탕"}


def test_tables_and_cells():
    head = struct.pack("<IHHh", 4 | 2, 1, 2, 5) + bytes(8) + bytes(2) + struct.pack("<H", 9)
    assert layouts.table(head) == {"rows": 1, "columns": 2, "page_break": "Cell", "repeat_header": True, "cell_spacing": 5, "border_fill": 9}
    assert layouts.table(b"")["rows"] == 0
    new, old = layouts.cell(a_cell(1, 2, True)), layouts.cell(a_cell(1, 2, True, old=True))
    assert new == old | {"border_fill": 7} and new["col_span"] == 1 and new["row_span"] == 2 and new["vertical"] == "Center" and new["is_header"]
    with pytest.raises(ValueError):
        layouts.cell(bytes(29))
    text = lambda s: s.encode("utf-16-le")
    stream = [(66, 0, b""), (71, 1, b" lbt"), (77, 2, head), (72, 2, a_cell(0, 0)), (66, 2, b""), (67, 3, text("a")), (67, 3, text("b")), (72, 2, a_cell(1, 0)), (67, 3, text("c")), (66, 0, b""), (67, 1, text("outside"))]
    assert [[(c["column"], c["text"]) for c in t] for t in layouts.grid(stream, compound.paragraph_text)] == [[(0, "a\nb"), (1, "c")]]
    assert layouts.char_runs(struct.pack("<4I", 0, 1, 5, 2)) == [{"start": 0, "shape": 1}, {"start": 5, "shape": 2}]
    with pytest.raises(ValueError):
        layouts.char_runs(b"1234567")


def test_charts():
    c = "http://schemas.openxmlformats.org/drawingml/2006/chart"
    points = lambda *v: "".join(f"<c:pt><c:v>{x}</c:v></c:pt>" for x in v)
    ser = f"<c:ser><c:tx><c:f>S!A1</c:f>{points('one')}</c:tx><c:cat>{points('a', 'b')}</c:cat><c:val>{points(1, 'x')}</c:val></c:ser>"
    made = charts.parse(f'<c:chartSpace xmlns:c="{c}"><c:chart><c:plotArea><c:barChart>{ser}</c:barChart></c:plotArea></c:chart></c:chartSpace>'.encode())
    assert made == {"kind": "barChart", "title": None, "categories": ["a", "b"], "series": [{"name": "one", "values": [1.0, 0.0]}]}
    dots = f"<c:ser><c:xVal>{points(1, 2)}</c:xVal><c:yVal>{points(3, 4)}</c:yVal></c:ser>"
    made = charts.parse(f'<c:chartSpace xmlns:c="{c}"><c:scatterChart>{dots}</c:scatterChart></c:chartSpace>'.encode())
    assert made["series"] == [{"name": "", "x": [1.0, 2.0], "y": [3.0, 4.0]}]
    stock = charts.parse(f'<c:chartSpace xmlns:c="{c}"><c:barChart>{ser}</c:barChart><c:stockChart>{ser * 4}</c:stockChart></c:chartSpace>'.encode())
    assert stock["kind"] == "stockVohlc"
    with pytest.raises(ValueError):
        charts.parse(f'<c:chartSpace xmlns:c="{c}"><c:barChart>{ser * 300}</c:barChart></c:chartSpace>'.encode())


def test_legacy_sections_become_packages(spark):
    """Paragraphs, a table with nested cells' text, a note, a header and a text box come over; levels tell what belongs where."""
    r, u = compound.make_record, lambda text: text.encode("utf-16-le")
    head = lambda level: r(66, level, bytes(24))
    ctrl = lambda letters: r(71, 1, letters[::-1].encode())
    cell = lambda column, row: r(72, 2, struct.pack("<II", 1, 0) + struct.pack("<4H2i4hH", column, row, 1, 1, 10, 20, 0, 0, 0, 0, 3))
    stream = head(0) + r(67, 1, u("one")) + ctrl("tbl ") + r(77, 2, struct.pack("<IHH", 6, 1, 2))
    stream += cell(0, 0) + head(2) + r(67, 3, u("a")) + head(2) + r(67, 3, u("b")) + cell(1, 0) + head(2) + r(67, 3, u("c"))
    stream += head(0) + r(67, 1, u("two")) + ctrl("fn  ") + r(72, 2, bytes(8)) + head(2) + r(67, 3, u("note"))
    stream += ctrl("head") + r(72, 2, bytes(8)) + head(2) + r(67, 3, u("top")) + ctrl("gso ") + r(76, 2, b"") + r(72, 2, bytes(8)) + head(2) + r(67, 3, u("box"))
    stream += head(0) + ctrl("gso ") + r(79, 2, b"") + r(0x3FF, 1, b"?")
    data = compound.build({"FileHeader": b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05010100, 0), "DocInfo": r(21, 0, bytes(42) + struct.pack("<iI", 1200, 3) + bytes(20)), "BodyText/Section0": stream})
    nested = compound.decode(spark.createDataFrame([("d", bytearray(data))], "path string, content binary")).cache()
    frame = lambda n: compound.frame(nested, n).collect()
    assert [(p.container, p.text) for p in frame("paragraphs")] == [
        ("body", "one"), ("table/tc/subList", "a"), ("table/tc/subList", "b"), ("table/tc/subList", "c"), ("body", "two"), ("footnote/subList", "note"), ("header/subList", "top"), ("rect/drawText/subList", "box"), ("body", ""),
    ]
    assert [c.kind for c in frame("controls")] == ["Table", "Footnote", "Header", "TextBox", "Rect"]
    assert [(c.size, c.bold, c.italic) for c in frame("char_shapes")] == [(1200, True, True)]
    assert [w.code for w in frame("warnings")] == [5100]
    made = packages.decode(compound.convert(nested), "doc_id").cache()
    cells = packages.frame(made, "cells").collect()
    assert sorted((c.row, c.column, c.text, c.width) for c in cells) == [(0, 0, "a\nb", 10), (0, 1, "c", 10)]
    assert {(c.kind) for c in packages.frame(made, "controls").collect()} == {"Footnote", "TextBox"}
    texts = [t.text for t in packages.frame(made, "runs").filter("kind = 'text'").collect()]
    assert [t for t in texts if t in ("one", "two", "note", "top", "box")] and {"one", "two", "note", "top", "box"} <= set(texts)
