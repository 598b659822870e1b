import struct
import zipfile
import zlib
from io import BytesIO

import pytest

from foliograph.operators.deep import deep_counts
from foliograph.sources import compound, exchange, lossless, markdown, packages

CELLS = [
    {"row": 0, "column": 0, "is_header": True, "text": "h1"},
    {"row": 0, "column": 1, "is_header": True, "text": "h2"},
    {"row": 1, "column": 0, "col_span": 2, "text": "wide\ntext"},
]


def made():
    return packages.build([[{"text": "Title", "style": 1}, {"text": "a\tb\nc d & <e>"}], [{"text": "", "cells": CELLS}]], {"BinData/pic.PNG": b"\x89PNG"}, ["Normal", "개요 1"])


def files(spark, rows):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows.items()], "path string, content binary")


def test_packages_round_trip(spark):
    nested = packages.decode(files(spark, {"a": made(), "bad": b"not a zip", "none": None, "empty": b""})).cache()
    texts = {(r.section, r.path): r.text for r in packages.frame(nested, "runs").collect() if r.kind == "text"}
    assert texts[0, "paragraphs[0]"] == "Title" and texts[0, "paragraphs[1]"] == "a\tb\nc d & <e>"
    cells = packages.frame(nested, "cells").orderBy("row", "column").collect()
    assert [(c.row, c.column, c.col_span, c.is_header, c.text) for c in cells] == [(0, 0, 1, True, "h1"), (0, 1, 1, True, "h2"), (1, 0, 2, False, "wide\ntext")]
    assert {r.name for r in packages.frame(nested, "styles").collect()} == {"Normal", "개요 1"}
    assert [(r.key, r.format) for r in packages.frame(nested, "images").collect()] == [("pic.PNG", "png")]
    assert {r.doc_id for r in packages.frame(nested, "warnings").collect()} == {"bad", "none", "empty"}
    counts = {r.section: (r.paragraphs, r.deep_paragraphs, r.tables) for r in deep_counts(packages.frame(nested, "paragraphs"), packages.frame(nested, "runs"), packages.frame(nested, "controls")).collect()}
    assert counts == {0: (2, 2, 0), 1: (1, 4, 1)}
    assert {r.path: r.format for r in packages.sniff(files(spark, {"a": made(), "b": compound.MAGIC, "c": b"x"})).collect()} == {"a": "package", "b": "compound", "c": "unknown"}


def test_package_rules():
    box = BytesIO()
    with zipfile.ZipFile(box, "w") as out:
        out.writestr("mimetype", "text/plain")
    assert packages.parse(box.getvalue())["warnings"][0]["code"] == 4001
    section = '<sec><p><run><tbl rowCnt="3"><tr><tc header="1"/><tc header="0"/></tr><tr><tc header="1"/></tr></tbl></run></p></sec>'
    rows = {n: [] for n in packages.PARTS}
    packages._Section(rows, 0).read(section.encode())
    assert [w["code"] for w in rows["warnings"]] == [4002, 4003, 4004]
    deep = "<sec>" + "<p><run><rect><subList>" * 40 + "</subList></rect></run></p>" * 40 + "</sec>"
    with pytest.raises(packages.Unreadable):
        packages._Section({n: [] for n in packages.PARTS}, 0).read(deep.encode())


def test_encoded_blocks_decode_to_the_same_text(spark):
    blocks = spark.createDataFrame([("d", 0, 0, "one"), ("d", 0, 1, "two\nlines"), ("d", 1, 0, "three"), ("e", 0, 0, "é")], "doc_id string, section int, ordinal int, text string")
    back = packages.frame(packages.decode(packages.encode(blocks), "doc_id"), "runs").filter("kind = 'text'")
    assert sorted((r.doc_id, r.section, r.text) for r in back.collect()) == [("d", 0, "one"), ("d", 0, "two\nlines"), ("d", 1, "three"), ("e", 0, "é")]


def compound_file(streams):
    """A compound file whose streams are all in large sectors."""
    names = sorted(streams)
    sectors, fat, starts = [], [], {}
    for n in names:
        body = streams[n].ljust(4096, b"\0")
        starts[n] = len(sectors)
        count = -(-len(body) // 512)
        sectors += [body[i * 512 : (i + 1) * 512].ljust(512, b"\0") for i in range(count)]
        fat += [len(fat) + i + 1 for i in range(count - 1)] and [starts[n] + i + 1 for i in range(count - 1)] + [0xFFFFFFFE]

    def node(name, kind, child=0xFFFFFFFF, right=0xFFFFFFFF, start=0, size=0):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", 0xFFFFFFFF, right, child) + bytes(36) + struct.pack("<IQ", start, size)

    tops = [n for n in names if "/" not in n]
    inner = [n for n in names if "/" in n]
    nodes = [node("Root Entry", 5, child=1)]
    for i, n in enumerate(tops):
        nodes.append(node(n, 2, right=i + 2, start=starts[n], size=max(len(streams[n]), 4096)))
    nodes.append(node("BodyText", 1, child=len(nodes) + 1))
    for i, n in enumerate(inner):
        nodes.append(node(n.split("/")[1], 2, right=len(nodes) + 1 if i + 1 < len(inner) else 0xFFFFFFFF, start=starts[n], size=max(len(streams[n]), 4096)))
    directory = b"".join(nodes).ljust(-(-len(nodes) // 4) * 512, b"\0")
    first_dir = len(sectors)
    own = [directory[i : i + 512] for i in range(0, len(directory), 512)]
    sectors += own
    fat += [first_dir + i + 1 for i in range(len(own) - 1)] + [0xFFFFFFFE]
    fat_at = len(sectors)
    fat.append(0xFFFFFFFD)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    assert len(table) == 512
    head = compound.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, first_dir, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head.ljust(76, b"\0") + struct.pack("<109I", fat_at, *[0xFFFFFFFF] * 108) + b"".join(sectors) + table


def padded(records):
    """Records up to the length from which a stream is in large sectors."""
    rest = 4096 - len(records)
    return records + compound.make_record(0x3FF, 0, bytes(rest - 4))


def test_compound_files(spark):
    text = "가나\t".encode("utf-16-le") + struct.pack("<8H", 11, *[0] * 7) + "끝\r".encode("utf-16-le")
    text = text.replace(struct.pack("<H", 9), struct.pack("<8H", 9, *[0] * 7))
    section = padded(compound.make_record(66, 0, b"abcd") + compound.make_record(67, 1, text))
    data = compound_file({"FileHeader": b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05010100, 0), "DocInfo": padded(compound.make_record(17, 0, b"x")), "BodyText/Section0": section})
    locked = compound_file({"FileHeader": b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05010100, 2)})
    nested = compound.decode(files(spark, {"a": data, "locked": locked, "bad": b"x"})).cache()
    assert [r.text for r in compound.frame(nested, "paragraphs").collect()] == ["가나\t￼끝"]
    census = {r.name: r.n for r in compound.tag_census(compound.frame(nested, "records")).collect()}
    assert census == {"IdMappings": 1, "ParaHeader": 1, "ParaText": 1, "Unknown(0x03FF)": 2}
    problems = {r.doc_id: r.detail for r in compound.frame(nested, "warnings").collect() if r.code == 5000}
    assert problems == {"locked": "password", "bad": "not a compound file"}


def test_records_and_streams():
    wide = bytes(5000)
    raw = compound.make_record(67, 3, b"ab") + compound.make_record(5, 1023, wide)
    assert [(r.tag, r.level, len(r.data)) for r in compound.records(raw)] == [(67, 3, 2), (5, 1023, 5000)]
    with pytest.raises(ValueError):
        list(compound.records(raw[:-1]))
    squeezed = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = squeezed.compress(b"abc" * 10) + squeezed.flush()
    assert compound.inflate(body) == b"abc" * 10 and compound.inflate(zlib.compress(b"xyz")) == b"xyz"
    with pytest.raises(ValueError):
        compound.inflate(zlib.compress(bytes(5_000_000)))


MD = """# One *two*

para `co*de*` with [link](http://x) and
more **bold** ![alt](pic.png)

- [x] done
  - sub
3. third

| h | i |
|---|---|
| 1 | a\\|b |
| 2 |

<!-- other-tool:section -->

> quoted
> text

```py
x = 1

y
```
---
"""


def test_markdown_blocks():
    found = [(b["section"], b["kind"], b["level"], b["text"]) for b in markdown.blocks(MD)]
    assert found == [
        (0, "heading", 1, "One two"),
        (0, "paragraph", None, "para co*de* with link and more bold "),
        (0, "bullet", 0, "done"),
        (0, "bullet", 1, "sub"),
        (0, "number", 0, "third"),
        (0, "table", None, ""),
        (1, "quote", None, "quoted text"),
        (1, "code", None, "x = 1\n\ny"),
        (1, "rule", None, "---"),
    ]
    assert [b["rows"] for b in markdown.blocks(MD) if b["rows"]] == [[["1", "a|b"], ["2", ""]]]
    assert [b["rows"] for b in markdown.blocks(MD, keep_header=True) if b["rows"]] == [[["h", "i"], ["1", "a|b"], ["2", ""]]]
    assert [b["rows"] for b in markdown.blocks("| a |\n|---|") if b["rows"]] == [[[""]]]
    assert markdown.blocks("<!-- s:section -->\n<!-- s:section -->\nx")[0]["section"] == 0


def test_markdown_round_trip(spark):
    docs = spark.createDataFrame([(1, MD), (2, None), (3, "")], "id int, md string")
    first = markdown.decode(docs, "id", "md", keep_header=True).cache()
    again = markdown.decode(markdown.encode(first), "doc_id", "markdown", keep_header=True)
    strip = lambda rows: sorted((r.doc_id, r.section, r.ordinal, r.kind, r.level or 0, r.text.strip(), str(r.rows)) for r in rows)
    assert strip(first.collect()) == strip(again.collect())


def test_exchange_round_trip(spark):
    nested = packages.decode(files(spark, {"a": made()}))
    docs = exchange.documents(packages.frame(nested, "paragraphs"), packages.frame(nested, "runs")).cache()
    back = exchange.from_json(exchange.to_json(docs)).filter("error IS NULL")
    key = lambda d: sorted((r.section, r.ordinal, r.run, r.kind, r.text) for r in exchange.flat_runs(d).collect())
    assert key(back) == key(docs) and len(key(docs)) == 3
    assert exchange.to_json(docs, section=7).head().error == "section out of range"
    assert exchange.to_json(docs, inline_limit=10).head().error == "too large"
    broken = exchange.from_json(spark.createDataFrame([("x", "{")], "doc_id string, json string"))
    assert broken.head().error == "not an exported document"
    assert '"sections"' in exchange.json_schema()


TEMPLATE = """
# a comment
meta:
  name: child
  extends: base
styles:
  body:
    font: "Batang"
    size: 12pt
  list: [1, 2, x]
tabs:
  - id: 3
    pos: 10
  - id: 5
    pos: 20
page: null
"""


def test_templates():
    child = exchange.read_yaml(TEMPLATE)
    assert child["styles"]["list"] == [1, 2, "x"] and child["tabs"][1] == {"id": 5, "pos": 20}
    base = exchange.read_yaml("meta:\n  name: base\nstyles:\n  body:\n    font: Dotum\n    color: '#000000'\ntabs:\n- id: 3\n  pos: 1\n- id: 4\n  pos: 2\npage:\n  width: 100\n")
    made = exchange.resolve({"child": child, "base": base}, "child")
    assert made["styles"]["body"] == {"font": "Batang", "color": "#000000", "size": "12pt"}
    assert made["tabs"] == [{"id": 3, "pos": 10}, {"id": 4, "pos": 2}, {"id": 5, "pos": 20}] and made["page"] == {"width": 100}
    for templates, name in (({"a": {"extends": "a"}}, "a"), ({"a": {"extends": "b"}}, "a"), ({f"t{i}": {"extends": f"t{i + 1}"} for i in range(20)}, "t0")):
        with pytest.raises(ValueError):
            exchange.resolve(templates, name)


def test_lossless_round_trip():
    tree = {"name": "section", "nodes": [{"name": "p", "attributes": {"style": "1"}, "nodes": [{"name": "span", "text": "a <b> & 'c'"}, {"name": "endnote", "nodes": [{"name": "p", "nodes": []}]}, {"name": "line", "text": ""}]}]}
    assert lossless.read(lossless.write(tree)) == [tree]
    for bad in ("<p></p>", "<section><tr></tr></section>", "<section>text</section>"):
        with pytest.raises(ValueError):
            lossless.read(bad)


def test_packages_in_lossless_form(spark):
    rows = {r.doc_id: r.text for r in lossless.encode(files(spark, {"a": made(), "bad": b"x"})).collect()}
    assert rows["bad"] == ""
    first, second = lossless.read(rows["a"])
    assert [s["text"] for p in first["nodes"] for s in p["nodes"]] == ["Title", "a\tb\nc d & <e>"]
    table = second["nodes"][0]["nodes"][0]
    assert [[td["attributes"]["colspan"] for td in tr["nodes"]] for tr in table["nodes"]] == [["1", "1"], ["2"]]
    assert [s["text"] for p in table["nodes"][1]["nodes"][0]["nodes"] for s in p["nodes"]] == ["wide", "text"]
