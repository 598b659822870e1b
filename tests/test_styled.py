import io
import zipfile

from foliograph.operators import styled
from foliograph.sources import packages

HEADER = """<head><refList><fontfaces><fontface lang="HANGUL"><font id="0" face="바탕"/><font id="1" face="D2Coding"/></fontface></fontfaces>
<charProperties><charPr id="0" height="1000"><fontRef hangul="0"/></charPr><charPr id="1" height="1000"><fontRef hangul="0"/><bold/></charPr><charPr id="2" height="900"><fontRef hangul="1"/></charPr></charProperties>
<paraProperties><paraPr id="0"/><paraPr id="1"><heading type="OUTLINE" level="1"/></paraPr><paraPr id="2"><heading type="BULLET" level="1"/></paraPr></paraProperties>
<styles><style id="0" name="본문" paraPrIDRef="0" charPrIDRef="0"/><style id="1" name="개요 3" paraPrIDRef="0" charPrIDRef="0"/></styles></refList></head>"""


def p(*runs, para=0, style=0, inner=""):
    return f'<p paraPrIDRef="{para}" styleIDRef="{style}">' + "".join(f'<run charPrIDRef="{c}"><t>{t}</t></run>' for c, t in runs) + inner + "</p>"


TABLE = '<run charPrIDRef="0"><tbl rowCnt="2"><tr><tc><subList>' + p((0, "h")) + "</subList></tc><tc><subList>" + p((0, "i|j")) + "</subList></tc></tr><tr><tc><subList>" + p((0, "1")) + "</subList></tc></tr></tbl></run>"


def test_styled_markdown(spark):
    section = "<sec>" + p((0, "Head"), para=1) + p((0, "By name"), style=1) + p((0, "a "), (1, "bo"), (1, "ld "), (0, "*")) + p((0, "item"), para=2)
    section += p((2, "x = 1")) + p((2, "y = 2")) + p((0, "after"), inner=TABLE) + "</sec>"
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as out:
        out.writestr("mimetype", "application/hwp+zip")
        out.writestr("Contents/header.xml", HEADER)
        out.writestr("Contents/section0.xml", section)
        out.writestr("Contents/section1.xml", "<sec>" + p((0, "second")) + "</sec>")
    files = spark.createDataFrame([("d", bytearray(box.getvalue()))], "path string, content binary")
    nested = packages.decode(files).cache()
    assert packages.frame(nested, "warnings").count() == 0
    frames = {n: packages.frame(nested, n) for n in packages.PARTS}
    expected = "## Head\n\n### By name\n\na **bold** \\*\n\n  - item\n\n```\nx = 1\ny = 2\n```\n\nafter\n\n| h | i\\|j |\n| --- | --- |\n| 1 |  |\n\n<!-- foliograph:section -->\n\nsecond"
    assert styled.markdown(frames).head().markdown == expected
