import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliograph.functions import equation, text, units


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).head().r


@pytest.mark.parametrize(
    "script,expected",
    [
        ("{a+b} over {c+d}", r"$\frac{a+b}{c+d}$"),
        ("sqrt {x+1}", r"$\sqrt{x+1}$"),
        ("sum from {i=1} to {n} a_i", r"$\sum_{i=1}^{n}a_{i}$"),
        ("int from {0} to {1} f(x)dx", r"$\int_{0}^{1}f(x)dx$"),
        ("x^2", "$x^{2}$"),
        ("alpha beta", r"$\alpha\beta$"),
        ("OMEGA <= b", r"$\Omega\le b$"),
        ("vec {x}", r"$\vec{x}$"),
        ("bar x", r"$\overline{x}$"),
        ("left ( a right )", r"$\left(a\right)$"),
        ("matrix {a # b ## c # d}", r"$\begin{pmatrix}a & b \\ c & d\end{pmatrix}$"),
        ("cases {x ## y}", r"$\begin{cases}x \\ y\end{cases}$"),
        ("a over b over c", r"$\frac{a}{\frac{b}{c}}$"),
        ("}", "$$"),
        ("", "$$"),
    ],
)
def test_equations(script, expected):
    assert equation.to_latex(script) == expected


@given(st.text(alphabet="ab{}_^# overmatix", max_size=40))
def test_equations_always_end(script):
    out = equation.to_latex(script)
    assert out[0] == out[-1] == "$"


def test_trim_knows_unicode_space(spark):
    assert one(spark, text.trim("v"), "\t 　a b\n ") == "a b"
    assert one(spark, text.trim("v"), "\x1ca") == "\x1ca"


def test_escapes(spark):
    assert one(spark, text.cell("v"), "a\\|b\nc") == "a\\\\\\|b<br>c"
    assert one(spark, text.html("v"), "<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, text.xml("v"), "'\"") == "'&quot;"
    assert one(spark, text.markdown("v"), "*a_b* [c] #<") == "\\*a\\_b\\* \\[c\\] \\#&lt;"
    assert one(spark, text.inline_xml("v"), "a\nb\tc\u00a0d") == "a<hp:lineBreak/>b<hp:tab/>c<hp:nbSpace/>d"
    assert one(spark, text.visible_controls("v"), "a\x01b\n") == "a\\u0001b\\u000a"
    assert one(spark, text.semantic_text("v"), "￼ a​b ") == "ab"


def test_names_and_links(spark):
    assert one(spark, text.heading_level("v"), "개요 9") == 6
    assert one(spark, text.heading_level("v"), "제목") == 1
    assert one(spark, text.heading_level("v"), "본문") is None
    assert one(spark, text.list_prefix("v"), "글머리표") == "- "
    assert one(spark, text.hyperlink(F.lit("a]b"), "v"), "http://x/(y)") == "[a\\]b](http://x/%28y%29)"
    assert one(spark, text.hyperlink(F.lit("a"), "v"), "JavaScript:alert(1)") == "a"
    assert one(spark, text.alt_text("v"), "a/b/photo.v1.png") == "photo"
    assert one(spark, text.image_format("v"), "a/PHOTO.JPeG") == "Jpeg"
    assert one(spark, text.memo(F.lit("me"), "v"), "a--b") == "<!-- memo(me): a\\-\\-b -->"
    assert one(spark, text.emphasise("v", F.lit(True), F.lit(True), F.lit(False)), " a ") == " ***a*** "
    assert one(spark, text.tagged("v", {"strong": F.lit(True), "em": F.lit(True)}), "a") == "<strong><em>a</em></strong>"


def test_units(spark):
    values = {"12pt": 1200, "25.4MM": 7200, "1in": 7200, "77": 77, "x": None, "1000001pt": None, "-2pt": -200}
    for source, expected in values.items():
        assert one(spark, units.dimension(F.col("v")), source) == expected, source
    assert one(spark, units.percentage(F.col("v")), "160%") == 160 and one(spark, units.percentage(F.col("v")), "-1%") is None
    assert one(spark, units.colour(F.col("v")), "#0102ff") == 0xFF0201
    assert one(spark, units.show_colour(units.colour(F.col("v"))), "#0102ff") == "#0102FF"
    assert one(spark, units.add(F.lit(2_147_483_647), F.lit(5))) == 2_147_483_647
    assert one(spark, units.divide(F.lit(7), F.lit(0))) == 0 and one(spark, units.divide(F.lit(-7), F.lit(2))) == -3
    assert one(spark, units.from_points(F.lit(0.005))) == 1 and one(spark, units.from_points(F.lit(-0.005))) == -1
    assert one(spark, units.from_points(F.lit(float("nan")))) is None
