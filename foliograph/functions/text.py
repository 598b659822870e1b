"""Text functions of the document model, as Column expressions.

Everything here stays in the JVM and inside generated code: escaping for the
output formats, list markers, link and note rendering, name heuristics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = "\u00a0"
#: Names of the control bytes' and marks that carry no text.
SILENT_MARKS = "\ufffc\u200b\ufeff"
#: Fonts that mark a paragraph as code.
CODE_FONTS = ("consolas", "courier", "d2coding", "fira code", "hack", "inconsolata", "jetbrains mono", "menlo", "monaco", "monospace", "source code pro")
#: Extensions of image streams that are kept.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp", "wmf", "emf")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def trim(c: Column | str) -> Column:
    """Without Unicode white space at either end; SQL's own trim takes spaces only."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    return trim(c) == ""


def cell(c: Column | str) -> Column:
    """A pipe-table cell: backslash, then bar, then line break."""
    return _swap(_col(c), ("\\", "\\\\"), ("|", "\\|"), ("\n", "<br>"))


def styled_cell(c: Column | str) -> Column:
    """A pipe-table cell whose text is escaped already."""
    return _swap(_col(c), ("|", "\\|"), ("\n", "<br>"))


def markdown(c: Column | str) -> Column:
    """Markdown's active characters behind a backslash, angle brackets as entities."""
    return _swap(F.regexp_replace(_col(c), r"([\\*_`\[\]~#])", r"\\$1"), ("<", "&lt;"), (">", "&gt;"))


def html(c: Column | str) -> Column:
    return _swap(_col(c), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def xml(c: Column | str) -> Column:
    """As HTML, but the apostrophe stays."""
    return _swap(_col(c), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def inline_xml(c: Column | str) -> Column:
    """Text of a run with its break, tab and fixed space as elements."""
    return _swap(xml(c), ("\n", "<hp:lineBreak/>"), ("\t", "<hp:tab/>"), (NBSP, "<hp:nbSpace/>"))


def needs_inline_markup(c: Column | str) -> Column:
    return _col(c).rlike(f"[\n\t{NBSP}]")


def visible_controls(c: Column | str) -> Column:
    r"""Control characters as \uXXXX."""
    shown = lambda x: F.when(x.rlike(r"\p{Cc}"), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(x))), 4, "0"))).otherwise(x)
    return F.array_join(F.transform(F.split(_col(c), ""), shown), "")


def semantic_text(c: Column | str) -> Column:
    """Without object, zero-width and order marks, trimmed."""
    return trim(F.translate(_col(c), SILENT_MARKS, ""))


def alt_text(c: Column | str) -> Column:
    """Last path component up to its first dot."""
    return F.split_part(F.element_at(F.split(_col(c), "/"), -1), F.lit("."), F.lit(1))


def image_path(c: Column | str) -> Column:
    """Relative path of an image file, parentheses encoded."""
    name = F.element_at(F.split(_col(c), "/"), -1)
    return F.concat(F.lit("images/"), _swap(name, ("(", "%28"), (")", "%29")))


def image_format(c: Column | str) -> Column:
    """Format by the lower-cased last extension; without a dot the unknown format of no name."""
    ext = F.lower(F.when(F.instr(_col(c), ".") > 0, F.element_at(F.split(_col(c), r"\."), -1)).otherwise(""))
    known = {"png": "Png", "jpg": "Jpeg", "jpeg": "Jpeg", "gif": "Gif", "bmp": "Bmp", "wmf": "Wmf", "emf": "Emf"}
    out = F.concat(F.lit("Unknown("), ext, F.lit(")"))
    for name, kind in known.items():
        out = F.when(ext == name, kind).otherwise(out)
    return out


def list_item(c: Column | str, kind: Column, level: Column, checked: Column) -> Column:
    """Marker by kind, two spaces for each level; numbers are always one."""
    mark = (
        F.when(kind == "NUMBER", "1. ")
        .when(checked.isNotNull(), F.when(checked, "- [x] ").otherwise("- [ ] "))
        .otherwise("- ")
    )
    return F.concat(F.repeat(F.lit("  "), level), mark, _col(c))


def list_continuation(c: Column | str, level: Column) -> Column:
    """Lines after an item, one level deeper; blank lines stay blank."""
    pad = F.repeat(F.lit("  "), level + 1)
    return F.array_join(F.transform(F.split(_col(c), "\n"), lambda x: F.when(x == "", x).otherwise(F.concat(pad, x))), "\n")


def heading_level(name: Column | str) -> Column:
    """Heading level that a style's Korean name stands for, or null."""
    number = F.regexp_extract(_col(name), r"^개요\s*([0-9]+)", 1)
    by_number = F.when(number != "", F.least(F.greatest(number.cast("int"), F.lit(1)), F.lit(6)))
    return F.coalesce(by_number, F.when(_col(name).isin("제목", "큰제목", "타이들"), 1))


def list_prefix(name: Column | str) -> Column:
    """List marker that a style's Korean name stands for, or null."""
    n = _col(name)
    return F.when(n.contains("글머리") | n.contains("개조"), "- ").when(n.contains("번호"), "1. ")


def safe_url(c: Column | str) -> Column:
    """Empty, http, https or mailto."""
    return (_col(c) == "") | _col(c).rlike("(?i)^(https?://|mailto:)")


def dangerous_url(c: Column | str) -> Column:
    return F.lower(_col(c)).rlike("^(javascript|data|vbscript|file):")


def hyperlink(text: Column | str, url: Column | str) -> Column:
    """Markdown link; a dangerous target leaves the text alone."""
    shown, target = _swap(_col(text), ("]", "\\]")), _swap(_col(url), ("(", "%28"), (")", "%29"))
    return F.when(dangerous_url(url), _col(text)).otherwise(F.concat(F.lit("["), shown, F.lit("]("), target, F.lit(")")))


def memo(author: Column | str, body: Column | str) -> Column:
    """A memo as a comment; double hyphens would end it."""
    inner = _swap(_col(body), ("--", "\\-\\-"))
    return F.when(_col(body) == "", "").otherwise(F.concat(F.lit("<!-- memo("), _col(author), F.lit("): "), inner, F.lit(" -->")))


def has_list_marker(c: Column | str) -> Column:
    return _col(c).rlike(r"^([-*+] |[0-9]+\.)")


def shorten(c: Column | str) -> Column:
    """Whole up to 50 bytes, else 50 characters and an ellipsis."""
    return F.when(F.octet_length(_col(c)) <= 50, _col(c)).otherwise(F.concat(F.left(_col(c), F.lit(50)), F.lit("...")))


def heading(c: Column | str, level: Column) -> Column:
    """One heading line, of level 1 to 6; a blank heading is no heading."""
    line = trim(_swap(_col(c), ("\n", " ")))
    marks = F.repeat(F.lit("#"), F.greatest(F.least(level, F.lit(6)), F.lit(1)))
    return F.when(line == "", "").otherwise(F.concat(marks, F.lit(" "), line))


def quote(c: Column | str) -> Column:
    return F.concat(F.lit("> "), _swap(_col(c), ("\n", "\n> ")))


def control(kind: Column, text: Column, extra: Column) -> Column:
    """What a control leaves in plain Markdown."""
    return (
        F.when(kind == "Footnote", F.concat(F.lit("(footnote: "), text, F.lit(")")))
        .when(kind == "Endnote", F.concat(F.lit("(endnote: "), text, F.lit(")")))
        .when(kind == "Dutmal", F.concat(text, F.lit("("), extra, F.lit(")")))
        .when(kind.isin("TextBox", "Compose"), text)
        .when(kind == "Unknown", F.concat(F.lit("`["), extra, F.lit("]`")))
        .otherwise("")
    )


def emphasise(c: Column | str, bold: Column, italic: Column, strike: Column) -> Column:
    """Markers around the text, outside white space left outside; blank text stays as it is."""
    text = _col(c)
    lead, tail = F.regexp_extract(text, r"(?U)^(\s*)", 1), F.regexp_extract(text, r"(?U)(\s*)$", 1)
    mark = F.concat(F.when(strike, "~~").otherwise(""), F.when(bold, "**").otherwise(""), F.when(italic, "*").otherwise(""))
    back = F.concat(F.when(italic, "*").otherwise(""), F.when(bold, "**").otherwise(""), F.when(strike, "~~").otherwise(""))
    return F.when(is_blank(text), text).otherwise(F.concat(lead, mark, trim(text), back, tail))


def tagged(c: Column | str, flags: dict[str, Column]) -> Column:
    """Nested HTML tags, the first flag outermost."""
    out = _col(c)
    for tag, on in reversed(flags.items()):
        out = F.when(on, F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
    return out


def control_code(code: Column) -> Column:
    """Four-letter name of a big-endian control code, unprintable bytes as dots."""
    byte = lambda n: F.shiftrightunsigned(code, n).bitwiseAND(F.lit(255))
    shown = lambda b: F.when(b.between(32, 126), F.char(b)).otherwise(".")
    return F.concat(*[shown(byte(n)) for n in (24, 16, 8, 0)])


def notes(**values: Column) -> Column:
    """``key: value`` strings of the values that are above zero or not empty."""
    parts = [F.when(v.cast("string").isNotNull() & ~v.cast("string").isin("", "0"), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in values.items()]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def inline_format(c: Column | str, bold: Column, italic: Column, strike: Column, underline: Column, superscript: Column, subscript: Column) -> Column:
    """A run with its formats: Markdown marks where they are safe, else HTML tags.

    Tags are for formats without a mark, and for texts that hold marks or begin
    or end with ASCII punctuation. White space stays outside; blank text stays
    as it is.
    """
    text = _col(c)
    lead, tail, body = F.regexp_extract(text, r"(?U)^(\s*)", 1), F.regexp_extract(text, r"(?U)(\s*)$", 1), trim(text)
    basic, only_html = bold | italic | strike, underline | superscript | subscript
    conflict = body.rlike(r"[*_~]|^[!-/:-@\[-`{-~]|[!-/:-@\[-`{-~]$")
    marks = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    struck = F.when(strike, "~~").otherwise("")
    marked = F.concat(struck, marks, markdown(body), marks, struck)
    in_html = tagged(html(body), {"sub": subscript, "sup": superscript, "u": underline, "del": strike, "em": italic, "strong": bold})
    wrapped = F.when(only_html | (basic & conflict), in_html).otherwise(marked)
    plain = ~(basic | only_html)
    return F.when(text == "", "").when(plain, markdown(text)).when(body == "", text).otherwise(F.concat(lead, wrapped, tail))


def audit_key(path: Column) -> Column:
    """A container path as one key."""
    return F.array_join(path, "/")


def render_frontmatter(title: Column, author: Column, created: Column, subject: Column, keywords: Column, modified: Column) -> Column:
    """A front matter block of the fields that are there; strings that YAML would read otherwise are quoted."""
    risky = r"^$|^[-?:,\[\]{}#&*!|>'\"%@` ]|: |:$| #| $|[\n\t]|^(?i:true|false|null|yes|no|on|off|~)$|^[-+.]?[0-9][0-9_.,eE+-]*$"
    safe = lambda v: F.when(v.rlike(risky), F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(v)
    line = lambda k, v, pad="": F.when(v.isNotNull(), F.concat(F.lit(f"{pad}{k}: "), safe(v), F.lit("\n"))).otherwise("")
    listed = F.array_join(F.transform(keywords, lambda k: F.concat(F.lit("  - "), safe(k), F.lit("\n"))), "")
    listed = F.when(F.size(keywords) > 0, F.concat(F.lit("  keywords:\n"), listed)).otherwise("")
    inner = F.concat(listed, line("modified", modified, "  "), line("subject", subject, "  "))
    return F.concat(F.lit("---\n"), line("title", title), line("author", author), line("date", created), F.when(inner != "", F.concat(F.lit("metadata:\n"), inner)).otherwise(""), F.lit("---\n"))
