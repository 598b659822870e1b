"""Registered queries for rules, rendering, text, units, styles and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import equation, text, units
from foliograph.operators import lookup, order, patch, render, rules, styles
from foliograph.plans.catalogue import _t, _TRIM, query

# -- rules ------------------------------------------------------------------------------------------------------
_CELL_RULES = """
    SELECT l_orderkey, l_linenumber, 'InvalidSpan' AS rule, 2005 AS code FROM lineitem WHERE l_quantity < 5
    UNION ALL SELECT l_orderkey, l_linenumber, 'EmptyTableCell', 2008 FROM lineitem WHERE l_discount = 0
    UNION ALL SELECT l_orderkey, l_linenumber, 'InvalidShapeSize', 2011 FROM lineitem WHERE l_tax = 0
"""


def _cell_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"InvalidSpan": F.col("l_quantity") < 5, "EmptyTableCell": F.col("l_discount") == 0, "InvalidShapeSize": F.col("l_tax") == 0}
    return rules.issues(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], tests)


@query(_CELL_RULES)
def ref_validate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a cell breaks."""
    return _cell_issues(spark, sf_dir)


@query(f"""
    WITH i AS ({_CELL_RULES}), f AS (SELECT l_orderkey, arg_min(rule, l_linenumber * 10000 + code) AS rule, arg_min(code, l_linenumber * 10000 + code) AS code, count(*) AS issues FROM i GROUP BY l_orderkey)
    SELECT o_orderkey AS l_orderkey, rule, code, issues, code IS NULL AS valid, 'E' || code AS error FROM orders LEFT JOIN f ON o_orderkey = l_orderkey
""")
def ref_validate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity and first issue of every document."""
    first = rules.first_issue(_cell_issues(spark, sf_dir), "l_orderkey", ["l_linenumber", "code"])
    return rules.verdicts(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), first, "l_orderkey")


@query("""
    SELECT 'duplicate id' AS issue, CAST(o_custkey AS VARCHAR) AS id FROM orders GROUP BY o_custkey HAVING count(*) > 1
    UNION SELECT 'dangling owner', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION SELECT 'dangling anchor', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION SELECT 'dangling edge', CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
""")
def ref_integrity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate ids and dangling references, each once."""
    t = lambda n: _t(spark, sf_dir, n)
    return rules.integrity(
        rules.duplicates(t("orders"), "o_custkey", "duplicate id"),
        rules.dangling(t("customer"), "c_custkey", t("orders"), "o_custkey", "dangling owner"),
        rules.dangling(t("documents"), "doc_id", t("labels"), "doc_id", "dangling anchor"),
        rules.dangling(t("lineitem"), "l_suppkey", t("supplier").filter("s_acctbal > 0"), "s_suppkey", "dangling edge"),
    )


_SIDE = "SELECT CAST(count(*) AS VARCHAR) AS documents, CAST(count(DISTINCT source) AS VARCHAR) AS sources, CAST(count(DISTINCT lang) AS VARCHAR) AS langs, CAST(max(n_chars) AS VARCHAR) AS longest FROM documents"


@query(f"""
    WITH a AS (UNPIVOT ({_SIDE}) ON documents, sources, langs, longest INTO NAME metric VALUE source),
    b AS (UNPIVOT ({_SIDE} WHERE n_chars > 800) ON documents, sources, langs, longest INTO NAME metric VALUE output)
    SELECT metric, source, output, CASE WHEN source IS NOT DISTINCT FROM output THEN 'MATCH' ELSE 'DIFF' END AS status FROM a FULL JOIN b USING (metric)
""")
def ref_audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of source and output side by side."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    side = lambda d: d.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.max("n_chars").alias("longest"))
    return rules.audit(side(docs), side(docs.filter("n_chars > 800")), ["documents", "sources", "langs", "longest"])


@query("""
    WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY user_id)
    SELECT user_id, errors, n, array_to_string(list_filter([CASE WHEN errors > 0 THEN 'check errors' END, CASE WHEN n > 5 THEN 'check size' END], lambda x: x IS NOT NULL), '; ') AS checklist FROM s
""")
def ref_audit_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the checks that apply."""
    summary = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("n"))
    return rules.checklist(summary, {"check errors": F.col("errors") > 0, "check size": F.col("n") > 5})


# -- rendering --------------------------------------------------------------------------------------------------
_CELLS = "SELECT n_regionkey AS t, n_nationkey AS r, c, v FROM (SELECT n_regionkey, n_nationkey, unnest([0, 1, 2]) AS c, unnest([n_name, 'a|b', CAST(n_nationkey AS VARCHAR)]) AS v FROM nation) WHERE c < 1 + n_nationkey % 3"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array("n_name", F.lit("a|b"), F.col("n_nationkey").cast("string"))
    cells = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("t"), F.col("n_nationkey").alias("r"), F.posexplode(values).alias("c", "v"))
    return cells.filter(F.col("c") < 1 + F.col("r") % 3)


_ROWS = f"SELECT t, r, list(replace(replace(replace(v, chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), chr(10), '<br>') ORDER BY c) AS texts FROM ({_CELLS}) GROUP BY t, r"


@query(f"""
    WITH rows AS ({_ROWS}), n AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r) AS k FROM rows),
    l AS (SELECT t, r, '| ' || array_to_string(texts, ' | ') || ' |' || CASE WHEN k = 1 THEN chr(10) || '|' || repeat(' --- |', len(texts)) ELSE '' END AS line FROM n)
    SELECT t, string_agg(line, chr(10) ORDER BY r) AS markdown FROM l GROUP BY t
""")
def ref_gfm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables with rows as they are."""
    return render.pipe_table(render.rows_of(_cells(spark, sf_dir), ["t"], "r", "c", text.cell("v")), ["t"], "r")


@query(f"""
    WITH rows AS ({_ROWS}), n AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r) AS k, first_value(len(texts)) OVER (PARTITION BY t ORDER BY r) AS w FROM rows),
    l AS (SELECT t, r, '| ' || array_to_string(list_concat(texts, ['', '', ''])[1:w], ' | ') || ' |' || CASE WHEN k = 1 THEN chr(10) || '|' || repeat(' --- |', w) ELSE '' END AS line FROM n)
    SELECT t, string_agg(line, chr(10) ORDER BY r) AS markdown FROM l GROUP BY t
""")
def ref_gfm_table_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables with rows cut or filled to the header's width."""
    return render.pipe_table(render.rows_of(_cells(spark, sf_dir), ["t"], "r", "c", text.cell("v")), ["t"], "r", padded=True)


@query(f"""
    WITH h AS (SELECT t, r, string_agg('<td' || CASE WHEN c + 1 > 1 THEN ' colspan="' || (c + 1) || '"' ELSE '' END || '>' || v || '</td>', '' ORDER BY c) AS tds FROM ({_CELLS}) GROUP BY t, r)
    SELECT t, '<table>' || string_agg('<tr>' || tds || '</tr>', '' ORDER BY r) || '</table>' AS html FROM h GROUP BY t
""")
def ref_html_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML tables with spans."""
    return render.html_table(_cells(spark, sf_dir), ["t"], "r", "c", text.html("v"), F.col("c") + 1, F.lit(1))


@query("""
    WITH s AS (SELECT conv_id, turn // 3 AS section, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations WHERE text <> '' GROUP BY ALL)
    SELECT conv_id, string_agg(body, chr(10) || chr(10) || '<!-- foliograph:section -->' || chr(10) || chr(10) ORDER BY section) AS markdown FROM s GROUP BY conv_id
""")
def ref_markdown_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents from blocks and sections."""
    turns = _t(spark, sf_dir, "conversations").withColumn("section", F.expr("turn div 3"))
    return render.document(turns, "conv_id", "section", "turn", "text")


@query(f"""
    WITH rows AS ({_ROWS}), m AS (SELECT *, max(len(texts)) OVER (PARTITION BY t) AS columns FROM rows)
    SELECT t, r, array_to_string(list_concat(texts, ['', '', ''])[1:columns], ';') AS texts, CAST(columns AS INTEGER) AS columns, CAST(floor(42520 / columns) AS INTEGER) AS column_width FROM m
""")
def ref_table_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows filled to the table's widest row, with the width of a column."""
    padded = render.pad_rows(render.rows_of(_cells(spark, sf_dir), ["t"], "r", "c", text.cell("v")), ["t"], 42520)
    return padded.select("t", "r", F.array_join("texts", ";").alias("texts"), "columns", "column_width")


# -- text -------------------------------------------------------------------------------------------------------
_B = "chr(92)"
_HTML = "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_XML = "replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"SELECT doc_id, replace(replace(replace(text, {_B}, {_B} || {_B}), '|', {_B} || '|'), chr(10), '<br>') AS escaped, replace(replace(text, '|', {_B} || '|'), chr(10), '<br>') AS styled FROM documents")
def ref_escape_gfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as table cells."""
    return _t(spark, sf_dir, "documents").select("doc_id", text.cell("text").alias("escaped"), text.styled_cell("text").alias("styled"))


@query(r"""SELECT page_id, replace(replace(regexp_replace(html, '([\\*_`\[\]~#])', '\\\1', 'g'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages""")
def ref_escape_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup as Markdown text."""
    return _t(spark, sf_dir, "pages").select("page_id", text.markdown("html").alias("escaped"))


@query(f"SELECT page_id, {_HTML.format(c='html')} AS escaped FROM pages")
def ref_escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup as HTML text."""
    return _t(spark, sf_dir, "pages").select("page_id", text.html("html").alias("escaped"))


@query(f"SELECT page_id, {_XML.format(c='html')} AS escaped FROM pages")
def ref_escape_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup as XML text."""
    return _t(spark, sf_dir, "pages").select("page_id", text.xml("html").alias("escaped"))


@query(f"""
    SELECT doc_id, replace(replace(replace({_XML.format(c="text")}, chr(10), '<hp:lineBreak/>'), chr(9), '<hp:tab/>'), chr(160), '<hp:nbSpace/>') AS inline_xml,
           contains(text, chr(10)) OR contains(text, chr(9)) OR contains(text, chr(160)) AS needs_markup FROM documents
""")
def ref_escape_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as runs with break elements."""
    return _t(spark, sf_dir, "documents").select("doc_id", text.inline_xml("text").alias("inline_xml"), text.needs_inline_markup("text").alias("needs_markup"))


@query(f"""
    SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN regexp_matches(c, '\\p{{Cc}}') THEN {_B} || 'u' || printf('%04x', unicode(c)) ELSE c END), '') AS shown FROM documents
""")
def ref_visible_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters made visible."""
    return _t(spark, sf_dir, "documents").select("doc_id", text.visible_controls("text").alias("shown"))


@query(f"SELECT doc_id, {_TRIM('text')} AS trimmed, CASE WHEN octet_length(encode(text)) <= 50 THEN text ELSE left(text, 50) || '...' END AS short FROM documents")
def ref_trim_and_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unicode trim and display form."""
    return _t(spark, sf_dir, "documents").select("doc_id", text.trim("text").alias("trimmed"), text.shorten("text").alias("short"))


@query("""
    SELECT page_id, split_part(list_last(string_split(url, '/')), '.', 1) AS alt, 'images/' || replace(replace(list_last(string_split(url, '/')), '(', '%28'), ')', '%29') AS path,
           CASE lower(list_last(string_split(url, '.'))) WHEN 'png' THEN 'Png' WHEN 'jpg' THEN 'Jpeg' WHEN 'jpeg' THEN 'Jpeg' WHEN 'gif' THEN 'Gif' WHEN 'bmp' THEN 'Bmp' WHEN 'wmf' THEN 'Wmf' WHEN 'emf' THEN 'Emf'
           ELSE 'Unknown(' || CASE WHEN contains(url, '.') THEN lower(list_last(string_split(url, '.'))) ELSE '' END || ')' END AS format
    FROM pages
""")
def ref_image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternative text, relative path and format of image names."""
    return _t(spark, sf_dir, "pages").select("page_id", text.alt_text("url").alias("alt"), text.image_path("url").alias("path"), text.image_format("url").alias("format"))


@query("""
    SELECT page_id, url = '' OR regexp_matches(url, '^(?i:https?://|mailto:)') AS safe, regexp_matches(lower(url), '^(javascript|data|vbscript|file):') AS dangerous,
           '[' || replace(html, ']', chr(92) || ']') || '](' || replace(replace(url, '(', '%28'), ')', '%29') || ')' AS link
    FROM pages
""")
def ref_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which targets are safe, and links."""
    return _t(spark, sf_dir, "pages").select("page_id", text.safe_url("url").alias("safe"), text.dangerous_url("url").alias("dangerous"), text.hyperlink(F.col("html"), "url").alias("link"))


@query(r"""
    SELECT conv_id, turn, repeat('  ', CAST(turn % 3 AS INTEGER)) || CASE WHEN role = 'system' THEN '1. ' WHEN role = 'user' THEN CASE WHEN turn % 2 = 0 THEN '- [x] ' ELSE '- [ ] ' END ELSE '- ' END || text AS item,
           array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN x ELSE repeat('  ', CAST(turn % 3 + 1 AS INTEGER)) || x END), chr(10)) AS rest,
           regexp_matches(text, '^([-*+] |[0-9]+\.)') AS has_marker, '> ' || replace(text, chr(10), chr(10) || '> ') AS quoted
    FROM conversations
""")
def ref_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items, what continues them, and quotes."""
    level = (F.col("turn") % 3).cast("int")
    kind = F.when(F.col("role") == "system", "NUMBER").otherwise("BULLET")
    checked = F.when(F.col("role") == "user", F.col("turn") % 2 == 0)
    return _t(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.list_item("text", kind, level, checked).alias("item"), text.list_continuation("text", level).alias("rest"), text.has_list_marker("text").alias("has_marker"), text.quote("text").alias("quoted")
    )


@query(f"""
    SELECT event_id, CASE event_type WHEN 'click' THEN '(footnote: ' || props || ')' WHEN 'view' THEN '(endnote: ' || props || ')' WHEN 'purchase' THEN props || '(' || user_id || ')'
           WHEN 'error' THEN '`[' || user_id || ']`' ELSE props END AS rendered,
           CASE WHEN props = '' THEN '' ELSE '<!-- memo(' || event_type || '): ' || replace(props, '--', {_B} || '-' || {_B} || '-') || ' -->' END AS memo
    FROM events
""")
def ref_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What controls leave in Markdown."""
    kinds = F.create_map(*map(F.lit, ("click", "Footnote", "view", "Endnote", "purchase", "Dutmal", "error", "Unknown", "signup", "TextBox")))[F.col("event_type")]
    return _t(spark, sf_dir, "events").select("event_id", text.control(kinds, F.col("props"), F.col("user_id").cast("string")).alias("rendered"), text.memo("event_type", "props").alias("memo"))


@query(f"""
    SELECT p_partkey, repeat('#', greatest(1, least(6, p_size // 5))) || ' ' || {_TRIM("p_name")} AS heading,
           CASE WHEN p_size % 2 = 0 THEN '~~' ELSE '' END || '**' || p_name || '**' || CASE WHEN p_size % 2 = 0 THEN '~~' ELSE '' END AS marked,
           '<strong>' || CASE WHEN p_size % 2 = 0 THEN '<em>' || p_name || '</em>' ELSE p_name END || '</strong>' AS tagged
    FROM part
""")
def ref_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and inline formats."""
    even = F.col("p_size") % 2 == 0
    return _t(spark, sf_dir, "part").select(
        "p_partkey", text.heading("p_name", F.expr("CAST(p_size div 5 AS INT)")).alias("heading"),
        text.emphasise("p_name", F.lit(True), F.lit(False), even).alias("marked"), text.tagged("p_name", {"strong": F.lit(True), "em": even}).alias("tagged"),
    )


@query("""
    SELECT DISTINCT event_type, printf('0x%08X', ascii(event_type) * 16777216 + 26995) AS hex,
           chr(ascii(event_type)) || '.' || 'is' AS code FROM events
""")
def ref_control_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printable names of control codes."""
    code = F.ascii("event_type").cast("long") * 16777216 + 26995
    return _t(spark, sf_dir, "events").select("event_type").distinct().select("event_type", F.format_string("0x%08X", code).alias("hex"), text.control_code(code).alias("code"))


# -- units ------------------------------------------------------------------------------------------------------
@query("""
    SELECT p_partkey, CAST(round(p_retailprice * 100.0) AS INTEGER) AS from_pt, CAST(round(p_size * 7200.0 / 25.4) AS INTEGER) AS from_mm, CAST(p_size * 7200 AS INTEGER) AS from_in,
           p_size / 100.0 AS to_pt, CAST(least(2000000000 + p_partkey * 100000, 2147483647) AS INTEGER) AS saturated, CAST(p_partkey // (p_size - 10) AS INTEGER) AS quotient
    FROM part WHERE p_size <> 10 UNION ALL
    SELECT p_partkey, CAST(round(p_retailprice * 100.0) AS INTEGER), CAST(round(p_size * 7200.0 / 25.4) AS INTEGER), CAST(p_size * 7200 AS INTEGER), p_size / 100.0,
           CAST(least(2000000000 + p_partkey * 100000, 2147483647) AS INTEGER), 0 FROM part WHERE p_size = 10
""")
def ref_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths from and to points, millimetres and inches, with saturating arithmetic."""
    size = F.col("p_size").cast("double")
    return _t(spark, sf_dir, "part").select(
        "p_partkey", units.from_points(F.col("p_retailprice")).alias("from_pt"), units.from_mm(size).alias("from_mm"), units.from_inches(size).alias("from_in"),
        units.to_points(F.col("p_size")).alias("to_pt"), units.add(F.lit(2_000_000_000), F.col("p_partkey") * 100_000).alias("saturated"), units.divide(F.col("p_partkey"), F.col("p_size") - 10).alias("quotient"),
    )


@query("""
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size * 100 WHEN 1 THEN CAST(round(p_size * 7200.0 / 25.4) AS INTEGER) WHEN 2 THEN p_size * 7200 ELSE p_size END AS length,
           CASE WHEN p_size % 4 = 3 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS percent FROM part
""")
def ref_dimension_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and percentages from text."""
    unit = F.element_at(F.array(F.lit("PT"), F.lit("mm"), F.lit("In"), F.lit("")), (F.col("p_size") % 4 + 1).cast("int"))
    sign = F.when(F.col("p_size") % 4 == 3, "").otherwise("%")
    return _t(spark, sf_dir, "part").select("p_partkey", units.dimension(F.concat(F.col("p_size").cast("string"), unit)).alias("length"), units.percentage(F.concat(F.col("p_size").cast("string"), sign)).alias("percent"))


@query("""
    SELECT p_partkey, CAST((p_size * 5 % 256) * 65536 + (p_partkey % 256) * 256 + p_size AS INTEGER) AS packed,
           '#' || printf('%02X%02X%02X', p_size, CAST(p_partkey % 256 AS INTEGER), p_size * 5 % 256) AS shown FROM part
""")
def ref_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours packed and shown."""
    shown = F.format_string("#%02x%02x%02x", F.col("p_size"), (F.col("p_partkey") % 256).cast("int"), F.col("p_size") * 5 % 256)
    return _t(spark, sf_dir, "part").select("p_partkey", units.colour(shown).alias("packed"), units.show_colour(units.colour(shown)).alias("shown"))


@query("SELECT o_orderkey, DATE '1970-01-01' + CAST(o_orderkey % 30000 AS INTEGER) AS stamped FROM orders")
def ref_days_to_ymd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Civil dates from day counts."""
    return _t(spark, sf_dir, "orders").select("o_orderkey", units.civil_date((F.col("o_orderkey") % 30000).cast("int")).alias("stamped"))


# -- styles -----------------------------------------------------------------------------------------------------
@query("""
    WITH RECURSIVE t AS (
        SELECT p_partkey AS node, CASE WHEN p_partkey > 10 THEN p_partkey // 10 END AS parent, CASE WHEN p_size % 3 = 0 THEN p_brand END AS brand, CASE WHEN p_size % 2 = 0 THEN p_size END AS size FROM part
        UNION ALL SELECT -1 - s_suppkey, -2 - s_suppkey, s_name, NULL FROM supplier),
    up AS (SELECT node, node AS ancestor, 0 AS distance FROM t UNION ALL SELECT u.node, t.parent, u.distance + 1 FROM up u JOIN t ON t.node = u.ancestor WHERE t.parent IS NOT NULL AND u.distance < 11),
    r AS (
        SELECT u.node AS p_partkey, max(distance) AS depth, max(CASE WHEN distance > 10 THEN 'too deep' WHEN t.node IS NULL THEN 'not found' END) AS error,
               arg_min(brand, distance) FILTER (WHERE brand IS NOT NULL) AS brand, arg_min(size, distance) FILTER (WHERE size IS NOT NULL) AS size
        FROM up u LEFT JOIN t ON t.node = u.ancestor GROUP BY u.node)
    SELECT p_partkey, depth, error, CASE WHEN error IS NULL THEN brand END AS brand, CASE WHEN error IS NULL THEN size END AS size FROM r
""")
def ref_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field from the nearest template that sets it; chains that are too deep or lead nowhere are errors."""
    templates = _t(spark, sf_dir, "part").select(
        "p_partkey", F.expr("IF(p_partkey > 10, p_partkey div 10, NULL)").alias("parent"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"),
    )
    chain = _t(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("p_partkey"), (-2 - F.col("s_suppkey")).alias("parent"), F.col("s_name").alias("brand"), F.lit(None).cast("int").alias("size"))
    return styles.inherit(spark, templates.unionByName(chain), "p_partkey", "parent", ["brand", "size"])


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_size END, CASE WHEN p_partkey % 2 = 0 THEN 12 END, 10) AS size, coalesce(CASE WHEN p_size < 5 THEN p_brand END, 'body') AS font FROM part")
def ref_style_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child, parent and default values field by field."""
    child = {"size": F.when(F.col("p_size") > 25, F.col("p_size")), "font": F.when(F.col("p_size") < 5, F.col("p_brand"))}
    parent = {"size": F.when(F.col("p_partkey") % 2 == 0, 12)}
    return _t(spark, sf_dir, "part").select("p_partkey", *styles.merge(child, parent, {"size": 10, "font": "body"}))


@query("SELECT p_partkey, p_brand, CASE WHEN p_brand = (SELECT arg_min(p_brand, p_partkey) FROM part) THEN '맑은 고딕' ELSE p_brand END AS new_face FROM part")
def ref_restyle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first font replaced everywhere."""
    return styles.restyle(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", "modern")


@query("SELECT p_partkey, CASE WHEN p_size % 8 >= 5 THEN 'h5' WHEN p_size % 8 >= 3 THEN 'h3' WHEN p_size % 8 >= 1 THEN 'h1' ELSE 'body' END AS style FROM part")
def ref_heading_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style of a heading level with its fallbacks."""
    return _t(spark, sf_dir, "part").select("p_partkey", styles.map_heading(F.col("p_size") % 8, {1: "h1", 3: "h3", 5: "h5"}, "body", "h1").alias("style"))


@query("""
    SELECT doc_id, doc_id % 3 <> 0 AS has_frontmatter, CASE WHEN doc_id % 3 <> 0 THEN 'Doc ' || doc_id END AS title, CASE WHEN doc_id % 3 <> 0 THEN source END AS author,
           CASE WHEN doc_id % 3 = 1 THEN '2024-01-02' END AS created, md5(text) AS body FROM documents
""")
def ref_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter and body of Markdown texts."""
    date = F.when(F.col("doc_id") % 3 == 1, "date: 2024-01-02\n").otherwise("")
    head = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit('---\ntitle: "Doc '), F.col("doc_id").cast("string"), F.lit('"\nauthor: '), F.col("source"), F.lit("\n"), date, F.lit("---\n"))).otherwise("")
    made = _t(spark, sf_dir, "documents").withColumn("md", F.concat(head, F.col("text")))
    return made.select("doc_id", *styles.frontmatter(F.col("md"))).withColumn("body", F.md5("body"))


@query(r"SELECT p_partkey, regexp_matches(replace(p_brand, '#', '_'), '^[A-Za-z_][A-Za-z0-9_]*$') AS valid, regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_]*$') AS name_valid FROM part")
def ref_style_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid style names."""
    return _t(spark, sf_dir, "part").select("p_partkey", styles.valid_name(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))).alias("valid"), styles.valid_name(F.col("p_name")).alias("name_valid"))


# -- patches ----------------------------------------------------------------------------------------------------
@query("""
    SELECT conv_id, 'paragraphs[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '].runs[0].text' AS path, sha256(text) AS hash, text FROM conversations
""")
def ref_text_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text slots with path and hash."""
    return patch.slots(_t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")


@query("""
    WITH b AS (SELECT conv_id, turn, text, sha256(text) AS h FROM conversations), n AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || chr(10) WHEN turn % 3 = 1 THEN upper(text) ELSE text END AS text FROM conversations WHERE length(text) > 100)
    SELECT b.conv_id, b.turn, CASE WHEN n.turn IS NULL THEN 'slot count differs' WHEN b.text <> n.text AND (contains(n.text, chr(10)) OR contains(n.text, chr(9)) OR contains(n.text, chr(160))) THEN 'inline markup needed' END AS refused,
           coalesce(b.text <> n.text, false) AS changed FROM b LEFT JOIN n ON b.conv_id = n.conv_id AND b.turn = n.turn
""")
def ref_patch_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the way of a text patch."""
    base = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    changed = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\n"))).when(F.col("turn") % 3 == 1, F.upper("text")).otherwise(F.col("text"))
    new = base.filter("length(text) > 100").select("conv_id", "turn", changed.alias("text"))
    return patch.guarded(base, new, ["conv_id", "turn"], "text").select("conv_id", "turn", "refused", "changed")


@query()
def ref_equation_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equation scripts to LaTeX; the grammar nests, so SQL cannot state it."""
    script = F.concat(F.lit("{a_"), F.col("p_size").cast("string"), F.lit("+1} over sqrt {x^2} + sum from {i=1} to n alpha"))
    return _t(spark, sf_dir, "part").select("p_partkey", equation.latex(script).alias("latex"))


@query()
def ref_grid_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid columns of spanned cells; each place depends on all before it."""
    cells = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.expr("CAST((l_linenumber - 1) div 3 AS INT)").alias("row"), F.col("l_linenumber").cast("int").alias("ordinal"),
        (F.col("l_partkey") % 2 + 1).cast("int").alias("col_span"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("row_span"),
    )
    return render.grid_places(cells, "l_orderkey")
