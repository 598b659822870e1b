"""Registered queries over document graphs, shapes, formats and styles."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import content, text
from foliograph.operators import deep, inspect, order, rules, shapes, styled, styles
from foliograph.plans.catalogue import _t, query
from foliograph.plans.catalogue_files import _EVENTS, _LEGACY, _chats, _controls, _frames, _read, _streams
from foliograph.sources import compound, packages

# -- graphs -----------------------------------------------------------------------------------------------------
_GRAPH = """
    c AS (SELECT c_nationkey AS doc_id, c_custkey AS id, c_name AS name, c_mktsegment AS seg, c_acctbal AS bal FROM customer),
    s AS (SELECT doc_id, length(seg) AS section_id FROM c),
    p AS (SELECT doc_id, id // 2 AS paragraph_id, CASE WHEN seg = 'BUILDING' THEN id END AS owner, [id, id + 1] AS held, CASE WHEN bal < 0 THEN [id] ELSE [id, id + 1] END AS inlined,
                 name AS text, CASE WHEN seg = 'MACHINERY' THEN 'x' || name ELSE name END AS shown FROM c),
    n AS (SELECT doc_id, id AS node_id, CASE WHEN seg <> 'HOUSEHOLD' THEN id // 2 ELSE id + 100000 END AS anchor FROM c WHERE bal > 0 UNION ALL SELECT doc_id, id, NULL FROM c WHERE bal > 9000),
    e AS (SELECT doc_id, id AS a, id + 1 AS b FROM c),
    u AS (SELECT doc_id, id // 3 AS item_id, CASE WHEN bal < -500 THEN id END AS section_id FROM c WHERE bal < 1000)
"""


@query(f"""
    WITH {_GRAPH}
    SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_id, issue, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (
        SELECT doc_id, 'DuplicateSectionId' AS issue, section_id AS a, NULL AS b FROM s GROUP BY doc_id, section_id HAVING count(*) > 1
        UNION ALL SELECT doc_id, 'DuplicateParagraphId', paragraph_id, NULL FROM p GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT doc_id, 'DuplicateControlId', node_id, NULL FROM n GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT doc_id, 'DuplicateUnresolvedId', item_id, NULL FROM u GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT doc_id, 'ParagraphTextSummaryMismatch', paragraph_id, NULL FROM p WHERE text <> shown
        UNION ALL SELECT doc_id, 'ParagraphControlInventoryMismatch', paragraph_id, NULL FROM p WHERE held <> inlined
        UNION ALL SELECT doc_id, 'DanglingParagraphControlRef', paragraph_id, h FROM (SELECT doc_id, paragraph_id, unnest(held) AS h FROM p) x WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = x.doc_id AND node_id = h)
        UNION ALL SELECT doc_id, 'DanglingParagraphOwnerControlRef', paragraph_id, owner FROM p WHERE owner IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = p.doc_id AND node_id = owner)
        UNION ALL SELECT doc_id, 'DanglingControlAnchorParagraphRef', node_id, anchor FROM n WHERE anchor IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = n.doc_id AND paragraph_id = anchor)
        UNION ALL SELECT doc_id, 'DanglingControlEdgeFrom', a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = e.doc_id AND node_id = a)
        UNION ALL SELECT doc_id, 'DanglingControlEdgeTo', a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = e.doc_id AND node_id = b)
        UNION ALL SELECT doc_id, 'DanglingUnresolvedSectionRef', item_id, section_id FROM u WHERE section_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = u.doc_id AND s.section_id = u.section_id))
""")
def ref_graph_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of integrity issues of document graphs."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("doc_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    held, half = F.array(F.col("id"), F.col("id") + 1), F.expr("id div 2")
    paragraphs = c.select(
        "doc_id", half.alias("paragraph_id"), F.when(F.col("seg") == "BUILDING", F.col("id")).alias("owner"), held.alias("control_ids"), F.when(F.col("bal") < 0, F.array("id")).otherwise(held).alias("inline_control_ids"),
        F.col("name").alias("text"), F.when(F.col("seg") == "MACHINERY", F.concat(F.lit("x"), "name")).otherwise(F.col("name")).alias("inline_text"),
    )
    anchored = c.filter("bal > 0").select("doc_id", F.col("id").alias("node_id"), F.when(F.col("seg") != "HOUSEHOLD", half).otherwise(F.col("id") + 100000).alias("anchor"))
    twice = c.filter("bal > 9000").select("doc_id", F.col("id").alias("node_id"), F.lit(None).cast("long").alias("anchor"))
    frames = {
        "sections": c.select("doc_id", F.length("seg").alias("section_id")),
        "paragraphs": paragraphs,
        "controls": anchored.unionByName(twice),
        "edges": c.select("doc_id", F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id")),
        "unresolved": c.filter("bal < 1000").select("doc_id", F.expr("id div 3").alias("item_id"), F.when(F.col("bal") < -500, F.col("id")).alias("section_id")),
    }
    return rules.graph_issues(frames)


_KIND = "CASE event_type WHEN 'click' THEN 'Table' WHEN 'view' THEN 'Unknown(\\$line)' WHEN 'purchase' THEN 'Unknown(\\$rec)' WHEN 'error' THEN 'Header' ELSE 'Polygon' END".replace("\\", "")


@query(f"""
    WITH e AS (SELECT user_id, event_type, value > 20 AS late, {_KIND} AS kind FROM events)
    SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(late AS INTEGER) AS section, count(*) FILTER (WHERE kind = 'Table') AS tables, CAST(0 AS BIGINT) AS images, count(*) FILTER (WHERE kind LIKE 'Unknown(%line%') AS lines,
           CAST(0 AS BIGINT) AS rectangles, count(*) FILTER (WHERE kind = 'Polygon') AS polygons, bool_or(kind = 'Header') AS has_header, false AS has_footer FROM e GROUP BY ALL
""")
def ref_semantic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls of legacy documents by kind, unknown tags among them."""
    events = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), (F.col("value") > 20).cast("int").alias("section"), F.expr(_KIND).alias("kind"))
    return deep.semantic_counts(events).select("doc_id", "section", "tables", "images", "lines", "rectangles", "polygons", "has_header", "has_footer")


@query("""
    WITH p AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(value > 20 AS INTEGER) AS section, event_type AS container, CASE WHEN value > 30 THEN 'TextBox' END AS owner FROM events),
    c AS (SELECT doc_id, section, container, coalesce(owner, 'Table') AS kind FROM p WHERE container <> 'view'), u AS (SELECT doc_id, section, owner AS container FROM p WHERE container = 'error'),
    r AS (
        SELECT doc_id, section, 'container' AS metric, container AS key, NULL AS other FROM p UNION ALL SELECT doc_id, section, 'container', container, NULL FROM c
        UNION ALL SELECT doc_id, section, 'paragraph_container', container, NULL FROM p UNION ALL SELECT doc_id, section, 'control_container', container, NULL FROM c
        UNION ALL SELECT doc_id, section, 'unresolved_container', container, NULL FROM u UNION ALL SELECT doc_id, section, 'control', kind, NULL FROM c
        UNION ALL SELECT doc_id, section, 'container_owner', container, owner FROM p WHERE owner IS NOT NULL UNION ALL SELECT doc_id, section, 'container_control', container, kind FROM c)
    SELECT doc_id, section, metric, key, other, count(*) AS n FROM r GROUP BY ALL
    UNION ALL SELECT doc_id, NULL, metric, key, other, count(*) FROM r GROUP BY ALL
""")
def ref_parser_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of a parse, by section and by document."""
    paragraphs = _t(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("doc_id"), (F.col("value") > 20).cast("int").alias("section"), F.col("event_type").alias("container"), F.when(F.col("value") > 30, "TextBox").alias("owner_kind")
    )
    controls = paragraphs.filter("container <> 'view'").select("doc_id", "section", "container", F.coalesce("owner_kind", F.lit("Table")).alias("kind"))
    unresolved = paragraphs.filter("container = 'error'").select("doc_id", "section", F.col("owner_kind").alias("container"))
    return inspect.audit_snapshot(paragraphs, controls, unresolved)


@query(f"""
    WITH e AS ({_EVENTS})
    SELECT doc_id, CAST(1 AS BIGINT) AS sections, count(*) AS paragraphs, count(*) FILTER (WHERE kind IN ('TextBox', 'Footnote') AND trim(props) <> '' OR kind = 'Hyperlink') AS non_empty,
           count(*) + count(*) FILTER (WHERE kind IN ('TextBox', 'Footnote')) AS deep_paragraphs, CAST(0 AS BIGINT) AS tables, count(*) FILTER (WHERE kind = 'TextBox') AS text_boxes,
           CAST(0 AS BIGINT) AS headers, CAST(0 AS BIGINT) AS page_numbers FROM e GROUP BY doc_id
""")
def ref_document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each document over its sections."""
    found = deep.totals(deep.summary(_frames(_controls(spark, sf_dir), "sections", "paragraphs", "runs", "controls", "xml_paths")))
    return found.select("doc_id", "sections", "paragraphs", "non_empty", "deep_paragraphs", "tables", "text_boxes", "headers", "page_numbers")


@query("""
    SELECT CAST(conv_id AS VARCHAR) AS doc_id, kind, count(*) AS n FROM conversations, (VALUES ('p'), ('run')) v(kind) GROUP BY ALL
""")
def ref_xml_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of interest in the sections of packages."""
    return _read(_chats(spark, sf_dir), "xml_paths").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY section NULLS FIRST, event_type NULLS FIRST, props NULLS FIRST, ref_id NULLS FIRST, text NULLS FIRST) - 1 AS rank FROM (
        SELECT *, CAST(value > 20 AS INTEGER) AS section, CASE WHEN value > 10 THEN CAST(value AS INTEGER) END AS ref_id, CAST(event_id AS VARCHAR) AS text FROM events)
""")
def ref_path_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a path inventory sorted by five keys, missing ones first."""
    rows = _t(spark, sf_dir, "events").select(
        "event_id", "user_id", (F.col("value") > 20).cast("int").alias("section"), F.col("event_type").alias("path"), F.col("props").alias("kind"), F.when(F.col("value") > 10, F.rint("value").cast("int")).alias("ref_id"),
        F.col("event_id").cast("string").alias("text"),
    )
    return order.path_order(rows, ["user_id"]).select("event_id", F.col("rank").cast("long").alias("rank"))


@query("""
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END, turn) - 1 AS slot FROM conversations
""")
def ref_slot_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots and tables numbered through body, headers and footers."""
    place = F.when(F.col("role") == "user", "body").when(F.col("role") == "assistant", "header").otherwise("footer")
    return order.by_place(_t(spark, sf_dir, "conversations").withColumn("place", place), ["conv_id"], "place", ["turn"], "slot").select("conv_id", "turn", F.col("slot").cast("long").alias("slot"))


@query("""
    WITH s AS (SELECT conv_id, sum(8 + CASE WHEN 2 * length(text) >= 4095 THEN 8 ELSE 4 END + 2 * length(text)) AS size FROM conversations GROUP BY conv_id)
    SELECT CAST(conv_id AS VARCHAR) AS doc_id, path, CAST(CASE path WHEN 'FileHeader' THEN 40 WHEN 'DocInfo' THEN 5 ELSE size END AS BIGINT) AS size, rank FROM s, (VALUES ('BodyText/Section0', 0), ('DocInfo', 1), ('FileHeader', 2)) v(path, rank)
""")
def ref_stream_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of legacy files by name, with their sizes."""

    @F.pandas_udf("binary")
    def made(bodies: pd.Series) -> pd.Series:
        head = _LEGACY.ljust(32, b"\0") + struct.pack("<II", 0x05010100, 0)
        return pd.Series([compound.build({"FileHeader": head, "DocInfo": compound.make_record(17, 0, b"x"), "BodyText/Section0": bytes(b)}) for b in bodies])

    files = _streams(spark, sf_dir).select(F.col("doc_id").alias("path"), made("data").alias("content"))
    return compound.stream_sizes(compound.frame(compound.decode(files), "entries"))


@query(f"""
    WITH e AS ({_EVENTS}), n AS (SELECT doc_id, n, props, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM e WHERE kind = 'Footnote')
    SELECT doc_id, string_agg('[^' || k || ']: ' || trim(props), chr(10) ORDER BY k) AS definitions FROM n GROUP BY doc_id
""")
def ref_note_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of the notes of packages."""
    return styled.note_definitions(*_frames(_controls(spark, sf_dir), "controls", "paragraphs", "runs").values())


@query("SELECT CAST(page_id AS VARCHAR) AS doc_id, 'images/p' || page_id || '.png' AS path, html AS body FROM pages")
def ref_image_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that packages show, under the names that Markdown gives them."""
    pages = _t(spark, sf_dir, "pages")
    doc, name = F.col("page_id").cast("string").alias("doc_id"), F.concat(F.lit("p"), F.col("page_id").cast("string"))
    parts = pages.select(doc, F.concat(F.lit("BinData/"), name, F.lit(".png")).alias("path"), F.col("html").alias("data"))
    parts = parts.unionByName(pages.select(doc, F.lit("BinData/unused.png").alias("path"), F.lit("x").alias("data")))
    blocks = pages.select(doc, F.lit(0).alias("section"), F.lit(0).alias("ordinal"), F.lit("").alias("text"), content.image(name).alias("control"))
    nested = packages.decode(packages.encode(blocks, parts), "doc_id")
    return styled.image_map(packages.frame(nested, "runs"), packages.frame(nested, "images")).select("doc_id", "path", F.decode("data", "UTF-8").alias("body"))


# -- tables and shapes ------------------------------------------------------------------------------------------
@query("""
    SELECT l_orderkey, bool_or(l_linenumber > 4 OR l_tax > 0.06) AS has_merge, l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AS has_nested_table FROM lineitem GROUP BY l_orderkey
""")
def ref_merge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with merged cells, and tables that hold tables."""
    cells = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.greatest(F.col("l_linenumber") - 3, F.lit(1)).alias("col_span"), F.when(F.col("l_tax") > 0.06, 2).otherwise(1).alias("row_span"))
    nested = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return shapes.merge_flags(cells, ["l_orderkey"], nested)


@query("""
    SELECT p_partkey, CASE WHEN p_size - 25 > 0 THEN p_size - 25 WHEN p_partkey - 50 > 0 THEN CAST(p_partkey - 50 AS INTEGER) ELSE p_size - 25 END AS width,
           CASE WHEN p_size > 40 THEN 'Square' WHEN p_size - 25 <> 0 THEN 'InFrontOfText' ELSE 'Inline' END AS wrap, CASE WHEN p_size > 40 OR p_size = 25 THEN 'Para' ELSE 'Paper' END AS relative_to, CAST(p_size - 25 AS INTEGER) AS x FROM part
""")
def ref_image_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents and placements of images."""
    own = F.col("p_size") - 25
    place = shapes.image_placement(F.when(F.col("p_size") > 40, "TextBox").otherwise("Flow"), own, F.lit(0))
    found = _t(spark, sf_dir, "part").select("p_partkey", shapes.image_extent(own, F.col("p_partkey") - 50).alias("width"), place.alias("place"))
    return found.select("p_partkey", "width", "place.wrap", "place.relative_to", "place.x")


@query("""
    WITH g AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS pictures, count(*) FILTER (WHERE l_returnflag = 'R') AS polygons, count(*) FILTER (WHERE l_linenumber > 5) AS lines, count(*) AS corners FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN CAST(pictures > 0 AS INTEGER) + CAST(polygons > 0 AS INTEGER) + CAST(lines > 0 AS INTEGER) <> 1 THEN 'Unknown' WHEN pictures > 0 THEN 'Image' WHEN lines > 0 THEN 'Line' WHEN corners >= 3 THEN 'Polygon' ELSE 'Unknown' END AS kind FROM g
""")
def ref_drawing_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of drawings by their payloads."""
    count = lambda c: F.count_if(c)
    own = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(count(F.col("l_returnflag") == "A").alias("pictures"), count(F.col("l_returnflag") == "R").alias("polygons"), count(F.col("l_linenumber") > 5).alias("lines"), F.count(F.lit(1)).alias("corners"))
    return own.select("l_orderkey", shapes.classify(F.col("pictures"), F.lit(0), F.lit(0), F.col("lines"), F.col("polygons"), F.col("corners")).alias("kind"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(l_partkey, l_suppkey) AS "left", least(l_linenumber, 3) AS top, greatest(abs(l_suppkey - l_partkey), 100) AS width, greatest(abs(3 - l_linenumber), 100) AS height,
           l_partkey - least(l_partkey, l_suppkey) AS start_x, l_suppkey - least(l_partkey, l_suppkey) AS end_x FROM lineitem WHERE l_partkey <> l_suppkey OR l_linenumber <> 3
""")
def ref_line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as boxes with their ends; a line without length is none."""
    made = shapes.line(F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.lit(3))
    found = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", made.alias("s")).filter("s IS NOT NULL")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s.left", "s.top", "s.width", "s.height", "s.start_x", "s.end_x")


@query("SELECT c_custkey, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS is_empty FROM customer")
def ref_empty_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents without any child."""
    children = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return inspect.with_emptiness(_t(spark, sf_dir, "customer").select("c_custkey"), children, ["c_custkey"])


@query("""
    SELECT event_id, CASE event_type WHEN 'click' THEN 'OUTLINE' WHEN 'view' THEN 'NUMBER' WHEN 'purchase' THEN 'BULLET' WHEN 'error' THEN 'BULLET' ELSE 'NONE' END AS heading,
           CASE WHEN event_type IN ('click', 'view', 'purchase', 'error') THEN CAST(user_id % 10 AS INTEGER) END AS level, CASE WHEN event_type = 'error' THEN value > 20 END AS checked FROM events
""")
def ref_list_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List references of paragraphs: heading type, level, check mark."""
    e = F.col("event_type")
    kind = F.when(e == "click", "Outline").when(e == "view", "Number").when(e == "purchase", "Bullet").when(e == "error", "CheckBullet").otherwise("None")
    return _t(spark, sf_dir, "events").select("event_id", *inspect.list_reference(kind, (F.col("user_id") % 10).cast("int"), F.col("value") > 20))


@query("""
    SELECT event_id, 'body/table/tc/subList' || CASE WHEN value > 20 THEN '/' || event_type ELSE '' END AS container,
           array_to_string(list_filter([CASE WHEN user_id > 0 THEN 'table-header-rows: ' || user_id END, CASE WHEN props <> '' THEN 'table-cell-evidence: ' || props END], lambda x: x IS NOT NULL), '; ') AS notes FROM events
""")
def ref_container_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container keys, and notes of what is there."""
    parts = F.concat(F.array(*map(F.lit, ("body", "table", "tc", "subList"))), F.when(F.col("value") > 20, F.array("event_type")).otherwise(F.array().cast("array<string>")))
    notes = text.notes(**{"table-header-rows": F.col("user_id"), "table-cell-evidence": F.col("props")})
    return _t(spark, sf_dir, "events").select("event_id", text.audit_key(parts).alias("container"), F.array_join(notes, "; ").alias("notes"))


# -- formats and styles -----------------------------------------------------------------------------------------
@query("""
    WITH t AS (SELECT p_partkey, p_size, '  ' || p_name || CASE WHEN p_size % 5 = 0 THEN '!' ELSE '' END || ' ' AS raw, p_name || CASE WHEN p_size % 5 = 0 THEN '!' ELSE '' END AS body, p_size > 25 AS b, p_size % 2 = 0 AS i, p_size % 3 = 0 AS s, p_size > 45 AS u, p_size % 5 = 0 AS punct FROM part),
    h AS (SELECT *, CASE WHEN b THEN '<strong>' || body || '</strong>' ELSE body END AS h1 FROM t),
    m AS (SELECT *, CASE WHEN i THEN '<em>' || h1 || '</em>' ELSE h1 END AS h2, CASE WHEN b AND i THEN '***' WHEN b THEN '**' WHEN i THEN '*' ELSE '' END AS mark FROM h),
    n AS (SELECT *, CASE WHEN s THEN '<del>' || h2 || '</del>' ELSE h2 END AS h3 FROM m)
    SELECT p_partkey, CASE WHEN NOT (b OR i OR s OR u) THEN raw WHEN u THEN '  <u>' || h3 || '</u> ' WHEN punct THEN '  ' || h3 || ' '
           ELSE '  ' || CASE WHEN s THEN '~~' ELSE '' END || mark || body || mark || CASE WHEN s THEN '~~' ELSE '' END || ' ' END AS shown FROM n
""")
def ref_inline_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their formats as marks or tags."""
    size = F.col("p_size")
    raw = F.concat(F.lit("  "), "p_name", F.when(size % 5 == 0, "!").otherwise(""), F.lit(" "))
    return _t(spark, sf_dir, "part").select("p_partkey", text.inline_format(raw, size > 25, size % 2 == 0, size % 3 == 0, size > 45, F.lit(False), F.lit(False)).alias("shown"))


@query("""
    SELECT p_partkey, '---' || chr(10) || 'title: ' || p_name || chr(10) || CASE WHEN p_size > 10 THEN 'author: ''' || p_partkey || '''' || chr(10) ELSE '' END || 'date: ''2024-01-02: x''' || chr(10) ||
           'metadata:' || chr(10) || CASE WHEN p_size > 20 THEN '  keywords:' || chr(10) || '  - ' || p_type || chr(10) || '  - ''#x''' || chr(10) ELSE '' END || '  subject: ' || p_type || chr(10) || '---' || chr(10) AS block FROM part
""")
def ref_frontmatter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter of document metadata."""
    size, none = F.col("p_size"), F.lit(None).cast("string")
    words = F.when(size > 20, F.array(F.col("p_type"), F.lit("#x"))).otherwise(F.array().cast("array<string>"))
    author = F.when(size > 10, F.col("p_partkey").cast("string"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.render_frontmatter(F.col("p_name"), author, F.lit("2024-01-02: x"), F.col("p_type"), words, none).alias("block"))


@query("SELECT p_partkey, p_type, CASE WHEN p_type = 'ECONOMY' THEN '맑은 고딕' ELSE p_type END AS new_face FROM part")
def ref_base_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preset's font for the base font alone."""
    return styles.with_base_font(_t(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "ECONOMY", "modern")


@query("""
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.border, b.border, 'NONE') AS border, coalesce(a.fill, b.fill, 'none') AS fill
    FROM (SELECT p_partkey AS k, CASE WHEN p_size > 20 THEN p_brand END AS border, p_type AS fill FROM part WHERE p_retailprice > 1000) a
    FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size > 10 THEN p_name END AS border, CASE WHEN p_size > 30 THEN p_name END AS fill FROM part WHERE p_size < 40) b ON a.k = b.k
""")
def ref_border_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Border and fill of a style from itself, its parent, or the default."""
    part, size = _t(spark, sf_dir, "part"), F.col("p_size")
    child = part.filter("p_retailprice > 1000").select(F.col("p_partkey").alias("k"), F.when(size > 20, F.col("p_brand")).alias("border"), F.col("p_type").alias("fill"))
    parent = part.filter("p_size < 40").select(F.col("p_partkey").alias("k"), F.when(size > 10, F.col("p_name")).alias("border"), F.when(size > 30, F.col("p_name")).alias("fill"))
    return styles.merge_borders(child, parent, "k", {"border": "NONE", "fill": "none"})


@query("SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS images FROM part WHERE p_size <= 30 GROUP BY p_brand")
def ref_border_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that each document's border fills ask for."""
    rows = _t(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_size") <= 30, F.col("p_size")).alias("image"))
    return styles.border_images(rows, ["p_brand"], "image").select("p_brand", F.array_join(F.col("images").cast("array<string>"), ",").alias("images"))


def _literal(rows: list[tuple]) -> str:  # type: ignore[type-arg]
    shown = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


#: Names of built-in styles that the modern and the latest set end with, and their ids.
_KNOWN = [("바탕글", "Normal", 0), ("본문", "Body", 1), ("개요 1", "Outline 1", 2), ("개요 10", "Outline 10", 11), ("쪽 번호", "Page Number", 12), ("머리말", "Header", 13), ("차례 3", "TOC 3", 20), ("캡션", "Caption", 21)]


@query(f"SELECT name, english, CAST(id AS INTEGER) AS id FROM (VALUES {_literal(_KNOWN)}) v(name, english, id)")
def ref_builtin_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of built-in styles by their Korean and their English names."""
    names = spark.createDataFrame([(k, e) for k, e, _ in _KNOWN], "name string, english string")
    found = names.select("name", "english", styles.style_id(F.col("name")).alias("id"), styles.style_id(F.col("english")).alias("by_english"))
    there = styles.builtin_styles(spark).select("name", F.col("id").alias("at"))
    return found.join(there, "name").filter("id = by_english AND id = at").select("name", "english", "id")


#: Formats and texts of the ten outline levels.
_OUTLINE = [(1, "DIGIT", "^1."), (2, "HANGUL_SYLLABLE", "^2."), (3, "DIGIT", "^3)"), (4, "HANGUL_SYLLABLE", "^4)"), (5, "DIGIT", "(^5)"), (6, "HANGUL_SYLLABLE", "(^6)"), (7, "CIRCLED_DIGIT", "^7"), (8, "CIRCLED_HANGUL_SYLLABLE", "^8"), (9, "DIGIT", "^9"), (10, "DIGIT", "^10")]


@query(f"SELECT CAST(level AS INTEGER) AS level, format, text FROM (VALUES {_literal(_OUTLINE)}) v(level, format, text)")
def ref_outline_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline numbering of new documents."""
    return styles.outline_numbering(spark)


@query("""
    WITH c AS (SELECT p_partkey AS k, CASE WHEN p_size > 5 THEN p_brand END AS font, CASE WHEN p_size > 20 THEN p_size END AS size, CASE WHEN p_size > 30 THEN true END AS bold, CASE WHEN p_size > 40 THEN 90 END AS ratio FROM part WHERE p_retailprice > 950),
    p AS (SELECT p_partkey AS k, CASE WHEN p_size > 3 THEN p_type END AS font, p_size + 1 AS size, CASE WHEN p_size < 30 THEN 'Bottom' END AS underline_type, CASE WHEN p_size < 10 THEN 80 END AS ratio, CASE WHEN p_size > 45 THEN 7 END AS color FROM part WHERE p_size < 48)
    SELECT coalesce(c.k, p.k) AS k, coalesce(c.font, p.font) AS font, coalesce(c.size, p.size) AS size, coalesce(c.bold, false) AS bold, coalesce(p.underline_type, 'None') AS underline_type, coalesce(c.ratio, p.ratio, 100) AS ratio, coalesce(p.color, 0) AS color,
           'Normal' AS vertical_position, CASE WHEN coalesce(c.font, p.font) IS NULL THEN 'font' WHEN coalesce(c.size, p.size) IS NULL THEN 'size' END AS missing FROM c FULL JOIN p ON c.k = p.k
""")
def ref_resolved_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character shapes of styles and their parents with all defaults, and the field that is missing."""
    part, size = _t(spark, sf_dir, "part"), F.col("p_size")
    child = part.filter("p_retailprice > 950").select(
        F.col("p_partkey").alias("k"), F.when(size > 5, F.col("p_brand")).alias("font"), F.when(size > 20, size).alias("size"), F.when(size > 30, F.lit(True)).alias("bold"), F.when(size > 40, 90).alias("ratio")
    )
    parent = part.filter("p_size < 48").select(
        F.col("p_partkey").alias("k"), F.when(size > 3, F.col("p_type")).alias("font"), (size + 1).alias("size"), F.when(size < 30, "Bottom").alias("underline_type"), F.when(size < 10, 80).alias("ratio"), F.when(size > 45, 7).alias("color")
    )
    found = styles.resolve_styles(child, parent, "k", styles.CHAR_DEFAULTS, ["font", "size"])
    return found.select("k", "font", "size", "bold", "underline_type", "ratio", "color", "vertical_position", "missing")


@query("""
    WITH r AS (SELECT p_brand AS t, CASE WHEN p_size > 45 THEN p_name ELSE 's' || p_partkey END AS name, CASE WHEN p_size > 4 THEN p_type END AS font, CASE WHEN p_size < 47 THEN p_size END AS size, p_size AS tab FROM part WHERE p_brand <> 'Brand#2'),
    d AS (SELECT p_brand AS t, CAST(p_partkey // 3 % 40 AS INTEGER) AS id FROM part), l AS (SELECT p_brand AS t, p_type AS kind, p_size % 9 AS id FROM part), m AS (SELECT DISTINCT p_brand AS t, 'body' AS field, 's' || p_size AS style FROM part)
    SELECT t AS template, issue, subject FROM (
        SELECT DISTINCT p_brand AS t, 'EmptyStyleMap' AS issue, NULL AS subject FROM part WHERE p_brand = 'Brand#2'
        UNION ALL SELECT t, 'InvalidStyleName', name FROM r WHERE NOT regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*')
        UNION ALL SELECT t, 'FontRequired', name FROM r WHERE font IS NULL UNION ALL SELECT t, 'SizeRequired', name FROM r WHERE size IS NULL
        UNION ALL SELECT t, 'UnknownTabReference', name FROM r WHERE tab >= 3 AND NOT EXISTS (SELECT 1 FROM d WHERE d.t = r.t AND d.id = r.tab)
        UNION ALL SELECT t, 'ReservedTabDefinition', CAST(id AS VARCHAR) FROM d WHERE id < 3
        UNION ALL SELECT t, 'DuplicateTabDefinition', CAST(id AS VARCHAR) FROM d WHERE id >= 3 GROUP BY t, id HAVING count(*) > 1
        UNION ALL SELECT t, 'DuplicateListDefinition', kind || ' ' || id FROM l GROUP BY t, kind, id HAVING count(*) > 1
        UNION ALL SELECT t, 'InvalidMappingReference', field || ' ' || style FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.t = m.t AND r.name = m.style))
""")
def ref_registry_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that keeps templates from becoming a registry."""
    part, size = _t(spark, sf_dir, "part").withColumn("template", F.col("p_brand")), F.col("p_size")
    name = F.when(size > 45, F.col("p_name")).otherwise(F.concat(F.lit("s"), F.col("p_partkey").cast("string")))
    rows = part.filter("p_brand <> 'Brand#2'").select("template", name.alias("name"), F.when(size > 4, F.col("p_type")).alias("font"), F.when(size < 47, size).alias("size"), size.alias("tab"))
    tabs = part.select("template", F.expr("CAST(p_partkey div 3 % 40 AS INT)").alias("id"))
    lists = part.select("template", F.col("p_type").alias("kind"), (size % 9).alias("id"))
    mappings = part.select("template", F.lit("body").alias("field"), F.concat(F.lit("s"), size.cast("string")).alias("style")).distinct()
    return styles.registry_problems(part.select("template").distinct(), rows, tabs, lists, mappings)
