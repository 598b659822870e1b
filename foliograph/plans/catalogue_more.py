"""Registered queries for shapes, stores, guards and summaries, and extensions that are plain Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.functions import text, units
from foliograph.operators import inspect, lookup, order, shapes, styles
from foliograph.plans.catalogue import _ROW, _TRIM, _t, query
from foliograph.schema import LANGUAGES, LIMITS, TAG_NAMES


@query("""
    WITH r AS (SELECT page_id, CASE WHEN length(html) > 3000 THEN url ELSE regexp_replace(regexp_replace(url, '^BinData/', ''), '\\.[^.]*$', '') END AS reference FROM pages),
    e AS (SELECT url AS name, min(page_id) AS k FROM pages WHERE length(html) > 2000 GROUP BY url),
    s AS (SELECT regexp_replace(regexp_replace(url, '^BinData/', ''), '\\.[^.]*$', '') AS stem, min(page_id) AS k FROM pages WHERE length(html) > 2000 GROUP BY 1)
    SELECT r.page_id, coalesce(e.k, s.k) AS image_key FROM r LEFT JOIN e ON reference = e.name LEFT JOIN s ON reference = s.stem
""")
def ref_image_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by full name, else by stem; the first wins."""
    pages = _t(spark, sf_dir, "pages")
    stem = F.regexp_replace(F.regexp_replace("url", "^BinData/", ""), r"\.[^.]*$", "")
    references = pages.select("page_id", F.when(F.length("html") > 3000, F.col("url")).otherwise(stem).alias("reference"))
    store = pages.filter("length(html) > 2000").select(F.col("page_id").alias("k"), "url")
    return lookup.resolve_image(references, store, "k", "url").select("page_id", "image_key")


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS shape, len(string_split(text, chr(10))) AS n FROM documents),
    s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY shape ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
    SELECT doc_id, CAST(start AS BIGINT) AS start, shape, line || CASE WHEN shape < n - 1 THEN chr(10) ELSE '' END AS piece FROM s WHERE shape < n - 1 OR line <> ''
""")
def ref_split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts split at the starts of their style runs, one for each line."""
    texts = _t(spark, sf_dir, "documents").select("doc_id", "text").filter("text IS NOT NULL")
    lines = inspect.lines(texts).withColumn("size", F.length("text") + 1)
    runs = order.offsets(lines, ["doc_id"], ["ordinal"], "size").select("doc_id", F.col("offset").alias("start"), F.col("ordinal").cast("long").alias("shape"))
    return order.split_runs(texts, runs, ["doc_id"], "text", "start", "shape")


@query("SELECT l_orderkey, l_linenumber, bool_and(l_returnflag = 'R') AS is_header, bool_or(l_returnflag = 'R') AND NOT bool_and(l_returnflag = 'R') AS mixed FROM lineitem GROUP BY 1, 2")
def ref_row_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows and mixed rows."""
    return shapes.row_headers(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_returnflag") == "R")


@query("SELECT l_orderkey, greatest(4, max(l_linenumber + 1 + l_suppkey % 2)) AS rows FROM lineitem GROUP BY 1")
def ref_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a table declares or its cells reach."""
    return shapes.extents(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_suppkey") % 2 + 1, F.lit(4))


@query("SELECT user_id % 50 AS para, bool_and(regexp_matches(lower(event_type), 'click|view|signup')) AS is_code FROM events GROUP BY 1")
def ref_code_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs whose text runs all have a code font."""
    runs = _t(spark, sf_dir, "events").withColumn("para", F.col("user_id") % 50)
    return shapes.all_code(runs, ["para"], "event_type", ["click", "view", "signup"])


@query("SELECT p_partkey, p_size, p_size < 3 OR p_size IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS known FROM part")
def ref_known_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab references that are built in or defined."""
    defined = _t(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("p_size"))
    return lookup.with_known(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), defined, "p_size").select("p_partkey", "p_size", "known")


_NAMES = ", ".join(f"({k}, '{v}')" for k, v in TAG_NAMES.items())


@query(f"""
    WITH r AS (SELECT CAST(event_id % 130 AS INTEGER) AS tag FROM events), n(tag, name) AS (VALUES {_NAMES})
    SELECT r.tag, coalesce(n.name, printf('Unknown(0x%04X)', r.tag)) AS name, r.tag BETWEEN 16 AND 63 AS in_info, r.tag BETWEEN 66 AND 115 AS in_body, count(*) AS n
    FROM r LEFT JOIN n ON r.tag = n.tag GROUP BY r.tag, n.name
""")
def ref_tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record tags with names and ranges."""
    counted = _t(spark, sf_dir, "events").groupBy((F.col("event_id") % 130).cast("int").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("tag", *inspect.tag_ranges(F.col("tag")), "n")


@query(f"""
    SELECT doc_id, octet_length(encode(text)) AS size, octet_length(encode(text)) <= {LIMITS["inline"]} AS accepted,
           octet_length(encode(text)) // greatest(n_chars // 150, 1) <= 100 AS ratio_ok FROM documents
""")
def ref_size_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes against the limits of the readers."""
    size = F.octet_length("text").cast("long")
    return _t(spark, sf_dir, "documents").select("doc_id", size.alias("size"), (size <= LIMITS["inline"]).alias("accepted"), units.ratio_ok(size, F.expr("n_chars div 150")).alias("ratio_ok"))


@query("""
    WITH p AS (SELECT l_orderkey, count(*) AS points, min(l_partkey) AS l, min(l_suppkey) AS t, max(l_partkey) AS r, max(l_suppkey) AS b FROM lineitem GROUP BY 1)
    SELECT l_orderkey, points, l AS "left", t AS top, greatest(r - l, 1) AS width, greatest(b - t, 1) AS height, points < 3 AS too_few FROM p
""")
def ref_shape_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes of point lists."""
    return shapes.box(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey", "l_suppkey")


@query("SELECT p_partkey, CASE WHEN p_size - 10 = 0 THEN 0 ELSE CAST(trunc(p_partkey * 7 / (p_size - 10)) AS BIGINT) END AS scaled FROM part")
def ref_scaled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates scaled between boxes."""
    return _t(spark, sf_dir, "part").select("p_partkey", shapes.scale(F.col("p_partkey"), F.lit(7), F.col("p_size") - 10).alias("scaled"))


_LANGS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(LANGUAGES))


@query(f"""
    WITH f AS (SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS idx FROM part GROUP BY p_brand), l("rank", language) AS (VALUES {_LANGS})
    SELECT CAST(idx AS INTEGER) AS idx, p_brand, CAST("rank" AS INTEGER) AS "rank", language FROM f, l
""")
def ref_font_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every font in every language."""
    return styles.font_store(_t(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query("""
    WITH s AS (SELECT 'Style_' || p_partkey || CASE WHEN p_partkey % 11 = 0 THEN ' x' ELSE '' END AS name, CASE WHEN p_size % 7 <> 0 THEN p_brand END AS font, CASE WHEN p_size % 5 <> 0 THEN p_size END AS size, p_size AS tab FROM part)
    SELECT name, 'invalid name' AS issue FROM s WHERE NOT regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') UNION ALL SELECT name, 'font required' FROM s WHERE font IS NULL
    UNION ALL SELECT name, 'size required' FROM s WHERE size IS NULL UNION ALL SELECT name, 'tab id reserved' FROM s WHERE tab < 3
""")
def ref_registry_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each style of a registry."""
    name = F.concat(F.lit("Style_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 11 == 0, " x").otherwise(""))
    rows = _t(spark, sf_dir, "part").select(
        name.alias("name"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("font"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("size"), F.col("p_size").alias("tab")
    )
    return styles.registry_issues(rows, "name", "font", "size", "tab")


@query("""
    WITH o AS (SELECT conv_id, turn, turn % 3 AS n, coalesce(sum(turn % 3) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
    p AS (SELECT DISTINCT conv_id, turn AS part FROM conversations)
    SELECT p.conv_id, p.part, o.turn FROM p LEFT JOIN o ON p.conv_id = o.conv_id AND p.part >= o.first AND p.part < o.first + o.n
""")
def ref_masterpage_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts dealt to sections by running counts."""
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    parts = turns.select("conv_id", F.col("turn").alias("part"))
    return order.assign_by_count(parts, turns.withColumn("n", F.col("turn") % 3), ["conv_id"], "part", "turn", "n").select("conv_id", "part", "turn")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Table' WHEN 2 THEN 'Cell' ELSE 'Unknown(3)' END AS page_break, CASE WHEN user_id - 5 > 0 THEN CAST(user_id - 5 AS INTEGER) END AS positive FROM events")
def ref_wire_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by name, unknown ones kept; positive numbers."""
    return _t(spark, sf_dir, "events").select("event_id", shapes.named(F.col("event_id") % 4, shapes.PAGE_BREAKS).alias("page_break"), shapes.positive(F.col("user_id") - 5).alias("positive"))


@query("SELECT l_orderkey, l_partkey, p_brand AS shape, p_brand IS NULL AS out_of_range FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <> 4) ON l_partkey = p_partkey")
def ref_rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local shape ids rebound to a store's, with what is out of range."""
    store = _t(spark, sf_dir, "part").filter("p_size <> 4").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("shape"))
    bound = lookup.style_lookup(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), store, ["l_partkey"], ["shape"])
    return bound.select("l_orderkey", "l_partkey", "shape", F.col("shape").isNull().alias("out_of_range"))


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS number FROM events WHERE event_type IN ('click', 'view')")
def ref_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnotes and endnotes numbered apart within a document."""
    notes = _t(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    return order.numbering(notes, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_id", "event_type", F.col("number").cast("long").alias("number"))


@query("""
    WITH t AS (SELECT conv_id, count(*) AS paragraphs, count(DISTINCT role) AS sections, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1),
    l AS (SELECT conv_id, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS md_lines FROM conversations GROUP BY 1)
    SELECT t.*, l.md_lines FROM t JOIN l USING (conv_id)
""")
def ref_integrity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, paragraphs, characters and Markdown lines of each document."""
    return inspect.content_summary(_t(spark, sf_dir, "conversations"), "conv_id", "role", "text")


@query("""
    WITH e AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS element FROM pages)
    SELECT page_id, string_agg(DISTINCT element, ',' ORDER BY element) AS elements FROM e GROUP BY 1
""")
def ref_path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of a page in sorted order."""
    found = inspect.path_inventory(_t(spark, sf_dir, "pages"), "page_id", "html")
    return found.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("element")), ",").alias("elements"))


@query("SELECT * FROM (VALUES ('default', '함초롬돋움', 59528, 84188), ('modern', '맑은 고딕', 59528, 84188), ('classic', '바탕', 59528, 84188), ('latest', '함초롬바탕', 59528, 84188)) p(name, font, width, height)")
def ref_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named presets."""
    return styles.presets(spark)


@query("""
    WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '개요 ' || p_size WHEN 1 THEN '제목' WHEN 2 THEN '글머리표' WHEN 3 THEN '번호 매기기' ELSE '본문' END AS name, p_size FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN greatest(1, least(6, p_size)) WHEN 1 THEN 1 END AS level, CASE p_partkey % 5 WHEN 2 THEN '- ' WHEN 3 THEN '1. ' END AS prefix FROM s
""")
def ref_style_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and lists by style name."""
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(F.lit("개요 "), F.col("p_size").cast("string"))).when(k == 1, "제목").when(k == 2, "글머리표").when(k == 3, "번호 매기기").otherwise("본문")
    return _t(spark, sf_dir, "part").select("p_partkey", text.heading_level(name).alias("level"), text.list_prefix(name).alias("prefix"))


@query(f"SELECT p_partkey, 59528 - p_size * 100 - 8504 AS width, CASE WHEN p_size > 25 THEN p_size * 3 ELSE CASE WHEN p_size - 25 > 0 THEN 0 ELSE p_size + 2000 * 2 END END AS indent, {_TRIM('p_name')} <> '' AS shown FROM part")
def ref_page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printable widths and list indents."""
    base = F.when(F.col("p_size") > 25, units.indent(F.col("p_size"), F.lit(2))).otherwise(units.add(F.col("p_size"), units.subtract(units.indent(F.lit(0), F.lit(2)), F.lit(0))))
    return _t(spark, sf_dir, "part").select("p_partkey", units.printable(F.lit(59528), F.col("p_size") * 100, F.lit(8504)).alias("width"), base.alias("indent"), (~text.is_blank("p_name")).alias("shown"))


# -- extensions: plain Spark, without a counterpart in the document model -----------------------------------------
@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: cube."""
    cube = _t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return cube.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 1000)")
def ext_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: semi-join."""
    large = _t(spark, sf_dir, "orders").filter("o_totalprice > 1000").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(large, "c_custkey", "left_semi")


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3")
def ext_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the three dearest parts of each brand; Spark limits each group before the shuffle."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return _t(spark, sf_dir, "part").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT s_suppkey FROM supplier")
def ext_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: intersect and except."""
    k = lambda t, c: _t(spark, sf_dir, t).select(F.col(c).alias("k"))
    rich = _t(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return k("orders", "o_custkey").intersect(rich).subtract(k("supplier", "s_suppkey"))


@query("""
    WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY user_id, k
""")
def ext_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions by gaps of half an hour."""
    own = _t(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended")).drop("w")


@query("""
    SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_size >= n_nationkey * 2 AND p_size < n_nationkey * 2 + 3
""")
def ext_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: range join by unrolled ranges, an equi-join."""
    ranges = _t(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.col("n_nationkey") * 2, F.col("n_nationkey") * 2 + 2)).alias("p_size"))
    return _t(spark, sf_dir, "part").select("p_partkey", "p_size").join(ranges, "p_size").select("p_partkey", "n_nationkey")
