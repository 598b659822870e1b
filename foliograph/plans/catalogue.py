"""Registered queries over the driver's tables, each with its SQL where SQL can state it.

The tables stand in for document frames: documents' lines are paragraphs,
conversations are documents of sections, order lines are table cells, events
are a record stream, pages are markup, parts and customers are names, styles
and owners.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators import inspect, lookup, order

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A total order of the lines of an order; line numbers repeat.
_ROW = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
#: White space of RE2, and what Unicode counts besides.
_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TRIM = lambda c: f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- inspection -------------------------------------------------------------------------------------------------
_LINES = "SELECT doc_id, lang, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ordinal FROM documents"
_SEEN = _TRIM("translate(line, chr(65532) || chr(8203) || chr(65279), '')")


@query(f"""
    WITH l AS ({_LINES}), s AS (SELECT doc_id, ordinal, line, {_SEEN} AS seen FROM l)
    SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (WHERE seen <> '') AS non_empty,
           CAST(sum(length(line)) AS BIGINT) AS chars, arg_min(seen, ordinal) FILTER (WHERE seen <> '') AS first_text
    FROM s GROUP BY doc_id
""")
def ref_inspect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, visible paragraphs, characters and first visible text of each document."""
    return inspect.summarise(inspect.lines(_t(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


@query(f"""
    WITH l AS ({_LINES}), s AS (SELECT lang, doc_id, line, {_SEEN} AS seen FROM l),
    d AS (SELECT lang, doc_id, count(*) AS paragraphs, count(*) FILTER (WHERE seen <> '') AS non_empty, sum(length(line)) AS chars FROM s GROUP BY ALL)
    SELECT lang, CAST(sum(paragraphs) AS BIGINT) AS paragraphs, CAST(sum(non_empty) AS BIGINT) AS non_empty, CAST(sum(chars) AS BIGINT) AS chars, count(*) AS documents
    FROM d GROUP BY ROLLUP (lang)
""")
def ref_inspect_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by language and over all."""
    paragraphs = inspect.lines(_t(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return inspect.totals(inspect.summarise(paragraphs, "lang", "doc_id"), "lang", ["paragraphs", "non_empty", "chars"])


@query("""
    SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS text, count(*) AS run_count
    FROM conversations GROUP BY conv_id
""")
def ref_text_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text runs of each conversation joined in order; other runs count but give no text."""
    return inspect.text_content(_t(spark, sf_dir, "conversations").withColumnRenamed("role", "kind"), ["conv_id"], ["turn"], "user")


@query("""
    SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS tables, count(*) FILTER (WHERE event_type = 'view') AS images,
           count(*) FILTER (WHERE event_type = 'purchase') AS charts FROM events GROUP BY user_id
""")
def ref_content_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, images and charts by section."""
    kinds = F.create_map(*map(F.lit, ("click", "table", "view", "image", "purchase", "chart")))[F.col("event_type")]
    return inspect.content_counts(_t(spark, sf_dir, "events").withColumn("kind", kinds), "user_id")


@query("""
    SELECT event_type, count(*) AS n, array_to_string(list_sort(list_distinct(list(user_id % 7))), ',') AS levels FROM events GROUP BY event_type
""")
def ref_tag_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by tag, with the distinct levels of each."""
    return inspect.census(_t(spark, sf_dir, "events").withColumn("level", F.col("user_id") % 7), "event_type", "level")


@query("""
    SELECT user_id % 5 AS section, event_type, CAST(grouping(user_id % 5, event_type) AS INTEGER) AS level, count(*) AS n
    FROM events GROUP BY GROUPING SETS ((user_id % 5), (event_type), (user_id % 5, event_type))
""")
def ref_container_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by section, by kind and by both, in one pass."""
    return inspect.snapshot(_t(spark, sf_dir, "events").withColumn("section", F.col("user_id") % 5), "section", "event_type")


@query("""
    SELECT l_orderkey, count(DISTINCT l_linenumber) AS rows, count(*) AS cells, count(*) FILTER (WHERE l_returnflag = 'R') AS flagged,
           max(l_suppkey) FILTER (WHERE l_suppkey > 0) AS tallest,
           coalesce(array_to_string(list_sort(list_distinct(list(l_suppkey) FILTER (WHERE l_suppkey > 0))), ','), '') AS heights,
           coalesce(array_to_string(list_sort(list_distinct(list(l_partkey) FILTER (WHERE l_partkey > 0))), ','), '') AS widths
    FROM lineitem GROUP BY l_orderkey
""")
def ref_table_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row, cell and header counts, tallest cell, and distinct sizes of each table."""
    return inspect.table_properties(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_returnflag") == "R")


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, sum(l_partkey) FILTER (WHERE l_partkey > 0) AS wide, count(*) AS n, max(l_suppkey) FILTER (WHERE l_suppkey > 0) AS high FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, CAST(arg_min_null(wide, l_linenumber) AS BIGINT) AS width, arg_min(n, l_linenumber) AS columns,
           coalesce(string_agg(CAST(high AS VARCHAR), ',' ORDER BY l_linenumber), '') AS row_heights
    FROM r GROUP BY l_orderkey
""")
def ref_table_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and column count of the first row, and row heights in order."""
    return inspect.structure(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT user_id, arg_min(value, event_id) FILTER (WHERE value > 0) AS value, count(*) AS n FROM events GROUP BY user_id")
def ref_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First positive size of each key."""
    return inspect.first_positive(_t(spark, sf_dir, "events"), "user_id", "value", "event_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def ref_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last record of each key."""
    return lookup.last_wins(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], ["event_type", "value"])


@query("""
    SELECT source, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE lang = 'de') AS n_de,
           count(*) FILTER (WHERE lang = 'fr') AS n_fr, count(*) FILTER (WHERE lang = 'es') AS n_es FROM documents GROUP BY source
""")
def ref_font_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language, one column each."""
    return inspect.buckets(_t(spark, sf_dir, "documents").select("source", "lang"), "source", "lang", ["en", "de", "fr", "es"])


@query("SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY source, lang")
def ref_unique_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct faces by language, the first kept."""
    return inspect.unique_first(_t(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id")


@query("""
    WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS charts, count(*) FILTER (WHERE event_type = 'error') AS objects FROM events GROUP BY user_id)
    SELECT *, CASE WHEN charts > 0 AND objects > 0 THEN 'chart_and_object' WHEN charts > 0 THEN 'chart' WHEN objects > 0 THEN 'object_only' ELSE 'none' END AS assessment FROM s
""")
def ref_chart_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the records say about charts, and the verdict."""
    kinds = {"charts": F.col("event_type") == "purchase", "objects": F.col("event_type") == "error"}
    charts, objects = F.col("charts") > 0, F.col("objects") > 0
    return inspect.evidence(_t(spark, sf_dir, "events"), "user_id", kinds, [(charts & objects, "chart_and_object"), (charts, "chart"), (objects, "object_only")], "none")


@query(f"""
    SELECT CASE WHEN n_chars > 5000 THEN 'skipped_too_large' WHEN {_TRIM("coalesce(text, '')")} = '' THEN 'failed' ELSE 'success' END AS status,
           count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1
""")
def ref_migration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by what becomes of them."""
    return inspect.migration_report(_t(spark, sf_dir, "documents"), "n_chars", "text", 5000)


@query("""
    WITH e AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS element FROM pages)
    SELECT page_id, element, count(*) AS n FROM e GROUP BY ALL
""")
def ref_xml_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of each page's markup."""
    return inspect.path_inventory(_t(spark, sf_dir, "pages"), "page_id", "html")


@query("""
    SELECT o_orderkey, n, CASE WHEN v AND n >= 4 THEN 'Vohlc' WHEN v THEN 'Vhlc' WHEN n >= 4 THEN 'Ohlc' ELSE 'Hlc' END AS kind
    FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, bool_or(l_quantity > 45) AS v FROM lineitem GROUP BY 1)
""")
def ref_stock_chart_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock chart variant by series and volume."""
    series = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_quantity") > 45).alias("v"))
    return series.select("o_orderkey", "n", inspect.stock_kind(F.col("n"), F.col("v")).alias("kind"))


@query("""
    SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS categories, count(*) AS points FROM nation GROUP BY n_regionkey
""")
def ref_chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of each series in order."""
    pairs = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(pairs, lambda x: x["n_name"]), "|").alias("categories"), F.count(F.lit(1)).alias("points"))


@query("SELECT vec_id, label, len(embedding) AS n, len(embedding) <> 64 AS mismatch FROM embeddings")
def ref_series_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series whose values do not match the axis in number."""
    n = F.size("embedding").cast("long")
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", n.alias("n"), (n != 64).alias("mismatch"))


# -- lookups ----------------------------------------------------------------------------------------------------
@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def ref_style_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its style's values, or nulls."""
    return lookup.style_lookup(_t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ref_missing_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose style does not exist."""
    return lookup.missing(_t(spark, sf_dir, "documents").select("doc_id", "source"), _t(spark, sf_dir, "labels"), ["doc_id"])


@query("""
    WITH r AS (SELECT p_brand AS id, arg_min(p_name, p_partkey) AS name, arg_min(p_type, p_partkey) AS ext FROM part WHERE p_size > 20 GROUP BY p_brand),
    s AS (SELECT DISTINCT p_name AS name FROM part WHERE p_retailprice < 1500)
    SELECT p_partkey, p_brand AS id, CASE WHEN s.name IS NOT NULL THEN 'High' ELSE 'Medium' END AS confidence, 'BinData/' || s.name AS package_path,
           CASE WHEN r.id IS NULL THEN 'ole bin data record missing'
                ELSE 'storage_name=' || r.name || '; storage_extension=' || r.ext || CASE WHEN s.name IS NULL THEN '; bin_data_stream_missing' ELSE '' END END AS notes
    FROM part p LEFT JOIN r ON p.p_brand = r.id LEFT JOIN s ON r.name = s.name
""")
def ref_asset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded objects with record and stream, how sure the match is, and why not surer."""
    part = _t(spark, sf_dir, "part")
    records = part.filter("p_size > 20").select(F.col("p_brand").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("ext"), F.col("p_partkey").alias("ordinal"))
    streams = part.filter("p_retailprice < 1500").select(F.col("p_name").alias("name"))
    return lookup.asset_join(part.select("p_partkey", F.col("p_brand").alias("id")), records, streams, "id", "name", "ext")


@query("""
    WITH s AS (SELECT DISTINCT p_name FROM part WHERE p_retailprice < 1500),
    r AS (SELECT s_suppkey AS ordinal, s_nationkey AS id, n.p_name AS name, CASE WHEN s_acctbal > 5000 THEN 'PNG' WHEN s_acctbal > 2000 THEN 'jpeg' ELSE 'xls' END AS ext
          FROM supplier JOIN part n ON s_suppkey = n.p_partkey)
    SELECT ordinal, id, name, ext, n_regionkey AS width, ordinal = max(ordinal) OVER (PARTITION BY id) AS wins
    FROM r LEFT JOIN nation ON id = n_nationkey AND n_regionkey > 0 WHERE lower(ext) IN ('png', 'jpeg') AND name IN (SELECT p_name FROM s)
""")
def ref_image_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with their streams and sizes; the last record of an id wins."""
    part = _t(spark, sf_dir, "part")
    ext = F.when(F.col("s_acctbal") > 5000, "PNG").when(F.col("s_acctbal") > 2000, "jpeg").otherwise("xls")
    records = _t(spark, sf_dir, "supplier").join(part, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("ordinal"), F.col("s_nationkey").alias("id"), F.col("p_name").alias("name"), ext.alias("ext"))
    hints = _t(spark, sf_dir, "nation").filter("n_regionkey > 0").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("width"))
    found = lookup.image_assets(records, part.filter("p_retailprice < 1500").select(F.col("p_name").alias("name")), hints, "id", "name", "ext", ["width"])
    return found.select("ordinal", "id", "name", "ext", "width", "wins")


@query("""
    SELECT DISTINCT c_nationkey AS id, s.name, CASE WHEN s.name IS NULL THEN 'missing_image_asset_for_binary_data_id=' || c_nationkey END AS warning
    FROM customer LEFT JOIN (SELECT n_nationkey, n_name AS name FROM nation WHERE n_regionkey <> 2) s ON c_nationkey = n_nationkey
""")
def ref_border_image_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that border fills ask for, with a warning for each that is not there."""
    assets = _t(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return lookup.supplement(_t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id")), assets, "id", "name")


@query("SELECT n_regionkey AS kind, count(*) AS n, count(DISTINCT c_nationkey) AS owners FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def ref_owner_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children by their owner's kind."""
    owners = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("kind"))
    return lookup.owner_counts(_t(spark, sf_dir, "customer"), owners, "c_nationkey", "kind")


@query("""
    SELECT l.l_orderkey, l.l_linenumber, CASE WHEN p.p_partkey IS NULL THEN 'index out of range' WHEN l_quantity > 25 AND NOT p_size > 25 THEN 'checkable definition required'
           WHEN NOT l_quantity > 25 AND p_size > 25 THEN 'plain definition required' END AS issue
    FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size <> 13) p ON l_partkey = p_partkey
""")
def ref_list_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List references against their definitions."""
    defs = _t(spark, sf_dir, "part").filter("p_size <> 13").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") > 25).alias("checkable"))
    found = lookup.resolve_definition(_t(spark, sf_dir, "lineitem"), defs, "l_partkey", "checkable", F.col("l_quantity") > 25)
    return found.select("l_orderkey", "l_linenumber", "issue")


@query("""
    WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT p.event_id, p.user_id, r.value FROM p ASOF LEFT JOIN r ON p.user_id = r.user_id AND p.ts >= r.ts
""")
def ref_style_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style of the last run that starts at or before each position."""
    events = _t(spark, sf_dir, "events")
    runs = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    points = events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return lookup.as_of(points, runs, ["user_id"], "ts", "value").select("event_id", "user_id", "value")


@query("""
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.name ELSE a.name END AS name, CASE WHEN b.k IS NOT NULL THEN b.size ELSE a.size END AS size
    FROM (SELECT p_partkey AS k, p_brand AS name, p_size AS size FROM part WHERE p_size > 12) a
    FULL JOIN (SELECT p_partkey AS k, p_type AS name, CAST(NULL AS INTEGER) AS size FROM part WHERE p_retailprice > 1000) b ON a.k = b.k
""")
def ref_overlay_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child's definitions over the parent's."""
    part = _t(spark, sf_dir, "part")
    parent = part.filter("p_size > 12").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("name"), F.col("p_size").alias("size"))
    child = part.filter("p_retailprice > 1000").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("name"), F.lit(None).cast("int").alias("size"))
    return lookup.overlay(parent, child, "k", ["name", "size"])


@query("""
    SELECT coalesce(a.lang, b.lang) AS lang, a.n AS n_source, b.n AS n_output, a.s AS s_source, b.s AS s_output,
           CASE WHEN a.n IS NOT DISTINCT FROM b.n AND a.s IS NOT DISTINCT FROM b.s THEN 'MATCH' ELSE 'DIFF' END AS status
    FROM (SELECT lang, count(*) AS n, count(DISTINCT source) AS s FROM documents GROUP BY lang) a
    FULL JOIN (SELECT lang, count(*) AS n, count(DISTINCT source) AS s FROM documents WHERE n_chars > 800 GROUP BY lang) b ON a.lang = b.lang
""")
def ref_audit_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of source and output side by side."""
    docs = _t(spark, sf_dir, "documents").select("n_chars", "lang", "source")
    side = lambda d: d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("s"))
    return lookup.compare_sides(side(docs), side(docs.filter("n_chars > 800")), ["lang"], ["n", "s"])


@query("""
    WITH RECURSIVE e AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 10 THEN p_partkey // 10 END AS parent FROM part
                         UNION ALL SELECT -1 - s_suppkey, -2 - s_suppkey FROM supplier),
    up AS (SELECT node, parent AS ancestor, 1 AS distance FROM e WHERE parent IS NOT NULL
           UNION ALL SELECT u.node, e.parent, u.distance + 1 FROM up u JOIN e ON e.node = u.ancestor WHERE e.parent IS NOT NULL AND u.distance < 11)
    SELECT node, ancestor, distance, CASE WHEN distance > 10 THEN 'too deep' WHEN ancestor NOT IN (SELECT node FROM e) THEN 'not found' END AS error FROM up
""")
def ref_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestor chain of every template; chains that are too deep or lead nowhere say so."""
    edges = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.expr("IF(p_partkey > 10, p_partkey div 10, NULL)").alias("parent"))
    chain = _t(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("node"), (-2 - F.col("s_suppkey")).alias("parent"))
    return lookup.ancestors(spark, edges.unionByName(chain))


# -- document order ---------------------------------------------------------------------------------------------
@query("""
    WITH m AS (SELECT *, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM conversations)
    SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY part) - 1 AS section FROM m WHERE role <> 'system'
""")
def ref_section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section of each row, split at markers."""
    turns = _t(spark, sf_dir, "conversations")
    return order.split_sections(turns, ["conv_id"], ["turn"], F.col("role") == "system").select("conv_id", "turn", F.col("section").cast("long").alias("section"))


@query("""
    WITH f AS (SELECT *, role = 'assistant' AS is_code, row_number() OVER w AS rn, lag(role = 'assistant') OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    i AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM is_code THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f),
    g AS (SELECT conv_id, min(turn) AS first, count(*) AS rows, is_code, string_agg(text, chr(10) ORDER BY turn) AS body FROM i GROUP BY conv_id, island, is_code, CASE WHEN NOT is_code THEN rn END)
    SELECT conv_id, first, rows, is_code, CASE WHEN is_code THEN '```' || chr(10) || body || chr(10) || '```' ELSE body END AS block FROM g
""")
def ref_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring code paragraphs as one fence."""
    return order.merge_blocks(_t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "assistant", "text")


@query("""
    WITH f AS (SELECT conv_id, turn, turn % 2 AS lvl, role, CASE WHEN role = 'user' THEN turn % 2 WHEN role <> 'assistant' THEN -1 END AS item FROM conversations)
    SELECT conv_id, turn, coalesce(role = 'assistant' AND last_value(item IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = lvl, false) AS attaches FROM f
""")
def ref_list_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a paragraph continues the list item before it."""
    turns = _t(spark, sf_dir, "conversations").withColumn("lvl", F.col("turn") % 2)
    return order.continue_lists(turns, ["conv_id"], ["turn"], "lvl", F.col("role") == "user", F.col("role") == "assistant").select("conv_id", "turn", "attaches")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) + 4 AS number FROM conversations")
def ref_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List numbers from a start value."""
    return order.numbering(_t(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"], 5).select("conv_id", "turn", "role", F.col("number").cast("long").alias("number"))


@query("""
    SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AND coalesce(max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS misplaced FROM lineitem
""")
def ref_leading_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows that do not lead their table."""
    return order.leading_headers(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], _ROW, F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "misplaced")


@query("SELECT user_id, event_id, CAST(coalesce(sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_before FROM events")
def ref_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes before each entry."""
    sized = _t(spark, sf_dir, "events").withColumn("size", F.length("props"))
    return order.offsets(sized, ["user_id"], ["event_id"], "size").select("user_id", "event_id", F.col("offset").cast("long").alias("offset_before"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS node FROM lineitem")
def ref_preorder_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in document order."""
    return order.preorder_ids(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber"]).select("l_orderkey", "l_linenumber", F.col("node").cast("long").alias("node"))


@query("""
    WITH f AS (SELECT *, row_number() OVER w AS rn, lag(l_linestatus) OVER w AS before FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
    i AS (SELECT *, sum(CASE WHEN rn = 1 OR before IS DISTINCT FROM l_linestatus THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS island FROM f)
    SELECT l_orderkey, CAST(island AS BIGINT) AS island, l_linestatus, count(*) AS runs, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text FROM i GROUP BY ALL
""")
def ref_merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring runs of equal format merged."""
    return order.merge_runs(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], _ROW, ["l_linestatus"], "l_returnflag")


@query("SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS run_end FROM events")
def ref_run_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each style run ends."""
    return order.run_ends(_t(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", F.col("end").alias("run_end"))


@query("SELECT p_brand, min(p_partkey) AS first, count(*) AS uses, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS id FROM part GROUP BY p_brand")
def ref_font_intern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts numbered in first-seen order."""
    return order.intern(_t(spark, sf_dir, "part"), "p_brand", "p_partkey").withColumn("id", F.col("id").cast("long"))
