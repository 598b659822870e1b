"""What large tables need: bounded batches, one decode for a job, no limit of a format or of Spark in the way."""

import pyarrow as pa
import pytest

from foliograph.operators import lookup, styles
from foliograph.plans.registry import QUERIES
from foliograph.sources import columns, packages


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_decoded_rows_are_handed_on_a_bounded_number_at_a_time(monkeypatch):
    monkeypatch.setattr(columns, "ROWS", 10)
    files = pa.RecordBatch.from_pydict({"doc_id": list("abcdefgh"), "content": [packages.build([[{"text": "one"}, {"text": "two"}, {"text": "three"}]])] * 8})
    read = lambda doc, data: ({"doc_id": doc, "runs": packages.parse(data, ["runs"])["runs"]}, 0)
    out = list(columns.nested([files], read, {"runs": packages._arrow("runs")}))
    assert len(out) == 3 and [d for b in out for d in b.column(0).to_pylist()] == list("abcdefgh")
    assert all(len(own) == 3 for b in out for own in b.column(1).to_pylist())


def test_wide_rows_become_python_values_a_few_at_a_time():
    batch = pa.RecordBatch.from_pydict({"doc_id": list("abc"), "own": [[{"x": 1, "y": [None, "b"]}], None, [{"x": 3, "y": None}, None]]})
    assert [r["own"] for _, r in columns.rows([batch, batch.slice(1)], "own", 1)] == [*batch.column(1).to_pylist(), *batch.column(1).to_pylist()[1:]]


@pytest.mark.parametrize("name", ["ref_deep_summary", "ref_document_totals", "ref_note_definitions", "ref_styled_controls"])
def test_packages_are_decoded_once_for_all_frames(spark, sf_dir, name):
    assert "MapIn" not in plan(QUERIES[name](spark, sf_dir))  # rows that were read once are in a folder


def test_content_controls_decode_no_other_frames(spark, sf_dir):
    assert "xml_paths" not in plan(QUERIES["ref_content_controls"](spark, sf_dir))


def test_content_controls_gather_no_blocks(spark, tmp_path):
    spark.sql("SELECT 7L AS p_partkey, p_name, 'b' AS p_brand FROM VALUES ('m'), ('n') AS t(p_name)").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["ref_content_controls"](spark, str(tmp_path))
    assert "Aggregate" not in plan(found) and plan(found).count("Exchange hashpartitioning(p_partkey") == 1
    rows = found.collect()
    assert sorted(r.control for r in rows) == sorted([*range(16)] * 2)  # each row its own package, as in SQL
    assert {r.detail for r in rows if r.kind == "Bookmark"} == {"m", "n"}


@pytest.mark.parametrize(("name", "exchanges"), [("ref_package_tables", 1), ("ref_table_warnings", 2), ("ref_legacy_tables", 1), ("ref_shape_points", 2)])
def test_cells_and_corners_are_dealt_out_no_more_than_needed(spark, sf_dir, name, exchanges):
    text = plan(QUERIES[name](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") == exchanges and "Join" not in text


@pytest.fixture
def few_recursive_rows(spark):
    name = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(name, "50")
    yield
    spark.conf.unset(name)


def test_ancestors_are_not_bound_by_the_rows_of_a_recursive_query(spark, few_recursive_rows):
    edges = spark.createDataFrame([(n, n // 10 if n > 10 else None) for n in range(1, 200)], "node long, parent long")
    found = lookup.ancestors(spark, edges).collect()
    assert len(found) == 189 + 90 and not any(r.error for r in found)


def test_inheritance_is_not_bound_by_the_rows_of_a_recursive_query(spark, few_recursive_rows):
    rows = spark.createDataFrame([(n, n // 10 if n > 10 else None, "x" if n < 10 else None) for n in range(1, 200)], "name long, parent long, a string")
    found = styles.inherit(spark, rows, "name", "parent", ["a"]).collect()
    assert len(found) == 199 and all(r.a == "x" for r in found if r.name not in (10, *range(100, 110)))


def test_inheritance_broadcasts_no_templates(spark, sf_dir, monkeypatch):
    plans = []
    monkeypatch.setattr(lookup, "settled", lambda df, own=lookup.settled: (plans.append(plan(df)), own(df))[1])
    plans.append(plan(QUERIES["ref_inheritance"](spark, sf_dir)))
    assert sum(p.count("SortMergeJoin") for p in plans) >= 12 and not any("Broadcast" in p for p in plans)


def test_charts_of_more_points_than_a_part_may_hold(spark, tmp_path):
    spark.range(10_002).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "'b' AS p_brand", "CAST(id % 50 AS INT) AS p_size", "id / 4 AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["ref_chart_points"](spark, str(tmp_path)).filter("doc_id = 'b' AND chart = 'Chart/chart1.xml'").collect()
    assert sorted((r.series, r.point, r.category, r.y) for r in found) == [(s, n, f"n{n}", n / 4 if s else n % 50) for s in (0, 1) for n in range(10_002)]


def test_more_master_pages_than_a_package_may_hold(spark, tmp_path):
    spark.range(10_002).selectExpr("id AS c_custkey", "concat('n', id) AS c_name", "7 AS c_nationkey", "'BUILDING' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["ref_master_pages"](spark, str(tmp_path)).collect()
    owner = [0, 1, 1, 2, 2, 2, 3, 3, 3, 3]
    assert sorted((r.doc_id, r.master, r.text, r.section if r.section is not None else -1) for r in found) == [("7", n, f"n{n}", owner[n] if n < 10 else -1) for n in range(10_002)]


def test_references_of_paths_are_rounded_to_even(spark, tmp_path):
    spark.sql("SELECT event_id, 1L AS user_id, 'click' AS event_type, '' AS props, value FROM VALUES (2L, 12.5D), (1L, 12.4D), (3L, 11.5D), (4L, 13.5D) AS t(event_id, value)").write.parquet(f"{tmp_path}/events.parquet")
    found = {r.event_id: r["rank"] for r in QUERIES["ref_path_ranks"](spark, str(tmp_path)).collect()}
    assert found == {1: 0, 2: 1, 3: 2, 4: 3}  # references 12, 12, 12 and 14
