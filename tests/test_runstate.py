from pyspark.sql import functions as F

from domloom.operators import runstate as rt
from domloom.operators.schema import Section


def test_next_run_id(spark):
    def next_id(*names):
        return rt.next_run_id(spark.createDataFrame([(n,) for n in names], "run_dir string")).first()[0]

    assert next_id("flow1", "flow7", "flowX", "flow_9", "run99", "flow10b") == 8
    assert next_id("flow 3", "flow+4") == 5 and next_id("x") == 1 and next_id("flow1_000") == 1001 and next_id("flow-5") == -4


def test_latest_state_keeps_earlier_values_over_nulls(spark):
    rows = [(1, "schema", "s1"), (2, "schema", "s2"), (3, "schema", None), (1, "code", "c1"), (2, "notes", None)]
    got = rt.latest_state(spark.createDataFrame(rows, "run_id int, field string, value string")).collect()
    assert {(r.field, r.value, r.run_id) for r in got} == {("schema", "s2", 2), ("code", "c1", 1)}


def test_latest_state_of_repeated_runs(spark):
    """Several values of the last run, runs without a number, keys that are null; nothing is aggregated by sorting."""
    rows = [("u", 1, "f", "z"), ("u", 2, "f", "a"), ("u", 2, "f", "c"), ("u", 2, "f", "b"), (None, 1, "f", "x"), (None, None, "f", "y"),
            ("v", None, "g", "p"), ("v", None, "g", "q"), ("v", 3, None, "n"), ("w", 5, "f", None), ("w", 4, "f", "kept"), ("w", 4, "f", "kept")]
    table = spark.createDataFrame(rows, "user string, run_id int, field string, value string")
    got = rt.latest_state(table, "user")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("u", "f", "c", 2), (None, "f", "x", 1), ("v", "g", "q", None), ("v", None, "n", 3), ("w", "f", "kept", 4)], key=str)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_completed_steps(spark):
    rows = [(1, "text_analysis"), (4, "text_analysis"), (2, "code"), (5, "code_validated"), (3, "unknown")]
    got = rt.completed_steps(spark.createDataFrame(rows, "run_id int, step string")).collect()
    assert {(r.step_number, r.run_id) for r in got} == {(1, 4), (6, 5)}


def test_pending_pages(spark, pages_of):
    pages = pages_of("<p>a", "<p>b", "<p>c", "<p>d", None)
    key = rt.schema_hash([Section("t", "//h1")])
    keys = pages.select("page_id", rt.content_key(F.col("html")).alias("content_key"), F.lit(key).alias("schema_key"))
    done = keys.filter("page_id != 1").withColumn("fallback", F.col("page_id") == 2).withColumn(
        "content_key", F.when(F.col("page_id") == 3, F.lit("old")).otherwise(F.col("content_key"))
    )
    def ids(df):
        return sorted(r.page_id for r in df.collect())
    assert ids(rt.pending_pages(pages, done, key)) == [1, 2, 3]
    assert ids(rt.pending_pages(pages, done, key, broadcast_rows=0)) == [1, 2, 3]
    assert ids(rt.pending_pages(pages, done, "other schema")) == [1, 2, 3, 4, 5]
    assert ids(rt.pending_pages(pages, done, key, resume=False)) == [1, 2, 3, 4, 5]
    assert rt.pending_pages(pages, done, key).columns == ["page_id", "url", "html"]


def test_schema_hash_follows_what_is_extracted():
    base = rt.schema_hash([Section("t", "//h1")])
    assert base == rt.schema_hash([Section("t", "//h1", description="other")])
    assert base != rt.schema_hash([Section("t", "//h2")]) and base != rt.schema_hash([Section("t", "//h1", is_list=True)])


def test_pending_results(spark):
    rows = [(1, "ok", "success"), (2, "x fallback template", "success"), (3, None, "success"), (4, "ok", "failed"), (5, "API generation failed", "success")]
    got = rt.pending_results(spark.createDataFrame(rows, "subject_id int, result string, status string")).collect()
    assert {(r.subject_id, r.reason) for r in got} == {(2, "fallback"), (3, "missing"), (4, "failed"), (5, "fallback")}
