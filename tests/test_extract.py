import json

import pytest
from pyspark.sql import functions as F

from domloom.operators import extract as ex
from domloom.operators import profile
from domloom.operators.schema import Section
from domloom.plans.flows import to_markdown
from domloom.plans.queries import all_queries
from domloom.streaming.incremental import incremental_extract

PAGE = "<title>T</title><h1>Head</h1><ul><li>a<li><b>x</b>y</ul><p class=k>one <b>two</b></p>"
SECTIONS = [
    Section("title", "//h1"),
    Section("items", "//li", is_list=True),
    Section("missing", "//h2"),
    Section("no_items", "//ol/li", is_list=True),
    Section("broken", "//a[position()=1]"),
    Section("broken_list", "count(//a)", is_list=True),
    Section("skipped", None),
]


def long(extracted):
    return {(r.page_id, r.section): r for r in ex.extractions(extracted).collect()}


def test_null_contract(pages_of):
    rows = long(ex.extract(pages_of(PAGE), SECTIONS))
    assert {s for _, s in rows} == {"title", "items", "missing", "no_items", "broken", "broken_list"}
    assert rows[1, "title"].value == "Head" and rows[1, "title"]["values"] is None
    assert rows[1, "items"]["values"] == ["a", ""] and rows[1, "items"].value is None
    assert rows[1, "missing"].value is None and rows[1, "missing"].source_xpath is None
    assert rows[1, "no_items"]["values"] == [] and rows[1, "broken"].value is None
    assert rows[1, "broken_list"]["values"] == []


def test_full_text_mode(pages_of):
    rows = long(ex.extract(pages_of(PAGE), [Section("p", "//p"), Section("li", "//li", is_list=True)], full_text=True))
    assert rows[1, "p"].value == "one two" and rows[1, "li"]["values"] == ["a", "xy"]


def test_fallback_takes_the_first_candidate_with_text(pages_of):
    section = Section("t", "//h3", xpath_list=("//h3", "//p[@class='none']", "//ul", "//h1", "//title"))
    rows = long(ex.extract(pages_of(PAGE, "<title>Only</title>", "<p>x"), [section], fallback=True))
    assert (rows[1, "t"].value, rows[1, "t"].source_xpath) == ("Head", "//h1")
    assert (rows[2, "t"].value, rows[2, "t"].source_xpath) == ("Only", "//title")
    assert rows[3, "t"].value is None


def test_last_of_equal_names_counts(pages_of):
    rows = long(ex.extract(pages_of(PAGE), [Section("a", "//h1"), Section("a", "//title")]))
    assert len(rows) == 1 and rows[1, "a"].value == "T"


def test_bad_pages_do_not_stop_the_rest(pages_of):
    extracted = ex.extract(pages_of(PAGE, None, "", "<"), SECTIONS[:1], keep=["url"])
    status = {r.page_id: r for r in ex.extract_status(extracted, F.concat(F.lit("p"), "page_id", F.lit(".html"))).collect()}
    assert [status[i].status for i in (1, 2, 3, 4)] == ["success", "failed", "failed", "success"]
    assert status[2].error == "No HTML content available" and status[2].result_file is None
    assert status[1].result_file == "p1.json"
    totals = ex.status_summary(ex.extract_status(extracted, F.lit("x"))).first()
    assert tuple(totals) == (4, 2, 2)


def test_no_usable_section(pages_of):
    assert ex.extractions(ex.extract(pages_of(PAGE), [Section("x", None)])).count() == 0


def test_records(pages_of):
    extracted = ex.extract(pages_of(PAGE, None), SECTIONS)
    rows = ex.extraction_records(extracted, SECTIONS).select("page_id", ex.record_json(F.col("record")).alias("j")).collect()
    records = {r.page_id: json.loads(r.j) for r in rows}
    assert records[1] == {"title": "Head", "items": ["a", ""], "missing": None, "no_items": [], "broken": None, "broken_list": []}
    assert records[2] == {}


def test_order_and_neighbours_do_not_matter(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    def rows(p):
        return sorted(map(str, ex.extract_sections(p, SECTIONS[:3]).collect()))
    everything = rows(pages)
    assert rows(pages.orderBy(F.desc("page_id")).repartition(5)) == everything
    some = rows(pages.filter("page_id < 10"))
    assert set(some) <= set(everything) and len(some) == 30


def test_validation(pages_of):
    pages = pages_of(PAGE, PAGE)
    sections = SECTIONS[:4]
    stored = ex.extract_sections(pages, sections)
    assert ex.validate_extractions(pages, sections, stored).count() == 0
    broken = stored.filter("not (page_id = 1 and section = 'missing')").withColumn(
        "values", F.when(F.col("section") != "no_items", F.col("values"))
    ).withColumn("value", F.when(F.col("section") == "items", F.lit("x")).otherwise(F.col("value"))).withColumn(
        "section", F.when((F.col("section") == "title") & (F.col("page_id") == 2), "other").otherwise(F.col("section"))
    )
    found = {(r.page_id, r.section, r.type) for r in ex.validate_extractions(pages, sections, broken).collect()}
    assert found == {
        (1, "missing", "MissingField"), (2, "title", "MissingField"), (2, "other", "UnexpectedField"),
        (1, "items", "WrongShape"), (2, "items", "WrongShape"), (1, "no_items", "NullList"), (2, "no_items", "NullList"),
    }


def test_profile_and_markdown(pages_of):
    sections = [Section("title", "//h1"), Section("author", "//b"), Section("text", "//p"), Section("tags", "//li", is_list=True),
                Section("foot", "//footer"), Section("none", "//h5")]
    pages = pages_of(
        "<h1>T</h1><b>A</b><p>" + "long " * 100 + "</p><ul><li>x<li>y</ul><footer>F</footer>",
        "<h1>U</h1><p>" + "more " * 100 + "</p>", None,
    )
    extracted = ex.extract(pages, sections)
    table = profile.field_profile(ex.extractions(extracted))
    # the footer is recognised by its path
    rows = {r.section: r for r in table.collect()}
    assert {s: r.role for s, r in rows.items()} == {
        "title": "metadata", "author": "metadata", "text": "main", "tags": "main", "foot": "structural", "none": "metadata",
    }
    assert rows["author"].fill_rate == 0.5 and rows["tags"].avg_items == 1.0 and rows["tags"].field_type == "list"
    summary = profile.content_hierarchy(table).first()
    assert summary.primary == "text" and summary.secondary == ["tags"]
    docs = {r.page_id: r.markdown for r in profile.records_to_markdown(extracted, sections, profile.collect_roles(table)).collect()}
    assert docs[1] == "# T\n\n**author**: A\n\n" + "long " * 100 + "\n\n## tags\n\n- x\n- y\n\n## foot\n\nF"
    assert docs[2] == "# U\n\n" + "more " * 100 and docs[3] is None
    states = ex.markdown_status(profile.records_to_markdown(extracted, sections, {}).withColumn("result_file", F.lit("r.json")))
    assert tuple(ex.status_summary(states).first()) == (3, 2, 1)


def test_field_types(spark):
    rows = [("h", False, "<p>x</p>", None), ("o", False, '{"a":1}', None), ("t", False, "x", None), ("l", True, None, ["x"])]
    table = spark.createDataFrame(
        [(1, *r, None) for r in rows], "page_id bigint, section string, is_list boolean, value string, values array<string>, source_xpath string"
    )
    assert {r.section: r.field_type for r in profile.field_profile(table).collect()} == {"h": "html", "o": "object", "t": "text", "l": "list"}


def test_records_by_field_type(spark):
    entry = "struct<section:string,is_list:boolean,value:string,values:array<string>,source_xpath:string>"
    fields = [("title", False, "1. *A*", None, None), ("h", False, "<p>x <b>y</b> <a href='/z'>z</a></p>", None, None),
              ("o", False, '{"a_b":1}', None, None), ("t", False, "a_b [c]", None, None), ("l", True, None, ["x_y", "", "z"], None)]
    extracted = spark.createDataFrame([(1, None, fields), (2, "e", None)], f"page_id bigint, error string, fields array<{entry}>")
    sections = [Section(f[0], "//p", is_list=f[1]) for f in fields]
    docs = {r.page_id: r.markdown for r in to_markdown(extracted, sections).collect()}
    assert docs[2] is None and docs[1].split("\n\n") == [
        "# 1\\. \\*A\\*", "**h**: x **y** [z](/z)", '**o**:', '```\n{"a_b":1}\n```', "**t**: a\\_b \\[c\\]", "## l", "- x\\_y\n- z"]


def test_stream_continues_where_it_stopped_and_equals_the_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.filter("page_id < 20").write.parquet(source)
    for expected in (20, 50, 50):
        incremental_extract(spark, source, out, state, SECTIONS).awaitTermination()
        assert spark.read.parquet(out).count() == expected
        if expected == 20:
            pages.filter("page_id >= 20").write.mode("append").parquet(source)
    def rows(df):
        return sorted(map(str, df.select("page_id", "error", "fields").collect()))
    assert rows(spark.read.parquet(out)) == rows(ex.extract(pages, SECTIONS))


@pytest.mark.parametrize("folder", [True, False])
def test_stream_query_reads_a_table_of_many_files(spark, tmp_path, folder):
    """The pages are a folder of part files, or one file; other tables beside them are left alone."""
    rows = [(i, f"http://h/{i}", f"<title>t{i}</title><h1>h{i}</h1>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    where = tmp_path / ("pages.parquet" if folder else "made")
    pages.repartition(3).write.parquet(str(where)) if folder else pages.coalesce(1).write.parquet(str(where))
    if not folder:
        next(where.glob("part-*.parquet")).rename(tmp_path / "pages.parquet")
    spark.range(3).write.parquet(str(tmp_path / "labels.parquet"))
    found = all_queries()["incremental_extract"](spark, str(tmp_path)).filter("section = 'title'")
    assert sorted((r.page_id, r.value) for r in found.collect()) == [(i, f"h{i}") for i in range(5)]


def test_section_without_xpath_is_absent_even_with_fallbacks(pages_of):
    sections = [Section("a", "//h1"), Section("b", None, xpath_list=("//h1",)), Section("c", "", xpath_list=("//h1",))]
    rows = ex.extract_sections(pages_of("<h1>t"), sections, fallback=True).collect()
    assert [(r.section, r.value) for r in rows] == [("a", "t")]


def test_html_in_list_items(spark):
    """Items with tags become Markdown of their own, others are escaped; without tags in any, all are."""
    entry = "struct<section:string,is_list:boolean,value:string,values:array<string>,source_xpath:string>"
    items = ["<b>a</b> <a href='/u'>t</a>", "1 * 2", "", "<ul><li>x</li><li>y</li></ul>", "<table><tr><td>a</td><td>b</td></tr></table>"]
    rows = [(1, None, [("l", True, None, items, "//x"), ("m", True, None, ["p_q"], "//y")])]
    extracted = spark.createDataFrame(rows, f"page_id bigint, error string, fields array<{entry}>")
    profiled = profile.field_profile(ex.extractions(extracted))
    types = profile.collect_types(profiled)
    assert types == {"l": "html_list", "m": "list"}
    sections = [Section("l", "//x", is_list=True), Section("m", "//y", is_list=True)]
    text = profile.records_to_markdown(extracted, sections, {}, types).first().markdown
    assert text == "## l\n\n- **a** [t](/u)\n- 1 \\* 2\n- - x\n  - y\n- a | b\n\n## m\n\n- p\\_q"
