import json

import pytest
from pyspark.sql import functions as F

from domloom.operators import schema as sc
from domloom.operators import structure as st
from domloom.operators.nodes import node_rows, parse_pages
from domloom.operators.schema import Section

A = """<html><body><header>top</header><nav class=menu><a href=1>x</a><a href=2>y</a></nav>
<article class=post><h1>One</h1><p>p1</p><p>p2</p></article>
<div id=comments><div class="comment hot">c1</div><div class="comment">c2</div><div class="comment">c3</div></div>
<footer>f</footer></body></html>"""
B = "<html><body><h1>Two</h1><main><p>q</p></main><span class=author>me</span></body></html>"
C = "<html><body><article class=post><p>r1</p><p>r2</p><h1>Three</h1></article><aside>s</aside></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, A), (2, B), (3, C), (4, None)], "page_id bigint, html string")


@pytest.fixture(scope="module")
def parsed(pages):
    return parse_pages(pages).persist()


@pytest.fixture(scope="module")
def sections(parsed):
    return st.page_sections(parsed).persist()


def test_sections(sections):
    rows = {(r.page_id, r.section): r for r in sections.collect()}
    assert {s for p, s in rows if p == 1} == {"title", "body", "body_paragraphs", "comments", "navigation", "nav_links", "header", "footer"}
    assert {s for p, s in rows if p == 2} == {"title", "body", "body_paragraphs", "metadata"}
    assert {s for p, s in rows if p == 3} == {"title", "body", "body_paragraphs", "aside"}
    assert rows[4, None].error == "No HTML content available"
    c = rows[1, "comments"]
    assert c.is_list and c.n_matches == 4 and c.xpath == "/html/body/div" and c.attributes == {"id": "comments"}
    assert rows[1, "nav_links"].list_xpath == "/html/body/nav/a" and not rows[1, "title"].is_list
    assert rows[1, "body"].content_sample.replace("\n", "") == "Onep1p2"


def test_missing_sections(parsed):
    rows = {(r.page_id, r.section) for r in st.missing_sections(parsed, ["title", "footer", "unknown"]).collect()}
    assert rows == {(2, "footer"), (3, "footer"), (4, "title"), (4, "footer"), (1, "unknown"), (2, "unknown"), (3, "unknown"), (4, "unknown")}


def test_class_and_id_patterns(parsed, pages):
    rows = {(r.kind, r.token): (r.occurrences, r.pages, r.support) for r in st.class_id_patterns(parsed, pages).collect()}
    assert rows[("class", "comment")] == (3, 1, 0.25) and rows[("class", "post")] == (2, 2, 0.5)
    assert rows[("id", "comments")] == (1, 1, 0.25) and len(rows) == 6


def test_structural_patterns(parsed, pages):
    rows = {r.gpath: (r.occurrences, r.pages, r.avg_per_page) for r in st.structural_patterns(node_rows(pages, "gpath", "gseq"), pages).collect()}
    assert rows["html/body/article/p"] == (4, 2, 2.0) and rows["html/body"] == (3, 3, 1.0)


def test_repeating_patterns(parsed):
    def rows(k):
        return {(r.gpath, r.cls): (r.groups, r["items"], r.pages) for r in st.repeating_patterns(parsed, k).collect()}
    assert rows(2) == {
        ("html/body/nav/a", ""): (1, 2, 1), ("html/body/article/p", ""): (2, 4, 2), ("html/body/div/div", "comment"): (1, 2, 1),
    }
    assert rows(3) == {}


def test_layout(parsed):
    rows = {(r.page_id, r.xpath): r for r in st.layout_roles(parsed).collect()}
    kinds = {k: r.type for k, r in rows.items() if k[0] == 1}
    assert kinds == {
        (1, "/html/body/header"): "header", (1, "/html/body/nav"): "other", (1, "/html/body/article"): "body",
        (1, "/html/body/div"): "comment", (1, "/html/body/div/div[1]"): "comment", (1, "/html/body/div/div[2]"): "comment",
        (1, "/html/body/div/div[3]"): "comment", (1, "/html/body/footer"): "footer",
    }
    assert rows[1, "/html/body/header"].position == "top" and rows[1, "/html/body/footer"].position == "bottom"
    assert rows[1, "/html/body/div"].likely_xpath_hints == ["#comments"]
    assert rows[1, "/html/body/div/div[1]"].likely_xpath_hints == [".comment", ".hot"]
    assert rows[3, "/html/body/aside"].type == "sidebar"
    assert sum(r.regions for r in st.layout_summary(st.layout_roles(parsed)).collect()) == len(rows)


def test_merge(parsed, sections):
    rows = st.merge_analyses(parsed).collect()
    both = {(r.page_id, r.section, r.region_type) for r in rows if r.in_text and r.in_layout}
    assert both >= {(1, "body", "body"), (1, "comments", "comment"), (1, "navigation", "other"), (3, "aside", "sidebar")}
    only_layout = {(r.page_id, r.xpath) for r in rows if not r.in_text}
    assert only_layout == {(1, f"/html/body/div/div[{i}]") for i in (1, 2, 3)}
    off = st.merge_analyses(parsed, layout=False).collect()
    assert len(off) == sections.filter("section is not null").count() and not any(r.in_layout for r in off)


def test_across_pages(sections, pages):
    variants = st.section_variants(sections)
    common = {r.section: (r.pages, r.coverage) for r in st.common_patterns(variants, pages, 0.75).collect()}
    assert common == {"title": (3, 0.75), "body": (3, 0.75), "body_paragraphs": (3, 0.75)}
    cover = {(r.section, r.xpath): (r.pages, r.matches_per_page, r.rank) for r in st.xpath_coverage(variants, pages).collect()}
    assert cover["body_paragraphs", "/html/body/article/p"] == (2, 2.0, 1)
    assert cover["body_paragraphs", "/html/body/main/p"] == (1, 1.0, 2)
    assert cover["comments", "/html/body/div/div"] == (1, 3.0, 1)
    odd = {(r.section, r.kind): r.n for r in st.inconsistencies(variants, pages).collect()}
    assert odd["body_paragraphs", "mixed_is_list"] == 2 and odd["title", "path_variants"] == 2 and odd["title", "missing_pages"] == 1


def test_infer_schema_and_exchange(spark, sections, pages):
    schema = sc.infer_schema(st.section_variants(sections), pages)
    found = {s.name: s for s in sc.collect_schema(schema)}
    assert found["title"].xpath == "/html/body/article/h1" and found["title"].xpath_list == ("/html/body/article/h1", "/html/body/h1")
    assert found["body_paragraphs"].is_list and found["body"].attributes == (("class", "post"),)
    rare = {s.name: s for s in sc.collect_schema(sc.infer_schema(st.section_variants(sections), pages, min_support=0.5))}
    assert rare["title"].xpath_list == ("/html/body/article/h1",) and rare["aside"].xpath_list == ()
    document = sc.schema_document(schema, "notes").first()["json"]
    parsed = json.loads(document)
    assert parsed["schema_version"] == "1.0" and parsed["metadata"] == {"total_sections": len(found), "extraction_notes": "notes"}
    assert {s.name: (s.xpath, s.xpath_list, s.is_list) for s in sc.sections_from_json(document)} == {
        n: (s.xpath, s.xpath_list, s.is_list) for n, s in found.items()
    }
    table = sc.schema_table(spark, found.values())
    assert sc.collect_schema(table) == sorted(found.values(), key=lambda s: s.name)


def test_inferred_schemas_list_the_best_paths(spark):
    """Many paths of one section: the best are listed, all are ranked as rows."""
    rows = [("title", "title", "d", f"html/body/{'x' * (i % 9 + 1)}{i:03d}/h1", 1 + i // 50, 1 + i // 50, 1, 0, None) for i in range(300)]
    variants = spark.createDataFrame(rows, "section string, type string, description string, gpath string, pages bigint, matches bigint, "
                                           "lead_pages bigint, lead_list_pages bigint, cls string")
    pages = spark.range(10).withColumnRenamed("id", "page_id")
    ranked = sorted(rows, key=lambda r: (-r[4], len(r[3]), r[3]))
    for k in (1, 7, 20):
        found = sc.infer_schema(variants.repartition(8), pages, k=k).first()
        assert found.xpath_list == ["/" + r[3] for r in ranked[:k]] and found.xpath == found.xpath_list[0]
        assert found.notes == "on 300 pages, 300 paths"
    assert st.xpath_coverage(variants, pages).count() == 300
    many = sc.schema_table(spark, [Section(f"s{i:05d}", "//p") for i in range(10_050)])
    assert json.loads(sc.schema_document(many).first()["json"])["metadata"]["total_sections"] == 10_050


def test_simplify(spark):
    shape = "array<struct<name: string, description: string, xpath: string, xpath_list: array<string>, is_list: boolean, notes: string>>"
    rows = [
        ("1.0", "d", [("a", "A", "//a", ["//a", "//b"], True, "n"), ("b", None, "//b", ["//1", "//2", "//3", "//4"], None, "n"),
                      (None, None, None, None, None, None)]),
        (None, None, [("x", "", "//x", None, False, "")]),
    ]
    table = spark.createDataFrame(rows, f"v string, d string, s {shape}")
    out = [r.x for r in table.select(sc.simplify_schema(F.col("v"), F.col("d"), F.col("s"), 0).alias("x")).collect()]
    assert [tuple(s) for s in out[0].sections] == [
        ("a", "A", "//a", True, None), ("b", "", "//b", False, ["//1", "//2", "//3"]), ("", "", "", False, None),
    ]
    assert (out[1].schema_version, out[1].description) == ("1.0", "")
    assert table.select(sc.simplify_schema(F.col("v"), F.col("d"), F.col("s")).alias("x")).first().x is None


def test_validate_schema(spark):
    rows = [(1, 0, "a", "//h1", 3), (1, 1, None, "//h2[", 3), (1, 2, "c", "", 3), (2, 0, "x", "//a/@href", 5)]
    table = spark.createDataFrame(rows, "schema_id bigint, position int, name string, xpath string, total_sections int")
    found = {(r.schema_id, r.position, r.type) for r in sc.validate_schema(table).collect()}
    assert found == {(1, 1, "MissingName"), (1, 1, "InvalidXPath"), (1, 2, "MissingXPath"), (2, None, "WrongTotal")}
