"""Golden tests of the recovery rules: every element as (xpath, leading text, all text)."""

import tracemalloc

import pyarrow as pa
import pytest

from domloom.functions.html_scan import PageScan, parse_attributes
from domloom.operators import nodes
from domloom.operators import structure as st
from domloom.operators.xpath import fields_for, select_xpath
from domloom.plans.queries import XPATHS


def elements(source):
    s = PageScan(source)
    return [
        (x, t, "".join(s.runs[a:b]))
        for x, t, a, b in zip(s.xpaths(), s.text_heads(), s.run_start, s.run_end)
    ]


def body(source):
    """Elements below /html/body, with paths relative to it."""
    return [(x[len("/html/body"):], t, f) for x, t, f in elements(source) if x.startswith("/html/body/")]


GOLDEN = {
    "plain paragraph": ("<p>a</p>", [("/p", "a", "a")]),
    "siblings get an index only when repeated": (
        "<div><p>a</p><b>c</b><p>b</p></div>",
        [("/div", None, "acb"), ("/div/p[1]", "a", "a"), ("/div/b", "c", "c"), ("/div/p[2]", "b", "b")],
    ),
    "open p closed by p, with the b inside": (
        "<p><b>t.<br><p>n</p>",
        [("/p[1]", None, "t."), ("/p[1]/b", "t.", "t."), ("/p[1]/b/br", None, ""), ("/p[2]", "n", "n")],
    ),
    "p closed by a block": ("<p>a<div>b</div>c", [("/p", "a", "a"), ("/div", "b", "b")]),
    "li closed by li": ("<ul><li>a<li>b</ul>", [("/ul", None, "ab"), ("/ul/li[1]", "a", "a"), ("/ul/li[2]", "b", "b")]),
    "nested list keeps the outer li open": (
        "<ul><li>a<ul><li>b</ul><li>c</ul>",
        [("/ul", None, "abc"), ("/ul/li[1]", "a", "ab"), ("/ul/li[1]/ul", None, "b"),
         ("/ul/li[1]/ul/li", "b", "b"), ("/ul/li[2]", "c", "c")],
    ),
    "table cells and rows": (
        "<table><tr><td>1<td>2<tr><td>3</table>",
        [("/table", None, "123"), ("/table/tr[1]", None, "12"), ("/table/tr[1]/td[1]", "1", "1"),
         ("/table/tr[1]/td[2]", "2", "2"), ("/table/tr[2]", None, "3"), ("/table/tr[2]/td", "3", "3")],
    ),
    "definition list": (
        "<dl><dt>a<dd>b<dt>c</dl>",
        [("/dl", None, "abc"), ("/dl/dt[1]", "a", "a"), ("/dl/dd", "b", "b"), ("/dl/dt[2]", "c", "c")],
    ),
    "void elements do not nest": ("<p>a<br>b<img src=x>c</p>", [("/p", "a", "abc"), ("/p/br", None, ""), ("/p/img", None, "")]),
    "self closing slash is ignored on other tags": ("<div/>a", [("/div", "a", "a")]),
    "stray end tags are ignored": ("<div>a</span></p>b</div>", [("/div", "ab", "ab")]),
    "inline end tag does not cross a block": ("<b><div>a</b>b</div>c</b>", [("/b", None, "abc"), ("/b/div", "ab", "ab")]),
    "comment ends the leading text": ("<div>a<!-- > x -->b</div>", [("/div", "a", "ab")]),
    "comment with markup": ("<!-- <p>no</p> --><p>a</p>", [("/p", "a", "a")]),
    "upper case and bare attributes": ("<DIV Class=X><P>a</P></DIV>", [("/div", None, "a"), ("/div/p", "a", "a")]),
    "greater-than inside a quoted attribute": ("<a title='x > y'>a</a>", [("/a", "a", "a")]),
    "script content is no markup": ("<div><script>var t='</p><b>';</script>a</div>",
                                    [("/div", None, "var t='</p><b>';a"), ("/div/script", "var t='</p><b>';", "var t='</p><b>';")]),
    "textarea content is text": ("<textarea><b>&amp;</textarea>", [("/textarea", "<b>&", "<b>&")]),
    "entities, also without semicolon": ("<p>&amp;&lt &copy;&#65;&#x42;</p>", [("/p", "&< ©AB", "&< ©AB")]),
    "blank text between blocks is dropped": ("<div> <p>a</p> <p>b</p> </div>",
                                             [("/div", None, "ab"), ("/div/p[1]", "a", "a"), ("/div/p[2]", "b", "b")]),
    "blank text between inline elements is kept": ("<p><b>a</b> <i>b</i></p>",
                                                   [("/p", None, "a b"), ("/p/b", "a", "a"), ("/p/i", "b", "b")]),
    "a closed by a": ("<a href=1>x<a href=2>y</a>", [("/a[1]", "x", "x"), ("/a[2]", "y", "y")]),
    "options": ("<select><option>a<option>b</select>",
                [("/select", None, "ab"), ("/select/option[1]", "a", "a"), ("/select/option[2]", "b", "b")]),
    "heading closed by heading": ("<h1>a<h2>b</h2>", [("/h1", "a", "a"), ("/h2", "b", "b")]),
    "content after body still belongs to it": ("<body><p>a</p></body></html><p>b</p>", [("/p[1]", "a", "a"), ("/p[2]", "b", "b")]),
    "bare text gets a paragraph": ("hello <b>w</b>", [("/p", "hello ", "hello w"), ("/p/b", "w", "w")]),
    "less-than that opens nothing is text": ("<p>1 < 2 <3</p>", [("/p", "1 < 2 <3", "1 < 2 <3")]),
    "tag cut off at the end": ("<p>a<b class='x", [("/p", "a", "a"), ("/p/b", None, "")]),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(name):
    source, expected = GOLDEN[name]
    assert body(source) == expected


def test_head_and_body_are_implied():
    assert [x for x, _, _ in elements("<title>t</title><p>a")] == [
        "/html", "/html/head", "/html/head/title", "/html/body", "/html/body/p",
    ]


def test_repeated_body_merges_attributes():
    s = PageScan("<body class=a><p>x<body id=b class=c>")
    assert s.tag.count("body") == 1 and s.attrs[1] == {"class": "a", "id": "b"}


def test_empty_and_blank_input():
    assert elements("") == [] and elements(" \n ") == []


def test_attributes():
    assert parse_attributes(""" A=1 b='2 &amp; 3' c="x" d e=  f a=9""") == {
        "a": "1", "b": "2 & 3", "c": "x", "d": "", "e": "f",
    }


def test_outer_html_offsets():
    source = "<div>é<p>a</p><ul><li>x<li>y</ul></div>"
    s = PageScan(source)
    cut = {t: source[a:b] for t, a, b in zip(s.tag, s.html_start, s.html_end)}
    assert cut["p"] == "<p>a</p>" and cut["ul"] == "<ul><li>x<li>y</ul>" and cut["div"] == source


def test_subtree_intervals_nest():
    s = PageScan("<div><p>a<b>b</b></p><ul><li>c<li>d</ul></div><p>e")
    for i, (parent, last) in enumerate(zip(s.parent, s.last), 1):
        assert i <= last <= len(s.tag)
        if parent:
            assert parent < i and last <= s.last[parent - 1]


def test_deep_nesting_is_kept():
    n = 3000
    s = PageScan("<div>" * n + "<p>x" + "</div>" * n + "<p>y")
    assert s.depths() == [1, 2, *range(3, n + 4), 3] and "".join(s.runs) == "xy"
    assert list(s.xpaths())[-2:] == ["/html/body" + "/div" * n + "/p", "/html/body/p"]
    assert s.last[2] == n + 3
    paths = list(s.gpaths())
    assert paths[-1] == "html/body/p" and len(set(s.path_numbers())) == len(set(paths))


def test_hostile_input_is_linear():
    import time

    for source in ("<a '" * 20_000, "<" * 200_000, "<!--" * 50_000, "<p><b>" * 20_000, "<div>" * 100_000, "<b></i>" * 50_000):
        start = time.time()
        PageScan(source)
        assert time.time() - start < 10


def test_paths_take_memory_by_the_element(spark):
    """A page whose paths take hundreds of megabytes together is parsed, searched and written row by row."""
    from pyspark.sql import functions as F

    n = 9_000
    scan = PageScan("<div>" * n)
    tracemalloc.start()
    assert sum(map(len, scan.xpaths())) > 1 << 27
    assert tracemalloc.get_traced_memory()[1] < 1 << 23
    tracemalloc.stop()
    pages = spark.createDataFrame([(1, "<div>" * n + "<p>x"), (2, "<p>a<p>b"), (3, None)], "page_id bigint, html string")
    rows = nodes.node_rows(pages, "nid", "tag", "xpath", "gpath", "gseq", "attrs")
    deep = rows.where("page_id = 1").agg(F.count("*"), F.max(F.length("xpath"))).first()
    assert tuple(deep) == (n + 3, len("/html/body/p") + 4 * n)
    assert [(r.xpath, r.gpath, r.gseq) for r in rows.where("page_id = 2 AND tag = 'p'").orderBy("nid").collect()] == [
        ("/html/body/p[1]", "html/body/p", 1), ("/html/body/p[2]", "html/body/p", 2)]
    parsed = nodes.parse_pages(pages)
    found = select_xpath(parsed, {"x": "//p"}).collect()
    assert sorted((r.page_id, len(r.xpath)) for r in found) == [(1, len("/html/body/p") + 4 * n), (2, 15), (2, 15)]
    assert parsed.where("page_id = 1").first().error is None


@pytest.mark.parametrize("fields", [
    tuple(dict.fromkeys(fields_for(XPATHS.values(), *nodes.PATH_FIELDS))),
    tuple(dict.fromkeys((*st.SECTION_FIELDS, *st.LAYOUT_FIELDS))),
], ids=["select_xpath", "merge_analyses"])
def test_elements_of_a_few_pages_at_a_time(fields):
    """A batch of pages far above the bound: the elements of all its pages are not in memory at once."""
    pages = ["<ul>" + "<li class='a b'><a href='/x'>t</a>" * 3000, None] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(80), pa.int64()), pa.array(pages, pa.string())], names=["page_id", "html"])
    rows = elements = 0
    tracemalloc.start()
    for part in nodes._parsed_batches(iter([batch]), fields):
        assert part.num_rows <= 24 and part.column(0).to_pylist() == list(range(rows, rows + part.num_rows))
        rows += part.num_rows
        elements += len(part.column(2).flatten())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (rows, elements) == (80, 40 * 6003) and peak < 80_000_000
