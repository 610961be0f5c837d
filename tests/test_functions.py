import html as stdlib_html
import json
import re
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from domloom.functions import markdown as md
from domloom.functions import responses as rs
from domloom.functions import text as tx
from domloom.functions import urls as ur
from domloom.functions.columns import sql_literal, step_prefix, tally


def apply(spark, values, column, type_="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, v {type_}")
    by_name = getattr(column, "__module__", "").endswith((".text", ".markdown"))
    x = column("v" if by_name else F.col("v")).alias("x")
    return [r[0] for r in frame.select("i", x).orderBy("i").select("x").collect()]


def test_decode_entities_agrees_with_the_standard_library(spark):
    texts = ["a &amp; b", "&lt;b&gt;", "&amp;lt;", "&copy 2", "&notit;", "&bogus;", "&#65;&#x42;&#X43", "&#8364;", "&#0;",
             "&", "&&amp", "&ampx;", "no entity", "", "&eacute;&Eacute", "&apos;", "&#xD800;", "&#1114112;"]
    assert apply(spark, texts, tx.decode_entities) == [stdlib_html.unescape(t) for t in texts]


def test_text_content(spark):
    pages = [
        "<title> T </title><style>x</style><p>a <b> b</b></p><script>var t='</p>';</script>c&nbsp;d",
        "<!-- no --><!DOCTYPE html>a<br>b", "", None, "<script>open", "<p>a  b\n c</p>",
    ]
    assert apply(spark, pages, tx.text_content) == ["T a b c\xa0d", "a b", "", "", "", "a  b\n c"]


def test_body_content(spark):
    pages = ["<html><body class=x><p>a</p></body></html>", "<p>a</p>", "<body>open", "<BODY>a</BODY>"]
    assert apply(spark, pages, tx.body_content) == ["<body class=x><p>a</p></body>", "<p>a</p>", "<body>open", "<BODY>a</BODY>"]


def test_truncate(spark):
    cut = apply(spark, ["abc", "abcd", None], lambda c: tx.truncate_html("v", 3))
    assert cut == ["abc", "abc\n... [truncated]", None]
    assert apply(spark, ["abcd"], lambda c: tx.truncate_html("v", 2, "")) == ["ab"]


URLS = ["http://a.b/c", "https://a", "a.b/c", "//a/b", "http://", "http:///x", "mailto:x@y", "ftp://h/x", "", "http://[::1]/x",
        "http://[::1/x", "HTTP://X/y", "1http://a", "http://u:p@h:80/p?q#f", "http://h?q", "http://h#f"]


def test_url_valid_agrees_with_urlparse(spark):
    def expected(u):
        try:
            p = urlparse(u)
            return bool(p.scheme and p.netloc)
        except ValueError:
            return False

    assert apply(spark, URLS, ur.url_valid) == [expected(u) for u in URLS]


def filename(url, i):
    """The rule spelled out, for comparison."""
    parsed = urlparse(url)
    parts = [p for p in parsed.path.split("/") if p]
    if not parts:
        name = f"{parsed.netloc.replace('.', '_')}_{i:03d}"
    elif len(parts) > 1 and len(parts[-1]) < 5:
        name = "_".join(parts[-2:])
    else:
        name = parts[-1]
    name = re.sub(r"[^\w\-.]", "_", name)
    name = f"page_{i:03d}" if len(name) < 3 else name
    return name if name.endswith(".html") else name + ".html"


def test_url_filename(spark):
    urls = ["http://a.b/2025/10/a-long-name/", "http://h/en/12?x=1", "http://h.com", "http://h.com/", "http://h/x", "http://h/ab;p=1/c;q",
            "http://h/a b/ü~x.html", "http://h/dir/page.html#t", "http://h/abc/de", "http://h/12345;x=/y"]
    rows = [(u, i) for i, u in enumerate(urls, 998)]
    got = spark.createDataFrame(rows, "u string, i bigint").select(
        "i", ur.url_filename(F.col("u"), F.col("i")).alias("f")
    ).orderBy("i").collect()
    assert [r.f for r in got] == [filename(u, i) for u, i in rows]


def test_result_filenames(spark):
    names = ["a.html", "a.htm", "a.htm.html", "a b(c).html", "x", "a.xhtml"]
    assert apply(spark, names, ur.result_filename) == ["a.json", "a.json", "a.json", "a_b_c_.json", "x.json", "a.xhtml.json"]
    assert apply(spark, ["a.json", "a.b.json"], ur.markdown_filename) == ["a.md", "a.b.md"]


MARKDOWN = {
    "<h1>A &amp; B</h1><p>x</p><p>y</p>": "# A & B\n\nx\n\ny",
    "<h6>s</h6>": "###### s",
    "<p><strong>a</strong> <b>b</b> <em>c</em> <i>d</i></p>": "**a** **b** *c* *d*",
    "<b>x <i>y</i></b>": "**x *y***",
    "<a href='/u?x=1'>t</a>": "[t](/u?x=1)",
    '<a class="k" href="/u"><b>t</b></a>': "[**t**](/u)",
    "<ul><li>a</li><li>b</li></ul>": "- a\n- b",
    "<ol><li>a<li>b</ol>": "1. a\n1. b",
    "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>": "- a\n  - b\n- c",
    "<code>x</code>": "`x`",
    "<pre><code>if a &lt; b:\n    c</code></pre>": "```\nif a < b:\n    c\n```",
    "<blockquote><p>a</p><p>b</p></blockquote>": "> a\n>\n> b",
    "<blockquote>a<blockquote>b</blockquote></blockquote>": "> a\n\n> > b",
    "<img alt='A' src='a.png'>": "![A](a.png)",
    "<img src=a.png>": "![](a.png)",
    "a<hr>b": "a\n\n---\n\nb",
    "a<br>b": "a\nb",
    "<div>a</div><span>b</span>": "a\n\nb",
    "<p><b>open<br><p>next": "open\n\nnext",
    "<p>a\n   b</p>": "a b",
    "<script>x</script><!-- c --><p>a</p>": "a",
    "<h2>a <b>b</b></h2><h3>c</h3>d": "## a **b**\n\n### c\n\nd",
    "<h1>open<p>x</p>": "open\n\nx",
    "<ul><li>a<li>b &amp; c": "- a\n- b & c",
    "1 < 2": "1 < 2",
    "": "",
}


def test_html_to_markdown(spark):
    assert apply(spark, list(MARKDOWN), md.html_to_markdown) == list(MARKDOWN.values())
    assert apply(spark, [None], md.html_to_markdown) == [None]


def test_markdown_of_a_long_page(spark):
    page = "<p>" + "word &amp; " * 200_000 + "</p>" + "<ul>" + "<li>x</li>" * 2_000 + "</ul>"
    out = apply(spark, [page], md.html_to_markdown)[0]
    assert out.count("word &") == 200_000
    assert out.count("- x") == 2_000


def test_hostile_pages_stay_linear(spark):
    import time

    pages = ["<p" * 300_000, "<a<a" * 200_000 + ">", "<h1>" * 50_000, "<li>" * 3_000, "<!--" * 100_000, "&" * 50_000]
    for page in pages:
        start = time.time()
        apply(spark, [page], md.html_to_markdown)
        apply(spark, [page], tx.text_content)
        assert time.time() - start < 30, page[:10]


def test_markdown_escape(spark):
    assert apply(spark, ["a*b_[c](d)#1+2-3.!{}`\\"], md.markdown_escape) == [
        "a\\*b\\_\\[c\\]\\(d\\)\\#1\\+2\\-3\\.\\!\\{\\}\\`\\\\"
    ]


JSON_TEXTS = ['{"a":1}', "1", "1,2", "1] [2", '1,"v":2', "", "nul", "null", '"x"', '{"a":1} ', '{"a":1} x', "[1,2]", '{"a":}',
              "{a:1}", "{'a':1}", "01", "-1.5e3", "[1,2", '{"a":1}}', "1}", '"a\\u00zz"', "//x\n1", "1 1", '"a":1', "prose"]


def test_is_json_agrees_with_the_standard_library(spark):
    def valid(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    assert apply(spark, JSON_TEXTS, rs.is_json) == [valid(t) for t in JSON_TEXTS]


def salvage(text, mode):
    """The strategies spelled out, for comparison."""
    def parses(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    if mode != "visual" and parses(text):
        return "whole", text
    for name, pattern, group in rs.MODES[mode]:
        m = re.search(pattern, text)
        if m:
            if parses(m.group(group)):
                return name, m.group(group)
            return ("raw" if mode == "visual" else "error"), None
    return "raw", None


RESPONSES = ['{"a": 1}', 'x ```json\n{"a": 1}\n``` y', 'x ```\n{"a": 1}\n```', 'see {"a": {"b": 2}} ok', '{"a": 1} {"b": 2}',
             '```json\n{bad}\n```', "plain", '```json {"a": 1} ``` then {"b"', "[1]", '```json\n{"a": "}"}\n```', ""]


@pytest.mark.parametrize("mode", list(rs.MODES))
def test_salvage(spark, mode):
    got = apply(spark, RESPONSES, lambda c: rs.salvage_json(c, mode))
    assert [(g.strategy, g.json) for g in got] == [salvage(t, mode) for t in RESPONSES]
    assert all((g.raw is None) == (g.json is not None) for g in got)


def test_code_and_suggestions(spark):
    assert apply(spark, ["a ```python\nx = 1\n``` b ```y```", "```\nz\n```", " none ", "```python3\nq\n```"], rs.extract_fenced_code) == [
        "x = 1", "z", "none", "q",
    ]
    assert apply(spark, ["- a\n  * b\nc\n-d"], rs.review_suggestions) == [["- a", "* b", "-d"]]
    long = "def f():\n" + "    pass\n" * 20
    reviews = [f"```python\n{long}```", "```\nx\n```", "nothing", f"```\nzz\n```\nfixed code:\n{long.strip()}\n\nbye"]
    assert apply(spark, reviews, rs.reviewed_code) == [long.strip(), None, None, long.strip()]


def test_fix_json_bools(spark):
    assert apply(spark, ['{"a": true, "b":false}', "x: trueish,"], rs.fix_json_bools) == ['{"a": True, "b": False}', "x: trueish,"]


def test_tally(spark):
    got = apply(spark, [["a", "b", "a"], []], tally, "array<string>")
    assert [[(x["item"], x["seen"]) for x in g] for g in got] == [
        [("a", True), ("b", True), ("a", False), ("b", False), ("a", False)], [],
    ]


def test_step_prefix(spark):
    rows = [("/a/b/c", "/a/b/d", "/a/b"), ("/a", "/a/b", "/a"), ("/a/bc", "/a/bd", "/a"), ("/x", "/y", ""), ("/a/b", "/a/b", "/a/b")]
    frame = spark.createDataFrame(rows, "lo string, hi string, want string")
    for r in frame.select("want", step_prefix(F.col("lo"), F.col("hi")).alias("got")).collect():
        assert r.got == r.want


def test_sql_literal(spark):
    for text in ("plain", "it's", "back\\slash", "//a[@x='1']", "ü\n", ""):
        assert spark.range(1).selectExpr(f"{sql_literal(text)} AS x").first().x == text


def test_text_keeps_what_follows_odd_tags_and_references(spark):
    pages = [
        ("<p>keep one</p><style-guide>shown</style-guide><p>keep two</p>", "keep one shown keep two"),
        ("<p>it&#146;s &#150; ok</p>", "it\u2019s \u2013 ok"),
        ("<p>&#000000065;B &#x0000000041;C &#99999999999999999999999;</p>", "AB AC \ufffd"),
        ("<p>a</p><script>x</script><p>b</p>", "a b"),
    ]
    rows = spark.createDataFrame(pages, "html string, want string").withColumn("got", tx.text_content("html"))
    assert [r.got for r in rows.collect()] == [w for _, w in pages]


QUOTED = {
    '<a title="a>b">t</a>': "t",
    "<p><a title='x > y' href=/u>t</a> and <b data-x='</b>'>c</b></p>": "t and c",
    '<img alt="1 < 2 > 0">after': "after",
    '<p class="open>a</p><p>b</p>': "a b",
    '<script data-x="a>b">no</script x>yes': "yes",
    '<a ">"><b>x</b>': "x",
    "a < b <i>c</i> <d": "a < b c <d",
    "<script>a<b>c": "",
    "<p>x<!-- a>b --> y</p><!-- open <p>": "x y",
}


def test_quotes_hide_the_end_of_a_tag(spark):
    assert apply(spark, list(QUOTED), tx.text_content) == list(QUOTED.values())
    pages = {
        '<a title="a>b" href="/u">t</a>': "[t](/u)", '<p data-x="</p><h1>">a</p>': "a", '<img alt="a>b" src="c.png">': "![a>b](c.png)",
        '<h2 id="x>y">a</h2>': "## a", "it's <b>a</b> isn't it": "it's **a** isn't it",
        "<body data-x='<b>'><p>a": "a",
    }
    assert apply(spark, list(pages), md.html_to_markdown) == list(pages.values())
    bodies = {
        "<!-- <body > --><div title='<body >'></div><script>'<body >'</script><BODY id='>'>a</body >b": "<BODY id='>'>a</body >",
        "<body x": "<body x", "<p>a</p><body": "<p>a</p><body", "<body><p>a</p> b": "<body><p>a</p> b", "<bodyx>a": "<bodyx>a",
    }
    assert apply(spark, list(bodies), tx.body_content) == list(bodies.values())


def test_table_cells_stay_apart(spark):
    pages = {
        "<table><tr><th>a</th><th>b</th></tr><tr><td>c<td><b>d</b></tr></table>e": "a | b\nc | **d**\n\ne",
        "<table><tr><td>a</td></tr></table>": "a", "<td>a</td> <td></td><td>b</td>": "a |  | b",
    }
    assert apply(spark, list(pages), md.html_to_markdown) == list(pages.values())


def test_text_agrees_with_the_scanner_on_random_tags(spark):
    """Both read tags, quotes and comments alike, whatever they are strung together from."""
    import random

    from domloom.functions.html_scan import PageScan

    draw = random.Random(7)
    pieces = ["<b", "<i>", "</i>", ">", '"', "'", " x", "=", "t ", "<!--", "-->", "<br>", "</b>", "a", "&amp;", "<img alt='>'>"]
    pages = ["<p>s " + "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 25))) + "</p>" for _ in range(400)]
    squeezed = lambda text: re.sub(r"\s+", "", text)
    got = apply(spark, pages, tx.text_content)
    assert [squeezed(t) for t in got] == [squeezed("".join(PageScan(p).runs)) for p in pages]


def test_all_entity_names(spark):
    from html.entities import html5

    texts = [f"a&{name}b &{name.rstrip(';')}1" for name in html5]
    assert apply(spark, texts, tx.decode_entities) == [stdlib_html.unescape(t) for t in texts]


HOSTILE = ["<script ", "<body ", "<a \">\"", "<a '", "<a \"'>", "<code><br>", "</script ", "<b>\n<br>", "<a href ", "<td", "<!-- ", "&notin"]


@pytest.mark.parametrize("column", [tx.text_content, tx.body_content, md.html_to_markdown])
def test_open_tags_cost_linear_time(spark, column):
    import time

    def seconds(repeats):
        pages = [unit * repeats for unit in HOSTILE] + ["<code>" + "<br>" * repeats + "x", "<a href=1>" + "<br>" * repeats + "<i>"]
        best = float("inf")
        for _ in range(3):
            start = time.perf_counter()
            apply(spark, pages, column)
            best = min(best, time.perf_counter() - start)
        return best

    small, large = seconds(4_000), seconds(16_000)
    assert large < 4 * 2.2 * small
