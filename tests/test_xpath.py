import random
import time

import pytest
from pyspark.sql import functions as F

from domloom.functions.html_scan import PageScan
from domloom.operators.nodes import page_nodes, page_runs, parse_pages
from domloom.operators.schema import validate_schema
from domloom.operators.xpath import compile_xpath, select_xpath, suggest_xpath, unsupported_xpaths, xpath_text

PAGE = """<html><head><title>T</title></head><body>
<nav id=menu><ul class="x list"><li>a<li class="on">b<li>c</ul></nav>
<div class="post featured"><h1>H</h1><p>one <b>bold</b> two</p><div class="inner"><p>deep</p></div><p></p></div>
<div class="post-old"><a href="/u" rel="next">L</a><a href="it's">M</a></div></body></html>"""


@pytest.fixture(scope="module")
def parsed(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>x</p>"), (3, None)], "page_id bigint, html string")
    return parse_pages(pages).persist()


CASES = {
    "//li": ["a", "b", "c"],
    "//li[2]": ["b"],
    "//li[last()]": ["c"],
    "/html/body/nav/ul/li[1]": ["a"],
    "//nav//li[@class='on']": ["b"],
    "//ul[@class='list']/li": [],
    "//ul[contains(@class,'list')]/li[3]": ["c"],
    "//ul[contains(concat(' ',normalize-space(@class),' '),' list ')]/li[1]": ["a"],
    "//div[contains(concat(' ',@class,' '),' post ')]/p": ["one ", None],
    "//div[starts-with(@class,'post')]//p": ["one ", "deep", None],
    "//div//p": ["one ", "deep", None],
    "//div//div/p": ["deep"],
    "//nav[@id='menu']//li[2]": ["b"],
    "//*[@id='menu']/ul/*": ["a", "b", "c"],
    "//a/@href": ["/u", "it's"],
    "//@rel": ["next"],
    "//a[@rel]": ["L"],
    "//a[@rel and @href='/u']": ["L"],
    "//a[@rel or @href=\"it's\"]": ["L", "M"],
    "//h1/text()": ["H"],
    "//h1 | //title": ["T", "H"],
    ".//h1": ["H"],
    "body/nav/ul/li[1]": ["a"],
    "/body": [],
    "./body/nav/ul/li[1]": ["a"],
    "./li": [],
    "//a//@href": ["/u", "it's"],
    "//div//@rel": ["next"],
    "//nav//@class": ["x list", "on"],
    ".//@rel": ["next"],
    "li | //h1": ["H"],
    "//table": [],
    # existence and values
    "//div[a]/@class": ["post-old"],
    "//div[p]/h1": ["H"],
    "//div[.//p]/@class": ["post featured", "inner"],
    "//nav[ul/li]/@id": ["menu"],
    "//*[ul/*/@class]/@id": ["menu"],
    "//div[not(h1)]/@class": ["inner", "post-old"],
    "//div[not(.//p) and a]/@class": ["post-old"],
    "//li[not(@class)]": ["a", "c"],
    "//li[not(@class='on') and not(text()='c')]": ["a"],
    "//li[@class!='on']": [],
    "//li[text()='b']": ["b"],
    "//p[text()=' two']": ["one "],
    "//p[.='one bold two']": ["one "],
    "//p[normalize-space( . ) = 'one bold two' or not(text())]": ["one ", None],
    "//p[contains(text(),'one')]": ["one "],
    "//p[contains(.,'bold')]": ["one "],
    "//p[starts-with(normalize-space(),'deep')]": ["deep"],
    "//p[b='bold']": ["one "],
    "//p[text()]": ["one ", "deep"],
    "//div[a/@href='/u']/@class": ["post-old"],
    "//div[@class='nope' or a]/a[2]": ["M"],
    # siblings
    "//h1/following-sibling::p": ["one ", None],
    "//h1/following-sibling::p[1]": ["one "],
    "//h1/following-sibling::*[1]": ["one "],
    "//li/following-sibling::li[1]": ["b", "c"],
    "//p/preceding-sibling::h1": ["H"],
    "//p/preceding-sibling::*[1]/@class": ["inner"],
    "//li[@class]/preceding-sibling::li": ["a"],
    "//div[@class='inner']/preceding-sibling::p/b": ["bold"],
    "//h1/following-sibling::div[@class='inner']//p": ["deep"],
    "//title/following-sibling::p": [],
    # places
    "//li[not(@class)][2]": ["c"],
    "//li[not(@class)][last()]": ["c"],
    "//div[starts-with(@class,'post')][2]/a[1]": ["L"],
    "//li[position()<3]": ["a", "b"],
    "//li[position()>=2]": ["b", "c"],
    "//li[position()!=2]": ["a", "c"],
    "//li[position()=last()]": ["c"],
    "//li[position() < last()]": ["a", "b"],
    "//li[last()-1]": ["b"],
    "//li[last() - 7]": [],
    "//li[0]": [],
    "//li[@class or position()=3]": ["b", "c"],
    "/html/body/*[1]/@id": ["menu"],
    "//*[2]": [None, "b", None, "one ", "M"],
    "//p[@a][2]": [],
    "(//a)[1]": ["L"],
    "(//a)[last()]/@href": ["it's"],
    "(//li)[position()>1]": ["b", "c"],
    "(//h1 | //title)[2]": ["H"],
    "(//ul)[1]/li[2]": ["b"],
    "(//div)[2]//p": ["deep"],
    "(//div[h1])[1]/p[1]/text()": ["one "],
    "(//a)[3]": [],
    "(//a)[1] | //h1": ["H", "L"],
}


@pytest.mark.parametrize("expression", CASES)
def test_select(parsed, expression):
    rows = select_xpath(parsed, {"x": expression}).filter("page_id = 1").orderBy("nid").collect()
    assert [r.value for r in rows] == CASES[expression]


UNSUPPORTED = [
    "count(//p)", "", "//p[", "//a//following-sibling::b", "//a/@x | //b", "/@href", "/text()", "//text()", "//a | ", "//li[2][@a",
    "//div/", "//a[@b and]", "(//a)", "(//a[1]", "//p[count(a)=1]", "//p[not(not(@a))]", "//p[a[@b]]", "following-sibling::p",
    "//p/following-sibling::a[2]", "//p/following-sibling::a[@b][1]", "//p/following-sibling::a[position()<2]", "//p/..", "//p/ancestor::div",
    "(//a)[@b]", "(//a/@href)[1]", "//p[2 and @a]", "//p[string-length(.)>1]",
]


@pytest.mark.parametrize("expression", UNSUPPORTED)
def test_unsupported_matches_nothing_and_says_why(spark, parsed, expression):
    assert not compile_xpath(expression).supported
    assert select_xpath(parsed, {"x": expression, "ok": "//h1"}).filter("name = 'x'").count() == 0
    assert unsupported_xpaths(spark, {"x": expression, "ok": "//h1"}).count() == 1


def test_schemas_are_checked_by_the_grammar_of_the_compiler(spark):
    more = ["h1", "//h1 | //footer", "//a[@href='x[1]']", "//a[ @b = 'c' ][@d]", "//p[2][@a]", "//p[@a and 2]", "//p[ last() - 1 ][a]", "//a[not( @b='x y' )]", "( //a | .//b )[ position() <= 2 ]//c[1]/@d", "//p[.//a/@b != 'c']", " //p ", "@id",
            "./@id", "./text()", "//a[@x='it and b' or @y]", "//a['x']", "//a[@b='x\"y']", "//a//b//@c", "a/b", "//a//text()"]
    expressions = [*CASES, *UNSUPPORTED, *more]
    rows = spark.createDataFrame([(1, i, "n", x) for i, x in enumerate(expressions)],
                                 "schema_id int, position int, name string, xpath string")
    bad = {r.position for r in validate_schema(rows).collect()}
    assert {expressions[i] for i in bad} == {x for x in expressions if not compile_xpath(x).supported}


def test_own_xpath_selects_exactly_the_node(parsed):
    nodes = page_nodes(parsed, "nid", "xpath").collect()
    for page in (1, 2):
        paths = {r.xpath: r.nid for r in nodes if r.page_id == page}
        found = select_xpath(parsed.filter(F.col("page_id") == page), {p: p for p in paths}).collect()
        assert {(r.name, r.nid) for r in found} == set(paths.items()) and len(found) == len(paths)


def test_text_and_runs(parsed):
    rows = xpath_text(parsed, "//p").filter("page_id = 1").orderBy("nid").collect()
    assert [r.text for r in rows] == ["one bold two", "deep", ""]
    assert page_runs(parsed).filter("page_id = 2").first().runs == ["x"]


def test_suggestions(parsed):
    rows = suggest_xpath(parsed, "DEEP").filter("page_id = 1").orderBy("rank").collect()
    assert [r.xpath for r in rows] == ["/html", "/html/body", "/html/body/div[1]", "/html/body/div[1]/div", "/html/body/div[1]/div/p"]
    assert suggest_xpath(parsed, "deep", window=3).filter("page_id = 1").count() == 0


def test_failed_pages_keep_their_row(parsed):
    row = parsed.filter("page_id = 3").first()
    assert row.nodes is None and row.error == "No HTML content available"


def test_only_requested_fields_and_kept_columns(pages_of):
    parsed = parse_pages(pages_of("<p>a", "<p>b"), ["tag", "nid"], keep=["url"])
    assert parsed.schema["nodes"].dataType.elementType.names == ["nid", "tag"]
    assert {(r.page_id, r.url) for r in parsed.collect()} == {(1, "http://h/1"), (2, "http://h/2")}


def trees():
    """Random nestings of three tags with classes and texts."""
    draw = random.Random(11)
    pages = []
    for _ in range(25):
        parts, opened = [], []
        for k in range(draw.randrange(5, 60)):
            if opened and draw.random() < 0.4:
                parts.append(f"</{opened.pop()}>")
            else:
                opened.append(draw.choice(["div", "section", "span"]))
                parts.append(f"<{opened[-1]}{draw.choice(['', ' class=a', ' class=b'])}>{draw.choice(['', 'x', 'y'])}")
        pages.append("<body>" + "".join(parts))
    return pages


class Tree:
    """The same page walked element by element."""

    def __init__(self, page):
        scan = PageScan(page)
        self.all = list(range(1, len(scan.tag) + 1))
        self.tag = dict(zip(self.all, scan.tag))
        self.parent = dict(zip(self.all, scan.parent))
        self.cls = {n: a.get("class") for n, a in zip(self.all, scan.attrs)}
        self.text = dict(zip(self.all, scan.own_texts()))

    def above(self, n):
        while n := self.parent[n]:
            yield n

    def children(self, n, tag=None):
        return [c for c in self.all if self.parent[c] == n and tag in (None, self.tag[c])]

    def has(self, n, tag):
        return bool(self.children(n, tag))

    def named(self, tag, cls=None):
        return [n for n in self.all if self.tag[n] == tag and (cls is None or self.cls[n] == cls)]

    def place(self, n, among):
        return [c for c in self.children(self.parent[n]) if c in among].index(n) + 1


WALKS = {
    "//div//span": lambda t: [n for n in t.named("span") if any(t.tag[a] == "div" for a in t.above(n))],
    "//div//div//span/*": lambda t: [n for n in t.all if t.parent[n] and t.tag[t.parent[n]] == "span"
                                     and sum(t.tag[a] == "div" for a in t.above(t.parent[n])) >= 2],
    "//div[@class='a']//section/span": lambda t: [
        n for n in t.named("span") if t.tag[t.parent[n]] == "section" and any(t.tag[a] == "div" and t.cls[a] == "a" for a in t.above(t.parent[n]))],
    "//div//@class": lambda t: [n for n in t.all if t.cls[n] and (t.tag[n] == "div" or any(t.tag[a] == "div" for a in t.above(n)))],
    "//div[span]": lambda t: [n for n in t.named("div") if t.has(n, "span")],
    "//div[not(.//section/span)]": lambda t: [
        n for n in t.named("div") if not any(t.tag[t.parent[m]] == "section" and n in t.above(t.parent[m]) for m in t.named("span"))],
    "//*[text()='y']": lambda t: [n for n in t.all if "y" in t.text[n]],
    "//span[@class='b']/following-sibling::div": lambda t: [
        n for n in t.named("div") if any(m < n and t.parent[m] == t.parent[n] for m in t.named("span", "b"))],
    "//span/following-sibling::*[1]": lambda t: [
        n for n in t.all if (before := [c for c in t.children(t.parent[n]) if c < n]) and t.tag[before[-1]] == "span" and t.parent[n]],
    "//div/preceding-sibling::span[1]": lambda t: [
        n for n in t.named("span") if any(
            m > n and t.parent[m] == t.parent[n] and not any(n < o < m and t.parent[o] == t.parent[n] for o in t.named("span")) for m in t.named("div"))],
    "//div[@class='a'][2]": lambda t: [n for n in t.named("div", "a") if t.place(n, t.named("div", "a")) == 2],
    "//span[@class][last()-1]": lambda t: [
        n for n in t.named("span") if t.cls[n] and len(same := [c for c in t.children(t.parent[n], "span") if t.cls[c]]) > 1 and same[-2] == n],
    "(//div//span)[position()>2]": lambda t: [n for n in t.named("span") if any(t.tag[a] == "div" for a in t.above(n))][2:],
    "(//section)[last()]/*[2]": lambda t: [n for s in t.named("section")[-1:] for n in t.children(s)[1:2]],
}


def test_random_trees_agree_with_a_walk(spark):
    pages = trees()
    table = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")
    rows = select_xpath(parse_pages(table), {x: x for x in WALKS}).collect()
    for x, walk in WALKS.items():
        want = [(i, n) for i, page in enumerate(pages) for n in walk(Tree(page))]
        assert sorted((r.page_id, r.nid) for r in rows if r.name == x) == want, x


def test_contexts_cost_linear_time(spark):
    """Contexts beside each other, and each inside the one before."""

    def seconds(n):
        pages = ["<div>" * n + "<p>x" + "</div>" * n + "<p>y", "<div><p>x</p></div>" * n]
        table = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")
        parsed = parse_pages(table, ("nid", "parent_nid", "last_nid", "tag", "idx", "n_same")).persist()
        best = float("inf")
        for _ in range(3):
            start = time.perf_counter()
            for x, want in {"//div//p": (1, n), "//div//div//p": (1, 0), "//div[.//p]": (n, n), "//div[p]/p[1]": (1, n)}.items():
                got = parsed.selectExpr("page_id", f"size({compile_xpath(x).select()}) AS n").orderBy("page_id").collect()
                assert tuple(r.n for r in got) == want, x
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(16_000) < 4 * 2.2 * seconds(4_000)
