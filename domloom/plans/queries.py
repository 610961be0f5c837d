"""The registered queries: each operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domloom.functions.markdown import html_to_markdown, markdown_escape
from domloom.functions.responses import (
    MODES,
    extract_fenced_code,
    fix_json_bools,
    review_suggestions,
    salvage_json,
)
from domloom.functions.text import body_content, text_content, truncate_html
from domloom.functions.urls import markdown_filename, result_filename, url_valid
from domloom.operators import extract as ex
from domloom.operators import lint, profile, runstate
from domloom.operators import schema as sc
from domloom.operators import structure as st
from domloom.operators.nodes import PATH_FIELDS, node_rows, node_text, page_nodes, parse_pages
from domloom.operators.schema import Section
from domloom.operators.xpath import common_xpath as paths_in_common
from domloom.operators.xpath import fields_for, select_xpath, suggest_xpath, xpath_text
from domloom.plans import inputs
from domloom.plans.flows import to_markdown
from domloom.session import checkpointed, shared_dir
from domloom.sources import sinks, urls
from domloom.sources.page_files import write_page_files
from domloom.sources.pages import list_html_dir, load_changed, load_html_dir, with_identifier
from domloom.sources.steps import StepStore
from domloom.streaming.incremental import incremental_extract

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        return function

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# The schema the extraction queries apply.
SECTIONS = (
    Section("title", "//h1", type="title"),
    Section("doc_title", "/html/head/title", type="title"),
    Section("links", "//nav/ul/li/a", is_list=True),
    Section("paragraphs", "//article/p", is_list=True, type="body"),
    Section("ad", "//div[@class='ad']"),
    Section("footer", "//footer"),
    Section("subtitle", "//h2"),
    Section("tags", "//ul[@id='tags']/li", is_list=True),
    Section("later", None),
)
FALLBACK_SECTIONS = (
    Section("heading", "//h2", xpath_list=("//h2", "//article/h1", "//title")),
    Section("main_text", "//article/p", is_list=True, xpath_list=("//main/p",)),
    Section("closing", "//footer", xpath_list=("//div[@class='ad']",)),
)
XPATHS = {
    "headings": "//h1",
    "links": "/html/body/nav/ul/li/a",
    "hrefs": "//nav//a/@href",
    "second_item": "//ul/li[2]/a",
    "last_item": "//li[last()]/a",
    "ad": "//div[@class='ad']",
    "ad_token": "//*[contains(concat(' ', normalize-space(@class), ' '), ' ad ')]",
    "bold": "//article//b",
    "title_text": "//title/text()",
    "ends": "//h1 | //footer",
    "none": "//section/p",
    "with_items": "//ul[li/a]",
    "bare_items": "//li[not(@class) and a]",
    "after_heading": "//h1/following-sibling::p",
    "next_to_heading": "//article/h1/following-sibling::p[1]",
    "own_text": "//a[text()='The' or @href='/and']",
    "first_ad": "//div[@class='ad'][1]",
    "early_items": "//li[position()<3]/a",
    "first_of_page": "(//a)[1]",
    "first_in_body": "/html/body/*[1]",
    "below_nested": "//body//ul//a",
    "unsupported": "//a/ancestor::nav",
}

#: What a schema can ask for that no page will give.
OUT_OF_REACH = (
    Section("heading", "//h1"),
    Section("menu", "//a/ancestor::nav", xpath_list=("//li/..",)),
    Section("words", "count(//p)", is_list=True),
)


# A character that page text does not hold.
SEPARATOR = "\x1f"


def _joined(values: Column, sep: str = "|") -> Column:
    return F.array_join(values, sep)


def _long(extracted: DataFrame, *keep: str) -> DataFrame:
    return ex.extractions(extracted, *keep).select(
        "page_id", *keep, "section", "is_list", "value",
        _joined(F.col("values"), SEPARATOR).alias("values"), F.size("values").alias("n_values"), "source_xpath",
    ).withColumn("n_values", F.when(F.col("is_list"), F.col("n_values")))


# -- sources and sinks ---------------------------------------------------------------------


@query("load_pages")
def load_pages(spark, sf):
    return with_identifier(inputs.pages(spark, sf)).select(
        "page_id", "identifier", F.length("html").cast("bigint").alias("n_chars")
    )


def _page_files(spark, sf, content: Column) -> str:
    """The folder of a file for each page that has text: ``content``, which is binary, and a line end.

    Numbers of rows by their place in the scan name the files, as page ids may repeat.
    """
    path = shared_dir(spark, "html")
    pages = inputs.table(spark, sf, "pages").where("html <> ''").select(
        F.concat(F.lit("page-"), F.monotonically_increasing_id(), F.lit(".txt")).alias("file"),
        F.concat(content, F.lit(b"\n")).alias("content"))
    write_page_files(pages, path, "file", "content")
    return path


@query("load_html_dir")
def load_html_files(spark, sf):
    """Every page as a file of its own, each seventh with a byte that is not UTF-8, read back."""
    broken = F.concat(F.col("html").cast("binary"), F.lit(b"\xff"))
    path = _page_files(spark, sf, F.when(F.col("page_id") % 7 == 0, broken).otherwise(F.col("html").cast("binary")))
    files = load_html_dir(spark, path, "*.txt")
    return files.groupBy(F.md5(F.col("html").cast("binary")).alias("html_md5"), "error").agg(F.count("*").alias("n_files"))


def _url_lines(spark, sf):
    return inputs.page_urls(spark, sf).select(
        F.col("page_id").alias("line_no"), F.expr(inputs.URL_LINES).alias("line")
    )


@query("load_urls")
def load_urls(spark, sf):
    return urls.load_urls(_url_lines(spark, sf))


@query("rejected_urls")
def rejected_urls(spark, sf):
    return urls.rejected_urls(_url_lines(spark, sf))


@query("url_valid")
def url_valid_check(spark, sf):
    return inputs.page_urls(spark, sf).select("page_id", F.expr(inputs.URL_FORMS).alias("candidate")).withColumn(
        "valid", url_valid(F.col("candidate"))
    )


def _named(spark, sf, forms: str):
    return urls.name_files(
        inputs.page_urls(spark, sf).select(
            "page_id", (F.col("page_id") + 1).alias("position"), F.expr(forms).alias("url")
        )
    )


@query("url_filename")
def url_filename(spark, sf):
    return _named(spark, sf, inputs.NAMED_URLS).select("page_id", "url", "filename")


@query("filename_dedup")
def filename_dedup(spark, sf):
    return urls.dedupe_filenames(_named(spark, sf, inputs.CROWDED_URLS)).select("page_id", "natural", "filename")


@query("attach_url")
def attach_url(spark, sf):
    named = urls.dedupe_filenames(_named(spark, sf, "url"))
    files = named.select(
        "page_id",
        F.when(F.col("url").contains("spam-farm"), F.concat(F.lit("lost_"), "filename"))
        .otherwise(F.col("filename"))
        .alias("name"),
    )
    return urls.attach_url(files, named).select("page_id", "name", "url", "matched")


@query("fetch_backlog")
def fetch_backlog(spark, sf):
    pages = inputs.page_urls(spark, sf)
    wanted = pages.select(F.explode(F.array("url", F.expr(inputs.BARE))).alias("url"))
    return urls.fetch_backlog(wanted, pages)


@query("fetch_coverage")
def fetch_coverage(spark, sf):
    return fetch_backlog(spark, sf).groupBy("fetched").agg(
        F.count("*").alias("urls"), F.sum("n_lines").alias("n_lines")
    )


@query("result_filename")
def result_filenames(spark, sf):
    names = inputs.page_urls(spark, sf).select("page_id", F.expr(inputs.FILE_NAMES).alias("name"))
    result = result_filename(F.col("name"))
    return names.select("page_id", "name", result.alias("result_file")).withColumn(
        "markdown_file", markdown_filename(F.col("result_file"))
    )


def _records(spark, sf):
    extracted = ex.extract(inputs.varied_pages(spark, sf), SECTIONS)
    return ex.extraction_records(extracted, SECTIONS).withColumn("result_file", _result_name())


def _page_name() -> Column:
    return F.concat(F.lit("page_"), F.col("page_id"), F.lit(".html"))


def _result_name() -> Column:
    return result_filename(_page_name())


@query("write_extractions")
def write_extractions(spark, sf):
    path = shared_dir(spark, "extractions")
    sinks.write_extractions(_records(spark, sf), path)
    stored = sinks.read_extractions(spark, path)
    field = lambda name: F.get_json_object("record", f"$.{name}")
    return stored.select(
        "page_id", "result_file", field("title").alias("title"), field("footer").alias("footer"),
        field("links[1]").alias("second_link"),
    )


@query("write_markdown")
def write_markdown(spark, sf):
    path = shared_dir(spark, "markdown")
    documents = _markdown(spark, sf).withColumn("markdown_file", markdown_filename(_result_name()))
    sinks.write_markdown(documents, path)
    return spark.read.parquet(path).select("page_id", "markdown_file", "markdown")


@query("markdown_files")
def markdown_files(spark, sf):
    """One Markdown file per page, read back by name."""
    path = shared_dir(spark, "files")
    documents = _markdown(spark, sf).withColumn("markdown_file", markdown_filename(_result_name()))
    sinks.write_markdown_files(documents, path)
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_name").alias("markdown_file"), F.col("value").alias("markdown"))


@query("changed_files")
def changed_files(spark, sf):
    """Every page as a file of its own; those of odd length were another length when last read."""
    path = _page_files(spark, sf, F.col("html").cast("binary"))
    done = list_html_dir(spark, path, "*.txt").withColumn("bytes", F.col("bytes") + F.col("bytes") % 2)
    files = load_changed(spark, path, done, "*.txt")
    return files.groupBy(F.md5(F.col("html").cast("binary")).alias("html_md5"), "bytes").agg(F.count("*").alias("n_files"))


@query("step_tables")
def step_tables(spark, sf):
    store = StepStore(spark, shared_dir(spark, "steps"))
    store.save(1, "text_analysis", _sections(spark, sf, inputs.pages(spark, sf)))
    found = store.load(1, "text_analysis")
    assert store.load(1, "schema") is None and store.exists(1, "text_analysis")
    return found.groupBy("section").agg(F.count("*").alias("n_rows"))


# -- nodes, XPath, text --------------------------------------------------------------------


@query("page_nodes")
def page_nodes_all(spark, sf):
    return node_rows(inputs.pages(spark, sf), "nid", "parent_nid", "depth", "tag", "gpath", "text_head")


@query("tag_counts")
def tag_counts(spark, sf):
    parsed = parse_pages(inputs.pages(spark, sf), ("tag",))
    return page_nodes(parsed).groupBy("tag").agg(F.count("*").alias("n"))


@query("node_text_full")
def node_text_full(spark, sf):
    """Text of the elements between body and paragraphs, from the slices of the text runs."""
    parsed = parse_pages(inputs.pages(spark, sf), ("nid", "tag", "run_start", "run_end"))
    rows = parsed.select("page_id", F.inline(F.transform(
        "nodes", lambda n: F.struct(n["nid"].alias("nid"), n["tag"].alias("tag"), node_text(n).alias("text"))
    )))
    return rows


@query("node_outer_html")
def node_outer_html(spark, sf):
    """Outer HTML of navigation and headings by the source offsets of their nodes."""
    parsed = parse_pages(inputs.pages(spark, sf), ("tag", "html_start", "html_end"), keep=["html"])
    cut = F.transform(
        F.filter("nodes", lambda n: n["tag"].isin("nav", "h1")),
        lambda n: F.struct(
            n["tag"].alias("tag"),
            F.substring(F.col("html"), n["html_start"] + 1, n["html_end"] - n["html_start"]).alias("outer_html"),
        ),
    )
    return parsed.select("page_id", F.inline(cut))


@query("text_content")
def text_contents(spark, sf):
    return inputs.pages(spark, sf).select("page_id", text_content("html").alias("text"))


@query("body_content")
def body_contents(spark, sf):
    return inputs.pages(spark, sf).select("page_id", body_content("html").alias("body"))


@query("node_xpath")
def node_xpath(spark, sf):
    return node_rows(inputs.pages(spark, sf), "nid", "xpath")


@query("select_xpath")
def select_xpaths(spark, sf):
    parsed = parse_pages(inputs.pages(spark, sf), fields_for(XPATHS.values(), *PATH_FIELDS))
    return select_xpath(parsed, XPATHS)


@query("unsupported_xpaths")
def unsupported_sections(spark, sf):
    return ex.unmatched_sections(ex.extract(inputs.pages(spark, sf), OUT_OF_REACH, fallback=True))


@query("xpath_text")
def xpath_texts(spark, sf):
    parsed = parse_pages(inputs.pages(spark, sf), fields_for(["//li"], "run_start", "run_end"))
    return xpath_text(parsed, "//h1 | //li | //footer")


@query("common_xpath")
def common_xpath(spark, sf):
    return paths_in_common(node_rows(inputs.pages(spark, sf), "tag", "xpath"), "tag")


@query("suggest_xpath")
def suggest_xpaths(spark, sf):
    parsed = parse_pages(inputs.pages(spark, sf), (*PATH_FIELDS, "run_start", "run_end"))
    return suggest_xpath(parsed, "The")


@query("truncate_html")
def truncate_pages(spark, sf):
    return inputs.table(spark, sf, "documents").select(
        "doc_id", truncate_html("text", 500).alias("text_cut")
    )


# -- structure -----------------------------------------------------------------------------


def _sections(spark, sf, pages):
    return st.page_sections(parse_pages(pages, st.SECTION_FIELDS))


def _variants(spark, sf):
    return st.section_variants(_sections(spark, sf, inputs.varied_pages(spark, sf)))


@query("page_sections")
def page_sections(spark, sf):
    return _sections(spark, sf, inputs.varied_pages(spark, sf)).select(
        "page_id", "error", "section", "type", "xpath", "is_list", "list_xpath", "content_sample",
        "n_matches", F.col("attributes")["class"].alias("cls"),
    )


@query("class_id_patterns")
def class_id_patterns(spark, sf):
    pages = inputs.pages(spark, sf)
    return st.class_id_patterns(parse_pages(pages, ("cls", "id")), inputs.table(spark, sf, "pages"))


@query("structural_patterns")
def structural_patterns(spark, sf):
    pages = inputs.pages(spark, sf)
    return st.structural_patterns(node_rows(pages, "gpath", "gseq"), inputs.table(spark, sf, "pages"))


@query("repeating_patterns")
def repeating_patterns(spark, sf):
    return st.repeating_patterns(parse_pages(inputs.pages(spark, sf), (*PATH_FIELDS, "attrs", "alike", "n_alike")))


@query("layout_roles")
def layout_roles(spark, sf):
    layout = st.layout_roles(parse_pages(inputs.varied_pages(spark, sf), st.LAYOUT_FIELDS))
    return layout.select(
        "page_id", "nid", "name", "type", "position", "xpath",
        _joined(F.col("likely_xpath_hints")).alias("hints"),
    )


@query("layout_summary")
def layout_summary(spark, sf):
    return st.layout_summary(st.layout_roles(parse_pages(inputs.varied_pages(spark, sf), st.LAYOUT_FIELDS)))


def _for_both(spark, sf):
    return parse_pages(inputs.varied_pages(spark, sf), (*st.SECTION_FIELDS, *st.LAYOUT_FIELDS))


@query("merge_analyses")
def merge_analyses(spark, sf):
    return st.merge_analyses(_for_both(spark, sf))


@query("merge_without_layout")
def merge_without_layout(spark, sf):
    return st.merge_analyses(_for_both(spark, sf), layout=False)


@query("common_patterns")
def common_patterns(spark, sf):
    return st.common_patterns(_variants(spark, sf), inputs.table(spark, sf, "pages"), threshold=0.9)


@query("xpath_coverage")
def xpath_coverage(spark, sf):
    return st.xpath_coverage(_variants(spark, sf), inputs.table(spark, sf, "pages"))


@query("inconsistencies")
def inconsistencies(spark, sf):
    return st.inconsistencies(_variants(spark, sf), inputs.table(spark, sf, "pages"))


@query("missing_pages")
def missing_pages(spark, sf):
    parsed = parse_pages(inputs.varied_pages(spark, sf), st.SECTION_FIELDS)
    return st.missing_sections(parsed, ["title", "footer", "body", "header"])


@query("infer_schema")
def infer_schema(spark, sf):
    schema = sc.infer_schema(_variants(spark, sf), inputs.table(spark, sf, "pages"))
    return schema.select(
        "name", "type", "description", "xpath", _joined(F.col("xpath_list")).alias("xpath_list"), "is_list",
        F.col("attributes")["class"].alias("cls"), "notes",
    )


@query("schema_document")
def schema_document(spark, sf):
    document = sc.schema_document(sc.infer_schema(_variants(spark, sf), inputs.table(spark, sf, "pages")))
    get = lambda path: F.get_json_object("json", path)
    return document.select(
        get("$.schema_version").alias("schema_version"),
        get("$.metadata.total_sections").cast("bigint").alias("total_sections"),
        get("$.sections[0].name").alias("first_section"),
        get("$.sections[1].xpath").alias("second_xpath"),
        get("$.sections[1].xpath_list[1]").alias("second_alternative"),
    )


def _hrefs() -> Column:
    return F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)


@query("simplify_schema")
def simplify_schema(spark, sf):
    def section(name, xpath, alternatives, is_list):
        return F.struct(
            F.lit(name).cast("string").alias("name"), F.col("url").alias("description"), xpath.alias("xpath"),
            alternatives.alias("xpath_list"), F.lit(is_list).cast("boolean").alias("is_list"),
        )

    links = F.col("links")
    sections = F.array(
        section("same", F.get(links, F.lit(0)), links, True),
        section("other", F.lit("//nav"), links, False),
        section(None, F.lit(None).cast("string"), F.lit(None).cast("array<string>"), None),
    )
    schemas = inputs.pages(spark, sf).select("page_id", "url", _hrefs().alias("links")).select(
        "page_id",
        sc.simplify_schema(F.lit(None).cast("string"), F.col("url"), sections, max_chars=100).alias("s"),
    )
    return schemas.select("page_id", "s.schema_version", F.inline("s.sections")).withColumn(
        "xpath_list", _joined(F.col("xpath_list"))
    )


# -- extraction ----------------------------------------------------------------------------


@query("extract_sections")
def extract_sections(spark, sf):
    return _long(ex.extract(inputs.varied_pages(spark, sf), SECTIONS))


@query("extract_text_mode")
def extract_text_mode(spark, sf):
    return _long(ex.extract(inputs.varied_pages(spark, sf), SECTIONS, full_text=True))


@query("xpath_fallback")
def xpath_fallback(spark, sf):
    return _long(ex.extract(inputs.varied_pages(spark, sf), FALLBACK_SECTIONS, fallback=True))


@query("extraction_records")
def extraction_records(spark, sf):
    records = _records(spark, sf)
    record = F.col("record")
    return records.select(
        "page_id",
        *[record[n].alias(n) for n in ("title", "doc_title", "ad", "footer", "subtitle")],
        *[_joined(record[n], SEPARATOR).alias(n) for n in ("links", "paragraphs", "tags")],
        ex.record_json(record).startswith('{"title":').alias("json_has_title"),
    )


def _status(spark, sf):
    return ex.extract_status(ex.extract(inputs.varied_pages(spark, sf), SECTIONS), _page_name())


@query("extract_status")
def extract_status(spark, sf):
    return _status(spark, sf)


@query("extraction_summary")
def extraction_summary(spark, sf):
    return ex.status_summary(_status(spark, sf))


@query("schema_transfer")
def schema_transfer(spark, sf):
    pages = inputs.varied_pages(spark, sf).withColumn(
        "role", F.when(F.col("url").contains("/en/"), "learning").otherwise("spread")
    )
    learning = pages.filter(F.col("role") == "learning")
    schema = sc.infer_schema(st.section_variants(_sections(spark, sf, learning)), learning)
    sections = sc.collect_schema(schema)
    long = ex.extractions(ex.extract(pages, sections, full_text=True, keep=["role"]), "role")
    return ex.fill_rates(long, "role")


# -- validation ----------------------------------------------------------------------------


@query("validate_schema")
def validate_schema(spark, sf):
    link = F.posexplode(F.arrays_zip(
        _hrefs().alias("href"),
        F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]*)</a>'), 1).alias("label"),
    ))
    rows = inputs.pages(spark, sf).select(F.col("page_id").alias("schema_id"), link.alias("position", "link")).select(
        "schema_id", "position",
        F.when(F.length("link.label") > 2, F.col("link.label")).alias("name"),
        F.when(F.length("link.label") == 3, F.lit(""))
        .when(F.length("link.label") == 4, F.concat(F.lit("//a[@href='"), "link.href", F.lit("'")))
        .otherwise(F.concat(F.lit("//a[@href='"), "link.href", F.lit("']")))
        .alias("xpath"),
        F.lit(5).alias("total_sections"),
    )
    return sc.validate_schema(rows).select("schema_id", "position", "type", "severity")


@query("validate_extractions")
def validate_extractions(spark, sf):
    pages = inputs.varied_pages(spark, sf)
    stored = ex.extractions(ex.extract(pages, SECTIONS))
    broken = (
        stored.filter(~((F.col("section") == "ad") & (F.length("value") > 60)))
        .withColumn("values", F.when(~((F.col("section") == "links") & (F.size("values") == 4)), F.col("values")))
        .withColumn("section", F.when((F.col("section") == "footer") & F.col("value").isNull(), "closing").otherwise(F.col("section")))
    )
    return ex.validate_extractions(pages, SECTIONS, broken)


@query("code_lint")
def code_lint(spark, sf):
    return lint.code_lint(inputs.codes(spark, sf)).select(
        "subject_id", "check_group", "kind", "type", "severity", "line"
    )


@query("code_syntax")
def code_syntax(spark, sf):
    return lint.code_syntax(lint.code_facts(inputs.codes(spark, sf))).select("subject_id", "type", "line")


@query("code_interface")
def code_interface(spark, sf):
    return lint.code_interface(lint.code_facts(inputs.codes(spark, sf))).select(
        "subject_id", "kind", "type", "severity"
    )


@query("fix_json_bools")
def fix_json_booleans(spark, sf):
    return inputs.codes(spark, sf).select("subject_id", fix_json_bools(F.col("code")).alias("code"))


@query("issue_rollup")
def issue_rollup(spark, sf):
    codes = inputs.codes(spark, sf)
    return lint.issue_rollup(codes, lint.all_issues(codes))


@query("top_issues")
def top_issues(spark, sf):
    # read twice, so parsed once
    issues = checkpointed(lint.all_issues(inputs.codes(spark, sf)))
    return lint.top_issues(issues).select(
        "subject_id", "check_group", "rank", "type", "total"
    )


@query("revalidation_diff")
def revalidation_diff(spark, sf):
    codes = inputs.codes(spark, sf)
    fixed = codes.withColumn("code", F.concat(F.lit("from lxml import etree\n"), fix_json_bools(F.col("code"))))
    return lint.revalidation_diff(lint.code_lint(codes), lint.code_lint(fixed))


# -- responses -----------------------------------------------------------------------------


@query("salvage_json")
def salvage_json_modes(spark, sf):
    rows = inputs.responses(spark, sf)
    for mode in MODES:
        rows = rows.withColumn(mode, salvage_json(F.col("text"), mode))
    return rows.select(
        "event_id",
        *[F.col(f"{m}.strategy").alias(f"{m}_strategy") for m in MODES],
        *[F.col(f"{m}.json").alias(f"{m}_json") for m in MODES],
    )


@query("extract_fenced_code")
def fenced_code(spark, sf):
    return inputs.reviews(spark, sf).select("subject_id", extract_fenced_code(F.col("review")).alias("code"))


@query("extract_reviewed_code")
def reviewed_code(spark, sf):
    return lint.settle_review(inputs.reviews(spark, sf))


@query("review_suggestions")
def suggestions(spark, sf):
    return inputs.reviews(spark, sf).select(
        "subject_id", F.posexplode(review_suggestions(F.col("review"))).alias("pos", "suggestion")
    )


# -- profiling and Markdown ----------------------------------------------------------------


@query("sample_records")
def sample_records(spark, sf):
    return profile.sample_records(_records(spark, sf)).select("page_id", F.col("record.title").alias("title"))


@query("field_profile")
def field_profile(spark, sf):
    return profile.field_profile(ex.extractions(ex.extract(inputs.varied_pages(spark, sf), SECTIONS)))


@query("content_hierarchy")
def content_hierarchy(spark, sf):
    found = profile.content_hierarchy(field_profile(spark, sf))
    return found.select(
        *[_joined(F.col(c)).alias(c) for c in ("main_content_fields", "metadata_fields", "structural_fields", "secondary")],
        "primary",
    )


@query("html_to_markdown")
def html_to_markdown_pages(spark, sf):
    return inputs.pages(spark, sf).select("page_id", html_to_markdown("html").alias("markdown"))


@query("markdown_escape")
def markdown_escaped(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", markdown_escape("text").alias("escaped"))


def _markdown(spark, sf):
    return to_markdown(ex.extract(inputs.varied_pages(spark, sf), SECTIONS), SECTIONS)


@query("records_to_markdown")
def records_to_markdown(spark, sf):
    return _markdown(spark, sf)


def _markdown_status(spark, sf):
    return ex.markdown_status(_markdown(spark, sf).withColumn("result_file", _result_name()))


@query("markdown_status")
def markdown_status(spark, sf):
    return _markdown_status(spark, sf)


@query("markdown_summary")
def markdown_summary(spark, sf):
    return ex.status_summary(_markdown_status(spark, sf))


# -- run state -----------------------------------------------------------------------------


@query("run_manifest")
def run_manifest(spark, sf):
    store = StepStore(spark, shared_dir(spark, "manifest"))
    store.save(1, "text_analysis", inputs.page_urls(spark, sf), {"pages": "all"})
    store.note(2, "schema", None)
    rows = store.manifest()
    stored = store.load(1, "text_analysis").agg(F.count("*").alias("n")).scalar()
    return rows.select("run_id", "step", F.when(F.col("payload").isNotNull(), stored).alias("rows"))


@query("next_run_id")
def next_run_id(spark, sf):
    return runstate.next_run_id(inputs.run_dirs(spark, sf))


@query("latest_state")
def latest_state(spark, sf):
    return runstate.latest_state(inputs.manifests(spark, sf), "user_id")


@query("completed_steps")
def completed_steps(spark, sf):
    steps = inputs.table(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("run_id"), F.expr(inputs.STEP_OF).alias("step")
    )
    return runstate.completed_steps(steps, "user_id")


def _done(pages: DataFrame, key: str) -> DataFrame:
    """What an earlier run did: stale French pages, fallback for German ones."""
    return pages.filter(~F.col("url").contains("/es/")).select(
        "page_id",
        F.when(F.col("url").contains("/fr/"), "stale").otherwise(runstate.content_key(F.col("html"))).alias("content_key"),
        F.lit(key).alias("schema_key"),
        F.col("url").contains("/de/").alias("fallback"),
    )


@query("pending_pages")
def pending_pages(spark, sf):
    pages = inputs.pages(spark, sf)
    key = runstate.schema_hash(SECTIONS)
    return runstate.pending_page_ids(pages, _done(pages, key), key)


@query("pending_pages_html")
def pending_pages_html(spark, sf):
    """The pages to resume with themselves, not only their ids."""
    pages = inputs.pages(spark, sf)
    key = runstate.schema_hash(SECTIONS)
    pending = runstate.pending_pages(pages, _done(pages, key), key)
    return pending.select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query("regenerate_fallback")
def regenerate_fallback(spark, sf):
    results = inputs.pages(spark, sf).select(
        F.col("page_id").alias("subject_id"),
        F.when(F.col("url").contains("#top"), F.lit("")).when(
            F.col("url").contains("/de/"), F.concat(F.lit("# fallback template: "), "url")
        ).otherwise(F.col("url")).alias("result"),
        F.when(F.col("url").contains("spam-farm"), "failed").otherwise("success").alias("status"),
    )
    return runstate.pending_results(results)


@query("incremental_extract")
def incremental_extraction(spark, sf):
    base = shared_dir(spark, "incremental")
    # a pattern of one name, as the table can be one file or a folder of files
    stream = incremental_extract(
        spark, f"{sf}/page[s].parquet", f"{base}/out", f"{base}/checkpoint", SECTIONS, glob="*"
    )
    stream.awaitTermination()
    return _long(spark.read.parquet(f"{base}/out"))

