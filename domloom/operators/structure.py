"""Page structure: sections of a page, regions of a page, and patterns across pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domloom.functions.columns import sql_let, sql_literal, sql_strip, tally
from domloom.operators.nodes import PATH_FIELDS, node_text_sql, path_sql
from domloom.operators.xpath import compile_xpath, fields_for
from domloom.session import checkpointed


@dataclass(frozen=True)
class SectionRule:
    """A kind of section and where to look for it; the first expression that matches wins."""

    section: str
    type: str
    description: str
    xpaths: tuple[str, ...]


def _token(name: str) -> str:
    return f"contains(concat(' ',normalize-space(@class),' '),' {name} ')"


def _tokens(*names: str) -> str:
    return f"//*[{' or '.join(map(_token, names))}]"


BODY = ("//article", "//main", "//*[@role='main']", _tokens("content", "post", "entry-content", "article-body"))

SECTION_RULES: tuple[SectionRule, ...] = (
    SectionRule("title", "title", "Main heading or document title", ("//h1", "//title")),
    SectionRule("body", "body", "Main content", BODY),
    SectionRule("body_paragraphs", "body", "Paragraphs of the main content", tuple(f"{x}//p" for x in BODY)),
    SectionRule("comments", "comment", "Comment blocks", ("//*[contains(@class,'comment') or contains(@id,'comment')]",)),
    SectionRule("metadata", "metadata", "Author, date and tags",
                ("//meta[@name] | //time | " + _tokens("author", "byline", "date", "published", "tags"),)),
    SectionRule("navigation", "other", "Navigation block", ("//nav",)),
    SectionRule("nav_links", "other", "Navigation links", ("//nav//a",)),
    SectionRule("header", "other", "Page header", ("//header",)),
    SectionRule("footer", "other", "Page footer", ("//footer",)),
    SectionRule("aside", "other", "Side content", ("//aside",)),
    SectionRule("ad", "other", "Advertisement", (_tokens("ad"),)),
)

SECTION_FIELDS = fields_for(
    [x for r in SECTION_RULES for x in r.xpaths], *PATH_FIELDS, "run_start", "run_end", "attrs"
)


def _first_match(expressions: Sequence[str]) -> str:
    """SQL for the matches of the first expression that has any."""
    head, *rest = expressions
    hits = compile_xpath(head).select()
    if not rest:
        return hits
    return sql_let(hits, "h", f"CASE WHEN size(h) > 0 THEN h ELSE {_first_match(rest)} END")


def _section(rule: SectionRule, sample_chars: int) -> str:
    lead = "get(hits, 0)"
    row = f"""CASE WHEN size(hits) > 0 THEN struct(
        {sql_literal(rule.section)} AS section,
        {sql_literal(rule.type)} AS type,
        {sql_literal(rule.description)} AS description,
        {path_sql(lead)} AS xpath,
        paths[0] AS gpath,
        size(hits) > 1 AS is_list,
        CASE WHEN size(hits) > 1 THEN concat('/', paths[0]) END AS list_xpath,
        {lead}.attrs AS attributes,
        substring({sql_strip(node_text_sql(lead))}, 1, {sample_chars}) AS content_sample,
        size(hits) AS n_matches,
        paths AS gpaths) END"""
    paths = f"transform(hits, n -> {path_sql('n', indexed=False)})"
    return sql_let(_first_match(rule.xpaths), "hits", sql_let(paths, "paths", row))


def _sections_array(rules: Sequence[SectionRule], sample_chars: int) -> str:
    found = ", ".join(_section(r, sample_chars) for r in rules)
    return f"filter(array({found}), s -> s IS NOT NULL)"


def page_sections(
    parsed: DataFrame, rules: Sequence[SectionRule] = SECTION_RULES, sample_chars: int = 100
) -> DataFrame:
    """Sections found on each page, one row per page and section, without a shuffle.

    A page without any section, or one that failed to parse, keeps a row with a null
    ``section`` and its ``error``. ``gpaths`` holds the path of every match.
    """
    sections = _sections_array(rules, sample_chars)
    return parsed.selectExpr(
        "page_id", "error", f"inline_outer(CASE WHEN nodes IS NOT NULL THEN {sections} END)"
    )


def missing_sections(
    parsed: DataFrame, section_names: Sequence[str], rules: Sequence[SectionRule] = SECTION_RULES
) -> DataFrame:
    """Pages lacking any of the named sections, one row per page and section, in the row."""
    known = [r for r in rules if r.section in section_names]
    tests = ", ".join(
        f"CASE WHEN coalesce(size({_first_match(r.xpaths)}), 0) > 0 THEN {sql_literal(r.section)} END" for r in known
    )
    names = ", ".join(map(sql_literal, section_names))
    return parsed.selectExpr("page_id", f"explode(array_except(array({names}), array({tests}))) AS section")


# -- patterns over nodes ---------------------------------------------------------------


def class_id_patterns(parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """Class tokens and ids: occurrences, pages, support."""

    def tokens(kind: str, items: Column) -> Column:
        return F.transform(
            tally(items),
            lambda x: F.struct(F.lit(kind).alias("kind"), x["item"].alias("token"), x["seen"].alias("seen")),
        )

    nodes = F.col("nodes")
    ids = F.filter(F.transform(nodes, lambda n: n["id"]), lambda i: i.isNotNull())
    rows = parsed.select(
        F.inline(F.concat(
            tokens("class", F.flatten(F.transform(nodes, lambda n: n["cls"]))),
            tokens("id", ids),
        ))
    )
    counted = rows.groupBy("kind", "token").agg(
        F.count_if(~F.col("seen")).alias("occurrences"), F.count_if("seen").alias("pages")
    )
    return _with_support(counted, pages)


def structural_patterns(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Index-free paths: occurrences, pages, occurrences per page, support.

    ``rows`` are elements with ``gpath`` and ``gseq``, from ``node_rows``.
    """
    counted = rows.groupBy("gpath").agg(
        F.count("*").alias("occurrences"), F.count_if(F.col("gseq") == 1).alias("pages")
    )
    return _with_support(
        counted.withColumn("avg_per_page", F.col("occurrences") / F.col("pages")), pages
    )


def repeating_patterns(parsed: DataFrame, min_repeat: int = 3) -> DataFrame:
    """Siblings alike in tag and class that occur at least ``min_repeat`` times together."""
    groups = f"filter(nodes, n -> n.alike = 1 AND n.n_alike >= {int(min_repeat)})"
    # path and class in one string, because distinct strings are found by hashing
    path = path_sql("n", indexed=False)
    keys = F.expr(f"transform({groups}, n -> concat_ws(' ', {path}, coalesce(n.attrs['class'], '')))")
    sizes = F.expr(f"transform({groups}, n -> n.n_alike)")
    distinct = F.size(F.array_distinct(keys))
    # tally lists the distinct keys first, then one entry per group, in the order of sizes
    rows = parsed.select(F.posexplode(tally(keys)).alias("pos", "x"), sizes.alias("sizes"), distinct.alias("d")).select(
        F.split("x.item", " ", 2).alias("key"), "x.seen", F.get("sizes", F.col("pos") - F.col("d")).alias("size")
    )
    return (
        rows.groupBy(F.col("key")[0].alias("gpath"), F.col("key")[1].alias("cls"))
        .agg(
            F.count_if(~F.col("seen")).alias("groups"),
            F.sum(F.when(~F.col("seen"), F.col("size"))).alias("items"),
            F.count_if("seen").alias("pages"),
        )
    )


def _with_support(counted: DataFrame, pages: DataFrame) -> DataFrame:
    return counted.withColumn("support", F.col("pages") / page_total(pages))


def page_total(pages: DataFrame) -> Column:
    """Number of pages as a scalar subquery, which reads no column of the table."""
    return pages.select(F.count("*").alias("n")).scalar()


# -- regions ---------------------------------------------------------------------------

# What makes an element a region; the first role that applies wins.
REGION_ROLES: tuple[tuple[str, tuple[str, ...], str | None, str | None], ...] = (
    # role, tags, value of the role attribute, text in class or id
    ("header", ("header",), "banner", "header"),
    ("comment", (), None, "comment"),
    ("footer", ("footer",), "contentinfo", "footer"),
    ("sidebar", ("aside",), "complementary", "sidebar"),
    ("body", ("article", "main"), "main", None),
    ("other", ("nav", "section", "form"), "navigation", None),
)
MARKED_TAGS = ("div", "ul", "ol", "table")


def _region_role(n: str) -> str:
    cases = []
    for name, tags, aria, text in REGION_ROLES:
        tests = [f"{n}.tag IN ({', '.join(map(sql_literal, tags))})"] if tags else []
        if aria:
            tests.append(f"{n}.attrs['role'] <=> {sql_literal(aria)}")
        if text:
            tests.append(f"contains(marks, {sql_literal(text)})")
        cases.append(f"WHEN {' OR '.join(tests)} THEN {sql_literal(name)}")
    marked = ", ".join(map(sql_literal, MARKED_TAGS))
    cases.append(f"WHEN {n}.tag IN ({marked}) AND marks != '' THEN 'other'")
    marks = f"lower(concat_ws(' ', {n}.attrs['class'], {n}.id))"
    return sql_let(marks, "marks", f"CASE {' '.join(cases)} END")


def _regions() -> str:
    """SQL for the regions of a page; roles are settled before the rest is built."""
    region = """struct(
        x.n.nid AS nid, x.n.tag AS name, x.role AS type,
        CASE WHEN (x.n.nid - 1) * 3 < size(nodes) THEN 'top'
             WHEN (x.n.nid - 1) * 3 < size(nodes) * 2 THEN 'middle' ELSE 'bottom' END AS position,
        array(concat('elements=', x.n.last_nid - x.n.nid + 1), concat('depth=', x.n.depth)) AS characteristics,
        concat(transform(x.n.cls, c -> concat('.', c)),
               CASE WHEN x.n.id IS NULL THEN CAST(array() AS ARRAY<STRING>) ELSE array(concat('#', x.n.id)) END) AS likely_xpath_hints,
        %s AS gpath, %s AS xpath)""" % (path_sql("x.n", indexed=False), path_sql("x.n"))
    roles = f"transform(nodes, n -> struct(n, {_region_role('n')} AS role))"
    return f"transform(filter({roles}, x -> x.role IS NOT NULL), x -> {region})"


LAYOUT_FIELDS = (*PATH_FIELDS, "last_nid", "attrs", "cls", "id")


def layout_roles(parsed: DataFrame) -> DataFrame:
    """Regions of each page with role, vertical position and hints, from the markup alone.

    Position is the third of the document the region starts in.
    """
    return parsed.selectExpr("page_id", f"inline({_regions()})")


def layout_summary(layout: DataFrame) -> DataFrame:
    return layout.groupBy("type", "position").agg(F.count("*").alias("regions"))


def merge_analyses(
    parsed: DataFrame, layout: bool = True, rules: Sequence[SectionRule] = SECTION_RULES
) -> DataFrame:
    """Text and layout results side by side on the exact element; layout may be switched off.

    ``in_text`` and ``in_layout`` say which side a row comes from. Both analyses come from
    the same parsed row, so they meet inside it instead of in a join.
    """
    regions = _regions() if layout else "CAST(array() AS ARRAY<STRUCT<type: STRING, position: STRING, xpath: STRING>>)"
    both = parsed.selectExpr("page_id", f"{_sections_array(rules, 100)} AS sections", f"{regions} AS regions")
    of_section = """struct(s.xpath AS xpath, s.section AS section, s.type AS section_type, r.type AS region_type,
        r.position AS position, true AS in_text, r.type IS NOT NULL AS in_layout)"""
    alone = """struct(r.xpath AS xpath, CAST(NULL AS STRING) AS section, CAST(NULL AS STRING) AS section_type,
        r.type AS region_type, r.position AS position, false AS in_text, true AS in_layout)"""
    same = "get(filter(regions, r -> r.xpath = s.xpath), 0)"
    return both.selectExpr("page_id", f"""inline(concat(
        transform(sections, s -> {sql_let(same, 'r', of_section)}),
        transform(filter(regions, r -> NOT exists(sections, s -> s.xpath = r.xpath)), r -> {alone})))""")


# -- sections across pages -------------------------------------------------------------


def section_variants(sections: DataFrame) -> DataFrame:
    """The one aggregation everything below is derived from: section x path.

    Columns: ``pages`` with a match on the path, ``matches``, ``lead_pages`` where the path
    is the section's first match (so a section's ``lead_pages`` add up to its pages) and
    ``lead_list_pages`` of those with more than one match; ``cls`` is the class attribute
    when it is the same on all pages.
    """
    rows = sections.filter(F.col("section").isNotNull()).select(
        "section", "type", "description", "is_list",
        F.coalesce(F.col("attributes")["class"], F.lit("")).alias("cls"),
        F.posexplode(tally(F.col("gpaths"))).alias("pos", "path"),
    )
    lead = F.col("pos") == 0
    keys = ("section", "type", "description", "gpath")
    counts = ("pages", "matches", "lead_pages", "lead_list_pages")
    # Counts hash; minima and maxima of strings sort, so they see a row per distinct class.
    by_class = rows.groupBy(
        *keys[:3], F.col("path.item").alias("gpath"), F.when(lead, F.col("cls")).alias("cls")
    ).agg(
        F.count_if(F.col("path.seen")).alias("pages"),
        F.count_if(~F.col("path.seen")).alias("matches"),
        F.count_if(lead).alias("lead_pages"),
        F.count_if(lead & F.col("is_list")).alias("lead_list_pages"),
    )
    return (
        by_class.groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in counts], F.min("cls").alias("cls_low"), F.max("cls").alias("cls_high"))
        .withColumn("cls", F.when((F.col("cls_low") == F.col("cls_high")) & (F.col("cls_low") != ""), F.col("cls_low")))
        .drop("cls_low", "cls_high")
    )


def common_patterns(variants: DataFrame, pages: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Sections present on at least ``threshold`` of the pages."""
    return (
        variants.groupBy("section")
        .agg(F.sum("lead_pages").alias("pages"), F.sum("matches").alias("matches"))
        .withColumn("coverage", F.col("pages") / page_total(pages))
        .filter(F.col("coverage") >= threshold)
    )


def xpath_coverage(variants: DataFrame, pages: DataFrame) -> DataFrame:
    """Paths of each section with the share of pages they hit and their rank (1 = most pages).

    Equal page counts share a rank, so it follows from counting paths per page count: the
    window sees one row per distinct count, never the long tail of rare paths. ``variants``
    is read twice, so it is computed once and kept in the checkpoint folder.
    """
    variants = checkpointed(variants)
    by_count = variants.groupBy("section", "pages").agg(F.count("*").alias("n"))
    above = Window.partitionBy("section").orderBy(F.desc("pages")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranks = by_count.select(
        "section", "pages", (F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).alias("rank")
    )
    return variants.join(ranks, ["section", "pages"]).select(
        "section", F.concat(F.lit("/"), F.col("gpath")).alias("xpath"), "pages", "matches",
        (F.col("pages") / page_total(pages)).alias("coverage"),
        (F.col("matches") / F.col("pages")).alias("matches_per_page"),
        "rank",
    )


def inconsistencies(variants: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections missing on some pages, found at several paths, or list on some pages only.

    ``n`` is the number of pages, paths or list pages concerned.
    """
    per_section = variants.groupBy("section").agg(
        F.sum("lead_pages").alias("found"),
        F.count("*").alias("paths"),
        F.sum("lead_list_pages").alias("lists"),
    )
    missing = page_total(pages) - F.col("found")

    def kind(name: str, condition: Column, n: Column) -> Column:
        return F.when(condition, F.struct(F.lit(name).alias("kind"), n.cast("bigint").alias("n")))

    found = F.array(
        kind("missing_pages", F.col("missing") > 0, F.col("missing")),
        kind("path_variants", F.col("paths") > 1, F.col("paths")),
        kind("mixed_is_list", (F.col("lists") > 0) & (F.col("lists") < F.col("found")), F.col("lists")),
    )
    return per_section.withColumn("missing", missing).select(
        "section", F.inline(F.filter(found, lambda x: x.isNotNull()))
    )
