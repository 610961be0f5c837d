"""Applying a schema to pages.

All sections of a schema are evaluated against the parsed row of a page, so extraction is
one scan, one parse and no shuffle, whatever the number of sections or pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domloom.functions.columns import sql_let, sql_literal
from domloom.functions.urls import markdown_filename, result_filename
from domloom.operators.nodes import NO_CONTENT, parse_pages
from domloom.operators.schema import Section
from domloom.operators.xpath import compile_xpath, fields_for

EXTRACTION_TYPE = "section: string, is_list: boolean, value: string, values: array<string>, source_xpath: string, reason: string"


def usable(sections: Sequence[Section]) -> list[Section]:
    """Sections with an XPath; of equal names the last counts, as in a record keyed by name."""
    return list({s.name: s for s in sections if s.candidates}.values())


def unsupported(sections: Sequence[Section]) -> dict[str, str]:
    """Why a section can match nothing: the reason by name, for XPaths outside the subset."""
    return {s.name: compile_xpath(s.xpath).reason for s in usable(sections) if not compile_xpath(s.xpath).supported}


def schema_fields(sections: Sequence[Section], full_text: bool = False) -> tuple[str, ...]:
    extra = ("run_start", "run_end") if full_text else ()
    return fields_for([x for s in sections for x in s.candidates], *extra)


def _extraction(section: Section, full_text: bool, fallback: bool) -> str:
    """SQL for the entry of one section."""

    def attempt(expression: str) -> str:
        xp = compile_xpath(expression)
        texts = f"transform({xp.select()}, n -> {xp.value('n', full_text)})" if xp.supported else "CAST(array() AS ARRAY<STRING>)"
        return f"struct({texts} AS texts, {sql_literal(expression)} AS xpath)"

    def choose(candidates: Sequence[str]) -> str:
        head = attempt(candidates[0])
        if len(candidates) == 1:
            return head
        return sql_let(
            head, "a",
            f"CASE WHEN exists(a.texts, t -> coalesce(t, '') != '') THEN a ELSE {choose(candidates[1:])} END",
        )

    tried = section.candidates if fallback else section.candidates[:1]
    if section.is_list:
        shape = "CAST(NULL AS STRING) AS value, transform(a.texts, t -> coalesce(t, '')) AS values"
    else:
        shape = "get(a.texts, 0) AS value, CAST(NULL AS ARRAY<STRING>) AS values"
    row = (
        f"struct({sql_literal(section.name)} AS section, {str(section.is_list).lower()} AS is_list, "
        f"{shape}, CASE WHEN size(a.texts) > 0 THEN a.xpath END AS source_xpath, {sql_literal(_reason(tried))} AS reason)"
    )
    return sql_let(choose(tried), "a", row)


def _reason(expressions: Sequence[str]) -> str | None:
    """Why none of the expressions can match anything, if so."""
    reasons = [compile_xpath(x).reason for x in expressions]
    return f"{expressions[0]}: {reasons[0]}" if all(reasons) else None


def extract(
    pages: DataFrame,
    sections: Sequence[Section],
    full_text: bool = False,
    fallback: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per page: ``page_id, error, fields`` and the ``keep`` columns.

    ``fields`` is an array with one entry per section that has an XPath, matched or not: a
    scalar without a match is null, a list without one is empty and never null. ``fields``
    is null where the page has no content or failed to parse. An entry whose XPaths are all outside
    the supported subset says so in ``reason``. ``full_text`` takes all text
    inside a match instead of the text before its first child; ``fallback`` tries
    ``xpath_list`` in order until a candidate yields text.
    """
    wanted = usable(sections)
    parsed = parse_pages(pages, schema_fields(wanted, full_text), keep)
    entries = ", ".join(_extraction(s, full_text, fallback) for s in wanted)
    fields = f"CAST(array({entries}) AS ARRAY<STRUCT<{EXTRACTION_TYPE}>>)"
    return parsed.select(
        "page_id", "error", F.expr(f"CASE WHEN nodes IS NOT NULL THEN {fields} END").alias("fields"), *keep
    )


def extractions(extracted: DataFrame, *keep: str, reasons: bool = False) -> DataFrame:
    """Long form: one row per page and section; with ``reasons`` also why one cannot match.

    The outer form and a filter on its result: for a plain ``inline`` the optimizer would
    add a filter on the array's size, which evaluates every section a second time.
    """
    rows = extracted.select("page_id", *keep, F.inline_outer("fields"))
    rows = rows.filter(F.col("section").isNotNull())
    return rows if reasons else rows.drop("reason")


def unmatched_sections(extracted: DataFrame) -> DataFrame:
    """``(page_id, section, reason)`` of sections that could not be looked for on a page."""
    rows = extractions(extracted, reasons=True)
    return rows.where(F.col("reason").isNotNull()).select("page_id", "section", "reason")


def extract_sections(pages: DataFrame, sections: Sequence[Section], **options) -> DataFrame:
    """``(page_id, section, is_list, value, values, source_xpath)`` for every page."""
    return extractions(extract(pages, sections, **options))


def field_of(section: Section) -> Column:
    entry = F.get(F.filter(F.col("fields"), lambda f: f["section"] == section.name), F.lit(0))
    return entry["values"] if section.is_list else entry["value"]


def extraction_records(extracted: DataFrame, sections: Sequence[Section], *keep: str) -> DataFrame:
    """One record per page with a typed column per section; ``{}`` pages have a null record."""
    wanted = usable(sections)
    record = F.struct(*[field_of(s).alias(s.name) for s in wanted])
    return extracted.select(
        "page_id", "error", *keep, F.when(F.col("fields").isNotNull(), record).alias("record")
    )


def record_json(record: Column) -> Column:
    """A record as JSON with its nulls kept; ``{}`` for a page without one."""
    return F.coalesce(F.to_json(record, {"ignoreNullFields": "false"}), F.lit("{}"))


def extract_status(extracted: DataFrame, name: Column, read_error: Column | None = None) -> DataFrame:
    """Per page: ``success`` with the result file, or ``failed`` with the reason.

    ``read_error`` is why a file could not be read, from ``load_html_dir``.
    """
    error = F.col("error")
    if read_error is not None:
        error = F.coalesce(F.concat(F.lit("Failed to read file: "), read_error), error)
    failed = error.isNotNull()
    return extracted.select(
        "page_id",
        name.alias("file"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        error.alias("error"),
        F.when(~failed, result_filename(name)).alias("result_file"),
    )


def status_summary(status: DataFrame) -> DataFrame:
    """Totals of a status table; also serves the Markdown step."""
    return status.agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("status") == "success").alias("processed_files"),
        F.count_if(F.col("status") == "failed").alias("failed_files"),
    )


def markdown_status(documents: DataFrame) -> DataFrame:
    """Per record of ``(page_id, result_file, markdown)``: success or failed with the reason."""
    failed = F.col("markdown").isNull()
    return documents.select(
        "page_id",
        F.col("result_file").alias("json_file"),
        F.when(~failed, markdown_filename(F.col("result_file"))).alias("markdown_file"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(failed, F.lit(NO_CONTENT)).alias("error"),
    )


def fill_rates(long: DataFrame, *by: str) -> DataFrame:
    """Pages and filled pages per section (and ``by``): how well a schema transfers."""
    filled = F.coalesce(F.col("value"), F.lit("")) != ""
    listed = F.size(F.filter("values", lambda v: v != "")) > 0
    return (
        long.groupBy(*by, "section")
        .agg(
            F.count("*").alias("pages"),
            F.count_if(F.when(F.col("is_list"), listed).otherwise(filled)).alias("filled"),
        )
        .withColumn("fill_rate", F.col("filled") / F.col("pages"))
    )


def validate_extractions(page_ids: DataFrame, sections: Sequence[Section], actual: DataFrame) -> DataFrame:
    """Stored extractions against the contract of their schema.

    Every page must have every section with an XPath and no other; scalars carry no list,
    lists are never null. Both sides shuffle on ``(page_id, section)``, which no page or
    section can skew, with whether value and list are null instead of the texts themselves.
    """
    entries = [
        F.struct(F.lit(s.name).alias("section"), F.lit(s.is_list).alias("want_list"), F.lit(True).alias("wanted"))
        for s in usable(sections)
    ]
    expected = page_ids.select("page_id", F.inline(F.array(*entries)))
    have = actual.select(
        "page_id", "section", "is_list", F.col("value").isNotNull().alias("has_value"),
        F.col("values").isNotNull().alias("has_list"), F.lit(True).alias("present"),
    )
    both = expected.join(have, ["page_id", "section"], "full_outer")

    def issue(condition: Column, type_: str) -> Column:
        return F.when(condition, F.lit(type_))

    present, wanted = F.col("present").isNotNull(), F.col("wanted").isNotNull()
    issues = F.array(
        issue(~present, "MissingField"),
        issue(~wanted, "UnexpectedField"),
        issue(
            present & wanted
            & ((F.col("is_list") != F.col("want_list"))
               | (F.col("want_list") & F.col("has_value"))
               | (~F.col("want_list") & F.col("has_list"))),
            "WrongShape",
        ),
        issue(present & wanted & F.col("want_list") & ~F.col("has_list"), "NullList"),
    )
    return both.select(
        "page_id", "section", F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("type")
    )
