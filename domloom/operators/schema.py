"""Extraction schemas: inferring them, exchanging them as JSON, simplifying and checking them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from domloom.operators.structure import page_total
from domloom.operators.xpath import XPATH_SHAPE
from domloom.session import checkpointed

SCHEMA_VERSION = "1.0"
SCHEMA_DESCRIPTION = "Schema for extracting content from HTML pages"
SCHEMA_ROW = (
    "name string, type string, description string, xpath string, xpath_list array<string>, "
    "is_list boolean, attributes map<string,string>, notes string"
)
#: Alternative paths of a section that an inferred schema lists, best first.
ALTERNATIVES = 20


@dataclass(frozen=True)
class Section:
    name: str
    xpath: str | None = None
    is_list: bool = False
    xpath_list: tuple[str, ...] = ()
    type: str = "other"
    description: str = ""
    attributes: tuple[tuple[str, str], ...] = field(default=())
    notes: str = ""

    @property
    def candidates(self) -> tuple[str, ...]:
        """XPaths to try in order; none for a section without an XPath of its own."""
        if not self.xpath:
            return ()
        return (self.xpath, *(x for x in self.xpath_list if x != self.xpath))


def infer_schema(variants: DataFrame, pages: DataFrame, min_support: float = 0.0, k: int = ALTERNATIVES) -> DataFrame:
    """One schema row per section seen, from ``section_variants``.

    The best path is the one on most pages (shorter, then smaller, wins ties). ``xpath_list`` holds
    the best ``k`` that are on a share of ``min_support`` of all pages; ``xpath_coverage`` ranks all of
    them as rows. Tasks keep ``k`` paths of a section each before any are brought together, so no
    task sees all paths of a section. ``variants`` is read twice and therefore written once.
    """
    variants = checkpointed(variants)
    path = F.concat(F.lit("/"), F.col("gpath"))
    order = F.struct(-F.col("pages"), F.length("gpath"), F.col("gpath"))
    grouped = variants.groupBy("section").agg(
        F.min_by("type", order).alias("type"),
        F.min_by("description", order).alias("description"),
        F.min_by(path, order).alias("xpath"),
        F.min_by("cls", order).alias("cls"),
        F.sum("lead_pages").alias("pages"),
        F.sum("lead_list_pages").alias("lists"),
        F.count("*").alias("paths"),
    )
    listed = best_paths(variants, pages, min_support, k).groupBy("section").agg(
        F.sort_array(F.collect_list(F.struct("rank", "xpath"))).alias("ranked"))
    return grouped.join(listed, ["section"], "left").select(
        F.col("section").alias("name"),
        "type",
        "description",
        "xpath",
        F.transform(F.coalesce("ranked", F.array().cast("array<struct<rank:int,xpath:string>>")), lambda r: r["xpath"]).alias("xpath_list"),
        (F.col("lists") * 2 > F.col("pages")).alias("is_list"),
        F.when(F.col("cls").isNotNull(), F.create_map(F.lit("class"), F.col("cls")))
        .otherwise(F.create_map().cast("map<string,string>"))
        .alias("attributes"),
        F.concat(
            F.lit("on "), F.col("pages"), F.lit(" pages, "), F.col("paths"), F.lit(" paths")
        ).alias("notes"),
    )


def best_paths(variants: DataFrame, pages: DataFrame, min_support: float = 0.0, k: int = ALTERNATIVES) -> DataFrame:
    """``(section, rank, xpath, pages)``: the ``k`` paths of each section that are on most pages,
    shorter ones and then smaller ones first among equals, on a share of ``min_support`` at least."""
    best = Window.partitionBy("section").orderBy(F.desc("pages"), F.length("gpath"), "gpath")
    frequent = variants.where(F.col("pages") >= F.lit(min_support) * page_total(pages))
    ranked = frequent.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("section", "rank", F.concat(F.lit("/"), F.col("gpath")).alias("xpath"), "pages")


def schema_document(schema: DataFrame, extraction_notes: str = "") -> DataFrame:
    """The whole schema as one JSON document (one row, column ``json``), sections by name.

    A schema has as many sections as there are rules or as its author wrote, each with at most the
    alternatives it was inferred with, however many pages it was learnt from.
    """
    section = F.struct("name", "description", "xpath", "xpath_list", "is_list", "attributes", "notes")
    named = F.array_sort(
        F.collect_list(section),
        lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0),
    )
    return schema.agg(named.alias("rows")).select(
        F.to_json(
            F.struct(
                F.lit(SCHEMA_VERSION).alias("schema_version"),
                F.lit(SCHEMA_DESCRIPTION).alias("description"),
                F.col("rows").alias("sections"),
                F.struct(
                    F.size("rows").alias("total_sections"),
                    F.lit(extraction_notes).alias("extraction_notes"),
                ).alias("metadata"),
            )
        ).alias("json")
    )


def collect_schema(schema: DataFrame) -> list[Section]:
    """Schema rows to the driver, which compiles each section to an expression."""
    rows = schema.orderBy("name").collect()
    known = set(schema.columns)

    def get(row, name, default):
        value = row[name] if name in known else None
        return default if value is None else value

    return [
        Section(
            name=row["name"],
            xpath=get(row, "xpath", None),
            is_list=get(row, "is_list", False),
            xpath_list=tuple(get(row, "xpath_list", ())),
            type=get(row, "type", "other"),
            description=get(row, "description", ""),
            attributes=tuple(sorted(get(row, "attributes", {}).items())),
            notes=get(row, "notes", ""),
        )
        for row in rows
    ]


def sections_from_json(document: str) -> list[Section]:
    """Sections of a schema document, e.g. one a user exported or wrote by hand."""
    return [
        Section(
            name=s.get("name", ""),
            xpath=s.get("xpath") or None,
            is_list=bool(s.get("is_list", False)),
            xpath_list=tuple(s.get("xpath_list") or ()),
            type=s.get("type", "other"),
            description=s.get("description", ""),
            attributes=tuple(sorted((k, str(v)) for k, v in (s.get("attributes") or {}).items())),
            notes=s.get("notes", ""),
        )
        for s in json.loads(document).get("sections", [])
    ]


def schema_table(spark: SparkSession, sections: Iterable[Section]) -> DataFrame:
    rows = [
        (s.name, s.type, s.description, s.xpath, list(s.xpath_list), s.is_list, dict(s.attributes), s.notes)
        for s in sections
    ]
    return spark.createDataFrame(rows, SCHEMA_ROW)


def simplify_schema(
    version: Column, description: Column, sections: Column, max_chars: int = 100_000
) -> Column:
    """Schema struct reduced to its essential fields when its JSON exceeds ``max_chars``.

    Kept per section: name, description, xpath, is_list, and the first three of
    ``xpath_list`` where its first entry is not the section's xpath. Null where the schema
    is small enough to be used as it is.
    """
    full = F.struct(version.alias("schema_version"), description.alias("description"), sections.alias("sections"))

    def simple(s: Column) -> Column:
        alternatives = s["xpath_list"]
        return F.struct(
            F.coalesce(s["name"], F.lit("")).alias("name"),
            F.coalesce(s["description"], F.lit("")).alias("description"),
            F.coalesce(s["xpath"], F.lit("")).alias("xpath"),
            F.coalesce(s["is_list"], F.lit(False)).alias("is_list"),
            F.when(
                alternatives.isNotNull() & ~s["xpath"].eqNullSafe(F.get(alternatives, F.lit(0))),
                F.slice(alternatives, 1, 3),
            ).alias("xpath_list"),
        )

    return F.when(
        F.length(F.to_json(full)) > max_chars,
        F.struct(
            F.coalesce(version, F.lit("1.0")).alias("schema_version"),
            F.coalesce(description, F.lit("")).alias("description"),
            F.transform(sections, simple).alias("sections"),
        ),
    )


def validate_schema(schema_rows: DataFrame) -> DataFrame:
    """Issue rows for malformed schema rows.

    Input: ``schema_id, position, name, xpath`` and optionally ``total_sections`` (the
    number the schema declares). Output: ``schema_id, position, type, severity, message``;
    ``position`` is null for an issue of the whole schema.
    """
    name, xpath = F.col("name"), F.col("xpath")

    def issue(condition: Column, type_: str, severity: str, message: str) -> Column:
        return F.when(
            condition,
            F.struct(F.lit(type_).alias("type"), F.lit(severity).alias("severity"), F.lit(message).alias("message")),
        )

    no_xpath = F.coalesce(xpath, F.lit("")) == ""
    found = F.array(
        issue(F.coalesce(name, F.lit("")) == "", "MissingName", "high", "Section has no name"),
        issue(no_xpath, "MissingXPath", "medium", "Section has no XPath and will be skipped"),
        issue(~no_xpath & ~xpath.rlike(XPATH_SHAPE), "InvalidXPath", "high", "XPath is not supported"),
    )
    rows = schema_rows.select(
        "schema_id", "position", F.inline(F.filter(found, lambda i: i.isNotNull()))
    )
    if "total_sections" not in schema_rows.columns:
        return rows
    totals = (
        schema_rows.groupBy("schema_id")
        .agg(F.count("*").alias("n"), F.max("total_sections").alias("declared"))
        .filter(~F.col("n").eqNullSafe(F.col("declared")))
        .select(
            "schema_id",
            F.lit(None).cast(schema_rows.schema["position"].dataType).alias("position"),
            F.lit("WrongTotal").alias("type"),
            F.lit("low").alias("severity"),
            F.lit("total_sections is not the number of sections").alias("message"),
        )
    )
    return rows.unionByName(totals)


def section_names(sections: Sequence[Section]) -> list[str]:
    return [s.name for s in sections]
