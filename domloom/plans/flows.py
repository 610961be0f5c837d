"""The whole way from learning pages to Markdown, resumable page by page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domloom.operators import profile, runstate
from domloom.operators.extract import extract, extractions, unsupported
from domloom.operators.nodes import parse_pages
from domloom.operators.schema import Section, collect_schema, infer_schema, schema_table
from domloom.operators.structure import (
    SECTION_FIELDS,
    SECTION_RULES,
    SectionRule,
    page_sections,
    section_variants,
)
from domloom.session import checkpointed
from domloom.sources.steps import StepStore

SCHEMA, EXTRACTIONS, PROFILE, MARKDOWN = "schema", "extractions", "profile", "markdown"


def learn(
    pages: DataFrame, rules: Sequence[SectionRule] = SECTION_RULES, min_support: float = 0.0
) -> list[Section]:
    """An extraction schema from a learning set of ``(page_id, html)``."""
    sections = page_sections(parse_pages(pages, SECTION_FIELDS), rules)
    return collect_schema(infer_schema(section_variants(sections), pages, min_support))


def to_markdown(
    extracted: DataFrame, sections: Sequence[Section], profiled: DataFrame | None = None, **options
) -> DataFrame:
    """Documents for extracted records.

    Roles and types of fields come from ``profiled``, a table of ``field_profile``, and the
    records are read once. Without it they come from the records themselves, which are then
    read twice, so they are written once instead of parsed twice.
    """
    if profiled is None:
        extracted = checkpointed(extracted)
        profiled = checkpointed(profile.field_profile(extractions(extracted)))
    return profile.records_to_markdown(
        extracted, sections, profile.collect_roles(profiled), profile.collect_types(profiled), **options
    )


def current_extractions(store: StepStore, run_id: int) -> DataFrame | None:
    """The newest extraction of every page of a run."""
    return _newest(store.load(run_id, EXTRACTIONS))


def _newest(stored: DataFrame | None) -> DataFrame | None:
    """Rows of each page's last batch, without ``batch``. Only numbers are aggregated."""
    if stored is None:
        return None
    last = stored.groupBy("page_id").agg(F.max("batch").alias("batch"))
    return stored.join(last, ["page_id", "batch"], "left_semi").drop("batch")


def process(
    store: StepStore,
    run_id: int,
    learning: DataFrame,
    spread: DataFrame,
    resume: bool = True,
    full_text: bool = True,
) -> DataFrame:
    """Learn, extract and render in steps; returns the Markdown table.

    Every step leaves a table and a manifest row. With ``resume`` the schema and the field roles
    of the run are reused, and only pages that are new or whose content changed are extracted
    and rendered, as a batch of their own; without any, nothing is written. The extraction's
    manifest row names sections whose XPath is not supported, and why.
    """
    spark = store.spark
    known = store.load(run_id, SCHEMA) if resume else None
    if known is None:
        sections = learn(learning)
        store.save(run_id, SCHEMA, schema_table(spark, sections))
    else:
        sections = collect_schema(known)

    if not resume:
        for step in (EXTRACTIONS, PROFILE, MARKDOWN):
            store.withdraw(run_id, step)
    key = runstate.schema_hash(sections)
    done = store.load(run_id, EXTRACTIONS) if resume else None
    batch = 0
    todo = spread
    if done is not None:
        batch = done.agg(F.max("batch")).first()[0] or 0
        todo = runstate.pending_pages(spread, _newest(done.select("page_id", "content_key", "schema_key", "batch")), key)
        rendered = store.load(run_id, MARKDOWN)
        if rendered is not None and rendered.where(F.col("batch") == batch).limit(1).count() and todo.isEmpty():
            return _newest(rendered)
    batch += 1
    keyed = todo.withColumn("content_key", runstate.content_key(F.col("html")))
    extracted = extract(keyed, sections, full_text=full_text, keep=["content_key"])
    store.save(
        run_id, EXTRACTIONS,
        extracted.withColumn("schema_key", F.lit(key)).withColumn("batch", F.lit(batch)),
        {"batch": batch, "unsupported": unsupported(sections)}, append=done is not None,
    )

    if not store.exists(run_id, PROFILE):
        store.save(run_id, PROFILE, profile.field_profile(extractions(current_extractions(store, run_id))))
    stored, rendered = store.load(run_id, EXTRACTIONS), store.load(run_id, MARKDOWN)
    # Batches that an interrupted run extracted but did not render are rendered with this one.
    left = stored if rendered is None else stored.join(rendered.select("batch").distinct(), ["batch"], "left_anti")
    documents = to_markdown(left, sections, store.load(run_id, PROFILE), keep=["batch"])
    store.save(run_id, MARKDOWN, documents, append=rendered is not None)
    return _newest(store.load(run_id, MARKDOWN))
