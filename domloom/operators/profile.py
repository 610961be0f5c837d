"""Profiling extracted fields and writing records as Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domloom.functions.markdown import html_to_markdown, list_items, markdown_escape
from domloom.operators.extract import field_of, usable
from domloom.operators.schema import Section

STRUCTURAL_PATH = r"/(?:nav|header|footer|aside)(?:[\[/]|$)"
# A scalar field shorter than this on average is metadata, not main content.
SHORT_FIELD = 200


def sample_records(records: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` records by page id."""
    return records.orderBy("page_id").limit(n)


def field_profile(long: DataFrame, metadata_types: Sequence[str] = ("title", "metadata")) -> DataFrame:
    """One row per section: fill, lengths, role and type.

    ``long`` is the long extraction table; a ``type`` column, if there, marks metadata.
    All measures are sums and maxima, so a section of any size aggregates map-side.
    """
    texts = F.when(F.col("is_list"), F.col("values")).otherwise(F.array("value"))
    texts = F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != "")
    rows = long.select(
        "section", "is_list",
        F.coalesce(F.col("type") if "type" in long.columns else F.lit(None).cast("string"), F.lit("")).alias("type"),
        texts.alias("texts"),
        F.coalesce(F.col("source_xpath").rlike(STRUCTURAL_PATH), F.lit(False)).alias("structural"),
    ).select(
        "*",
        F.aggregate("texts", F.lit(0), lambda a, t: a + F.length(t)).alias("chars"),
        F.aggregate("texts", F.lit(0), lambda a, t: F.greatest(a, F.length(t))).alias("longest"),
        F.aggregate("texts", F.lit(0), lambda a, t: a + F.regexp_count(t, F.lit(r"</?[A-Za-z][^>]*>"))).alias("tags"),
        F.aggregate("texts", F.lit(0), lambda a, t: a + F.rlike(t, F.lit(r"^\s*\{")).cast("int")).alias("objects"),
    )
    filled = F.size("texts") > 0
    sums = rows.groupBy("section").agg(
        F.count("*").alias("records"),
        F.count_if(filled).alias("filled"),
        F.sum(F.size("texts")).alias("items"),
        F.sum("chars").alias("chars"),
        F.max("longest").alias("max_length"),
        F.sum("tags").alias("tags"),
        F.sum("objects").alias("objects"),
        F.bool_or("is_list").alias("is_list"),
        F.count_if("structural").alias("structural"),
        F.count_if(F.col("type").isin(*metadata_types) | F.col("section").isin(*metadata_types)).alias("meta"),
    )
    avg_length = F.when(F.col("items") > 0, F.col("chars") / F.col("items")).otherwise(F.lit(0.0))
    role = (
        F.when((F.col("structural") * 2 > F.col("filled")) & (F.col("filled") > 0), "structural")
        .when((F.col("meta") > 0) | ((avg_length < SHORT_FIELD) & ~F.col("is_list")), "metadata")
        .otherwise("main")
    )
    return sums.select(
        "section", "records", "filled",
        (F.col("filled") / F.col("records")).alias("fill_rate"),
        avg_length.alias("avg_length"),
        "max_length",
        (F.col("items") / F.col("records")).alias("avg_items"),
        role.alias("role"),
        F.when(F.col("is_list"), "list")
        .when(F.col("objects") * 2 > F.col("filled"), "object")
        .when(F.col("tags") > 0, "html")
        .otherwise("text")
        .alias("field_type"),
        (F.col("tags") > 0).alias("tagged"),
    )


def content_hierarchy(profile: DataFrame) -> DataFrame:
    """One row: field names by role, the primary main field and the secondary ones."""
    chars = F.col("avg_length") * F.col("avg_items") * F.col("records")

    def names(role: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col("section"))))

    main = F.col("role") == "main"
    gathered = profile.agg(
        names("main").alias("main_content_fields"),
        names("metadata").alias("metadata_fields"),
        names("structural").alias("structural_fields"),
        F.max_by(F.when(main, F.col("section")), F.when(main, F.struct(chars, F.col("section")))).alias("primary"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "field_type")))).alias("field_types"),
    )
    return gathered.withColumn(
        "secondary", F.filter("main_content_fields", lambda f: f != F.col("primary"))
    )


def collect_roles(profile: DataFrame) -> dict[str, str]:
    """Section roles for the driver, which builds expressions from them: a row per section."""
    return {r["section"]: r["role"] for r in profile.select("section", "role").collect()}


def collect_types(profile: DataFrame) -> dict[str, str]:
    """Field types by section, for the same; lists with tags in their items are ``html_list``."""
    tagged = F.col("tagged") if "tagged" in profile.columns else F.lit(False)
    rows = profile.select("section", "field_type", tagged.alias("tagged")).collect()
    return {r["section"]: "html_list" if r["tagged"] and r["field_type"] == "list" else r["field_type"] for r in rows}


def records_to_markdown(
    extracted: DataFrame,
    sections: Sequence[Section],
    roles: dict[str, str],
    types: dict[str, str] | None = None,
    title: str = "title",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(page_id, markdown)``: title, then metadata, then main fields, then structure.

    The title becomes a heading, metadata ``**name**: value`` lines, a main text field
    plain text, and every list a Markdown list under its name. Fields of type ``html`` are
    converted, as are items of lists that have tags; ``object`` fields become code, all other texts
    are escaped. Fields without text leave no trace. Pages that failed have a null document.
    """
    wanted = usable(sections)
    fields = {s.name: f"field_{i}" for i, s in enumerate(wanted)}
    types = types or {}

    def block(s: Section, role: str) -> Column:
        name, type_ = fields[s.name], types.get(s.name, "text")
        opened = f"**{s.name}**: "
        if s.is_list:
            listed = list_items(name, type_ == "html_list")
            return F.when(listed != "", F.concat(F.lit(f"## {s.name}\n\n"), listed))
        shown = html_to_markdown(name) if type_ == "html" else markdown_escape(name)
        if type_ == "object":
            shown = F.concat(F.lit("```\n"), name, F.lit("\n```"))
            opened = f"**{s.name}**:\n\n"
        text = F.when(F.coalesce(F.col(name), F.lit("")) != "", shown)
        if s.name == title:
            return F.concat(F.lit("# "), text)
        if role == "metadata":
            return F.concat(F.lit(opened), text)
        if role == "structural":
            return F.concat(F.lit(f"## {s.name}\n\n"), text)
        return text

    rank = {"metadata": 1, "main": 2, "structural": 3}
    ordered = sorted(
        wanted, key=lambda s: (0 if s.name == title else rank[roles.get(s.name, "main")])
    )
    blocks = [block(s, roles.get(s.name, "main")) for s in ordered]
    document = F.concat_ws("\n\n", *blocks) if blocks else F.lit("")
    rows = extracted.select(
        "page_id", *keep, F.col("fields").isNotNull().alias("has_fields"), *[field_of(s).alias(fields[s.name]) for s in wanted]
    )
    return rows.select("page_id", *keep, F.when(F.col("has_fields"), document).alias("markdown"))
