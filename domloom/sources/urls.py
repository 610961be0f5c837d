"""URL lists and the files downloaded from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domloom.functions.columns import strip
from domloom.functions.urls import url_filename, url_valid
from domloom.operators.ranking import number_rows, running_total
from domloom.session import checkpointed

# Positions and copy numbers are dense: one level of ranges keeps every window small.
DENSE = (20,)


def read_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a UTF-8 URL list as ``(line_no, line)``; ``line_no`` grows with file order."""
    return spark.read.text(path).select(
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")
    )


def parse_url_lines(lines: DataFrame) -> DataFrame:
    """``(line_no, url, reason)``: comments and blank lines dropped, invalid URLs with a reason."""
    return (
        lines.select("line_no", strip(F.col("line")).alias("url"))
        .filter((F.col("url") != "") & ~F.col("url").startswith("#"))
        .withColumn("reason", F.when(~url_valid(F.col("url")), "invalid URL"))
    )


def load_urls(lines: DataFrame) -> DataFrame:
    return parse_url_lines(lines).filter(F.col("reason").isNull()).select("line_no", "url")


def rejected_urls(lines: DataFrame) -> DataFrame:
    return parse_url_lines(lines).filter(F.col("reason").isNotNull())


def number_urls(urls: DataFrame) -> DataFrame:
    """Adds the 1-based ``position`` of each URL in its list."""
    return number_rows(urls, [], "line_no", "position")


def name_files(urls: DataFrame, url: str = "url", position: str = "position") -> DataFrame:
    """Adds ``filename``, derived from the URL and not yet unique."""
    return urls.withColumn("filename", url_filename(F.col(url), F.col(position)))


def dedupe_filenames(files: DataFrame, order: str = "position", name: str = "filename") -> DataFrame:
    """Makes file names unique; adds ``natural`` (the name before) and replaces ``name``.

    The first row of a name, by ``order``, keeps it; the later ones get ``_1``, ``_2``, …
    before ``.html``. A number whose result is some row's own name is skipped. A name
    shared by very many rows is numbered in ranges, and the numbers to skip are counted the
    same way, so neither is gathered in one task.
    """
    stem = r"\.html\z"
    # used three times below, so it is computed once and cut off from its input
    ranked = checkpointed(
        number_rows(files.withColumnRenamed(name, "natural"), ["natural"], order, "copy", DENSE).withColumn(
            "copy", F.col("copy") - 1
        )
    )
    sizes = ranked.filter("copy > 0").groupBy("natural").agg(F.max("copy").alias("copies"))

    # own names of the form <other own name>_<k>.html, which take the number k from it
    owned = ranked.filter("copy = 0").select(F.col("natural").alias("taken"))
    claims = owned.select(
        F.concat(F.regexp_extract("taken", r"\A(.+)_([1-9][0-9]{0,17})\.html\z", 1), F.lit(".html")).alias("natural"),
        F.regexp_extract("taken", r"\A(.+)_([1-9][0-9]{0,17})\.html\z", 2).alias("digits"),
    ).filter("digits != ''").select("natural", F.col("digits").cast("bigint").alias("k"))
    # no name has 2**40 copies, so larger numbers are never reached
    claims = claims.filter(F.col("k") < (1 << 41)).join(sizes, "natural")
    # the m-th taken number k shifts copy i by one when k - (m - 1) <= i
    shifts = checkpointed(
        number_rows(claims, ["natural"], "k", "m", DENSE)
        .withColumn("at", F.col("k") - F.col("m") + 1)
        .filter("at <= copies")
        .groupBy("natural", "copies", "at")
        .agg(F.count("*").alias("taken"))
    )

    def finish(numbered: DataFrame, number: Column) -> DataFrame:
        suffixed = F.concat(F.regexp_replace("natural", r"\.html\z", ""), F.lit("_"), number, F.lit(".html"))
        return numbered.withColumn(
            name, F.when(F.col("copy") == 0, F.col("natural")).otherwise(suffixed)
        ).drop("copy", "skipped")

    if shifts.isEmpty():
        return finish(ranked, F.col("copy"))
    # only copies of the names concerned are counted; the range keeps a hot name split
    range_of = F.shiftright("copy", DENSE[0])
    affected = shifts.select("natural", "copies").distinct().select(
        "natural", F.explode(F.sequence(F.lit(0), F.shiftright("copies", DENSE[0]))).alias("range")
    )
    copies = (
        ranked.filter("copy > 0")
        .withColumn("range", range_of.cast("bigint"))
        .join(affected, ["natural", "range"], "left_semi")
        .select("natural", F.col("copy").alias("at"), F.lit(0).cast("bigint").alias("taken"))
    )
    events = copies.unionByName(shifts.select("natural", "at", "taken")).groupBy("natural", "at").agg(
        F.sum("taken").alias("taken")
    )
    skipped = running_total(events, ["natural"], "at", F.col("taken"), "skipped", DENSE).select(
        "natural", F.col("at").alias("copy"), "skipped"
    )
    return finish(
        ranked.join(skipped, ["natural", "copy"], "left"), F.col("copy") + F.coalesce("skipped", F.lit(0))
    )


def attach_url(files: DataFrame, urls: DataFrame) -> DataFrame:
    """Files with the URL their name was derived from; ``matched`` is false where none was.

    Both sides have unique names after ``dedupe_filenames``, so no key is hot.
    """
    known = urls.select(F.col("filename").alias("name"), "url")
    return files.join(known, "name", "left").withColumn("matched", F.col("url").isNotNull())


def fetch_backlog(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Each distinct URL of a list with its line count and whether a page for it exists.

    Both sides are reduced to distinct URLs map-side before they meet.
    """
    wanted = urls.groupBy("url").agg(F.count("*").alias("n_lines"))
    have = pages.select("url").distinct().withColumn("fetched", F.lit(True))
    return wanted.join(have, "url", "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))
