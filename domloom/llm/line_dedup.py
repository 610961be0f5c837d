"""Line deduplication by distinct-site spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domloom.llm.text import or_empty
from domloom.session import checkpointed

#: A line on so many sites is boilerplate.
MIN_SITES = 10

#: log2 of the registers of a sketch; its relative standard error is about 1.6 %.
LG_K = 12

#: Estimates within this share of the threshold are counted exactly: six standard errors.
MARGIN = 0.1

BLANKS = " \t\r"


def line_spread(
    docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """Keys ``(h1, h2)`` of the lines that stand on at least ``min_sites`` sites.

    Lines are compared without blanks at their ends; empty ones are never boilerplate. Per line,
    a HyperLogLog sketch of its sites, merged from partial sketches, so its state stays small
    however often a line occurs. Lines whose estimate lies near the threshold get an exact
    distinct count. Lines with fewer occurrences than ``min_sites`` cannot be on that many sites
    and are dropped first, by plain counts; that is the bulk. Null is no site.
    """
    lines = docs.select(
        F.col(site_col).cast("string").alias("site"), F.explode(_lines(F.col(text_col))).alias("line")
    ).select("site", *_key(F.col("line"))).where("h1 IS NOT NULL AND site IS NOT NULL")
    frequent = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).drop("n")
    repeated = checkpointed(lines.join(frequent, ["h1", "h2"], "left_semi"))
    estimated = checkpointed(repeated.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites")
    ))
    near = F.abs(F.col("sites") - min_sites) <= F.lit(MARGIN * min_sites + 1)
    exact = repeated.join(estimated.where(near).select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy(
        "h1", "h2"
    ).agg(F.count_distinct("site").alias("sites"))
    return estimated.where(~near).unionByName(exact).where(F.col("sites") >= min_sites).select("h1", "h2")


def remove_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, n_lines, n_removed``; ``text`` without the lines
    of ``line_spread``, the others as they were.

    Only line hashes are shuffled to find boilerplate. Its occurrences are gathered per document
    as hashes, a line once, and join the text by id.

    A null text stays null with no lines. Rows that repeat an id are cleaned alike. A null id
    loses its lines like any other. Other columns are ignored. An empty table gives no rows.
    """
    boilerplate = checkpointed(line_spread(docs, min_sites, site_col, text_col))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.explode(_lines(F.col(text_col))).alias("line")).select(
        "doc_id", *_key(F.col("line"))
    ).where("h1 IS NOT NULL")
    hits = lines.join(boilerplate, ["h1", "h2"], "left_semi").groupBy("doc_id").agg(
        F.collect_set(F.struct("h1", "h2")).alias("hits")
    ).withColumnRenamed("doc_id", "__id")
    joined = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(
        hits, F.col("doc_id").eqNullSafe(F.col("__id")), "left"
    )
    all_lines = F.split(or_empty(F.col("text")), "\n", -1)
    kept = F.filter(all_lines, lambda line: ~F.coalesce(
        F.array_contains(F.col("hits"), F.struct(*_key(line))), F.lit(False)))
    cleaned = joined.withColumn("kept", F.when(F.col("hits").isNotNull(), kept))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines)).cast("bigint")
    return cleaned.select(
        "doc_id",
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        n_lines.alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(n_lines - F.size("kept")).cast("bigint").alias("n_removed"),
    )


def _lines(text: Column) -> Column:
    return F.split(text.cast("string"), "\n", -1)


def _key(line: Column) -> tuple[Column, Column]:
    """96 bits of hash of a line that is not empty, or nulls."""
    bare = F.btrim(line, F.lit(BLANKS))
    full = F.length(bare) > 0
    return F.when(full, F.xxhash64(bare)).alias("h1"), F.when(full, F.hash(bare)).alias("h2")
