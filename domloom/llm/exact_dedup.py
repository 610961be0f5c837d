"""Exact deduplication by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domloom.llm.text import ascii_lower, or_empty
from domloom.session import checkpointed

#: Characters of a text that the second level hashes.
PREFIX_CHARS = 256


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the
    largest id stays. Three levels, each over the survivors of the one before:

    1. byte length (lower-casing A-Z does not change it): a length that occurs once is settled;
    2. hash of the first characters: a (length, prefix) pair that occurs once is settled;
    3. SHA-256 of the whole text, computed for surviving rows only.

    ``digest_all`` asks for the digest of settled rows too; it is then taken in the scan that
    measures lengths, which reads every text anyway, and level 3 groups the survivors by it.
    Otherwise ``text_sha256`` is null for settled rows.

    Only numbers and digests are shuffled. Groups are counted with partial sums and joined
    back under adaptive skew splitting, so one group may hold any share of the rows.

    Null counts as empty; all empty texts are equal. A null id ranks below any other. Rows that
    repeat an id and its text count as copies and share that id's verdict. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    text = or_empty(F.col(text_col))
    digest = F.unhex(F.sha2(ascii_lower(text), 256))
    heads = checkpointed(docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS))).alias("prefix"),
        *([digest.alias("digest")] if digest_all else []),
    ))
    lengths = _repeated(heads, "n_bytes")
    prefixes = _repeated(heads.join(lengths, ["n_bytes"], "left_semi"), "n_bytes", "prefix")
    if digest_all:
        survivors = heads.join(prefixes, ["n_bytes", "prefix"], "left_semi")
    else:
        full = docs.select(
            F.col(id_col).alias("doc_id"),
            F.octet_length(text).cast("bigint").alias("n_bytes"),
            F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS))).alias("prefix"),
            text.alias("__text"),
        ).join(prefixes, ["n_bytes", "prefix"], "left_semi")
        survivors = checkpointed(full.select(
            "doc_id", "n_bytes", "prefix", F.unhex(F.sha2(ascii_lower(F.col("__text")), 256)).alias("digest")
        ))
        settled = heads.join(prefixes, ["n_bytes", "prefix"], "left_anti")
        heads = survivors.unionByName(settled.withColumn("digest", F.lit(None).cast("binary")))
    groups = survivors.groupBy("n_bytes", "prefix", "digest").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    ).where("group_size > 1")
    return heads.join(groups, ["n_bytes", "prefix", "digest"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
