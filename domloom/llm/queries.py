"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domloom.llm.decontaminate import contaminations
from domloom.llm.embedding_dedup import near_vectors
from domloom.llm.exact_dedup import exact_dedup
from domloom.llm.hard_negatives import hard_negatives
from domloom.llm.language_id import fit_language_model, held_out, predict_language
from domloom.llm.licenses import license_scan
from domloom.llm.line_dedup import remove_boilerplate
from domloom.llm.mixing import mix_sources
from domloom.llm.ngram_join import jaccard_components
from domloom.llm.sharding import balanced_shards
from domloom.llm.source_audit import source_divergence
from domloom.llm.text import or_empty
from domloom.llm.token_counts import TokenRollup, count_tokens, deleted, inserted, revised
from domloom.llm.warc import read_archives, record_headers, resolve_revisits, resolved, write_archives
from domloom.session import checkpointed, shared_dir

Query = Callable[[SparkSession, str], DataFrame]

N_SHARDS = 40


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(_table(spark, sf, "documents"), digest_all=True)


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan(_table(spark, sf, "documents"))


def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Deduplicated archives of all pages, read back and resolved."""
    pages = _table(spark, sf, "pages")
    headers = checkpointed(record_headers(pages))
    path = shared_dir(spark, "warc")
    write_archives(pages, resolve_revisits(headers), path, date="2026-01-01T00:00:00Z")
    records = checkpointed(read_archives(spark, path).drop("payload"))
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(_table(spark, sf, "documents"))


def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Learned from the rows that are not held out; predicted for all, from the text alone."""
    docs = _table(spark, sf, "documents")
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"))))
    return predict_language(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents come in with an estimate of four characters per token, are then counted, a
    count that is committed twice, and those with a toxic label are deleted again."""
    docs = _table(spark, sf, "documents").select("doc_id", "text", "source", "lang", F.lit("byte_bpe_50k").alias("version"))
    estimate = F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 4).cast("bigint")
    counts = checkpointed(count_tokens(docs.withColumn("old_tokens", estimate)))
    rollup = TokenRollup(spark, shared_dir(spark, "tokens"))
    rollup.commit("arrivals", inserted(counts.withColumn("tokens", F.col("old_tokens"))))
    for _ in range(2):
        rollup.commit("counts", revised(counts))
    toxic = _table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct()
    rollup.commit("toxic", deleted(counts.join(toxic, ["doc_id"], "left_semi")))
    return rollup.totals()


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contaminations(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return remove_boilerplate(_table(spark, sf, "documents"))


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Equal texts are linked. The law is ``rows``: counts of shards differ by one at most."""
    text = or_empty(F.col("text"))
    docs = checkpointed(_table(spark, sf, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hub"),
    ))
    sharded = balanced_shards(docs.drop("hub"), docs.select("doc_id", "hub"), N_SHARDS)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth row is an anchor; every seventh has a label that is one off."""
    vectors = _table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), anchors=F.col("vec_id") % 50 == 0)


def op12_source_audit(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence(_table(spark, sf, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(_table(spark, sf, "embeddings"))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_license_scan": op2_license_scan,
        "op3_warc": op3_warc,
        "op4_ngram_join": op4_ngram_join,
        "op5_language_id": op5_language_id,
        "op6_token_counts": op6_token_counts,
        "op7_decontamination": op7_decontamination,
        "op8_line_dedup": op8_line_dedup,
        "op9_sharding": op9_sharding,
        "op10_mixing": op10_mixing,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_source_audit": op12_source_audit,
        "op13_embedding_dedup": op13_embedding_dedup,
    }
