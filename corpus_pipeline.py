"""The corpus pipeline: raw documents to sharded training data.

Each stage takes the rows its predecessor kept, from a written table, and returns rows with the
columns of ``documents``; the last adds where each row goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domloom.llm.decontaminate import decontaminated
from domloom.llm.language_id import UNDETERMINED, fit_language_model, predict_language
from domloom.llm.mixing import mix_sources
from domloom.llm.ngram_join import jaccard_components
from domloom.llm.queries import N_SHARDS
from domloom.llm.sharding import balanced_shards
from domloom.llm.text import or_empty, word_count
from domloom.session import checkpointed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; a missing ``lang`` becomes the one predicted.

    Texts without letters go. A low score is no ground to drop: short clean texts have it too.
    Columns travel under names of their place, whatever the caller's are.
    """
    plain = {c: f"column{i}" for i, c in enumerate(docs.columns)}
    others = [plain[c] for c in docs.columns if c != "doc_id"]
    told = predict_language(
        docs.toDF(*plain.values()), fit_language_model(docs), plain["doc_id"], plain["text"], keep=others,
    ).where(F.col("lang_pred") != UNDETERMINED).withColumn(plain["lang"], F.coalesce(plain["lang"], "lang_pred"))
    return told.select(*[F.col("doc_id" if c == "doc_id" else plain[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, once.

    Rows that repeat an id count as one document: they stay or go together, and of those that
    also repeat the text one stays. Rows with a null id are linked with nothing and all stay.
    """
    groups = jaccard_components(docs, count_links=False)
    dropped = groups.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    kept = docs.join(dropped, ["doc_id"], "left_anti").select(*docs.columns)
    repeated = checkpointed(repeated)
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, ["doc_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, ["doc_id"], "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no test item away."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy taken. The caller's columns travel as one."""
    mixed = mix_sources(docs).select("doc_id", "source", "size", "copies").where("copies > 0").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), word_count(F.col("text")).alias("words"))
    taken = rows.join(
        mixed,
        F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").cast("string").eqNullSafe(F.col("source"))
        & (F.col("words") == F.col("size")),
    )
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``.

    Rows get a number of their own, in a table written once, by which they are linked, placed and
    found again; ids that are null or repeated make no difference. Rows with equal texts are linked:
    the copies that the mix took of a document, above all. The text is shuffled once.
    """
    numbered = checkpointed(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*docs.columns).alias("row")))
    nodes = checkpointed(numbered.select(F.col("number").alias("doc_id"), F.xxhash64(or_empty(F.col("row.text"))).alias("hub")))
    sharded = balanced_shards(nodes.select("doc_id"), nodes, N_SHARDS)
    return numbered.join(sharded.withColumnRenamed("doc_id", "number"), ["number"]).select("row.*", "shard", "slot")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Trained models, component labels and hash draws are not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
