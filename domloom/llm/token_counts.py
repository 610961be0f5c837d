"""Token counts: additive rollups kept up to date by signed changes, in idempotent batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabularies of public tokenizers lie, see the README there.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that belongs to this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KEYS = ("source", "lang", "version")

#: Characters encoded at a time. Longer texts are cut where a word begins after a blank.
PIECE = 100_000


def count_tokens(
    docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", name: str = "tokens"
) -> DataFrame:
    """``docs`` with the number of tokens of the whole text; null has none.

    The vocabulary, whose size is fixed, is read by Spark and shipped to the tasks.
    """
    spark = docs.sparkSession
    lines = [tuple(r["value"].split()) for r in spark.read.text(vocabulary).collect()]
    shipped = spark.sparkContext.broadcast(lines)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding(
            "own", pat_str=SPLIT, mergeable_ranks={base64.b64decode(a): int(b) for a, b in shipped.value}, special_tokens={}
        )
        for batch in batches:
            counts = [sum(len(encoding.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], names=[*kept, name])

    kept = [c for c in docs.columns if c not in (text_col, name)]
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), *kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(count, f"{fields}, `{name}` bigint")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` cut in front of single blanks between letters, where no token can span the cut:
    there the split pattern begins a new match. Text without such a place stays in one piece."""
    begin = 0
    while len(text) - begin > size:
        at = begin + size
        while at < len(text) - 1 and not (text[at] == " " and text[at - 1].isalpha() and text[at + 1].isalpha()):
            at += 1
        if at >= len(text) - 1:
            break
        yield text[begin:at]
        begin = at
    yield text[begin:]


def inserted(counts: DataFrame) -> DataFrame:
    """Changes for new documents: ``counts`` holds ``source, lang, version, tokens``."""
    return _change(counts, F.lit(1), F.col("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Changes for documents that go, with the counts they came with."""
    return _change(counts, F.lit(-1), -F.col("tokens"))


def revised(counts: DataFrame) -> DataFrame:
    """Changes for documents counted anew: ``tokens`` now, ``old_tokens`` (and where given
    ``old_source, old_lang, old_version``) before."""
    old = counts.select(*[F.col(f"old_{k}" if f"old_{k}" in counts.columns else k).alias(k) for k in KEYS], F.col("old_tokens").alias("tokens"))
    return inserted(counts).unionByName(deleted(old))


def _change(rows: DataFrame, sign: Column, tokens: Column) -> DataFrame:
    return rows.select(
        *[F.col(k).cast("string").alias(k) for k in KEYS], sign.cast("bigint").alias("docs"),
        F.coalesce(tokens, F.lit(0)).cast("bigint").alias("tokens"),
    )


class TokenRollup:
    """Totals by source, language and tokenizer version, below a folder of a shared store.

    A batch is reduced to signed sums per key before it is written, so the state grows with keys
    and batches, not with documents. Batches are additive: their order does not matter. A batch
    is committed by a row in the folder of commits, written after its sums. Committing an id
    again changes nothing; a try that failed before its commit row is not seen by readers and is
    overwritten by the next. One writer per batch id at a time.

    Null sources and languages are keys like others. A null count is 0. Keys whose documents and
    tokens cancel out vanish. A rollup without batches has no rows.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add ``changes`` under the id ``batch``; False if that id was committed before."""
        if batch in self.committed():
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.root}/sums/{_folder(batch)}")
        self.spark.range(1).select(F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.root}/commits")
        return True

    def committed(self) -> list[str]:
        try:
            rows = self.spark.read.schema("batch string").parquet(f"{self.root}/commits").distinct().collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r["batch"] for r in rows)

    def totals(self) -> DataFrame:
        """``source, lang, version, docs, tokens`` over all committed batches."""
        schema = "source string, lang string, version string, docs bigint, tokens bigint"
        batches = self.committed()
        if not batches:
            return self.spark.createDataFrame([], schema)
        sums = self.spark.read.schema(schema).parquet(*[f"{self.root}/sums/{_folder(b)}" for b in batches])
        return sums.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where(
            "docs <> 0 OR tokens <> 0"
        )


def _folder(batch: str) -> str:
    return "batch-" + batch.encode().hex()
