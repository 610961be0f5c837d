"""Sinks for extraction records and Markdown documents.

Results go to splittable tables keyed by page; the file name a page would have is a column.
Billions of small files would overload any file system, so one file per page
(``write_extraction_files``, ``write_markdown_files``) is for consumers that ask for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domloom.operators.extract import record_json
from domloom.sources.page_files import write_page_files


def write_extractions(records: DataFrame, path: str, file_format: str = "json") -> None:
    """``(page_id, result_file, record)`` to ``path``; JSON lines or Parquet."""
    rows = records.select("page_id", "result_file", record_json(F.col("record")).alias("record"))
    if file_format == "json":
        rows.write.mode("overwrite").option("compression", "gzip").json(path)
    else:
        rows.write.mode("overwrite").format(file_format).save(path)


def read_extractions(spark, path: str, file_format: str = "json") -> DataFrame:
    schema = "page_id bigint, result_file string, record string"
    return spark.read.schema(schema).format(file_format).load(path)


def write_markdown(documents: DataFrame, path: str) -> None:
    """``(page_id, markdown_file, markdown)`` as Parquet; failed pages are left out."""
    documents.filter(F.col("markdown").isNotNull()).write.mode("overwrite").parquet(path)


def write_markdown_text(documents: DataFrame, path: str) -> None:
    """The documents as plain text, one after the other in page order within each file."""
    documents.filter(F.col("markdown").isNotNull()).sortWithinPartitions("page_id").select(
        F.concat("markdown", F.lit("\n"))
    ).write.mode("overwrite").text(path)


def write_extraction_files(records: DataFrame, path: str) -> None:
    """``(result_file, record)``: one JSON file per page; pages without a record have none."""
    rows = records.where(F.col("record").isNotNull()).withColumn("json", record_json(F.col("record")))
    write_page_files(rows, path, "result_file", "json")


def write_markdown_files(documents: DataFrame, path: str) -> None:
    """``(markdown_file, markdown)``: one Markdown file per page that has a document."""
    write_page_files(documents, path, "markdown_file", "markdown")
