"""Incremental extraction: a checkpointed stream over arriving page files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from domloom.operators.extract import extract
from domloom.operators.schema import Section

PAGES_SCHEMA = "page_id bigint, url string, html string"


def incremental_extract(
    spark: SparkSession,
    source: str,
    output: str,
    checkpoint: str,
    sections: Sequence[Section],
    glob: str = "*.parquet",
    max_files: int = 1000,
    once: bool = True,
    **options,
) -> StreamingQuery:
    """Extract from Parquet page files below ``source`` that no earlier run has processed.

    ``source`` is a folder or a path pattern, which can also match files; ``glob`` selects
    files by their name.

    The file source remembers files, the parser and the extraction keep no state, and the
    file sink commits whole batches, so an interrupted run continues with exactly what is
    left. With ``once`` the query ends when it has caught up.
    """
    pages = (
        spark.readStream.schema(PAGES_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .parquet(source)
    )
    writer = (
        extract(pages, sections, **options)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start()
