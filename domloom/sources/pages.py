"""Page sources: a Parquet table of pages, or a directory of HTML files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domloom.session import checkpointed

FILE_SCHEMA = "path string, name string, html string, error string"
LISTING_SCHEMA = "path string, bytes bigint, modified timestamp"

#: So many files are read by name.
FEW_FILES = 1000
#: A folder of files is read by so many tasks for each core at most.
TASKS_PER_CORE = 16


def identifier(url: Column | None = None, path: Column | None = None) -> Column:
    """What names a page in results: its URL, else its path, else ``unknown``."""
    known = [c for c in (url, path) if c is not None]
    return F.coalesce(*known, F.lit("unknown"))


def spread(scan: DataFrame, key: str) -> DataFrame:
    """``scan`` over at least as many tasks as there are cores.

    A table of few row groups would leave cores idle, so it is spread by a unique key. A
    large one already has more splits than cores and is left as scanned: no text of it is
    shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A ``(page_id, url, html)`` Parquet table."""
    return spread(spark.read.parquet(path).select("page_id", "url", "html"), "page_id")


def load_html_dir(spark: SparkSession, directory: str, pattern: str = "*.html") -> DataFrame:
    """Files named like ``pattern`` directly below ``directory`` as ``(path, name, html, error)``.

    Line ends are normalised as text reading does. A file that is not UTF-8 keeps its row
    with a null ``html`` and an error, so callers can log and skip it (``readable``). A
    missing directory gives an empty table.
    """
    files = _files(spark, "text", directory, pattern)
    return spark.createDataFrame([], FILE_SCHEMA) if files is None else _contents(files)


def _packed(scan: DataFrame) -> DataFrame:
    """``scan`` in fewer tasks: Spark counts each file as 4 MB at least, so a split is few small files,
    and a task for each costs more than the files. They are read one after the other; no text is shuffled."""
    return scan.coalesce(TASKS_PER_CORE * scan.sparkSession.sparkContext.defaultParallelism)


def _files(spark: SparkSession, kind: str, directory: str, pattern: str) -> DataFrame | None:
    try:
        return spark.read.format(kind).options(wholetext=True, pathGlobFilter=pattern).load(directory)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _contents(files: DataFrame, *more: Column) -> DataFrame:
    valid = F.is_valid_utf8("value")
    return _packed(files.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("name"),
        F.when(valid, F.regexp_replace("value", r"\r\n?", "\n")).alias("html"),
        F.when(~valid, F.lit("not valid UTF-8")).alias("error"),
        *more,
    ))


def _stamp() -> list[Column]:
    return [F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified")]


def list_html_dir(spark: SparkSession, directory: str, pattern: str = "*.html") -> DataFrame:
    """``(path, bytes, modified)`` of the files that ``load_html_dir`` would read, none of them opened."""
    files = _files(spark, "binaryFile", directory, pattern)
    if files is None:
        return spark.createDataFrame([], LISTING_SCHEMA)
    return _packed(files.select(F.col("_metadata.file_path").alias("path"), *_stamp()))


def load_changed(spark: SparkSession, directory: str, done: DataFrame, pattern: str = "*.html", few: int = FEW_FILES) -> DataFrame:
    """The files of ``load_html_dir`` that are new or changed since ``done`` was listed, with their
    ``bytes`` and ``modified`` for the next time.

    ``done`` is an earlier listing. A file is taken for unchanged if path, length and time of change
    are the same. Up to ``few`` changed files are read by name. More are read by the range of
    their times and lengths, which the scan applies to the listing before it opens a file, and then
    by name in a join.
    """
    key = ["path", "bytes", "modified"]
    # Left and inner joins, as Spark moves anti and semi joins below the packing of a scan.
    known = done.select(*key).distinct().withColumn("known", F.lit(True))
    changed = checkpointed(list_html_dir(spark, directory, pattern).join(known, key, "left").where("known IS NULL").drop("known"))
    found = changed.agg(
        F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in key[1:]]).first()
    if not found["n"]:
        return spark.createDataFrame([], f"{FILE_SCHEMA}, {LISTING_SCHEMA.removeprefix('path string, ')}")
    files = _files(spark, "text", directory, pattern)
    if found["n"] <= few:
        files = files.where(F.col("_metadata.file_path").isin([r["path"] for r in changed.select("path").collect()]))
    else:
        size, modified = _stamp()
        files = files.where(
            size.between(found["min_bytes"], found["max_bytes"]) & modified.between(found["min_modified"], found["max_modified"]))
    rows = _contents(files, *_stamp())
    return rows if found["n"] <= few else rows.join(changed.select("path"), ["path"]).select(rows.columns)


def readable(files: DataFrame) -> DataFrame:
    return files.filter(F.col("error").isNull())


def file_pages(files: DataFrame) -> DataFrame:
    """Files as pages: ``(page_id, url, path, name, html, read_error)``.

    The numbers hold for one reading of the directory; write the table once and work on
    that, as crawled pages are kept, so that they stay.
    """
    return files.select(
        F.monotonically_increasing_id().alias("page_id"), F.lit(None).cast("string").alias("url"),
        "path", "name", "html", F.col("error").alias("read_error"),
    )


def with_identifier(pages: DataFrame) -> DataFrame:
    return pages.withColumn(
        "identifier",
        identifier(
            F.col("url") if "url" in pages.columns else None,
            F.col("path") if "path" in pages.columns else None,
        ),
    )
