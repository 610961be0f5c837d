"""Run numbers, resumable state, and the pages still to do."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domloom.operators.schema import Section
from domloom.session import checkpointed

# The steps of a run in order, and the two that mean the same.
STEPS = ("text_analysis", "visual_analysis", "synthesized", "schema", "code_generated", "code_validated")
STEP_ALIASES = {"code": "code_validated"}


def run_number(name: Column, prefix: str = "flow") -> Column:
    """The number in a run folder name such as ``flow12``; null where there is none."""
    digits = F.regexp_extract(name, rf"\A{prefix}\s*([+-]?[0-9]+(?:_[0-9]+)*)\s*\z", 1)
    return F.replace(digits, F.lit("_"), F.lit("")).try_cast("bigint")


def next_run_id(run_dirs: DataFrame, name: str = "run_dir", prefix: str = "flow") -> DataFrame:
    """One row: the highest run number plus one; 1 where there is none."""
    return run_dirs.agg((F.coalesce(F.max(run_number(F.col(name), prefix)), F.lit(0)) + 1).alias("next_run_id"))


def step_number(step: Column) -> Column:
    number = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, name in enumerate(STEPS, 1):
        aliases = [a for a, s in STEP_ALIASES.items() if s == name]
        number = number.when(step.isin(name, *aliases), i)
    return number


def latest_state(manifest: DataFrame, *by: str) -> DataFrame:
    """Newest value of each field over all runs: ``field, value, run_id``.

    ``manifest`` has ``run_id, field, value``. A later run that recorded no value for a
    field leaves the earlier one standing; of several values of one run the greatest counts.

    Runs are numbers, so the last one of each field is found by hashing, with partial maxima. Only
    rows of a field's last run come along with their values, and those are put in order only
    where that run recorded several.
    """
    keys = [*by, "field"]
    rows = manifest.filter(F.col("value").isNotNull())
    # A run without a number comes before all others.
    number = F.coalesce(F.col("run_id").cast("bigint"), F.lit(-(2**63)))
    runs = rows.groupBy(*keys, "run_id").agg(F.count(F.lit(1)).alias("n"))
    last = runs.groupBy(*keys).agg(F.max(number).alias("last"), F.max_by("n", number).alias("n"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    newest = rows.withColumn("number", number).alias("r").join(last.alias("l"), [*same, F.col("number") == F.col("last")]).select(
        *[F.col(f"r.{k}").alias(k) for k in keys], "r.value", "r.run_id", "l.n")
    greatest = Window.partitionBy(*keys).orderBy(F.desc("value"))
    alone = newest.where("n = 1")
    settled = newest.where("n > 1").withColumn("place", F.row_number().over(greatest)).where("place = 1")
    return alone.select(*keys, "value", "run_id").unionByName(settled.select(*keys, "value", "run_id"))


def completed_steps(manifest: DataFrame, *by: str) -> DataFrame:
    """Latest run of each step that ran: ``step_number, run_id``."""
    return (
        manifest.withColumn("step_number", step_number(F.col("step")))
        .filter(F.col("step_number").isNotNull())
        .groupBy(*by, "step_number")
        .agg(F.max("run_id").alias("run_id"))
    )


def schema_hash(sections: Sequence[Section]) -> str:
    """Changes whenever an extraction with the schema could change."""
    text = repr([(s.name, s.candidates, s.is_list) for s in sections])
    return hashlib.md5(text.encode()).hexdigest()


def content_key(html: Column) -> Column:
    return F.md5(F.coalesce(html, F.lit("")).cast("binary"))


def pending_page_ids(pages: DataFrame, done: DataFrame, schema_key: str) -> DataFrame:
    """Ids of pages not yet done with this content and schema.

    ``done`` has ``page_id, content_key, schema_key`` and may have ``fallback``: rows
    marked so count as not done. Only ids and hashes are shuffled, never the HTML.
    """
    finished = done.filter(F.col("schema_key") == schema_key)
    if "fallback" in done.columns:
        finished = finished.filter(~F.coalesce("fallback", F.lit(False)))
    keys = pages.select("page_id", content_key(F.col("html")).alias("content_key"))
    return keys.join(finished.select("page_id", "content_key"), ["page_id", "content_key"], "left_anti").select("page_id")


def pending_pages(
    pages: DataFrame, done: DataFrame, schema_key: str, resume: bool = True, broadcast_rows: int = 2_000_000
) -> DataFrame:
    """The pages themselves. The ids are checkpointed and counted first: up to
    ``broadcast_rows`` of them (some 16 MB) are broadcast, so that the HTML is filtered where
    it is read; more of them join by shuffle."""
    if not resume:
        return pages
    ids = checkpointed(pending_page_ids(pages, done, schema_key))
    if ids.count() <= broadcast_rows:
        ids = F.broadcast(ids)
    return pages.join(ids, "page_id", "left_semi")


def pending_results(results: DataFrame, marks: Sequence[str] = ("API generation failed", "fallback template")) -> DataFrame:
    """Results to redo: ``(subject_id, result, reason)`` for those failed or made by a fallback."""
    text = F.coalesce(F.col("result"), F.lit(""))
    fallback = F.lit(False)
    for mark in marks:
        fallback = fallback | text.contains(mark)
    reason = F.when(F.col("status") == "failed", "failed").when(text == "", "missing").when(fallback, "fallback")
    return results.select("subject_id", "result", reason.alias("reason")).filter(F.col("reason").isNotNull())
