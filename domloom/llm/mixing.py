"""Mixing sources to target weights: whole copies plus Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domloom.llm.text import uniform, word_count
from domloom.session import checkpointed

#: Ranges that the ranking variable of a source is cut into. The cut falls where inclusion
#: odds meet random odds, about the middle of the scale, where a range holds at most about
#: 1/1000 of a source; only that range is ever sorted.
RANGES = 4096

#: Up to so many sources, tables with a row per source are broadcast; beyond, joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_targets(
    sizes: DataFrame, weights: Sequence[int], budget: float, max_copies: int
) -> DataFrame:
    """``source, source_size, target`` for ``source, source_size``.

    ``budget`` times all sizes is shared by weight, in code point order of the sources, null
    last, the weights repeating. A target stops at ``max_copies`` times its source, and what
    is over is shared again among the others. The outcome is a common level ``t`` with
    ``target = min(cap, weight * t)``: going through the sources by rising cap per weight,
    the level that the rest could have rises as long as sources stop at their cap and falls
    afterwards, so ``t`` is its maximum.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    order = Window.orderBy(F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    by_room = Window.orderBy("room", F.asc_nulls_last("source"))
    before, onward = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    return (
        sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)).cast("double"))
        .withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(onward))
        .withColumn("total", F.sum("source_size").over(everything).cast("double") * F.lit(float(budget)))
        .withColumn("level", F.max((F.col("total") - F.col("used")) / F.col("rest")).over(everything))
        .select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    budget: float = 1.5,
    max_copies: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    appeal: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``.

    A document of a source with target T should appear ``T / source_size`` times on average,
    multiplied by ``appeal`` (a column over ``docs`` with values from 0 to 1, say a quality
    score; by default 1 for all, and then sources meet their targets). The whole part of that
    number is certain; the fraction is the document's inclusion probability for one copy more.
    Pareto order sampling picks those: documents are ranked by
    ``(u / (1 - u)) / (p / (1 - p))`` with a uniform ``u`` that only id and seed decide, and
    taken from the front until the words left over for the source are used up. The gap left
    before the document that no longer fits is closed with the one whose size comes nearest to it,
    if that helps.

    No source is sorted as a whole. Word sums of ranges of the ranking variable find the range
    in which the cut falls, and only that range is sorted, so a source may hold any share of
    the rows. Reruns agree.

    Null texts have size 0 and take nothing. Null sources form a source of their own, last in
    order. Rows with equal ids get the same ``u`` and are ordered by size; full repeats
    share their fate. Other columns are ignored. An empty table gives no rows.
    """
    rows = checkpointed(docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        uniform(F.col(id_col), seed).alias("u"),
        F.least(F.greatest(appeal.cast("double"), F.lit(0.0)), F.lit(1.0)).alias("appeal") if appeal is not None
        else F.lit(1.0).alias("appeal"),
    ))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = checkpointed(source_targets(sizes, weights, budget, max_copies))
    few = targets.count() <= BROADCAST_SOURCES
    ranked = checkpointed(_same_source(rows, targets, few=few).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("appeal")
    ).withColumn("whole", F.floor("rate").cast("bigint")).withColumn(
        "chance", F.col("rate") - F.col("whole")
    ).withColumn("above", F.col("u") * (1 - F.col("chance"))).withColumn("below", (1 - F.col("u")) * F.col("chance")).withColumn(
        # The ratio q of the odds is above / below; q / (1 + q) ranks alike, on a scale from 0 to 1.
        # Copies that are certain or impossible are not sampled.
        "rank", F.when((F.col("chance") > 0) & (F.col("size") > 0), F.col("above") / (F.col("above") + F.col("below")))
    ).withColumn("range", F.floor(F.col("rank") * RANGES).cast("int")).drop("u", "appeal", "above", "below", "rate"))

    # Words to sample per source: what expected copies come to beyond the whole ones.
    sampled = ranked.where("rank IS NOT NULL")
    by_range = sampled.groupBy("source", "range").agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.col("chance")).alias("due")
    )
    in_source = Window.partitionBy("source")
    ranges = by_range.withColumn("due", F.sum("due").over(in_source)).withColumn(
        "before", F.coalesce(F.sum("words").over(
            in_source.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn(
        "cut", F.when(F.col("before") + F.col("words") <= F.col("due") + 1e-6, 1)
        .when(F.col("before") <= F.col("due"), 0).otherwise(-1)
    )
    placed = _same_source(sampled, ranges.select("source", "range", "due", "before", "cut"), "range")
    inside = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = checkpointed(placed.where("cut = 0").withColumn(
        "words", F.col("before") + F.sum("size").over(inside)
    ).withColumn("taken", (F.col("words") <= F.col("due") + 1e-6)))
    # What is still missing after the cut, and the document not taken that comes nearest to it.
    gaps = edge.groupBy("source").agg(
        (F.max("due") - F.max(F.greatest("before", F.when(F.col("taken"), F.col("words"))))).alias("gap")
    )
    rest = placed.where("cut = -1").select("source", "doc_id", "size", "rank").unionByName(
        edge.where(~F.col("taken")).select("source", "doc_id", "size", "rank"))
    closing = _same_source(rest, gaps, few=few).withColumn("miss", F.abs(F.col("gap") - F.col("size"))).where(
        "miss < gap"
    ).groupBy("source").agg(F.min(F.struct("miss", "rank", "doc_id", "size")).alias("last")).select("source", "last.*")
    # The decision goes back to the rows as a threshold on (rank, doc_id, size) per source.
    ends = edge.where("taken").groupBy("source").agg(F.max(F.struct("rank", "doc_id", "size")).alias("end"))
    full = ranges.where("cut = 1").groupBy("source").agg(F.max("range").alias("full_range"))
    sources = targets.select("source")
    for part in (ends, full, closing.select("source", F.struct("rank", "doc_id", "size").alias("closing"))):
        sources = _same_source(sources, part, how="left")
    own = F.struct("rank", "doc_id", "size")
    chosen = F.col("rank").isNotNull() & (
        F.coalesce(F.col("range") <= F.col("full_range"), F.lit(False))
        | F.coalesce(own <= F.col("end"), F.lit(False))
        | F.coalesce(own == F.col("closing"), F.lit(False))
    )
    return _same_source(ranked, sources, few=few).withColumn("copies", F.col("whole") + chosen.cast("bigint")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def _same_source(left: DataFrame, right: DataFrame, *more: str, how: str = "inner", few: bool = False) -> DataFrame:
    """Join by source, where null is a source like any other, and by ``more``. ``few``: ``right``
    has a row per source, and sources were counted to be few."""
    keys = ("source", *more)
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(F.broadcast(renamed) if few else renamed, same, how).drop(*[f"__{k}" for k in keys])
