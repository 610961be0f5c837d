"""Row numbers inside groups of any size.

``row_number`` over ``partitionBy(key)`` sorts a whole group in one task, so one key with a
third of all rows would stall a job. Here the order column is an integer that is unique
inside its group, and its high bits cut every group into ranges: rows are numbered inside
their range, and the counts of the ranges before are added. With the default shifts no
window ever sees more than 2**20 rows of the first levels, or 2**23 at the top.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHIFTS = (20, 40)


def running_total(
    rows: DataFrame, keys: Sequence[str], order: str, amount: Column, name: str,
    shifts: Sequence[int] = SHIFTS,
) -> DataFrame:
    """Sum of ``amount`` over the rows of the same keys up to and including this one."""
    keys = list(keys)
    levels = [f"__range{i}" for i in range(len(shifts))]
    split = rows.withColumn("__amount", amount.cast("bigint"))
    for level, shift in zip(levels, shifts):
        split = split.withColumn(level, F.shiftright(F.col(order).cast("bigint"), shift))
    # Spark would accept rows already partitioned by the keys alone, hot group and all
    split = split.repartition(*keys, levels[0])

    def before(children: DataFrame, depth: int) -> DataFrame:
        """Totals of all earlier ranges for each range at ``depth``."""
        here, parents = levels[depth], levels[depth + 1:]
        totals = children.groupBy(*keys, here, *parents).agg(F.sum("__amount").alias("__amount"))
        window = Window.partitionBy(*keys, *parents[:1]).orderBy(here)
        inside = F.sum("__amount").over(window.rowsBetween(Window.unboundedPreceding, -1))
        result = totals.withColumn("__before", F.coalesce(inside, F.lit(0)))
        if parents:
            above = before(totals, depth + 1)
            result = result.join(
                above.select(*keys, parents[0], F.col("__before").alias("__above")), [*keys, parents[0]]
            ).withColumn("__before", F.col("__before") + F.col("__above"))
        return result.select(*keys, here, "__before")

    window = Window.partitionBy(*keys, levels[0]).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = split.withColumn("__inside", F.sum("__amount").over(window))
    joined = numbered.join(before(split, 0), [*keys, levels[0]])
    return joined.withColumn(name, F.col("__inside") + F.col("__before")).drop(
        "__amount", "__inside", "__before", *levels
    )


def number_rows(
    rows: DataFrame, keys: Sequence[str], order: str, name: str, shifts: Sequence[int] = SHIFTS
) -> DataFrame:
    """1-based row number inside each group of ``keys`` by ``order``."""
    return running_total(rows, keys, order, F.lit(1), name, shifts)
