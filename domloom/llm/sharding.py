"""Sharding by balanced label propagation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domloom.operators.ranking import number_rows
from domloom.session import checkpointed

#: Rows are numbered in ranges of 2**12; sums of ranges in ranges of 2**28.
ROW_SHIFTS = (12, 28)


def balanced_shards(
    docs: DataFrame, links: DataFrame, n_shards: int, rounds: int = 12, settled: float = 0.001
) -> DataFrame:
    """``docs`` (``doc_id`` and any columns) with ``shard`` and ``slot``; row counts of shards
    differ by one at most and slots count from 0 without gaps.

    ``links`` holds ``(doc_id, hub)``: documents under one hub are linked with each other. A
    hub stands for all pairs of its members, which are never listed; a single link is a hub of
    two. Documents that are alone under their hubs are free.

    Linked documents start in the shard that their smallest hub hashes to, so that small groups start
    together; members of a hub larger than a shard start where their ids hash to. In each round every hub counts its
    members per shard, each document adds up the counts of its hubs and wants to go where most
    of its neighbours are: in even rounds among all shards, which lets full shards exchange
    documents, in odd rounds among shards with room, by which a group larger than a shard fills
    one after another. The moves wanted between each pair of shards are then cut to quotas, so
    that no shard is expected to exceed its capacity of linked documents; which of them go is
    decided by a hash. Rounds end when two in a row move under ``settled`` of the linked documents. Free documents cost nothing to place; dealing them (and what a shard holds beyond
    its quota) into the shards with gaps makes the sizes even exactly.

    Per round, the driver sees one count per pair of shards. A hub of any size is counted with
    partial sums, and its tally joins its members under adaptive skew splitting.

    Columns of ``docs`` named ``shard`` or ``slot`` are replaced. Rows that repeat an id keep a
    slot each. A null id is linked with nothing. Rows are numbered by their place in a table
    written once, whatever their ids, so no window holds more than a range of it, and reruns of lost
    tasks cannot number rows anew. Empty tables give no rows.
    """
    spark = docs.sparkSession
    hubs = links.where("doc_id IS NOT NULL AND hub IS NOT NULL").select("doc_id", "hub").distinct()
    shared = hubs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hubs = checkpointed(hubs.join(shared, ["hub"]))
    counted = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    quota = [counted // n_shards + (s < counted % n_shards) for s in range(n_shards)]
    together = F.when(F.col("largest") <= min(quota), F.col("tie")).otherwise(F.col("doc_id").cast("bigint"))
    labels = checkpointed(hubs.groupBy("doc_id").agg(F.min("hub").alias("tie"), F.max("n").alias("largest")).select(
        "doc_id", "tie", F.pmod(F.xxhash64(together), F.lit(n_shards)).cast("int").alias("shard")
    ))
    hubs = hubs.drop("n")
    still = 0
    for turn in range(rounds):
        load = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = [quota[s] - load.get(s, 0) for s in range(n_shards)]
        targets = [s for s in range(n_shards) if turn % 2 == 0 or room[s] > 0.005 * quota[s]]
        wishes = checkpointed(_wishes(labels, hubs, n_shards, targets))
        demand = {
            (r["shard"], r["wish"]): r["n"]
            for r in wishes.where("wish <> shard").groupBy("shard", "wish").agg(F.count(F.lit(1)).alias("n")).collect()
        }
        share = _quotas(demand, room, n_shards)
        still = still + 1 if sum(n * share[j] for (_, j), n in demand.items()) <= settled * sum(load.values()) else 0
        if still == 2:
            break
        rate = F.get(_array(share, "double"), F.col("wish"))
        draw = F.pmod(F.xxhash64("doc_id", F.lit(turn + 1)), F.lit(1 << 20)) / float(1 << 20)
        labels = wishes.withColumn(
            "shard", F.when((F.col("wish") != F.col("shard")) & (draw < rate), F.col("wish")).otherwise(F.col("shard"))
        ).select("doc_id", "tie", "shard")
    return _dealt(spark, docs, checkpointed(labels.select("doc_id", "shard")), quota)


def _wishes(labels: DataFrame, hubs: DataFrame, n: int, targets: Sequence[int]) -> DataFrame:
    """Labels with the shard each document wants: of its own and ``targets``, where most neighbours are."""
    tally = [F.count(F.when(F.col("shard") == s, 1)).alias(f"v{s}") for s in range(n)]
    votes = hubs.join(labels, ["doc_id"]).groupBy("hub").agg(*tally)
    near = hubs.join(votes, ["hub"]).groupBy("doc_id").agg(*[F.sum(f"v{s}").alias(f"v{s}") for s in range(n)])
    scored = labels.join(near, ["doc_id"])
    # Ties go to the first shard after a starting point that the members of a hub share.
    start = F.pmod(F.xxhash64("tie"), F.lit(n)).cast("int")

    def bid(s: int) -> Column:
        may = F.lit(True) if s in targets else F.col("shard") == s
        distance = F.pmod(F.lit(s) - F.col("start"), F.lit(n))
        return F.when(may, F.struct(F.col(f"v{s}").alias("votes"), (-distance).alias("nearness"), F.lit(s).alias("to")))

    return scored.withColumn("start", start).withColumn(
        "wish", F.array_max(F.array(*[bid(s) for s in range(n)]))["to"]
    ).select("doc_id", "tie", "shard", "wish")


def _quotas(demand: dict[tuple[int, int], int], room: Sequence[int], n: int) -> list[float]:
    """Per shard, the share of the wanted entries that may happen.

    Entries are limited by room plus departures, and departures are entries elsewhere. Going
    down from all wishes leads to the largest shares that keep every shard within capacity.
    """
    wanted = [sum(demand.get((i, j), 0) for i in range(n)) for j in range(n)]
    share = [1.0] * n
    for _ in range(500):
        leaving = [sum(demand.get((j, k), 0) * share[k] for k in range(n)) for j in range(n)]
        lower = [min(1.0, max(0.0, (room[j] + leaving[j]) / wanted[j])) if wanted[j] else 0.0 for j in range(n)]
        done = max(abs(a - b) for a, b in zip(share, lower)) < 1e-4
        share = lower
        if done:
            break
    return share


def _dealt(spark, docs: DataFrame, labels: DataFrame, quota: Sequence[int]) -> DataFrame:
    """Exact sizes: linked rows keep their shard up to its quota, all others fill the gaps."""
    # The caller's columns travel as one, whatever their names; ``shard`` and ``slot`` are replaced.
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = checkpointed(docs.select(F.monotonically_increasing_id().alias("__order"), "doc_id", F.struct(*columns).alias("__row")))
    placed = rows.join(labels, ["doc_id"], "left").withColumn("__key", F.coalesce("shard", F.lit(-1)))
    numbered = checkpointed(number_rows(placed, ["__key"], "__order", "__number", ROW_SHIFTS))
    held = {r["__key"]: r["n"] for r in numbered.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = [min(held.get(s, 0), q) for s, q in enumerate(quota)]
    limit = F.get(_array(kept, "bigint"), F.col("__key"))
    stays = (F.col("__key") >= 0) & (F.col("__number") <= limit)
    over = numbered.where((F.col("__key") >= 0) & (F.col("__number") > limit)).drop("__number").withColumn("__pool", F.lit(0))
    pool = numbered.where("__key < 0").drop("shard").withColumn("__entry", F.col("__number") - 1).unionByName(
        number_rows(over, ["__pool"], "__order", "__number", ROW_SHIFTS)
        .withColumn("__entry", F.col("__number") - 1 + held.get(-1, 0)).drop("__pool", "shard")
    )
    # Entry e goes to the shard in whose stretch of gaps it falls.
    ends, total = [], 0
    for q, k in zip(quota, kept):
        total += q - k
        ends.append(total)
    stretch = _array(ends, "bigint")
    shard = F.size(F.filter(stretch, lambda end: end <= F.col("__entry")))
    begin = F.when(shard == 0, F.lit(0)).otherwise(F.get(stretch, shard - 1))
    filled = pool.withColumn("shard", shard).withColumn(
        "slot", F.get(_array(kept, "bigint"), F.col("shard")) + F.col("__entry") - begin
    )
    chosen = ["__row.*", "shard", "slot"]
    staying = numbered.where(stays).withColumn("slot", F.col("__number") - 1)
    return checkpointed(staying.select(*chosen).unionByName(filled.select(*chosen)))


def _array(values: Sequence[float], kind: str) -> Column:
    return F.expr(f"array({', '.join(f'CAST({v} AS {kind})' for v in values)})")
