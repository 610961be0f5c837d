"""Odd rows: nulls, empty texts, ties, repeats, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

from domloom.llm.exact_dedup import exact_dedup
from domloom.llm.mixing import mix_sources
from domloom.llm.sharding import balanced_shards

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_bytes string, size string, shard string, words string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "Same TEXT é"), (2, "same text é"), (3, "same text É"), (4, None), (5, ""), (6, " \t\n"),
        (7, "x " * 200_000), (7, "x " * 200_000), (None, "same text é"), (None, None), (9, "one"),
    ]
    return spark.createDataFrame(
        [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 2}", None, "a", "b", "c", "d")
         for n, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.mark.parametrize("digest_all", [False, True])
def test_exact_dedup(odd, empty, digest_all):
    rows = exact_dedup(odd, digest_all=digest_all).collect()
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows), key=str)
    assert got == sorted([
        (1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 3, 1, True), (4, 5, 3, False), (5, 5, 3, True),
        (None, 5, 3, False), (6, 6, 1, True), (7, 7, 2, True), (7, 7, 2, True), (9, 9, 1, True)], key=str)
    assert all(r.text_sha256 is not None for r in rows if digest_all or r.group_size > 1)
    assert exact_dedup(empty, digest_all=digest_all).count() == 0


def test_mixing(odd, empty):
    rows = mix_sources(odd).collect()
    assert len(rows) == 11
    assert all(0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    assert {r.size for r in rows if r.doc_id in (4, 5, 6)} == {0}
    assert sorted(rows, key=str) == sorted(mix_sources(odd.repartition(5)).collect(), key=str)
    assert mix_sources(empty).count() == 0


def test_mixing_with_appeal(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 7 AS int)) AS text", "'s' AS source")
    rows = mix_sources(docs, appeal=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.25)).collect()
    share = [sum(r.copies for r in rows if r.doc_id % 2 == k) / 200 for k in (0, 1)]
    assert share[0] >= 1 and 0.25 < share[1] < 0.5
    expected = sum(r.size * (1.5 if r.doc_id % 2 == 0 else 0.375) for r in rows)
    assert abs(sum(r.taken for r in rows) - expected) < 5


def test_sharding(odd, empty):
    links = odd.select("doc_id", F.xxhash64("text").alias("hub"))
    docs = odd.withColumn("__key", F.lit("mine")).withColumn("slot", F.lit("mine"))
    rows = balanced_shards(docs, links, 3).collect()
    assert {r["__key"] for r in rows} == {"mine"}
    sizes = [sorted(r.slot for r in rows if r["shard"] == s) for s in range(3)]
    assert sorted(map(len, sizes)) == [3, 4, 4] and all(s == list(range(len(s))) for s in sizes)
    assert balanced_shards(docs.limit(0), links.limit(0), 3).count() == 0


def test_sharding_of_sparse_null_and_repeated_ids(spark):
    """Ids spread over 64 bits, a third of the rows without an id, a third with one and the same."""
    docs = spark.range(900).selectExpr("CASE id % 3 WHEN 0 THEN xxhash64(id) WHEN 1 THEN 7 END AS doc_id", "id AS own")
    rows = balanced_shards(docs, docs.selectExpr("doc_id", "own % 50 AS hub").where("doc_id <> 7"), 7).collect()
    sizes = [sorted(r.slot for r in rows if r["shard"] == s) for s in range(7)]
    assert sorted(map(len, sizes)) == [128] * 3 + [129] * 4 and all(s == list(range(len(s))) for s in sizes)
    assert sorted(r.own for r in rows) == list(range(900))


def test_sharding_keeps_groups_and_splits_giants(spark):
    """500 rows in 10 shards: a group of 120 fills three shards, pairs stay together."""
    docs = spark.range(500).withColumnRenamed("id", "doc_id")
    hub = F.when(F.col("doc_id") < 120, F.lit(-1)).otherwise(F.floor(F.col("doc_id") / 2))
    links = docs.select("doc_id", hub.alias("hub")).where("doc_id < 300")
    rows = balanced_shards(docs, links, 10, rounds=20).collect()
    shards = {r.doc_id: r.shard for r in rows}
    assert {list(shards.values()).count(s) for s in range(10)} == {50}
    assert sum(shards[i] == shards[i + 1] for i in range(120, 300, 2)) >= 80
    giant = [list(shards[i] for i in range(120)).count(s) for s in range(10)]
    assert sum(sorted(giant)[-4:]) >= 90
