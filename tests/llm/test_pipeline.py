"""The pipeline's stages on odd rows, each against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ("size", "__key", "__size", "score", "lang_pred", "row", "number", "copies", "words", "column1", "hub")
LONG = "The house of the man and the garden of the woman stand by the river "


@pytest.fixture(scope="module")
def odd(spark):
    words = [f"w{k}" for k in range(60)]
    near = words.copy()
    near[59] = "other"
    rows = [
        (1, " ".join(words), "en", "a"), (2, " ".join(near), "en", "b"), (3, " ".join(words).upper(), None, None), (4, None, "en", "a"),
        (5, "", None, "a"), (6, "123 456", "de", "b"), (7, LONG * 3_000, "en", "a"), (7, LONG * 3_000, "en", "a"), (8, "one text", "en", "a"),
        (8, "quite another text", "en", "a"), (None, "no id here", "en", "a"), (None, "no id here", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None) for r in rows], SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})


def taken(docs):
    rows = docs.collect()
    assert all(r[c] == "clash" for r in rows for c in CLASHES)
    return Counter((r.doc_id, r.text) for r in rows)


def test_languages_keep_what_has_letters(spark, odd):
    got = pipeline.language_id(spark, odd, SF)
    assert got.columns == odd.columns
    assert taken(got) == Counter({k: n for k, n in taken(odd).items() if k[0] not in (4, 5, 6)})
    assert got.where("lang IS NULL").count() == 0


def test_one_of_each_group_stays(spark, odd):
    got = pipeline.near_duplicates(spark, odd, SF)
    assert got.columns == odd.columns
    want = taken(odd)
    want = Counter({k: 1 if k[0] == 7 else n for k, n in want.items() if k[0] not in (2, 3)})
    assert taken(got) == want


def test_mixing_repeats_whole_rows(spark, odd):
    got = pipeline.mixing(spark, odd, SF)
    assert got.columns == odd.columns
    rows, mixed = taken(odd), taken(got)
    assert set(mixed) <= set(rows) and all(n <= 2 * rows[k] for k, n in mixed.items())


def test_shards_hold_every_row_once(spark, odd):
    got = pipeline.sharding(spark, odd, SF)
    assert got.columns == [*odd.columns, "shard", "slot"] and taken(got) == taken(odd)
    places = Counter((r["shard"], r["slot"]) for r in got.collect())
    assert set(places.values()) == {1} and all(0 <= s < pipeline.N_SHARDS for s, _ in places)


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_no_documents(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), SF).count() == 0
