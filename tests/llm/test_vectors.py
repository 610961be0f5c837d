"""Vector operators and the source audit against plain Python, and on odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from domloom.llm import hard_negatives as mining
from domloom.llm import source_audit
from domloom.llm.embedding_dedup import near_vectors
from domloom.llm.hard_negatives import hard_negatives, summaries
from domloom.llm.source_audit import source_divergence

VECTORS = "vec_id bigint, embedding array<double>, label int, n_links string, mark string, row string, length string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "a", "b", "c", "d") for i, v, k in rows], VECTORS)


def odd_rows(width=6):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, width))
    rows = []
    for n in range(140):
        vector = base[n % 6] + rng.normal(size=width) * [0.02, 0.1, 0.5][n % 3]
        rows.append((n, [float(x) for x in vector], None if n % 29 == 5 else n % 4))
    copy = rows[8][1]
    rows += [(500 + n, copy, 0) for n in range(30)]  # copies
    rows += [(600, [2 * x for x in copy], 0), (601, [1e200 * x for x in copy], 0), (602, copy[:-1], 0)]
    rows += [(650, copy, 0)] * 3 + [(650, rows[0][1], 0)]  # a repeated id
    rows += [(None, copy, 0), (700, None, 0), (701, [], 0), (702, [0.0] * width, 0), (703, [None, *copy[1:]], 0),
             (704, [float("nan"), *copy[1:]], 0), (705, [float("inf"), *copy[1:]], 0)]
    return rows


def usable(row):
    return None not in row and len(row[1]) and all(x is not None and np.isfinite(x) for x in row[1])


def links_by_force(rows, threshold):
    units = [np.array(v) / max(abs(x) for x in v) if usable(r) and any((v := r[1])) else None for r in rows]
    units = [u if u is None else u / np.sqrt(u @ u) for u in units]
    near = [[j for j in range(len(rows)) if j != i and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2]
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(len(rows))]
    part = [r[0] for r in rows]
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            for j in near[i]:
                if part[j] < part[i]:
                    part[i], moved = part[j], True
    return sorted(((r[0], len(near[i]), part[i], r[0] == part[i]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("tile_values, piece, threshold", [(1 << 17, 16, 0.98), (6, 1, 0.98), (6, 2, 0.6)])
def test_near_vectors(spark, tile_values, piece, threshold):
    rows = odd_rows()
    got = near_vectors(table(spark, rows).repartition(3), threshold=threshold, tile_values=tile_values, piece=piece).collect()
    assert sorted((tuple(r) for r in got), key=str) == links_by_force(rows, threshold)


def test_near_vectors_in_many_tiles(spark):
    """Ten groups of copies that differ a little, in tiles of 256."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(10, 16))
    rows = [(n, [float(x) for x in base[n % 10] + rng.normal(size=16) * (0.1 if n % 10 else 0.02)], n % 2) for n in range(1500)]
    got = near_vectors(table(spark, rows), tile_values=16).collect()
    assert sorted((tuple(r) for r in got), key=str) == links_by_force(rows, 0.98)


def test_near_vectors_of_floats_and_none(spark):
    rows = table(spark, odd_rows()).withColumn("embedding", F.col("embedding").cast("array<float>"))
    single = [(r.vec_id, r.embedding, r.label) for r in rows.select("vec_id", "embedding", "label").collect()]
    got = near_vectors(rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == links_by_force(single, 0.98)
    assert near_vectors(rows.limit(0)).count() == 0


def negatives_by_force(rows, anchor, positives=5, negatives=3):
    rows = [(i, [int(np.floor(256 * x)) for x in v], k) for i, v, k in rows if usable((i, v, k))]
    found = []
    for n, (i, v, k) in enumerate(rows):
        if not anchor(i):
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), j, kind) for m, (j, w, kind) in enumerate(rows) if m != n and len(w) == len(v)]
        for score, j, _ in sorted(s for s in scores if s[2] == k)[:positives]:
            usual = sorted(s for s in scores if s[2] != k and 50 * -score <= 100 * -s[0] <= 95 * -score)[:negatives]
            found += [(i, j, rank, other, -score, -s) for rank, (s, other, _) in enumerate(usual, 1)]
    return sorted(found)


@pytest.mark.parametrize("block, piece, cells", [(4096, 4096, 1 << 19), (7, 11, 40)])
@pytest.mark.parametrize("width", [6, 37])
def test_hard_negatives(spark, monkeypatch, block, piece, cells, width):
    for name, value in {"BLOCK": block, "PIECE": piece, "CELLS": cells}.items():
        monkeypatch.setattr(mining, name, value)
    rows = [r for r in odd_rows(width) if r[0] not in (601, 650)]
    rows += [(800 + n, [float(n % 2)] * width, n % 3) for n in range(12)]  # ties and zeros
    got = hard_negatives(table(spark, rows).repartition(3), F.col("vec_id") % 5 == 0).collect()
    assert sorted(tuple(r) for r in got) == negatives_by_force(rows, lambda i: i % 5 == 0)
    assert hard_negatives(table(spark, rows).limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_hard_negatives_repeated_and_large(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.0], 2), (3, [0.9, 0.9], 2),
            (10, [2.0**30, 2.0**30], 3), (11, [2.0**30, 2.0**30 + 1], 3), (12, [2.0**30, 2.0**29], 4), (20, [1e300, 1.0], 5), (21, [1e300, 1.0], 5)]
    got = sorted(tuple(r) for r in hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0).collect())
    want = negatives_by_force([r for r in rows if r[0] < 20 and r[0] != 12], lambda i: i % 10 == 0)
    assert [r for r in got if r[0] < 10] == [r for r in want if r[0] < 10]
    # 2**76 does not fit: both scores become the largest number, and 95 % of it is below the negative's.
    assert all(r[4] == 2**63 - 1 for r in got if r[0] >= 10)


def test_summaries_bound_scores():
    rng = np.random.default_rng(1)
    a, b = (np.floor(256 * rng.normal(size=(40, 37))) for _ in range(2))
    one, two = summaries(a), summaries(b)
    begin = 0
    for width in mining.SEGMENTS:
        n = -(-37 // width)
        middle = one[:, begin : begin + n] @ two[:, begin : begin + n].T
        apart = one[:, begin + n : begin + 2 * n] @ two[:, begin + n : begin + 2 * n].T
        assert (np.abs(a @ b.T - middle) <= apart * (1 + 1e-5) + 1).all()
        begin += 2 * n


def audit_by_force(rows, min_docs, top):
    pattern = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), t) for t in pattern.findall((text or "").encode())]
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = [s for k, s in counts if k == lang]

        def shares(count):
            return [1 + 10**9 * (count[t] + 2) // (sum(count[x] for x in kept) + 2 * len(kept)) for t in kept]

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[o])), o.encode()) for o in sources if o != s]
            terms = [(-((a - b) ** 2 // (a + b)), t) for t, a, b in zip(kept, p[s], q) if counts[lang, s][t] and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, n) for n, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs, held, piece", [(2, 400_000, 1 << 20), (1, 3, 5), (1000, 400_000, 1 << 20)])
def test_source_divergence(spark, monkeypatch, min_docs, held, piece):
    monkeypatch.setattr(source_audit, "HELD", held)
    monkeypatch.setattr(source_audit, "PIECE", piece)
    texts = ["One TWO two, three_4 é", "Ünïcode words ÉCOLE école\x00one", "", None, " \t\n9 [brackets] {braces}~\x7f", "日本語 one", "two two three"]
    rows = [(texts[n % 7], [None, "", "en", "fr"][n % 4], [None, "b", "a", "é", "z", ""][n % 6]) for n in range(90)]
    rows += [("One two " * 40_000, "en", "long")] * 2 + [(None, "xx", "lone"), ("", "yy", "p"), ("", "yy", "q")]
    table = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, term string, n string")
    got = source_divergence(table.repartition(3), min_docs=min_docs).collect()
    assert sorted(tuple(r) for r in got) == audit_by_force(rows, min_docs, 10)
    assert source_divergence(table.limit(0)).count() == 0
