"""Near copies, test items, licenses, languages, archives, lines and counts against plain Python."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from domloom.llm.decontaminate import contaminations, decontaminated
from domloom.llm.language_id import fit_language_model, predict_language
from domloom.llm.licenses import TEMPLATES, license_scan
from domloom.llm.line_dedup import remove_boilerplate
from domloom.llm.ngram_join import jaccard_components
from domloom.llm.oracles import llm_oracles
from domloom.llm.queries import llm_queries
from domloom.llm.token_counts import TokenRollup, count_tokens, deleted, inserted, pieces, revised
from domloom.llm.warc import parse_records, read_archives, record_headers, resolve_revisits, resolved, write_archives
from domloom.session import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = duck.execute(llm_oracles()[name])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    rows = llm_queries()[name](spark, SF)
    assert sorted(rows.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in rows.collect()), key=str) == sorted(
        (tuple(r[i] for i in order) for r in want.fetchall()), key=str)


def components_by_force(texts):
    sets = {}
    for i, text in texts.items():
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    part = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            shared = len(sets[i] & sets[j])
            if i < j and shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared) and part[i] != part[j]:
                low, high = sorted((part[i], part[j]))
                part = {k: low if v == high else v for k, v in part.items()}
    return {i: (len(sets[i]), part[i]) for i in sets}


@pytest.mark.parametrize("piece, few, block_sets", [(50_000, 16, 1000), (1, 16, 1000), (50_000, 1, 7), (1, 1, 1000)])
def test_near_copies(spark, piece, few, block_sets):
    """Families of edited copies; with ``piece`` 1 every frequent list is split, with ``few`` 1 what
    is left is compared in blocks."""
    words = [f"w{k}" for k in range(60)]
    texts = {}
    for i in range(120):
        own = words.copy() if i % 3 else [f"v{k}" for k in range(60)]
        for edit in range(i % 5):
            own[(7 * i + 13 * edit) % 60] = f"x{i}-{edit}"
        texts[i] = " ".join(own) if i % 11 else " ".join(own).upper()
    texts |= {200: None, 201: "", 202: "one two", 203: "ONE\ttwo\n", 204: "one", 205: "é" * 3, 206: "É" * 3, 207: "long " * 300_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = jaccard_components(docs.withColumn("n", F.lit("clash")), piece=piece, few=few, block_sets=block_sets).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components_by_force(texts)
    assert jaccard_components(docs.limit(0)).count() == 0


def links_by_force(rows):
    """Per ``(id, set)``, how many other such pairs have a similar set, and the least id of its group."""
    shingled = lambda words: frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    nodes = sorted({(i, shingled(text.split())) for i, text in rows}, key=lambda n: (n[0], sorted(n[1])))
    part = {i: i for i, _ in nodes}
    links = dict.fromkeys(nodes, 0)
    for x in nodes:
        for y in nodes:
            shared = len(x[1] & y[1])
            if x != y and 100 * shared >= 80 * (len(x[1]) + len(y[1]) - shared):
                links[x] += 1
                low, high = sorted((part[x[0]], part[y[0]]))
                part = {k: low if v == high else v for k, v in part.items()}
    return sorted((i, len(own), n, part[i]) for (i, own), n in links.items())


@pytest.mark.parametrize("block_sets", [1000, 7])
def test_links_are_counted(spark, block_sets):
    """All links of a group of near copies that are mostly compared with few others, and of copies."""
    texts = []
    for i in range(90):
        own = [f"w{k}" for k in range(120)]
        for edit in range(i % 3):
            own[(11 * i + 37 * edit) % 120] = f"x{i}-{edit}"
        texts += [(i, " ".join(own))] + [(1000 + i, " ".join(own))] * (i % 4 == 1)
    texts += [(i, " ".join(f"v{k}" for k in range(i % 2, 80))) for i in range(200, 206)]
    got = jaccard_components(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5), block_sets=block_sets)
    assert sorted(map(tuple, got.collect())) == links_by_force(texts)


def test_links_of_repeated_ids(spark):
    """Ids with texts of different sizes: every text has its own links, an id has one component."""
    texts = []
    for i in range(60):
        size = 40 + 9 * (i % 8)
        own = [f"w{k}" for k in range(size)]
        own[(13 * i) % size] = f"x{i}"
        texts += [(i % 25, " ".join(own)), (100 + i, " ".join(f"y{i}-{k}" for k in range(30)))]
    texts += [(3, " ".join(f"y7-{k}" for k in range(30)))]
    got = jaccard_components(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == links_by_force(texts)


def test_reordered_test_items(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    texts = [
        (1, "Start " + " ".join(item[6:]) + ", then " + " ".join(item[:6]) + " end"), (2, " ".join(item[:5])), (3, None), (4, ""),
        (5, "nothing " * 50_000), (6, " ".join(item).upper()),
    ]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (3, None), (4, "alpha beta")], "item_id bigint, text string")
    rows = contaminations(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage, len(r.tiles)) for r in rows) == [
        (1, 1, 1.0, 2), (1, 2, 1.0, 2), (1, 4, 1.0, 1), (2, 4, 1.0, 1), (6, 1, 1.0, 1), (6, 2, 1.0, 1), (6, 4, 1.0, 1)]
    assert {r.doc_id for r in decontaminated(docs, items, block_bytes=60).collect()} == {3, 4, 5}
    assert contaminations(docs.limit(0), items).count() == contaminations(docs, items.limit(0)).count() == 0


def tiled_by_force(item, doc, least):
    """Greedy string tiling as written down: the longest match of unmarked words, again and again."""
    item_free, doc_free, matched = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and item_free[i + n] and doc_free[d + n]:
                    n += 1
                best = max(best, (n, -d, -i))
        n, d, i = best[0], -best[1], -best[2]
        if n < least:
            return matched
        for k in range(n):
            item_free[i + k] = doc_free[d + k] = False
        matched += n


@pytest.mark.parametrize("block_bytes", [12_000_000, 40])
def test_tiles_equal_brute_force(spark, block_bytes):
    draw = random.Random(5)
    items = [(k, " ".join(draw.choice("abcdefgh") for _ in range(draw.choice([1, 2, 3, 5, 9, 14])))) for k in range(30)]
    texts = []
    for k in range(60):
        words = [draw.choice("abcdefghxyz") for _ in range(draw.randrange(0, 25))]
        if k % 2:  # pieces of an item in another order
            own = items[k % 30][1].split()
            cut = draw.randrange(len(own) + 1)
            words += own[cut:] + ["x"] + own[:cut]
        texts.append((k, " ".join(words)))
    rows = contaminations(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3),
                          spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes)
    want = []
    for i, text in texts:
        for j, item in items:
            own, words = item.split(), text.split()
            matched = tiled_by_force(own, words, min(4, len(own)))
            if len(own) < 4:
                matched = min(matched, len(own))
            if matched >= 0.6 * len(own) and (len(own) >= 4 or matched == len(own)):
                want.append((i, j, matched))
    assert sorted((r.doc_id, r.item_id, r.matched_words) for r in rows.collect()) == sorted(want)


def test_short_items_and_unspaced_scripts(spark):
    items = [(1, "What is entropy?"), (2, "熵是什么？"), (3, "Yes"), (4, "..."), (5, "何がエントロピーですか。答えは乱雑さです。"), (6, "Что такое энтропия сегодня")]
    texts = [(1, "They ask: WHAT IS ENTROPY, really"), (2, "问题：熵是什么？答案"), (3, "Yesterday and yes-men"), (4, "what is not entropy"),
             (5, "答えは乱雑さです。では、何がエントロピーですか。"), (6, "熵 是"), (7, "— что такое энтропия сегодня?"), (8, None), (1, "What is entropy?")]
    got = contaminations(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in got.collect()) == [
        (1, 1, 1.0), (1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (5, 5, 1.0), (7, 6, 1.0)]


def test_licenses(spark):
    mit = TEMPLATES["MIT"]
    edited = mit.replace("free of charge", "free of any charge").replace("without limitation the rights", "the rights")
    docs = spark.createDataFrame(
        [(1, "İ code\n" + mit + "\nmore"), (2, edited), (3, None), (4, ""), (5, "Released under the MIT License."), (6, "the rights to use")],
        "doc_id bigint, text string")
    rows = {(r.doc_id, r.license): r for r in license_scan(docs).collect()}
    assert set(rows) == {(1, "MIT"), (2, "MIT"), (5, "MIT-line")}
    assert rows[1, "MIT"].coverage == 1.0 and 0.9 < rows[2, "MIT"].coverage < 1.0 and len(rows[2, "MIT"].spans) > 1
    text = docs.where("doc_id = 1").first().text
    assert text[rows[1, "MIT"].start : rows[1, "MIT"].end] == mit.rstrip(".")
    assert license_scan(docs.limit(0)).count() == 0


def test_licenses_close_together(spark):
    """Each of several notices a few words apart is a row, and none is reported twice."""
    line = "Released under the MIT License"
    fill = [f"file{k}" for k in range(20)]
    texts = {gap: ". ".join([line + " " + " ".join(fill[:gap])] * 4) for gap in (0, 1, 3, 6, 11, 12, 20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = license_scan(docs).collect()
    for gap, text in texts.items():
        assert sorted((r.start, r.end) for r in rows if r.doc_id == gap) == [m.span() for m in re.finditer(line, text)]
    assert all(r.license == "MIT-line" and r.coverage == 1.0 for r in rows)


def test_licenses_after_letters_that_split(spark):
    """Lower-casing splits the first word in two; places are characters all the same."""
    text = "İstanbul İzmir. Released under the MIT License. Fin"
    row = license_scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert text[row.start : row.end] == "Released under the MIT License" and [tuple(s) for s in row.spans] == [(row.start, row.end)]


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_language_model(docs.where("doc_id % 4 <> 2"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 ..."), (-4, "the and of " * 200_000)], "doc_id bigint, text string")
    told = {r.doc_id: r for r in predict_language(docs.select("doc_id", "text").unionByName(odd), model).collect()}
    truth = {r.doc_id: r.lang for r in docs.where("doc_id % 4 = 2").collect()}
    assert sum(told[i].lang_pred == lang for i, lang in truth.items()) >= 0.95 * len(truth)
    assert [told[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and told[-4].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in told.values())
    assert fit_language_model(docs.limit(0)) is None and predict_language(docs.limit(0), None).count() == 0


def test_archives(spark):
    rows = [(1, "u1", "a\r\n\r\nWARC/1.1\r\n"), (2, "u\n2", "a\r\n\r\nWARC/1.1\r\n"), (3, None, None), (4, "u4", ""), (-5, "u5", "é"), (7, "u7", "x" * 500_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload_bytes", F.lit("clash"))
    for min_bytes, want in ((0, {1: 2, 3: 4}), (1, {1: 2})):
        path = shared_dir(spark, "warc")
        write_archives(pages, resolve_revisits(record_headers(pages), min_bytes), path, "2026-01-01T00:00:00Z", records_per_file=2)
        got = {r.page_id: r for r in resolved(read_archives(spark, path)).collect()}
        assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == want
        assert {i: bytes(r.payload).decode() for i, r in got.items() if r.payload is not None} == {i: h or "" for i, _, h in rows if i not in want}
        assert {i: r.payload_bytes for i, r in got.items()} == {i: len((h or "").encode()) for i, _, h in rows}
    assert [r["record_type"] for r in parse_records(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")] == ["warcinfo"]


def test_archives_of_repeated_rows(spark):
    """Rows that share an id keep their payloads, none is multiplied, null ids are responses."""
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (2, "u", "a"), (2, "u", "a"), (2, "v", "c"), (None, None, "a"), (None, "w", None), (None, "w", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("refers_to", F.lit("clash"))
    path = shared_dir(spark, "warc")
    write_archives(pages, resolve_revisits(record_headers(pages)), path, "2026-01-01T00:00:00Z")
    got = [(r.page_id, r.record_type, r.refers_to, r.payload and bytes(r.payload).decode()) for r in resolved(read_archives(spark, path)).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "revisit", 2, None), (1, "revisit", 2, None), (1, "response", None, "b"), (2, "response", None, "a"), (2, "response", None, "a"),
        (2, "response", None, "c"), (None, "response", None, "a"), (None, "response", None, b""), (None, "response", None, b""),
    ], key=str)
    path = shared_dir(spark, "warc")
    write_archives(pages.limit(0), resolve_revisits(record_headers(pages.limit(0))), path, "2026-01-01T00:00:00Z")
    assert resolved(read_archives(spark, path)).count() == 0


def test_boilerplate(spark):
    rows = [(i, f"own {i}\n  Cookie notice \nsites {i % 3}\n", f"s{i % 12}") for i in range(24)] + [(100, None, "s1"), (101, "", None), (102, "Cookie notice", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("h1", F.lit("clash"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in remove_boilerplate(docs).collect()}
    assert got[5] == ("own 5\nsites 2\n", 4, 1) and got[102] == ("", 1, 1) and got[100] == (None, 0, 0) and got[101] == ("", 1, 0)
    assert remove_boilerplate(docs.limit(0)).count() == 0


def test_token_rollup(spark):
    docs = spark.createDataFrame([(1, "a few words", "s", None), (2, None, None, "en"), (3, "", "s", None)], "doc_id bigint, text string, source string, lang string")
    counts = count_tokens(docs.withColumn("version", F.lit("v1")).withColumn("old_tokens", F.lit(7))).cache()
    assert {r.doc_id: r.tokens for r in counts.collect()} == {1: 3, 2: 0, 3: 0}
    rollup = TokenRollup(spark, shared_dir(spark, "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit("in", inserted(counts)) and not rollup.commit("in", inserted(counts))
    key = lambda rows: sorted(((r.source, r.lang, r.docs, r.tokens) for r in rows.collect()), key=str)
    assert key(rollup.totals()) == [("s", None, 2, 3), (None, "en", 1, 0)] or len(key(rollup.totals())) == 2
    rollup.commit("revise", revised(counts.where("doc_id = 1").withColumn("old_tokens", F.col("tokens")).withColumn("tokens", F.lit(9))))
    rollup.commit("out", deleted(counts.where("doc_id = 2")))
    assert key(rollup.totals()) == [("s", None, 2, 9)]
    long = "some words, \n  and more " * 9_000
    assert "".join(pieces(long, 1000)) == long and len(list(pieces(long, 1000))) > 50
