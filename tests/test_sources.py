import hashlib
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from domloom.operators import extract as ex
from domloom.operators.ranking import number_rows, running_total
from domloom.operators.schema import Section
from domloom.plans.queries import all_queries
from domloom.sources import sinks, urls
from domloom.sources.page_files import PageFilesWriter, file_name, write_page_files
from domloom.sources.pages import file_pages, list_html_dir, load_changed, load_html_dir, read_pages, readable, with_identifier
from domloom.sources.steps import StepStore, save_result


@pytest.mark.parametrize("shifts", [(1,), (2, 4), (1, 2, 3), (20, 40)])
def test_running_total_in_ranges_of_any_width(spark, shifts):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), o, rng.randint(0, 3)) for o in rng.sample(range(-20, 60), 50)]
    got = running_total(spark.createDataFrame(rows, "k string, o bigint, v int"), ["k"], "o", F.col("v"), "t", shifts)
    want = {(k, o): sum(v for k2, o2, v in rows if k2 == k and o2 <= o) for k, o, _ in rows}
    assert {(r.k, r.o): r.t for r in got.collect()} == want


def test_number_rows_without_keys(spark):
    got = number_rows(spark.createDataFrame([(i * 1_000_003,) for i in range(30)], "o bigint"), [], "o", "n")
    assert [r.n for r in got.orderBy("o").collect()] == list(range(1, 31))


def dedupe(names):
    """First row of a name keeps it; copies take the free numbers in order."""
    owned, seen, result = set(names), {}, []
    for name in names:
        if name not in seen:
            seen[name] = 0
            result.append(name)
            continue
        while True:
            seen[name] += 1
            candidate = f"{name[:-5]}_{seen[name]}.html"
            if candidate not in owned:
                break
        result.append(candidate)
    return result


@pytest.mark.parametrize("names", [
    ["a.html"] * 4,
    ["a.html", "a.html", "a_1.html", "a.html", "a_1.html"],
    ["a_1.html", "a_2.html", "a_3.html", "a.html", "a.html", "a.html", "a_10.html", "a_01.html"],
    ["x.html", "x.html", "x_1.html", "x_1.html", "x_1_1.html", "x.html"],
])
def test_dedupe_small(spark, names):
    files = spark.createDataFrame(list(enumerate(names, 1)), "position bigint, filename string")
    got = [r.filename for r in urls.dedupe_filenames(files).orderBy("position").collect()]
    assert got == dedupe(names) and len(set(got)) == len(names)


def test_dedupe_with_a_hot_name(spark, monkeypatch):
    rng = random.Random(3)
    names = [rng.choice(["i.html"] * 4 + ["b.html", f"i_{rng.randint(1, 60)}.html", f"b_{rng.randint(1, 9)}.html"]) for _ in range(300)]
    monkeypatch.setattr(urls, "DENSE", (3,))
    files = spark.createDataFrame(list(enumerate(names, 1)), "position bigint, filename string").repartition(4)
    got = [r.filename for r in urls.dedupe_filenames(files).orderBy("position").collect()]
    assert got == dedupe(names)


def test_url_list_file(spark, tmp_path):
    path = tmp_path / "urls.txt"
    path.write_text("# list\n\nhttp://a/1\n  https://b/2  \nno-scheme/x\n#http://c\nhttp://\nhttp://a/1\n", encoding="utf-8")
    lines = urls.read_url_lines(spark, str(path))
    assert [r.url for r in urls.load_urls(lines).orderBy("line_no").collect()] == ["http://a/1", "https://b/2", "http://a/1"]
    assert {r.url for r in urls.rejected_urls(lines).collect()} == {"no-scheme/x", "http://"}
    numbered = urls.number_urls(urls.load_urls(lines)).orderBy("position").collect()
    assert [(r.position, r.url) for r in numbered] == [(1, "http://a/1"), (2, "https://b/2"), (3, "http://a/1")]


def test_attach_and_backlog(spark):
    known = spark.createDataFrame([("a.html", "http://a"), ("b.html", "http://b")], "filename string, url string")
    files = spark.createDataFrame([("a.html",), ("z.html",)], "name string")
    assert {(r.name, r.url, r.matched) for r in urls.attach_url(files, known).collect()} == {
        ("a.html", "http://a", True), ("z.html", None, False),
    }
    wanted = spark.createDataFrame([("u1",), ("u2",), ("u1",)], "url string")
    pages = spark.createDataFrame([("u2",), ("u3",)], "url string")
    assert {tuple(r) for r in urls.fetch_backlog(wanted, pages).collect()} == {("u1", 2, False), ("u2", 1, True)}


def test_html_directory(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<p>ü</p>\r\n<p>b".encode())
    (tmp_path / "bad.html").write_bytes(b"<p>\xff\xfe</p>")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.html").write_text("no")
    files = load_html_dir(spark, str(tmp_path))
    rows = {r.name: r for r in files.collect()}
    assert set(rows) == {"a.html", "bad.html"}
    assert rows["a.html"].html == "<p>ü</p>\n<p>b" and rows["a.html"].error is None
    assert rows["bad.html"].html is None and rows["bad.html"].error == "not valid UTF-8"
    good = with_identifier(readable(files)).collect()
    assert len(good) == 1 and good[0].identifier.endswith("a.html")
    assert load_html_dir(spark, str(tmp_path / "missing")).count() == 0
    extracted = ex.extract(file_pages(files), [Section("p", "//p")], keep=["name", "read_error"])
    status = {r.file: r for r in ex.extract_status(extracted, F.col("name"), F.col("read_error")).collect()}
    assert status["a.html"].status == "success" and status["a.html"].result_file == "a.json"
    assert status["bad.html"].error == "Failed to read file: not valid UTF-8"


def test_small_files_share_tasks(spark, tmp_path):
    """The tasks that read a folder do not grow with its files, and no core is left without one."""
    for i in range(200):
        (tmp_path / f"{i}.html").write_text(f"<p>{i}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        for files in (load_html_dir(spark, str(tmp_path)), list_html_dir(spark, str(tmp_path))):
            assert 4 <= files.rdd.getNumPartitions() <= 64 and files.count() == 200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_identifier_order(spark):
    rows = spark.createDataFrame([("u", "p"), (None, "p"), (None, None)], "url string, path string")
    assert [r.identifier for r in with_identifier(rows).collect()] == ["u", "p", "unknown"]


def test_small_tables_are_spread(spark):
    assert read_pages(spark, "/root/testdata/sf0.001/pages.parquet").rdd.getNumPartitions() >= 4


def test_step_store(spark, tmp_path):
    store = StepStore(spark, str(tmp_path / "run"))
    assert store.load(1, "schema") is None and store.manifest().count() == 0
    store.save(1, "schema", spark.range(3), {"k": 1})
    store.save(1, "schema", spark.range(4))
    store.note(2, "failed", None)
    assert store.load(1, "schema").count() == 4 and store.exists(1, "schema") and not store.exists(2, "schema")
    rows = store.manifest().collect()
    assert sorted((r.run_id, r.step) for r in rows) == [(1, "schema"), (1, "schema"), (2, "failed")]


def test_save_result(spark, tmp_path):
    save_result(spark.createDataFrame([("a",)], "t string"), str(tmp_path / "t"))
    save_result(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "t")).first().value == "a"
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":1,"b":null}'


def test_markdown_text_sink(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# a"), (2, None)], "page_id bigint, markdown string")
    sinks.write_markdown_text(docs, str(tmp_path / "md"))
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).collect()] == ["# a", ""]


def opened_files(frame):
    """Files that the scans of a collected frame have opened, by the plan's own count."""
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return sum(x.metrics().apply("numFiles").value() for x in found if x.nodeName().startswith("Scan text"))


@pytest.mark.parametrize("few", [1000, 0])
def test_changed_files_only_are_read(spark, tmp_path, few):
    import os

    for i in range(6):
        (tmp_path / f"{i} ü.html").write_text(f"<p>{i}")
        os.utime(tmp_path / f"{i} ü.html", (1_700_000_000, 1_700_000_000 + i))
    (tmp_path / "no.txt").write_text("x")
    none = spark.createDataFrame([], "path string, bytes bigint, modified timestamp")
    first = load_changed(spark, str(tmp_path), none, few=few)
    assert sorted(r.html for r in first.collect()) == [f"<p>{i}" for i in range(6)]
    done = list_html_dir(spark, str(tmp_path))
    assert sorted(map(tuple, first.select("path", "bytes", "modified").collect())) == sorted(map(tuple, done.collect()))
    done = spark.createDataFrame(done.collect(), done.schema)
    assert load_changed(spark, str(tmp_path), done, few=few).count() == 0
    (tmp_path / "3 ü.html").write_text("<p>changed")
    (tmp_path / "new.html").write_text("<p>new")
    second = load_changed(spark, str(tmp_path), done, few=few)
    assert sorted(r.html for r in second.collect()) == ["<p>changed", "<p>new"]
    if few:
        assert opened_files(second.toDF(*second.columns)) in (0, 2)
    (tmp_path / "0 ü.html").unlink()
    assert load_changed(spark, str(tmp_path / "missing"), done, few=few).count() == 0


def test_one_file_per_page(spark, tmp_path):
    rows = [(f"p{i}.md", f"text {i} é") for i in range(50)] + [("a/../b.md", "x"), ("none.md", None), (None, "y")]
    documents = spark.createDataFrame(rows, "markdown_file string, markdown string").repartition(5)
    for _ in range(2):  # a second run replaces the files of the first
        sinks.write_markdown_files(documents, str(tmp_path / "md"))
    found = {p.name: p.read_text() for p in (tmp_path / "md").iterdir()}
    assert found.pop("_SUCCESS") == "51"
    assert found == {file_name(n): t for n, t in rows if n and t}
    assert spark.read.text(str(tmp_path / "md" / "*.md"), wholetext=True).count() == 51
    records = spark.createDataFrame([("a.json", (1, "x")), ("b.json", None)], "result_file string, record struct<n: int, t: string>")
    sinks.write_extraction_files(records, f"file://{tmp_path}/json")
    assert (tmp_path / "json" / "a.json").read_text() == '{"n":1,"t":"x"}' and not (tmp_path / "json" / "b.json").exists()


def test_page_files_of_bytes(spark, tmp_path):
    """A binary column reaches the file as it is, also where it is no UTF-8."""
    rows = [("a.txt", b"<p>\xff\r\n"), ("b.txt", b""), ("c.txt", None), ("d.txt", "é\n".encode())]
    write_page_files(spark.createDataFrame(rows, "file string, content binary"), str(tmp_path / "out"), "file", "content")
    found = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if p.suffix == ".txt"}
    assert found == {n: t for n, t in rows if t is not None}


def file_pages_table(spark, folder):
    """Pages whose ids repeat or are null; two are empty, one is null."""
    rows = [(7, "<p>ü"), (7, "<p>ü"), (1, "<p>a\r\nb"), (1, "<p>ab"), (None, "<p>n"), (2, ""), (7, ""), (3, None)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id bigint, url string, html string")
    pages.repartition(3).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture
def spark_files(spark, monkeypatch):
    """Spark's text writer, by which each file costs a place in the driver's commit, is not used."""
    def text(*_, **__):
        raise AssertionError("one file per row by the text writer")

    monkeypatch.setattr(DataFrameWriter, "text", text)
    return spark


def test_changed_files_query_has_a_file_for_each_page(spark_files, tmp_path):
    rows = all_queries()["changed_files"](spark_files, file_pages_table(spark_files, tmp_path)).collect()
    # with its line end, <p>ü has 6 bytes, <p>a\r\nb 8, <p>ab 6 and <p>n 5: only odd lengths have changed
    assert [tuple(r) for r in rows] == [(md5("<p>n\n"), 5, 1)]


def test_html_files_query_has_a_file_for_each_page(spark_files, tmp_path):
    rows = all_queries()["load_html_dir"](spark_files, file_pages_table(spark_files, tmp_path)).collect()
    assert {tuple(r) for r in rows} == {
        (None, "not valid UTF-8", 2), (md5("<p>a\nb\n"), None, 1), (md5("<p>ab\n"), None, 1), (md5("<p>n\n"), None, 1)}


def test_an_attempt_that_fails_leaves_no_file(tmp_path):
    """The first attempt of a task dies in the middle; the second writes the same rows."""
    rows = [{"name": f"{i}.md", "text": "x" * i} for i in range(5)]

    def dying():
        yield from rows[:3]
        raise OSError("lost")

    writer = PageFilesWriter(str(tmp_path / "out"), overwrite=True)
    with pytest.raises(OSError):
        writer.write(dying())
    message = writer.write(iter(rows))
    writer.commit([message, None])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [*(f"{i}.md" for i in range(5)), "_SUCCESS"]
