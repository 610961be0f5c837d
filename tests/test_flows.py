from pyspark.sql import functions as F

import domloom
from domloom.plans.flows import EXTRACTIONS, current_extractions, learn, process
from domloom.sources.steps import StepStore


def page(i, body="<p>text {i}</p><p>more {i}</p>"):
    return f"<html><body><nav><a href=/>home</a></nav><article><h1>Title {i}</h1>{body.format(i=i)}</article></body></html>"


def table(spark, rows):
    return spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in rows], "page_id bigint, url string, html string")


def test_learn_then_extract(spark):
    sections = {s.name: s for s in learn(table(spark, [(i, page(i)) for i in range(5)]))}
    assert sections["title"].xpath == "/html/body/article/h1" and sections["body_paragraphs"].is_list
    rows = domloom.extract_sections(table(spark, [(9, page(9))]), list(sections.values()), full_text=True).collect()
    got = {r.section: r["values"] if r.is_list else r.value for r in rows}
    assert got["title"] == "Title 9" and got["body_paragraphs"] == ["text 9", "more 9"] and got["navigation"] == "home"


def test_process_resumes_page_by_page(spark, tmp_path):
    store = StepStore(spark, str(tmp_path / "run"))
    learning = table(spark, [(i, page(i)) for i in range(4)])
    first = [(i, page(i)) for i in range(10, 15)] + [(99, None)]
    docs = process(store, 1, learning, table(spark, first))
    assert docs.count() == 6 and docs.filter("markdown is null").count() == 1
    assert docs.filter("page_id = 10").first().markdown.startswith("# Title 10\n\n")

    # one changed page, one new page: only those two are extracted again
    second = [(i, page(i)) for i in range(11, 15)] + [(10, page(10, "<p>changed</p>")), (20, page(20)), (99, None)]
    docs = process(store, 1, learning, table(spark, second))
    stored = store.load(1, EXTRACTIONS)
    assert {r.page_id for r in stored.filter("batch = 2").collect()} == {10, 20}
    assert current_extractions(store, 1).count() == 7 and docs.count() == 7
    assert "changed" in docs.filter("page_id = 10").first().markdown

    # nothing left to do
    process(store, 1, learning, table(spark, second))
    assert store.load(1, EXTRACTIONS).filter("batch = 3").count() == 0
    assert store.manifest().groupBy("step").count().filter("step = 'schema'").first()["count"] == 1


def test_process_without_resume_starts_over(spark, tmp_path):
    store = StepStore(spark, str(tmp_path / "run"))
    pages = table(spark, [(i, page(i)) for i in range(3)])
    process(store, 1, pages, pages)
    process(store, 1, pages, pages, resume=False)
    assert store.load(1, EXTRACTIONS).agg(F.max("batch"), F.count("*")).first() == (1, 3)


def test_to_markdown(spark):
    sections = [domloom.Section("title", "//h1"), domloom.Section("links", "//nav//a", is_list=True)]
    extracted = domloom.extract(table(spark, [(1, page(1))]), sections)
    assert domloom.to_markdown(extracted, sections).first().markdown == "# Title 1\n\n## links\n\n- home"
