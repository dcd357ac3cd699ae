from datetime import datetime

import pytest

from gleanwork import engine
from gleanwork.operators import highlight, index
from gleanwork.plans import planner
from gleanwork.plans.query import Scope, parse
from gleanwork.schemas import EXTRACTED

DOC = "本年度总结说明检索工具Gleaner的进展：寻迹模块、索引写入与性能优化都已完成，报告附后。"
ROWS = [
    ("/data/报告/2024年度总结报告.docx", "docx", 12345, DOC, True),
    ("/data/报告/预算表.xlsx", "xlsx", 999, "2024年部门预算明细表", True),
    ("/data/幻灯片/发布会.pptx", "pptx", 555, "", False),
]


def table(spark, rows, profile):
    full = [(p, e, s, datetime(2024, 1, 1), c, i, None) for p, e, s, c, i in rows]
    return index.map_documents(spark.createDataFrame(full, EXTRACTED), profile)


@pytest.fixture(scope="module")
def corpus(spark):
    docs = table(spark, ROWS, "A").persist()
    return docs, index.postings(docs).persist()


def find(corpus, raw, scope=Scope.BOTH, **more):
    q = parse(raw, scope)
    return engine.search(q, *corpus, **more) if q else None


@pytest.mark.parametrize(
    ("raw", "names"),
    [
        ("寻迹", ["2024年度总结报告.docx"]),
        ('"年度总结"', ["2024年度总结报告.docx"]),
        ("预算 -总结", ["预算表.xlsx"]),
        ("*.xlsx", ["预算表.xlsx"]),
        ("filename:明细表", []),
        ("content:性能优化", ["2024年度总结报告.docx"]),
        ("不存在的关键词xyz", []),
        ("发布会", ["发布会.pptx"]),
        ("-总结", ["发布会.pptx", "预算表.xlsx"]),
        ("gleaner", ["2024年度总结报告.docx"]),
        ("name:202?年*", ["2024年度总结报告.docx"]),
        ("content:glean*", ["2024年度总结报告.docx"]),
        ("*", ["2024年度总结报告.docx", "发布会.pptx", "预算表.xlsx"]),
        ("-filename:*.docx -预算", ["发布会.pptx"]),
    ],
)
def test_golden_queries(corpus, raw, names):
    r = find(corpus, raw)
    rows = r.df.collect()
    assert sorted(x.file_name for x in rows) == names and r.total_hits == len(names)


def test_highlights(corpus):
    row = find(corpus, "寻迹").df.first()
    assert "<mark>寻迹</mark>" in row.content_highlight and row.file_name_highlight is None
    row = find(corpus, "发布会").df.first()
    assert row.content_highlight is None and row.content_indexed is False and row.file_name_highlight == "<mark>发布会</mark>.pptx"


def test_two_profiles_are_searched_together(spark, corpus):
    other = table(spark, ROWS, "B")
    docs = corpus[0].unionByName(other)
    r = engine.search(parse("寻迹"), docs, index.postings(docs))
    assert sorted(x.profile_id for x in r.df.collect()) == ["A", "B"] and r.total_hits == 2


def test_update_and_delete(spark):
    a = table(spark, [("/data/a.txt", "txt", 1, "旧内容版本一", True), ("/data/b.txt", "txt", 1, "待删除文档的内容", True)], "A")
    new = table(spark, [("/data/a.txt", "txt", 2, "新内容版本二", True)], "A")
    docs = index.remove(index.update(a, new), spark.createDataFrame([("/data/b.txt",)], "path string"))
    both = docs, index.postings(docs)
    assert docs.count() == 1
    assert [find(both, q).total_hits for q in ("旧内容", "新内容", "待删除")] == [0, 1, 0]


def test_category_filters_the_page_only(corpus):
    r = find(corpus, "*", category="sheet", k=200)
    assert [x.file_name for x in r.df.collect()] == ["预算表.xlsx"] and r.total_hits == 3
    assert find(corpus, "*", category="sheet", k=1, filter_before_limit=True).df.count() == 1


def test_scores_and_ties(spark):
    rows = [("/d/a.txt", "txt", 1, "cat cat dog", True), ("/d/b.txt", "txt", 1, "cat dog bird", True), ("/d/c.txt", "txt", 1, "cat dog bird", True)]
    docs = table(spark, rows, "A")
    got = engine.search(parse("cat", Scope.CONTENT), docs, index.postings(docs), highlights=False).df.collect()
    assert [x.path for x in got] == ["/d/a.txt", "/d/b.txt", "/d/c.txt"] and got[1].score == got[2].score < got[0].score


def test_byte_norm(spark):
    from pyspark.sql import functions as F

    want = {1: 1.0, 2: 0.625, 3: 0.5, 4: 0.5, 5: 0.4375, 6: 0.375, 7: 0.375, 8: 0.3125, 10: 0.3125, 16: 0.25, 20: 0.21875, 50: 0.125, 100: 0.09375, 500: 0.0390625}
    got = spark.createDataFrame([(n,) for n in want], "n long").select("n", planner.byte_norm(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in got} == want


def test_fragment_picks_the_best_part():
    text = "alpha " * 30 + "beta gamma " + "delta " * 30
    assert "<mark>beta</mark> <mark>gamma</mark>" in highlight.fragment(parse("beta gamma"), text)
    assert highlight.fragment(parse("omega"), text) is None and highlight.fragment(parse("a"), "") is None
    assert highlight.whole(parse('"a b" -c'), "a b c a") == "<mark>a</mark> <mark>b</mark> c a"
    assert highlight.whole(parse("th*"), "The other this") == "<mark>The</mark> other <mark>this</mark>"


def test_plan_reads_few_columns_and_filters_terms(spark, tmp_path):
    docs = table(spark, ROWS, "A")
    index.postings(docs).write.parquet(f"{tmp_path}/p")
    q = parse("gleaner", Scope.CONTENT)
    plan = planner.Plan(q, docs, spark.read.parquet(f"{tmp_path}/p")).matches(scored=False)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(field,content), EqualTo(term,gleaner)]" in text or "In(term" in text or "EqualTo(term,gleaner)" in text
