import logging

from pyspark.sql import functions as F

from gleanwork import engine
from gleanwork.functions import segment
from gleanwork.logs import DailyFile
from gleanwork.operators import index
from gleanwork.plans.query import parse
from gleanwork.sources.extract import Router
from gleanwork.streaming import ingest
from tests.test_search import ROWS, table


def test_files_arrive(spark, tmp_path):
    root, t = tmp_path / "in", engine.IndexTable(spark, f"{tmp_path}/index")
    root.mkdir()
    for i in range(3):
        (root / f"a{i}.txt").write_text(f"text number{i}")
    (root / "skip.bin").write_text("x")
    for _ in range(2):
        ingest.ingest_stream(ingest.stream_files(spark, f"file://{root}", ["txt"], 2), t, "p", Router(), f"{tmp_path}/ck")
        (root / "late.txt").write_text("late words")
    assert t.count() == 4 and t.read("manifest").count() == 4
    r = engine.search(parse("late"), t.read("docs"), t.read("postings"))
    assert r.total_hits == 1 and r.df.first().content_highlight == "<mark>late</mark> words"


def test_upserts_in_batches(spark, tmp_path):
    rows = [(i % 5, i, f"v{i}") for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "k int, n int, v string").coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema("k int, n int, v string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    ingest.upsert_stream(stream, f"{tmp_path}/t", "k", ("n",))
    assert {r.k: r.v for r in ingest.read_version(spark, f"{tmp_path}/t").collect()} == {i: f"v{35 + i}" for i in range(5)}


def test_dictionary(spark, tmp_path):
    (tmp_path / "words.txt").write_text("年度 50\n总结 50\n年度总结 20\n报告 40\n性能 9\n优化 9\n")
    d = segment.load(segment.resolve("words.txt", ["/nowhere", str(tmp_path)]))
    assert d.tokens("2024年度总结报告 v1.5 OK") == ["2024", "年度", "总结", "年度总结", "报告", "v1.5", "ok"]
    assert d.tokens("优化xyz未知") == ["优化", "xyz", "未", "知"]
    docs = table(spark, ROWS, "A")
    p = index.postings(docs, segment.tokenizer(d)).where(F.col("term") == "性能").collect()
    assert [r.path for r in p] == ["/data/报告/2024年度总结报告.docx"]
    try:
        segment.resolve("none.txt", ["/a", "/b"])
    except FileNotFoundError as e:
        assert "/a/none.txt" in str(e) and "/b/none.txt" in str(e)


def test_log_file(tmp_path):
    log = logging.getLogger("t")
    log.addHandler(DailyFile(str(tmp_path / "logs")))
    log.error("went %s", "wrong")
    (f,) = (tmp_path / "logs").iterdir()
    assert "[ERROR] went wrong" in f.read_text()
    log.addHandler(DailyFile("/proc/none"))
    log.error("still fine")
