import pytest
from pyspark.sql import functions as F

from gleanwork.functions import text as T
from gleanwork.operators import manifest


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        (None, []), ("", []), ("plain", [("plain", False)]), ("前缀<mark>寻迹</mark>后缀", [("前缀", False), ("寻迹", True), ("后缀", False)]),
        ("a<mark>b</mark>c<mark>d</mark>", [("a", False), ("b", True), ("c", False), ("d", True)]),
        ("<mark>a</mark>b<mark>c</mark>", [("a", True), ("b", False), ("c", True)]), ("a<mark>b", [("a", False), ("b", False)]),
    ],
)
def test_parse_highlight(spark, markup, want):
    row = spark.createDataFrame([(markup,)], "m string").select(T.parse_highlight("m").alias("s")).first()
    assert [(x.text, x.is_highlighted) for x in row.s] == want


def test_manifest_upsert_stats_and_diff(spark):
    schema = "path string, size_bytes long, last_write_time long"
    old = spark.createDataFrame([("a", 100, 1), ("b", 250, 1), ("c", 5, 1)], schema)
    new = spark.createDataFrame([("a", 150, 2), ("d", 1, 1)], schema)
    table = manifest.upsert(old.where("path <> 'c'"), new.where("path = 'a'"))
    assert manifest.stats(table).first() == (2, 400) and manifest.stats(table.limit(0)).first() == (0, 0)
    got = {r.path: r.status for r in manifest.diff(new.unionByName(old.where("path = 'b'")), old).collect()}
    assert got == {"a": "Updated", "b": "Unchanged", "c": "Removed", "d": "Added"}
    full = {r.path: r.status for r in manifest.diff(new, old, incremental=False).collect()}
    assert full == {"a": "Updated", "d": "Added"}
    seen = manifest.latest(spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 1, "y")], "path string, n long, v string"), "path", "n")
    assert {r.path: r.v for r in seen.collect()} == {"x": "new", "y": "y"}


def test_scalars(spark):
    df = spark.createDataFrame([(r"C:\a\b.TXT", 0.0, "12"), ("/x/y", 1536.0, "nope"), ("name.tar.gz", 5e12, None)], "p string, n double, s string")
    rows = df.select(T.normalize_path("p").alias("p"), T.directory(T.normalize_path("p")).alias("d"), T.extension("p").alias("e"), T.humanize_bytes("n").alias("h"), T.parse_long(F.col("s")).alias("i"), T.humanize_seconds("n").alias("t")).collect()
    assert tuple(rows[0]) == ("C:/a/b.TXT", "C:/a", "txt", "0 B", 12, "1 秒")
    assert tuple(rows[1]) == ("/x/y", "/x", "", "1.5 KB", 0, "25 分 36 秒")
    assert rows[2].e == "gz" and rows[2].h == "4.5 TB" and rows[2].d == ""
