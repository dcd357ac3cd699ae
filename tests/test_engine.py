import os
import stat

import pytest

from gleanwork.control import Cancelled, RunControl
from gleanwork.engine import Engine, IndexTable, search
from gleanwork.plans.query import Scope, parse
from gleanwork.sources.scan import SourceUnavailable, scan, walk
from tests.test_search import table


def write(path, text="x", when=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    if when:
        os.utime(path, (when, when))


@pytest.fixture
def made(spark, tmp_path):
    eng = Engine(spark, f"{tmp_path}/home")
    return eng, str(tmp_path / "root"), eng.create_profile("p", str(tmp_path / "root"), str(tmp_path / "index"), ["txt", "ppt"])


def test_index_update_remove_and_search_offline(made, spark, tmp_path):
    eng, root, p = made
    write(f"{root}/a.txt", "寻迹关键词alpha内容", 1000)
    write(f"{root}/sub/b.txt", "另一份不相关的内容", 1000)
    write(f"{root}/ignored.exe")
    write(f"{root}/slides.ppt", "bytes")
    seen = []
    s = eng.index(p, on_progress=seen.append)
    assert (s.added, s.updated, s.removed, s.unchanged, s.final_count) == (3, 0, 0, 0, 3)
    assert seen[-1].indexed == 3 and seen[-1].percent == 100
    r = eng.search("alpha")
    assert r.total_hits == 1 and "<mark>alpha</mark>" in r.df.first().content_highlight
    row = IndexTable(spark, p.storage_path).read("docs").where("extension = 'ppt'").first()
    assert not row.content_indexed and "仅索引文件名" in row.skip_reason and row.content == ""

    s = eng.index(p)
    assert (s.added, s.updated, s.removed, s.unchanged, s.final_count) == (0, 0, 0, 3, 3)
    write(f"{root}/a.txt", "changed beta text", 2000)
    os.remove(f"{root}/sub/b.txt")
    s = eng.index(p)
    assert (s.added, s.updated, s.removed, s.unchanged, s.final_count) == (0, 1, 1, 1, 2)
    assert eng.search("alpha").total_hits == 0 and eng.search("beta").total_hits == 1
    s = eng.index(p, rebuild=True)
    assert (s.added, s.final_count) == (2, 2)

    import shutil

    shutil.rmtree(root)
    with pytest.raises(SourceUnavailable):
        eng.index(p)
    assert eng.search("beta", Scope.CONTENT).total_hits == 1
    (found,) = eng.all_profiles()
    assert found.status == "SourceUnavailable" and found.file_count == 2


def test_size_limit_and_full_mode(made, spark):
    eng, root, p = made
    p.max_content_bytes = 1
    write(f"{root}/huge.txt", "hello", 1000)
    write(f"{root}/gone.txt", "a", 1000)
    eng.index(p)
    row = IndexTable(spark, p.storage_path).read("docs").where("file_name = 'huge.txt'").first()
    assert not row.content_indexed and "MB 上限" in row.skip_reason
    p.incremental_enabled = False
    os.remove(f"{root}/gone.txt")
    s = eng.index(p)
    assert (s.updated, s.removed) == (1, 0)


def test_unbuilt_profiles_and_ids(made, spark, tmp_path):
    eng, root, p = made
    write(f"{root}/a.txt", "common words")
    eng.index(p)
    other = eng.create_profile("q", str(tmp_path / "r2"), str(tmp_path / "i2"), ["txt"])
    assert eng.search("common", profile_ids=[other.id]).total_hits == 0
    write(f"{tmp_path}/r2/b.txt", "common too")
    eng.index(other)
    assert eng.search("common").total_hits == 2
    assert [r.profile_id for r in eng.search("common", profile_ids=[other.id]).df.collect()] == [other.id]
    assert eng.search("   ").total_hits == 0


def test_unreadable_directories(tmp_path):
    root = str(tmp_path)
    write(f"{root}/open/a.txt")
    write(f"{root}/shut/b.txt")
    os.chmod(f"{root}/shut", 0)
    try:
        files, closed, failed, _ = walk(root, ["TXT"])
        if os.geteuid():
            assert closed == [f"{root}/shut"] and [f[0] for f in files] == [f"{root}/open/a.txt"]
        else:
            assert len(files) == 2 and not failed
    finally:
        os.chmod(f"{root}/shut", stat.S_IRWXU)


def test_scan_of_other_storage_lists_without_contents(spark, tmp_path):
    write(f"{tmp_path}/a.txt", "abc")
    write(f"{tmp_path}/b.bin", "abc")
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "false")
    found, _, _ = scan(spark, f"file://{tmp_path}", ["txt"])
    assert [(r.extension, r.size_bytes) for r in found.collect()] == [("txt", 3)]


def test_control():
    now = [0.0]
    c = RunControl(clock=lambda: now[0])
    c.pause()
    c.pause()
    now[0] = 5
    assert c.is_paused and c.total_paused() == 5
    c.resume()
    c.resume()
    now[0] = 9
    assert not c.is_paused and c.total_paused() == 5
    c.pause()
    c.reset()
    assert c.total_paused() == 0 and not c.is_paused
    c.checkpoint()
    c.cancel()
    with pytest.raises(Cancelled):
        c.checkpoint()


def test_commits_cost_what_they_write(spark, tmp_path):
    """A hundred documents, then one changed: the commit writes one; reads see the last state."""
    rows = [(f"/d/{i}.txt", "txt", 10, f"word{i} all", True) for i in range(100)]
    t = IndexTable(spark, f"{tmp_path}/i")
    t.append(table(spark, rows, "p"))
    t.upsert(table(spark, [("/d/7.txt", "txt", 11, "changed all", True)] * 2, "p"))  # a key twice: one row
    assert [(s["rows"], s["gone"]) for s in t.segments()] == [(100, 0), (1, 1)]
    size = lambda n: sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(f"{tmp_path}/i/segments/{n}") for f in fs)
    assert size(2) < size(1) / 2
    assert t.count() == 100 and t.read("manifest").count() == 100
    hit = lambda w: search(parse(w), t.read("docs"), t.read("postings")).total_hits
    assert (hit("word7"), hit("changed"), hit("all"), hit("word8")) == (0, 1, 100, 1)
    t.delete(spark.createDataFrame([("/d/7.txt",), ("/d/8.txt",)], "path string"))
    assert (t.count(), t.read("manifest").count(), hit("changed"), hit("word8")) == (98, 98, 0, 0)
    t.upsert(table(spark, [("/d/8.txt", "txt", 11, "back again", True)], "p"))
    assert (t.count(), hit("back"), hit("word8")) == (99, 1, 0)


def test_segments_merge(spark, tmp_path, monkeypatch):
    from gleanwork import segments

    monkeypatch.setattr(segments, "FANOUT", 3)
    t = IndexTable(spark, f"{tmp_path}/i")
    for i in range(5):
        t.upsert(table(spark, [(f"/d/{j}.txt", "txt", i, f"round{i}", True) for j in range(i, i + 3)], "p"))
        assert len(t.segments()) <= 3
    assert {(r.path, r.size_bytes) for r in t.read("docs").collect()} == {(f"/d/{j}.txt", min(j, 4)) for j in range(7)}
    kept = {int(n) for n in os.listdir(f"{tmp_path}/i/segments")}
    assert {s["id"] for s in t.segments()} <= kept and len(kept) <= 3 + 3 * segments.KEPT
    t.truncate()
    assert t.count() == 0 and t.exists()


def test_many_commits_of_a_run(made, spark, monkeypatch):
    from gleanwork import engine

    monkeypatch.setattr(engine, "COMMIT_EVERY", 2)
    eng, root, p = made
    for i in range(6):
        write(f"{root}/f{i}.txt", f"text number{i}", 1000)
    seen, control = [], RunControl()

    def watch(progress):
        seen.append(progress.indexed)
        if progress.indexed:
            control.cancel()

    with pytest.raises(Cancelled):
        eng.index(p, control=control, on_progress=watch)
    t = IndexTable(spark, p.storage_path)
    assert 0 < t.count() == t.read("manifest").count() == seen[-1] < 6
    s = eng.index(p)
    assert s.added == 6 - seen[-1] and s.unchanged == seen[-1] and s.final_count == 6


def test_only_one_process_writes(made, spark):
    from gleanwork.sources import storage

    eng, root, p = made
    write(f"{root}/a.txt", "text")
    with IndexTable(spark, p.storage_path).lock(), pytest.raises(storage.Locked):
        eng.index(p)
    with storage.lock(spark, f"{p.storage_path}/LOCK", lease=-1):  # a lock that was left is taken over
        pass
    assert eng.index(p).added == 1


def test_manifest_over_a_real_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from gleanwork.operators import manifest

    for i in range(30):
        write(f"{tmp_path}/r/d{i % 3}/f{i}.txt", "x" * i, 1000 + i)
    files, _, _ = scan(spark, f"{tmp_path}/r", ["txt"])
    old = files.where("size_bytes > 4").withColumn("size_bytes", F.when(F.col("size_bytes") == 9, 0).otherwise(F.col("size_bytes")))
    changes = manifest.diff(files.where("size_bytes < 25"), old)
    got = manifest.progress(changes, "path").orderBy("path").collect()
    status = {r.path: r.status for r in changes.collect()}
    assert [r.path for r in got] == sorted(status) and len(got) == 30
    for k, r in enumerate(got):
        before = [status[x.path] for x in got[: k + 1]]
        assert (r.scanned, r.unchanged_so_far, r.removed_so_far) == (len(before) - before.count("Removed"), before.count("Unchanged"), before.count("Removed"))
    assert {(r.batch, r.n_writes) for r in manifest.commit_batches(changes.where("status <> 'Unchanged'"), "path", 4).collect()} == {(0, 4), (1, 4), (2, 3)}
    twice = old.where("size_bytes = 6").unionByName(old.where("size_bytes = 6").withColumn("size_bytes", F.lit(99)))
    after = manifest.upsert(old, twice, order=("size_bytes",))
    assert after.count() == old.count() and after.where("size_bytes = 99").count() == 1


def test_walks_are_dealt(spark, tmp_path, monkeypatch):
    from gleanwork.sources import scan as module

    for i in range(40):
        write(f"{tmp_path}/a{i % 5}/b{i % 3}/f{i}.txt", "x" * i)
    want = {r.path: r.size_bytes for r in scan(spark, str(tmp_path), ["txt"])[0].collect()}
    monkeypatch.setattr(module, "DEALT", 4)
    files, closed, failed = scan(spark, str(tmp_path), ["txt"])
    assert {r.path: r.size_bytes for r in files.collect()} == want and len(want) == 40 and not closed and not failed


def test_wildcards_are_looked_up(spark, tmp_path, monkeypatch):
    from gleanwork.plans import planner

    t = IndexTable(spark, f"{tmp_path}/i")
    t.append(table(spark, [(f"/d/{i}.txt", "txt", 10, f"word{i} other", True) for i in range(20)], "p"))
    q = parse("word1* oth??")
    assert planner.expand(q, t.read("terms")) == {"word1*": ["word1", *(f"word1{i}" for i in range(10))], "oth??": ["other"]}
    hits = lambda: {r.path for r in search(q, t.read("docs"), t.read("postings"), terms=t.read("terms")).df.collect()}
    few = hits()
    monkeypatch.setattr(planner, "EXPANDED", 1)
    assert hits() == few == {f"/d/{i}.txt" for i in (1, *range(10, 20))}
    assert planner.expand(parse("none*"), t.read("terms")) == {"none*": []}
