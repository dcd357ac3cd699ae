import json

import pytest

from gleanwork import catalog
from gleanwork.profiles import Profile, ProfileStore, evaluate_status


def test_store(spark, tmp_path):
    store = ProfileStore(spark, f"{tmp_path}/home/registry.json")
    assert store.load_all() == ([], [])
    made = [Profile.create(f"p{i}", f"{tmp_path}/root{i}", f"{tmp_path}/s{i}") for i in range(3)]
    for p in [*made, made[0]]:
        store.save(p)
    found, gone = store.load_all()
    assert [p.name for p in found] == ["p0", "p1", "p2"] and not gone and found[0] == made[0]
    store.unregister(made[0].storage_path.upper() + "/")
    assert len(store.registry()) == 2 and store.load(made[0].storage_path) == made[0]
    store._write([*store.registry(), f"{tmp_path}/ghost"])
    assert store.load_all()[1] == [f"{tmp_path}/ghost"]
    (tmp_path / "root1").mkdir()
    store.delete(made[1])
    assert store.load(made[1].storage_path) is None and (tmp_path / "root1").exists()
    (tmp_path / "home/registry.json").write_text("{broken")
    assert store.registry() == []
    (tmp_path / "s2/profile.json").write_text("nonsense")
    assert store.load(made[2].storage_path) is None


def test_form():
    for bad in (("", "/r", "/s"), ("n", " ", "/s"), ("n", "/r", "")):
        with pytest.raises(ValueError):
            Profile.create(*bad)
    with pytest.raises(ValueError):
        Profile.create("n", "/r", "/s", [])
    assert Profile.create("n", "/r", "/s", max_mb="x").max_content_bytes == 200 << 20
    assert Profile.create("n", "/r", "/s", max_mb="5").max_content_bytes == 5 << 20
    assert len(json.dumps(Profile.create("n", "/r", "/s").included_extensions)) > 100


@pytest.mark.parametrize(("root", "built", "n", "status"), [(True, True, 5, "Ok"), (False, True, 5, "SourceUnavailable"), (True, False, 0, "NeedsUpdate"), (True, True, 0, "NeedsUpdate"), (False, False, 0, "SourceUnavailable")])
def test_status(root, built, n, status):
    assert evaluate_status(root, built, n) == status


def test_catalog():
    assert len(catalog.EXTENSIONS) == 30 == len(set(catalog.EXTENSIONS))
    assert catalog.find(".DOCX")[1] == "doc" and catalog.find("htm") is None
    assert [e for e in catalog.EXTENSIONS if catalog.strategy(e) == catalog.NAME_ONLY] == ["ppt", "pptx"]
