import random

import pytest

from gleanwork.llm import registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, set_key string"
LABELS = "doc_id long, quality int, toxic int, extra string"
PAGES = "page_id long, url string, html string, host string"
BENCH = "item_id long, text string, n int"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    names = ["".join(r2.choice(["th", "an", "er", "on", "re", "ing", "ed", "es"]) for _ in range(r2.randint(1, 4))) + str(i % 10) * (i % 3 == 0) for i in range(vocabulary) if (r2 := random.Random(i))]
    return " ".join(r.choice(names) + ("." if k % 11 == 10 else "") + ("\n" if k % 37 == 36 else "") for k in range(words))


def near(text: str, seed: int, edits: int = 1) -> str:
    r, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{seed}"
    return " ".join(w)


def write(spark, folder, docs, labels=(), pages=(), bench=()):
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("pages", pages, PAGES), ("benchmark", bench, BENCH)):
        spark.createDataFrame(list(rows), schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def doc(i, text, lang="en", source="s0"):
    return (i, text, lang, source, len(text or ""), 0.5, 1, "x")


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows and clashing column names."""
    base = prose(1, 120)
    docs = [doc(1, base), doc(2, None), doc(3, ""), doc(4, " \n\t "), doc(None, prose(2, 60)), doc(5, base), doc(6, near(base, 3)), doc(6, near(base, 3)), doc(7, "one"), doc(8, "one two three"), doc(9, "héé 日本 😀 \r\n ▁ x")]
    docs += [doc(10, prose(3, 60_000, 3000)), doc(11, "w" * 300_000), doc(12, "same " * 5000), doc(13, prose(4, 80), None, None), (None, None, None, None, None, None, None, None)]
    docs += [doc(100 + i, prose(100 + i, 90), "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    docs += [doc(200 + i, " ".join(w + "***" for w in prose(200 + i, 60).split())) for i in range(15)] + [doc(300 + i, prose(300 + i, 50) + " idiot stupid moron trash scum") for i in range(15)]
    labels = [(100 + i, 1, 0, None) for i in range(60)] + [(200 + i, 0, 0, "a") for i in range(15)] + [(300 + i, 1, 1, "b") for i in range(15)] + [(None, 1, 1, None), (1, None, None, None), (100, 1, 0, "twice"), (9999, 0, 1, None)]
    page = "<html><head><title>T</title></head><body><nav><a href=x>menu</a></nav><article><h1>Head &amp; more</h1><p>Body {}</p></article><footer>foot</footer></body></html>"
    pages = [(i, f"http://h{i % 3}.example.com/{i}", page.format(prose(i, 20 if i else 300)), None) for i in range(12)] + [(50, None, None, "h"), (51, "nonsense", "", None), (52, "http://a/", "plain text < 3", None), (None, "http://a/x", page.format("no id"), None)]
    pages += [(60 + i, "http://c/x", page.format(prose(7, 400)), None) for i in range(3)] + [(62, "http://c/x", page.format(prose(7, 400)), None), (70, "http://l/", "<p>" * 20000 + "deep", None)]
    bench = [(1, " ".join(base.split()[20:60]), 1), (2, None, 2), (3, "", None), (4, "one two three", 1), (None, prose(900, 30), 1), (5, prose(901, 25), 1)]
    return write(spark, tmp_path_factory.mktemp("edge"), docs, labels, pages, bench)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("nothing"), [])


@pytest.fixture(scope="session")
def queries():
    return registry.QUERIES
