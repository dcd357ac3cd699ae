"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleanwork.llm import components, decontaminate, gru, html_extract, lm_score, ngram_join, pieces, quality_rules, registry, sharding, textbytes, toxicity, warc
from tests.conftest import SF
from tests.llm.conftest import doc, near, prose, write


def table(spark, name):
    return {r[0]: r for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()}


def run(spark, name, sf=SF):
    return registry.QUERIES[name](spark, sf)


# ---------------------------------------------------------------- hashing


def test_hashes_depend_on_the_span_only():
    texts = [prose(i, 50).encode() for i in range(5)] + [b"", b"x" * 1_000_000, "é ü\n".encode(), b"a" * (textbytes.CHUNK + 7) + b" b"]
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    s, e, d = textbytes.spans(buf, offs)
    words = [w for t in texts for w in t.split()]
    assert [buf[a:b].tobytes() for a, b in zip(s, e, strict=True)] == words
    assert d.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
    h = textbytes.hashes(buf, s, e)
    own = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert own.setdefault(w, x) == x
        raw = np.frombuffer(w, np.uint8)
        assert textbytes.hashes(raw, np.array([0]), np.array([len(w)]))[0] == x
    assert len(set(own.values())) == len(own)


# ---------------------------------------------------------------- 1


@pytest.fixture(scope="module")
def machine():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Transducer(f.read())


def test_same_ids_as_the_library(machine, spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(5)
    parts = ["a", "e", "th", " ", "  ", "   ", "\n", "\n\n", "\t", "é", "日本", "😀", "in", "ing", "The", "▁", "1", "23", "        ", " " * 17, "ß", "\0", "\r\n", "क्"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [d.text for d in table(spark, "documents").values()]
    ids, offs = machine.encode_all(texts)
    for i, t in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == lib.encode(t), t
        assert machine.decode(ids[offs[i] : offs[i + 1]].tolist()) == lib.decode(ids[offs[i] : offs[i + 1]].tolist())


def test_tables_of_parts_are_bounded_and_keep_what_is_used_again(machine, monkeypatch):
    with open(pieces.MODEL, "rb") as f:
        small = pieces.Transducer(f.read())
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    words = ["".join(digits[n // 36**k % 36] for k in range(4)) for n in range(230_000)]
    texts = [" ".join(["some words come again", *words[i : i + 1000], "\nand  blanks"]) for i in range(0, len(words), 1000)]
    small.encode_all(texts)  # the tables as they are in use
    assert len(small.ends_of_paths) < 202_000 and len(small.known) + len(small.known_parts) == len(small.ends_of_paths)
    monkeypatch.setattr(pieces, "KEPT_PARTS", 3000)
    for again in (0, 2, 500):
        monkeypatch.setattr(pieces, "AGAIN", again, raising=False)
        for some in (texts[:9], texts[3:7], ["", "come again"], texts[:2] * 3):
            ids, offs = small.encode_all(some)
            for i, t in enumerate(some):
                assert ids[offs[i] : offs[i + 1]].tolist() == machine.encode(t)
    plain = [" ".join(["some words", *words[i : i + 1000]]) for i in range(0, 9000, 1000)]
    small.encode_all(plain)
    small.encode_all([" ".join(words[i : i + 1000]) for i in range(10_000, 13_000, 1000)] + ["x"])
    assert "some" in small.known and "words" in small.known and len(small.ends_of_paths) < 4100


def test_waiting_parts_are_relaxed_together(machine, monkeypatch):
    """Only parts longer than LONG go through the lattice one by one, and all have the path that it gives."""
    r = random.Random(3)
    some = ["th", "in", "ing", "e", "er", "an", "é", "日", "😀", "▁", "1", "7f", "ß", "क्", "\0", "%%%", "\t"]
    words = ["".join(r.choice(some) for _ in range(r.randint(1, 40))) for _ in range(3000)] + ["x" * n for n in (63, 64, 65, 200)] + ["", "\n"]
    with open(pieces.MODEL, "rb") as f:
        model = f.read()
    for kind in (pieces.BPE, pieces.UNIGRAM):
        one = pieces.Transducer(model, kind)
        want = [one.path(w) for w in words]
        for pairs in (400_000, 50):
            monkeypatch.setattr(pieces, "KEPT_PAIRS", pairs)
            m = pieces.Transducer(model, kind)
            for step in (1, 700, len(words)):
                for lo in range(0, len(words), step) if step > 1 else range(40):
                    ids, n = m.paths(words[lo : lo + step])
                    ends = np.cumsum(n)
                    assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == want[lo : lo + step]
    calls = []
    path = pieces.Transducer.path
    monkeypatch.setattr(pieces.Transducer, "path", lambda self, part: calls.append(part) or path(self, part))
    m = pieces.Transducer(model)
    texts = ["the theory of\neverything " + "y" * 65, "thsting onnt\n\nantiea  eredat " * 50]
    ids, offs = m.encode_all(texts)
    assert calls == ["▁" + "y" * 65]
    assert [ids[offs[i] : offs[i + 1]].tolist() for i in range(2)] == [machine.encode(t) for t in texts]


def test_a_failed_batch_leaves_no_places_without_paths(monkeypatch):
    with open(pieces.MODEL, "rb") as f:
        m = pieces.Transducer(f.read())
    want = m.encode("some words")
    with monkeypatch.context() as c, pytest.raises(ZeroDivisionError):
        c.setattr(m, "paths", lambda parts: 1 / 0)
        m.encode("other words")
    assert m.encode("some words") == want and m.decode(m.encode("other words")) == "other words"


def test_round_trip(spark):
    assert run(spark, "op1_sentencepiece").where("not round_trip").count() == 0


def message(*fields):
    """A protocol buffer message of (number, value) fields."""

    def varint(x):
        out = b""
        while True:
            out += bytes([x & 127 | (128 if x > 127 else 0)])
            x >>= 7
            if not x:
                return out

    wire = lambda n, v: varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 5) + struct.pack("<f", v) if isinstance(v, float) else varint(n << 3 | 2) + varint(len(v)) + v
    return b"".join(wire(n, v) for n, v in fields)


def unigram_model(scores, charsmap=b"", trim=0):
    parts = [("<unk>", 0.0, pieces.UNKNOWN), *((f"<0x{i:02X}>", 0.0, pieces.BYTE) for i in range(256)), *((p, s, pieces.NORMAL) for p, s in scores.items())]
    spec = [(2, charsmap)] if charsmap else []
    return message(*((1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in parts), (2, message((3, pieces.UNIGRAM), (35, 1))), (3, message((1, b"own"), *spec, (3, 1), (4, trim), (5, 1))))


def test_unigram_ids_equal_the_library():
    import sentencepiece

    r = random.Random(9)
    names = {"".join(r.choice("abc\u2581") for _ in range(r.randint(1, 4))) for _ in range(60)} | set("abc\u2581")
    model = unigram_model({p: -round(r.uniform(1, 9), 3) for p in sorted(names) if "\u2581" not in p[1:]})
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Transducer(model)
    for _ in range(1500):
        text = "".join(r.choice(["a", "b", "c", " ", "é", "ab", "cab"]) for _ in range(r.randint(0, 25)))
        assert own.encode(text) == lib.encode(text), text
        assert own.decode(own.encode(text)) == lib.decode(lib.encode(text))


def test_unigram_path_is_the_best_of_all():
    vocabulary = {"a": -3.0, "b": -3.5, "ab": -4.0, "ba": -4.2, "aba": -9.0, "bb": -5.0}
    m = pieces.Transducer(unigram_model(vocabulary))

    def best(text):
        return max(((vocabulary[p] + best(text[len(p) :])[0], (p, *best(text[len(p) :])[1])) for p in vocabulary if text.startswith(p)), default=(0.0, ())) if text else (0.0, ())

    for text in ("abab", "bbaab", "aabba", "babab"):
        got = m.lattice(text)
        assert "".join(got) == text and sum(vocabulary[p] for p in got) == pytest.approx(best(text)[0])


def test_character_maps():
    """A double array made by hand: one unit per byte of a key, the value below the last."""
    keys = {b"A": b"a", b"AB": b"x", "é".encode(): b"e", b"\t": b" "}
    texts, places = b"", {}
    for k, v in keys.items():
        places[k] = len(texts)
        texts += v + b"\0"
    units = {0: 1 << 10}
    free = [1024]

    def put(at, key):  # children of the node whose offset leads to ``at``
        for byte in sorted({k[len(key)] for k in keys if k.startswith(key) and len(k) > len(key)}):
            child, below = key + bytes([byte]), free[0]
            free[0] += 512
            to = at ^ byte
            units[to] = byte | ((to ^ below) << 10) | ((child in keys) << 8)
            if child in keys:
                units[below] = 0x80000000 | places[child]
            put(below, child)

    put(1, b"")
    flat = [units.get(i, 0) for i in range(max(units) + 1)]
    blob = struct.pack("<I", 4 * len(flat)) + struct.pack(f"<{len(flat)}I", *flat) + texts
    assert pieces.character_map(blob) == keys
    m = pieces.Transducer(unigram_model({"a": -1.0, "x": -1.0, "e": -1.0, "\u2581": -1.0}, blob))
    assert m.normalise("ABAé\tz") == "\u2581xae\u2581z"


def test_whole_text_without_parts(machine):
    """The lattice of a whole text has the path of its parts."""
    for text in ("the theory of everything", "aaaaabbbbab ab", "Straße 日本"):
        whole = machine.normalise(text)
        assert machine.path(whole) == machine.encode(text)


# ---------------------------------------------------------------- 2


def test_archives(spark, tmp_path, monkeypatch):
    import glob
    import zlib as z

    big = "é" * 600
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, "small\r\n\r\nWARC/1.1"), (4, "u", "small\r\n\r\nWARC/1.1"), (5, "u", None), (None, "n", big), (None, None, "x"), (6, "v", "w" * 1500), (6, "v", "w" * 1500), (1, "q", "w" * 1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for kind, hot, size in (("gzip", 10_000, 1 << 20), ("none", 10_000, 2000), ("gzip", 2, 2000)):
        path = f"{tmp_path}/{kind}{hot}"
        monkeypatch.setattr(warc, "HOT", hot)
        monkeypatch.setattr(warc, "FILE_BYTES", size)
        warc.write_archives(warc.resolve(warc.headers(pages.coalesce(1))), path, kind)
        read = warc.read_archives(spark, path).collect()
        assert len(read) == len(rows)
        got = {(r.page_id, r.url): r for r in read}
        assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
            (1, "http://a"): ("revisit", 2), (2, "http://b X: y"): ("response", None), (3, None): ("response", None), (4, "u"): ("response", None), (5, "u"): ("response", None),
            (None, "n"): ("revisit", 2), (None, None): ("response", None), (6, "v"): ("response", None), (1, "q"): ("revisit", 6),
        }
        assert bytes(got[2, "http://b X: y"].payload).decode() == big and bytes(got[1, "http://a"].payload) == b"" and got[1, "http://a"].payload_bytes == 1200
        assert got[3, None].payload_digest == hashlib.sha1(b"small\r\n\r\nWARC/1.1").hexdigest() and bytes(got[3, None].payload) == b"small\r\n\r\nWARC/1.1"
        files = [open(f, "rb").read() for f in glob.glob(f"{path}/part-*")]
        assert len(files) == 1 if size > 2000 else len(files) > 1
        ids, refers = [], []
        for data in files:
            members = []
            while data and kind == "gzip":
                one = z.decompressobj(31)
                members.append(one.decompress(data) + one.flush())
                data = one.unused_data
            members = [m for m in members if m] or [data]
            heads = [h for m in members for h, _ in warc.parse(m)]
            assert heads[0]["warc-type"] == "warcinfo" and (kind == "none" or len(heads) == len(members))  # a member per record
            ids += [h["warc-record-id"] for h in heads]
            refers += [(h["x-refers-to-page"], h.get("warc-refers-to")) for h in heads if h["warc-type"] == "revisit"]
        assert len(set(ids)) == len(ids) and all((to in ids) == (page == "2") for page, to in refers) and len(refers) == 3


def test_large_records(spark, tmp_path):
    """Beyond 16 MB a member's size doesn't end in a zero."""
    pages = spark.createDataFrame([(1, "a", "x" * (17 << 20)), (2, "b", "y")], "page_id long, url string, html string")
    warc.write_archives(warc.resolve(warc.headers(pages)), f"{tmp_path}/w")
    assert {r.page_id: r.payload_bytes for r in warc.read_archives(spark, f"{tmp_path}/w").select("page_id", "payload_bytes").collect()} == {1: 17 << 20, 2: 1}


def test_cut_archives():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


# ---------------------------------------------------------------- 3


def test_counts(spark):
    got = {r.doc_id: r for r in run(spark, "op3_quality_rules").collect()}
    for i, d in table(spark, "documents").items():
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (d.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", d.text or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and (not r.base_failed or not r.kept)


def test_sketches_merge_and_know_their_error(spark):
    r = random.Random(1)
    rows = [("en", f"s{i % 4}", 100, int(r.lognormvariate(6, 1)), 0, 0, 0, 10, 0, 0) for i in range(4000)]
    counts = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    whole = {x.rule: x for x in quality_rules.quantiles(quality_rules.sketches(counts)).collect()}
    parts = quality_rules.sketches(counts.where("source < 's2'")).unionByName(quality_rules.sketches(counts.where("source >= 's2'")))
    assert {x.rule: x for x in quality_rules.quantiles(parts).collect()} == whole
    v = sorted(x[3] / 100 for x in rows)
    x, mid = whole["word_length"], v[1999]
    assert x.mid == pytest.approx(mid, rel=0.0101) and x.low == pytest.approx(v[399], rel=0.0201) and x.high == pytest.approx(v[3599], rel=0.0201)
    assert x.above == pytest.approx(sum(max(y - mid, 0) for y in v) / 4000, rel=0.03) and x.below == pytest.approx(sum(max(mid - y, 0) for y in v) / 4000, rel=0.03)


def test_cutoffs_follow_the_group(spark):
    r = random.Random(2)
    rows = [("en", "calm", 100, 500, 0, 0, 0, 10, 3, 0)] * 300 + [("en", "wild", 100, 500, 0, 0, 0, 10, int(r.uniform(0, 100)), 0) for _ in range(300)] + [("en", "calm", 100, 500, 0, 0, 0, 10, 20, 0)]
    counts = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    kept = {(x.source, x.n_upper): x.kept for x in quality_rules.judge(counts).collect()}
    assert kept["calm", 3] and not kept["calm", 20] and all(kept[k] for k in kept if k[0] == "wild")


def test_verdict_agrees_with_labels(spark):
    kept = {r.doc_id: r.kept for r in run(spark, "op3_quality_rules").collect()}
    labels = [(i, r.quality) for i, r in table(spark, "labels").items()]
    words = {i: len((d.text or "").split()) for i, d in table(spark, "documents").items()}
    right = [kept[i] == bool(q) for i, q in labels if words[i] >= 20]
    assert sum(right) / len(right) > 0.95


# ---------------------------------------------------------------- 4, 10


def held(i, n):
    return zlib.crc32(str(i).encode()) % n == 0


def test_toxicity_held_out(spark, tmp_path):
    r = random.Random(3)
    stem = lambda i, bad: " ".join(("vequ" + w if bad and r.random() < 0.1 else w) for w in prose(i, 80).split())
    rows = [doc(i, stem(i, i % 5 == 0)) for i in range(600)]
    sf = write(spark, tmp_path, rows, [(i, 1, int(i % 5 == 0), None) for i in range(600)])
    got = {x.doc_id: x for x in run(spark, "op4_toxicity", sf).collect()}
    out = [i for i in range(600) if held(i, 5)]
    assert sum(got[i].is_toxic == (i % 5 == 0) for i in out) / len(out) > 0.95
    assert all(0 <= p <= 1 for x in got.values() for p in (x.p_insult, x.p_contempt, x.p_disgust, x.p_toxic))


def test_categories_come_from_the_labelled_texts(spark, tmp_path):
    r = random.Random(4)
    rows = [doc(i, " ".join("vequ" + w if i % 4 == 0 and r.random() < 0.1 else w for w in prose(i, 80).split())) for i in range(300)]
    sf = write(spark, tmp_path, rows, [(i, 1, int(i % 4 == 0), None) for i in range(300)])
    got = {x.doc_id: max(x.p_insult, x.p_contempt, x.p_disgust) for x in run(spark, "op4_toxicity", sf).collect()}
    out = [i for i in range(300) if held(i, 5)]
    assert sum((got[i] > 0.5) == (i % 4 == 0) for i in out) / len(out) > 0.9


def test_toxic_words_count_wherever_they_stand(spark, tmp_path):
    r = random.Random(5)
    cjk = lambda bad: "".join(chr(r.randrange(0x4E00, 0x4E80)) for _ in range(40)) + "\u8822\u8d27" * bad + "".join(chr(r.randrange(0x4E00, 0x4E80)) for _ in range(40))
    rows = [doc(i, prose(i, 40) + " blarg" * (i % 4 == 0) if i % 2 == 0 else cjk(i % 4 == 1)) for i in range(400)]
    odd = ['"blarg"', "(blarg)", "you/blarg", "-blarg", "megablarg"]
    rows += [doc(1000 + i, prose(1000 + i, 40) + " " + x) for i, x in enumerate(odd)] + [doc(1100 + i, cjk(True)) for i in range(9)]
    rows += [doc(1200 + i, prose(1200 + i, 40)) for i in range(9)] + [doc(1300 + i, cjk(False)) for i in range(9)]
    sf = write(spark, tmp_path, rows, [(i, 1, int(i % 4 < 2), None) for i in range(400)])
    got = {x.doc_id: x.is_toxic for x in run(spark, "op4_toxicity", sf).collect()}
    assert all(got[i] for i in (*range(1000, 1005), *range(1100, 1109))) and not any(got[i] for i in (*range(1200, 1209), *range(1300, 1309)))


def test_chain_feeds_earlier_probabilities(spark, edge):
    got = {x.doc_id: x for x in run(spark, "op4_toxicity", edge).collect()}
    bad = [got[300 + i] for i in range(15)]
    assert all(x.is_toxic and x.p_insult > 0.5 and x.p_disgust > 0.5 for x in bad) and not any(got[100 + i].is_toxic for i in range(60))


def test_chain_by_brute_force():
    """Each fold from the columns chosen outside it, each category from the ones before."""
    r = np.random.default_rng(8)
    y = (np.arange(200) % 3 == 0).astype(np.float32)
    every = (r.random((200, 30)) < 0.1 + 0.4 * y[:, None] * (np.arange(30) < 8)).astype(np.float32)
    fold = np.arange(200) % toxicity.FOLDS
    chosen = [np.sort(r.choice(30, 20, replace=False)) for _ in range(toxicity.FOLDS)] + [np.arange(25)]
    got = toxicity.fit_chain(every, chosen, y, fold, 0.3)
    x, feeds, weights = every[:, :25], [], {}
    n1, n0 = y.sum(), (1 - y).sum()
    chi = np.array([200 * (a * n0 - b * n1) ** 2 / max((a + b) * (200 - a - b) * n1 * n0, 1) for a, b in ((x[y == 1, j].sum(), x[y == 0, j].sum()) for j in range(25))])
    group = toxicity.groups(x, y, chi, np.array([x[y == 1, j].sum() * n0 > x[y == 0, j].sum() * n1 for j in range(25)]))
    for k, c in enumerate(toxicity.CHAIN):
        t = y if c == "toxic" else np.array([y[i] * any(x[i, j] for j in range(25) if group[j] == k) for i in range(200)], np.float32)
        feed = np.stack(feeds, 1) if feeds else np.zeros((200, 0), np.float32)
        assert np.allclose(got["models"][k], toxicity.fit(np.hstack([x, feed]), t), atol=1e-4)
        out = np.zeros(200, np.float32)
        for i in range(200):
            rest = fold != fold[i]
            cols = chosen[fold[i]]
            key = (c, fold[i])
            if key not in weights:
                weights[key] = toxicity.fit(np.hstack([every[rest][:, cols], feed[rest]]), t[rest])
            w = weights[key]
            z = sum(float(v) * float(u) for v, u in zip([*every[i, cols], *feed[i]], w[:-1], strict=True)) + float(w[-1])
            out[i] = 1 / (1 + math.exp(-z))
        feeds.append(out)


def test_scores_by_brute_force(spark):
    """op10: idf, projection and votes of each text, one at a time."""
    from gleanwork.llm import quality_classifier as q

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = q.train(docs.select("doc_id", "text"), labels)
    texts = {r.doc_id: (r.text or "") for r in docs.select("doc_id", "text").collect()}
    count = lambda t: q.term_counts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    counts = {i: count(t) for i, t in texts.items()}
    df = sum((c > 0).astype(int) for c in counts.values())
    assert np.allclose(m["idf"], np.log((1 + len(texts)) / (1 + df)) + 1, rtol=1e-5)
    got = {r.doc_id: r.score for r in run(spark, "op10_quality_classifier").collect()}
    k = min(q.NEIGHBOURS, max(3, int(min(m["y"].sum(), (1 - m["y"]).sum())) // 3), len(m["y"]))
    for i in list(texts)[:60]:
        v = np.sqrt(counts[i]) * m["idf"]
        z = (v / max(np.linalg.norm(v), 1e-9)) @ m["project"]
        z /= max(np.linalg.norm(z), 1e-9)
        sims = sorted(((round(float(sum(a * b for a, b in zip(z, t, strict=True))), 5), y) for t, y in zip(m["vectors"], m["y"], strict=True)), reverse=True)
        near_ = [(max(s, 0) ** q.SHARPNESS, y) for s, y in sims if s >= sims[k - 1][0] - q.TIE]
        want = sum(w * y for w, y in near_) / max(sum(w for w, _ in near_), 1e-9) if counts[i].any() else 0.0
        assert got[i] == pytest.approx(want, abs=0.02)


def test_quality_held_out(spark):
    labels = {i: r.quality for i, r in table(spark, "labels").items()}
    got = {r.doc_id: r for r in run(spark, "op10_quality_classifier").collect()}
    assert all(got[i].held_out == held(i, 5) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.3) for i in got)
    out = [i for i in labels if held(i, 5)]
    assert sum(got[i].predicted == labels[i] for i in out) / len(out) > 0.85


# ---------------------------------------------------------------- 5


def test_shards(spark):
    rows = run(spark, "op5_sharding").collect()
    docs = table(spark, "documents")
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        t = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "rows", None)
    assert sorted(slots) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {r.doc_id: (r.shard, r.slot) for r in registry.QUERIES["op5_sharding"](spark, SF).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 97, 1000])
def test_permutation_and_places(spark, n):
    from pyspark.sql import functions as F

    df = spark.range(n).select(F.col("id").alias("x"), F.lit(n).cast("long").alias("n"))
    got = {r.x: r.y for r in sharding.permute(df, "x", "n", 17, "y").collect()}
    assert sorted(got.values()) == list(range(n))
    if n < 100:
        salts = [17 + k for k in range(sharding.ROUNDS)]
        table_ = {(r.v, s): r[f"h{s}"] for r in spark.range(n + 50).select(F.col("id").alias("v"), *[F.xxhash64("id", F.lit(s)).alias(f"h{s}") for s in salts]).collect() for s in salts}
        for x in range(n):
            assert sharding.place(x, n, 7, lambda v, s: table_[v, s]) == (got[x] % 7, got[x] // 7)


def test_repeated_rows_and_files(spark, tmp_path):
    df = spark.createDataFrame([(None, "a")] * 500 + [(i, None) for i in range(33)], "doc_id long, text string")
    got = sharding.shard(df, 5, buckets=16)
    sizes = Counter(r.shard for r in got.collect())
    assert sum(sizes.values()) == 533 and max(sizes.values()) - min(sizes.values()) <= 1
    sharding.write_shards(got, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 533


# ---------------------------------------------------------------- 6


def test_lm_counts_and_gain(spark):
    got = run(spark, "op6_lm_score").collect()
    words = {i: (d.text or "").encode().lower().split() + [None] for i, d in table(spark, "documents").items()}
    c = Counter(w for i, ws in words.items() if not held(i, 10) for w in ws)
    total, v = sum(c.values()), len(c)
    for r in got:
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in c for w in ws), total, held(r.doc_id, 10))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in ws), rel=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_model_tells_most_tokens_apart(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    m = lm_score.prepare(lm_score.word_counts(rows.where(~lm_score.held_out())).cache())
    h, kind, _ = lm_score.tokens(*textbytes.column(rows.select("text").toArrow().column("text")))
    own = m["words"].find(h, kind)[0] < len(m["params"]["word"])
    assert own.mean() > 0.6  # 0.48 with 1024 words


def one_step(p, h, w):
    """The state after reading a word, by the formulas."""
    n, x, u = gru.HIDDEN, p["input"][w].astype(float), p["state"].astype(float).T @ h
    z, r = (1 / (1 + np.exp(-(x[i : i + n] + u[i : i + n]))) for i in (0, n))
    return (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :]) + z * h


def one_log_prob(p, cuts, h, w):
    """Natural log probability of a word (of a tail word, of its class), by the formulas."""
    k, h1 = len(p["word"]), np.append(h, 1.0)
    c = np.searchsorted(cuts, w, "right") - 1 if w < k else len(cuts) - 1 + w - k
    out = p["class"].astype(float) @ h1
    out = out[c] - math.log(np.exp(out).sum())
    if w < k:
        inner = p["word"][cuts[c] : cuts[c + 1]].astype(float) @ h1
        out += inner[w - cuts[c]] - math.log(np.exp(inner).sum())
    return out


@pytest.mark.parametrize("scale", [0.3, 30.0])
def test_model_is_a_distribution_and_carries_state(scale):
    counts, tails = np.array([50.0, 30, 20, 10, 5, 5, 1]), np.full(gru.TAILS, 3.0)
    p, cuts = gru.start(counts, tails), gru.split(counts)
    for v in p.values():
        v += np.random.default_rng(2).standard_normal(v.shape).astype(np.float32) * scale
    assert (gru.bounded(p["class"]) and gru.bounded(p["word"])) == (scale < 1)
    h = np.random.default_rng(1).random((1, gru.HIDDEN)).astype(np.float32)
    everything = np.arange(len(counts) + gru.TAILS)
    assert np.exp(gru.log_probs(p, cuts, np.repeat(h, len(everything), 0), everything)).sum() == pytest.approx(1, abs=1e-4)
    texts = [np.random.default_rng(i).integers(0, 20, n) for i, n in enumerate((1, 90, 7, 333, 2))]
    offs = np.cumsum([0, *map(len, texts)])
    got = gru.score(p, cuts, np.concatenate(texts), offs)
    for t, s in zip(texts, got, strict=True):
        h, want = np.zeros(gru.HIDDEN), 0.0
        for w in t:
            want += one_log_prob(p, cuts, h, w)
            h = one_step(p, h, w)
        assert s == pytest.approx(want, rel=1e-3)


def test_lm_scores_token_by_token(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, numbers, m = lm_score.fit(docs)
    got = {r.doc_id: r.score for r in run(spark, "op6_lm_score").collect()}
    texts = sorted(((r.text or ""), r.doc_id) for r in docs.select("doc_id", "text").collect())
    train = Counter(w for t, i in texts if not held(i, 10) for w in [*t.encode().lower().split(), None])
    for t, i in sorted(texts, key=lambda x: len(x[0]))[20:120:4]:
        words = [*t.encode().lower().split(), None]
        h, kind, _ = lm_score.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        number, _ = m["words"].find(h, kind)
        state, want = np.zeros(gru.HIDDEN), 0.0
        for w, n in zip(words, number.tolist(), strict=True):
            want += one_log_prob(m["params"], m["cuts"], state, n) / math.log(10)
            if n >= len(m["params"]["word"]):
                want += math.log10(train[w] + 0.1) - m["log_tails"][n - len(m["params"]["word"])]
            state = one_step(m["params"], state, n)
        assert got[i] == pytest.approx(want, rel=1e-3)


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "LEARNER", 20_000)
    monkeypatch.setattr(lm_score, "SENT", 300)
    monkeypatch.setattr(lm_score, "VOCABULARY", 200)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id % 50 = 7")).unionByName(docs.where("doc_id % 50 = 7"))  # rows that are repeated
    one, six = (sorted((r.doc_id, r.score, r.base_score, r.n_known) for r in lm_score.score(docs.repartition(n)).collect()) for n in (1, 6))
    assert len(one) == len(six) == docs.count()
    for a, b in zip(one, six, strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-5) and a[2] == pytest.approx(b[2], rel=1e-9) and a[3] == b[3]


def test_words_that_are_sent_are_bounded(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm_score, "SENT", 50)
    monkeypatch.setattr(lm_score, "VOCABULARY", 20)
    counts = spark.range(1000).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("kind"), F.lit(5_000_000).cast("long").alias("n"), "id")
    assert len(lm_score.prepare(counts)["words"].word) == 20  # all of one grade
    counts = counts.withColumn("n", 100_000 + F.col("id") * 1000)
    assert 20 <= len(lm_score.prepare(counts)["words"].word) <= 50


def test_every_token_is_learnt_once():
    for n in (1, 2, 5, 1000, 70_001, 300_000):
        words = np.arange(n) % 4000 + 1
        x, y = gru.streams(words, 0)
        follows = y.T.reshape(-1)
        assert sorted(follows[follows >= 0].tolist()) == sorted(words.tolist()) and x[0, 0] == 0
        assert ((x.T.reshape(-1)[1:] == follows[:-1]) | (follows[:-1] < 0)).all()


def test_gradients():
    counts = np.array([50.0, 30, 20, 10, 5, 5, 1, 1, 1])
    cuts = gru.split(counts)
    p = {k: v.astype(np.float64) for k, v in gru.start(counts, np.full(gru.TAILS, 2.0)).items()}
    r = np.random.default_rng(4)
    words, targets, h0 = r.integers(1, 20, (5, 3)), r.integers(1, 20, (5, 3)), r.standard_normal((gru.HIDDEN, 3)) * 0.1
    words[2, 1], targets[4, 2] = 0, -1
    n = (targets >= 0).sum()

    class Spy(gru.Learner):
        def _move(self, name, grad, rows=slice(None)):
            full = self.seen.setdefault(name, np.zeros_like(self.p[name]))
            full[rows] += grad

    spy = Spy(p, cuts, 0)
    spy.seen = {}
    spy.window(words, targets, h0.copy())
    for name in p:
        for _ in range(6):
            at = tuple(int(r.integers(0, n)) for n in p[name].shape)
            if name == "input":
                at = (int(words[0, 0]), at[1])
            eps, vals = 1e-5, []
            for sign in (1, -1):
                p[name][at] += sign * eps
                spy2 = Spy(p, cuts, 0)
                spy2.seen = {}
                vals.append(spy2.window(words, targets, h0.copy())[1] / n)
                p[name][at] -= sign * eps
            assert spy.seen.get(name, np.zeros_like(p[name]))[at] == pytest.approx((vals[0] - vals[1]) / (2 * eps), abs=2e-5)


# ---------------------------------------------------------------- 7

FRAME = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div>{}<aside>Related</aside><form>Search <input></form><div id=comments><p>Nice post</p></div><footer>&copy; 2024</footer></body></html>"
)


def test_extraction(spark):
    body = "<h1>A &lt;b&gt; &eacute;</h1><p>One\n  two<br>three <b>bold</b>ed.</p><ul><li>x<li>y</ul><div class=ad>Buy</div><p>end &nbsp; of<p>last</p>"
    want = "A <b> é\nOne two three bolded.\nx\ny\nend of\nlast"
    rows = [(i, "https://a.b/x", FRAME.format(f"<article>{body}</article>")) for i in range(3)] + [(9, "https://one.b", FRAME.format(f"<main>{body}</main>")), (10, "https://cut.b", f"<nav>menu<article>{body}")]
    long = " ".join(["word"] * 60)
    rows += [(20 + i, "https://div.b/x", FRAME.format(f"<div class=box><p>Promise {i}</p></div><div class=content><p>{long} {i}</p></div>")) for i in range(4)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in (0, 1, 2, 9, 10):
        assert got[i].text == want and got[i].n_chars == len(want)
    assert [got[20 + i].text for i in range(4)] == [f"{long} {i}" for i in range(4)]


def test_all_slots_of_the_article(spark):
    text = [" ".join([f"w{i}"] * 30) for i in range(4)]
    shapes = {
        "a": "<article><header><h1>T{0}</h1></header><div class=body><p>{1}</p></div><div class=more><p>M{0}</p></div></article>",
        "b": "<div class=post><h1>T{0}</h1><div class=content><p>{1}</p></div><div class=more>M{0}</div></div>",
        "c": "<main><h1>T{0}</h1><article><p>{1}</p></article><section>M{0}</section></main>",
        "d": "<h1>T{0}</h1><div class=one><p>{1}</p></div><div class=two><p>M{0} {1}</p></div>",
    }
    rows = [(100 * k + i, f"http://{h}/x", f"<html><body>{shape.format(i, text[i])}</body></html>") for k, (h, shape) in enumerate(shapes.items()) for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, h in enumerate(shapes):
        for i in range(4):
            assert got[100 * k + i] == f"T{i}\n{text[i]}\nM{i}" + f" {text[i]}" * (h == "d"), h


def test_template_texts_in_the_article_go(spark):
    page = "<html><body><article><h1>News</h1><p>{}</p><p>Subscribe to our letter</p></article></body></html>"
    rows = [(i, "http://h/x", page.format(f"Story number {i}")) for i in range(5)] + [(10 + i, "http://copies/x", page.format("Story")) for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [f"News\nStory number {i}" for i in range(5)]
    assert [got[10 + i] for i in range(3)] == ["News\nStory\nSubscribe to our letter"] * 3


def test_pages(spark):
    import html

    got = {r.page_id: r for r in run(spark, "op7_html_extraction").collect()}
    for i, p in table(spark, "pages").items():
        article = p.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[i].text == "\n".join(b for b in blocks if b)


def test_classes_share_vectors(spark):
    rows = [(i, "http://h/x", f"<html><body><div class=a>same</div><article><p>{prose(i, 30)}</p></article></body></html>") for i in range(6)]
    make = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")
    (t,) = html_extract.templates(html_extract.with_host(make(rows))).collect()
    assert t.main == ">html>body>article" and len(t.texts) == 1 and t.classes == 1 and t.gone == [">html>body>div.a"]
    (twice,) = html_extract.templates(html_extract.with_host(make(rows + rows))).collect()  # every row twice
    assert twice.pages == 12 and twice.asDict() | {"pages": 6} == t.asDict()
    (parts,) = html_extract.templates(html_extract.with_host(make(rows).repartition(5))).collect()
    assert parts == t


def test_classes_nest():
    row = lambda kind, path, vector, chars=0, linked=0: {"kind": kind, "token": hash((kind, path)), "path": path, "vector": vector, "pages": 9, "chars": chars, "linked": linked, "heads": 0}
    both = lambda path, vector, chars, linked=0: [row("open", path, vector, chars, linked), row("close", path, vector)]
    rows = [*both(">body", 1, 0), *both(">body>div.x", 1, 10), *both(">body>div.x>section", 2, 900), *both(">body>div.y", 1, 300, 290), row("open", ">body>div.z", 3, 50)]
    slots, _, n = html_extract.tree(rows)
    assert n == 2 and slots[">body>div.x>section"].up is slots[">body>div.x"] and ">body>div.z" not in slots  # never closed: not valid
    got = html_extract.deduce(rows)
    assert (got["main"], got["gone"], got["around"]) == (">body>div.x>section", [">body>div.y"], False)


def without_telling_names(i, k):
    """A page of tables and divs with numbered classes: menu, teaser, text with a line on every page, remarks, imprint."""
    menu = "".join(f"<a href=/{j}>{prose(5000 + i * 10 + j, 2)}</a> " for j in range(8))
    text = [prose(100 * i + j, 60).replace("\n", "") for j in range(k)]
    body = "".join(f"<p>{t}</p>" for t in text)
    page = f"<html><body><div class=c1>{menu}</div><div class=c2>{prose(9000 + i, 3)}</div><div class=c3><h1>Title {i}</h1><div class=c4>{body}<p>Read it in our app</p></div><div class=c5>{menu}</div></div><div class=c6>All rights {i}</div></body></html>"
    return page, "\n".join([f"Title {i}", *text])


def test_pages_without_telling_names(spark):
    made = [without_telling_names(i, 4 + i % 3) for i in range(8)]
    rows = [(i, "http://plain/x", page) for i, (page, _) in enumerate(made)]
    rows += [(100 + i, "http://search/x", page.replace("class=c4", "class=search-results").replace("class=c3", "class='comments'")) for i, (page, _) in enumerate(made)]  # names that would mislead
    pages = spark.createDataFrame(rows + rows, "page_id long, url string, html string")
    got = html_extract.extract(pages).collect()
    assert len(got) == 32 and all(r.text == made[r.page_id % 100][1] for r in got)
    by_names = [html_extract._main_text(page, None) for _, _, page in rows]
    assert sum(text != made[i % 8][1] for i, text in enumerate(by_names)) == 16  # the template decides on every page


def test_stray_quotes(spark):
    odd = ["<article><p data-x=5\" >Hello</p><p>more</p></article>", "<article><p title=it's>Hello</p><p>more</p></article>", "<article><p title='a>b' class=\"c>d\">Hello</p><p x=\"open>more</p></article>"]
    rows = [(i, f"http://{i}/", page) for i, page in enumerate(odd)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["Hello\nmore"] * 3


def test_hot_hosts(spark, monkeypatch):
    made = [without_telling_names(i, 4) for i in range(8)]
    pages = spark.createDataFrame([(i, f"http://{'hot' if i < 6 else 'cold'}/x", page) for i, (page, _) in enumerate(made)] + [(9, None, None)], "page_id long, url string, html string")
    want = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    monkeypatch.setattr(html_extract, "HOT", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = html_extract.extract(pages).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 9 and {r.page_id: r.text for r in rows} == want


def test_names_match_whole_words():
    assert all(html_extract.is_marked(x) for x in ("ad", "cookie-notice", "site_footer", "a.comments", "post-comments")) and not any(html_extract.is_marked(x) for x in ("address", "product-search-results", "shadow", ""))


# ---------------------------------------------------------------- 8


def brute_leaks(docs, items):
    """Every window of an item's length at every start."""
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    runs = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])
    items = {i: runs(words(t)) for i, t in items.items() if words(t)}
    df = Counter(h for v in items.values() for h in set(v))
    out = {}
    for d, t in docs.items():
        sh = runs(words(t or ""))
        for i, v in items.items():
            a = Counter(v)
            if not set(a) & set(sh):
                continue
            weight = lambda h: 1 / (1 + math.log(df[h])) if h in a else 1.0
            best = (0.0, 0)
            for s in range(len(sh)):
                b = Counter(sh[s : s + len(v)])
                if set(a) & set(b):
                    keys = set(a) | set(b)
                    sim = round(sum(weight(h) * min(a[h], b[h]) for h in keys) / sum(weight(h) * max(a[h], b[h]) for h in keys), 6)
                    best = max(best, (sim, -s if sh[s] in a else -len(sh) - 1))
            if best[0] >= 0.8:
                out[d, i] = (best[0], -best[1])
    return out


def test_leaks(spark):
    items = {i: prose(500 + i, 15 + i) for i in range(12)} | {50: "w1 w2 w3 w4 w5 w6 w7 w8 w9", 51: "w1 w2 w3 w4 w5 w6 x7 x8 x9"}
    docs = {}
    for i in range(40):
        passage = items[i % 12]
        if i % 3 == 1:
            w = passage.split(" ")
            w[0] = "other"
            passage = " ".join(w)
        elif i % 3 == 2:
            passage = near(passage, i, 3)
        docs[i] = prose(i, 30) + " " + passage.upper() + "! " + prose(900 + i, 25) + (" " + passage if i % 4 == 0 else "")
    docs |= {100: items[3], 101: "start w1 w2 w3 w4 w5 w6 w7 w8 w9 w1 w2 w3 w4 w5 end", 102: " ".join(items[5].split(" ")[1:])}
    got = decontaminate.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.start) for r in got} == brute_leaks(docs, items)


def test_leaks_on_documents(spark):
    docs, items = ({i: r.text for i, r in table(spark, t).items()} for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in run(spark, "op8_decontamination").collect()}
    assert got == set(brute_leaks(docs, items)) and got


def test_blocks_guarantee_the_radius(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    pairs = []
    for _ in range(300):
        a = b = r.getrandbits(64)
        for k in r.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << k
        pairs.append((decontaminate._signed(a), decontaminate._signed(b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    near_ = F.size(F.array_intersect(decontaminate.window_blocks(F.col("a")), decontaminate.item_blocks(F.col("b"), decontaminate.RADIUS)))
    assert df.where(near_ > 0).count() == df.where(decontaminate.first_block(F.col("a"), F.col("b"), decontaminate.RADIUS).isNotNull()).count() == 300


def test_long_items(spark):
    import time

    item = prose(77, 3000, 2000)
    docs = spark.createDataFrame([(1, prose(78, 500) + " " + near(item, 5, 20) + " " + prose(79, 300)), (2, item)], "doc_id long, text string")
    for _ in range(2):
        began = time.time()
        got = {r.doc_id: r.similarity for r in decontaminate.find(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
        took = time.time() - began
    assert got[2] == 1.0 and 0.8 < got[1] < 1 and took < 30
    long = " ".join(f"w{i}" for i in range(40_000))  # beyond the 32,767 that 16 bits would count
    (r,) = decontaminate.find(spark.createDataFrame([(1, long + " more")], "doc_id long, text string"), spark.createDataFrame([(1, long)], "item_id long, text string")).collect()
    assert (r.similarity, r.start) == (1.0, 0)


# ---------------------------------------------------------------- 9


def brute_links(docs):
    sets = {}
    for i, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = defaultdict(set)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    return links


def groups_of(docs, links):
    name = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            low = min([name[a], *(name[b] for b in links[a])])
            changed |= low != name[a]
            name[a] = low
    return name


def test_links_and_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "PAIRS", 50)
    docs = {i: prose(i, 60) for i in range(50)}
    for g in range(8):
        base = prose(1000 + g, 150)
        docs |= {1000 + 100 * g + k: near(base, 7 * g + k, k % 5) for k in range(6 + 9 * (g == 0) + 30 * (g == 1))}
    docs |= {5000 + k: prose(1001, 150) for k in range(5)}
    links = brute_links(docs)
    groups = groups_of(docs, links)
    got = ngram_join.similarity_join(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_links, r.group_id) for r in got} == {i: (len(links[i]), groups[i]) for i in docs}
    kept = ngram_join.keep_one(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(groups.values()))


def test_chains(spark):
    """Each text is like the next and not like the others."""
    words = prose(31, 400).replace("\n", "").split(" ")
    docs = {i: " ".join(words[3 * i : 3 * i + 60]) for i in range(60)}
    links = brute_links(docs)
    assert max(map(len, links.values())) <= 4
    got = ngram_join.similarity_join(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_links, r.group_id) for r in got} == {i: (len(links[i]), 0) for i in docs}


def test_links_on_documents(spark):
    docs = {i: r.text for i, r in table(spark, "documents").items()}
    links = brute_links(docs)
    assert {r.doc_id: r.n_links for r in run(spark, "op9_ngram_join").collect()} == {i: len(links[i]) for i in docs}


def test_pruning_keeps_similar_pairs():
    r = np.random.default_rng(1)
    least = ngram_join.least_matches()
    assert (np.diff(least) >= 0).all() and least[-1] > 50
    for j, few in ((0.8, 0.999), (0.9, 1.0)):
        sig = r.integers(0, 256, (2 * 3000, ngram_join.KEPT)).astype(np.uint8)
        same = r.random((3000, ngram_join.KEPT)) < j
        sig[3000:][same] = sig[:3000][same]
        assert len(ngram_join.survivors(sig, np.arange(3000), np.arange(3000, 6000))) >= few * 3000
    sig = r.integers(0, 256, (200, ngram_join.KEPT)).astype(np.uint8)
    assert len(ngram_join.survivors(sig, np.arange(100), np.arange(100, 200))) == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(30)] + [(100 + i, 100) for i in range(1, 200)] + [(r.randrange(500, 700), r.randrange(500, 700)) for _ in range(120)] + [(9, 9), (-5, -7)]
    name = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    df = spark.createDataFrame(edges, "a long, b long")
    assert {x.node: x.label for x in components.components(df).collect()} == name


# ---------------------------------------------------------------- entry


def test_entry_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/gleanwork", f"{tmp_path}/gleanwork", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=100, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0 and out.stdout.split()[1] == "False", out.stderr
