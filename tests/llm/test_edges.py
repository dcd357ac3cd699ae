"""Every query on odd rows and on empty tables."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanwork.llm import pieces, quality_classifier, sharding, toxicity
from gleanwork.llm.registry import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(name, spark, nothing):
    assert QUERIES[name](spark, nothing).collect() == []


def test_labels_without_their_documents(spark, edge, tmp_path):
    """No documents at all, and none of one label: nothing is learnt, nothing is found, no row is lost."""
    for keep in ("false", "doc_id between 200 and 214", "doc_id between 100 and 159", "doc_id between 300 and 314"):
        sf = f"{tmp_path}/{keep.replace(' ', '-')}"
        for name in ("documents", "labels", "benchmark"):
            spark.read.parquet(f"{edge}/{name}.parquet").where(keep if name == "documents" else "true").write.parquet(f"{sf}/{name}.parquet")
        n = spark.read.parquet(f"{sf}/documents.parquet").count()
        got = QUERIES["op4_toxicity"](spark, sf).collect()
        assert len(got) == n and not any(r.is_toxic for r in got)
        assert QUERIES["op10_quality_classifier"](spark, sf).count() == n
        if keep in ("false", "doc_id between 100 and 159"):
            corpus_pipeline.run(spark, sf).collect()


def test_columns_of_the_same_names(spark, edge):
    """An operator's columns replace the input's."""
    docs = spark.read.parquet(f"{edge}/documents.parquet").where("doc_id between 100 and 320")
    labels = spark.read.parquet(f"{edge}/labels.parquet")
    names = ("P_Toxic", "p_insult", "IS_TOXIC", "Score", "ids", "round_trip", "slot", "ROW_NUMBER")
    odd = docs.drop("score").withColumns({n: F.lit("old") for n in names})
    out = toxicity.score(odd, toxicity.train(odd, labels))
    assert out.where("p_toxic between 0 and 1").count() == 90 and out.schema["is_toxic"].dataType.simpleString() == "boolean"
    assert quality_classifier.score(odd, quality_classifier.train(odd, labels)).where("score between 0 and 1").count() == 90
    assert pieces.tokenize(odd).where("round_trip and size(ids) = n_ids").count() == 90
    assert sharding.shard(odd, 3).where("slot >= 0 and row_number < 90").count() == 90


def test_ids_of_other_types(spark, edge):
    docs, labels = (spark.read.parquet(f"{edge}/{t}.parquet").withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))) for t in ("documents", "labels"))
    bad = [f"d{300 + i}" for i in range(15)]
    got = {r.doc_id: r.is_toxic for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[i] for i in bad) and not any(got[f"d{100 + i}"] for i in range(60))
    assert quality_classifier.classify(docs, labels).where("doc_id = 'd100'").first().predicted == 1


def test_empty_pipeline(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op8_decontamination"}))
def test_one_row_for_each(name, spark, edge):
    table, key = ("pages", "page_id") if name.startswith(("op2", "op7")) else ("documents", "doc_id")
    ids = lambda df: sorted((r[key] for r in df.select(key).collect()), key=repr)
    assert ids(QUERIES[name](spark, edge)) == ids(spark.read.parquet(f"{edge}/{table}.parquet"))


def rows(spark, edge, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, edge).collect()}


def test_values_on_empty_texts(spark, edge):
    r = rows(spark, edge, "op3_quality_rules")
    assert all(r[i].n_words == 0 and r[i].base_failed and not r[i].kept for i in (2, 3, 4))
    r = rows(spark, edge, "op10_quality_classifier")
    assert all(r[i].score == 0 and r[i].predicted == 0 for i in (2, 3))
    r = rows(spark, edge, "op6_lm_score")
    assert all(r[i].n_tokens == 1 and r[i].score < 0 for i in (2, 3, 4)) and r[11].n_tokens == 2
    r = rows(spark, edge, "op9_ngram_join")
    assert all(r[i].n_links == 0 and r[i].class_id == i == r[i].group_id for i in (2, 3, 4, 7))
    assert r[1].class_id == r[5].class_id == 1 and r[6].group_id == 1 and r[1].n_links == 3 and r[1].n_class_links == 1 and r[6].n_links == 3
    r = rows(spark, edge, "op1_sentencepiece")
    assert r[2].n_ids == 0 and r[2].round_trip and not r[9].round_trip and r[11].round_trip
    r = rows(spark, edge, "op5_sharding")
    assert r[2].size == 8 and r[2].text_crc32 == 0 and r[7].text_crc32 == zlib.crc32(b"one")
    r = rows(spark, edge, "op7_html_extraction", "page_id")
    assert r[50].text == r[51].text == "" and r[52].text == "plain text < 3" and r[70].text == "deep" and r[1].text.startswith("Head & more\nBody ")
    r = rows(spark, edge, "op2_warc", "page_id")
    assert r[60].record_type == r[61].record_type == "revisit" and r[60].refers_to == 62 and r[62].record_type == "response" and r[50].payload_bytes == 0


def test_benchmark_on_edges(spark, edge):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontamination"](spark, edge).collect()}
    assert {(1, 1), (5, 1), (8, 4)} <= found and not {2, 3, 4, 7, 10} & {d for d, _ in found}


def test_pipeline_keeps_what_it_should(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, edge)
        path = f"{edge}/stage-{name}.parquet"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "tokens" or docs.columns == list(corpus_pipeline.COLUMNS)
    assert not left["quality"] & set(range(200, 215)) and set(range(100, 160)) <= left["quality"]
    assert not left["toxicity"] & set(range(300, 315)) and set(range(100, 160)) <= left["toxicity"]
    assert 1 in left["near_duplicates"] and not left["near_duplicates"] & {5, 6}
    assert 1 not in left["benchmark"] and set(range(100, 160)) <= left["tokens"]
    assert docs.where("doc_id = 100").first().round_trip
