"""Queries of this subpackage and their SQL, where SQL can express them."""

from gleanwork.llm import decontaminate, html_extract, lm_score, ngram_join, pieces, quality_classifier, quality_rules, sharding, toxicity, warc

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_warc": warc.op2_warc,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_sharding": sharding.op5_sharding,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_html_extraction": html_extract.op7_html_extraction,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "sentencepiece_unigram": pieces.sentencepiece_unigram,
}

ORACLE = {
    "op2_warc": warc.OP2_SQL,
    "op3_quality_rules": quality_rules.op3_sql(),
    "op8_decontamination": decontaminate.OP8_SQL,
    "op9_ngram_join": ngram_join.OP9_SQL,
}
