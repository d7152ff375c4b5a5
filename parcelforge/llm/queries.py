"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from parcelforge.llm import (
    hard_negatives,
    license_scan,
    line_dedup,
    mixing,
    nb_svm,
    piecewise_hash,
    prefix_trie,
    quality_rules,
    sentencepiece_codec,
    simhash,
    token_binary,
    url_filter,
    warc,
)

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_document_fingerprints": piecewise_hash.query,
    "op3_license_scan": license_scan.query,
    "op4_quality_rules": quality_rules.query,
    "op5_warc": warc.query,
    "op6_line_dedup": line_dedup.query,
    "op7_url_filters": url_filter.query,
    "op8_mixing": mixing.query,
    "op9_token_binary": token_binary.query,
    "op10_sentencepiece": sentencepiece_codec.query,
    "op11_quality_classifier": nb_svm.query,
    "op12_conversation_prefix_trie": prefix_trie.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLE_SQL = {"op5_warc": warc.SQL, "op7_url_filters": url_filter.SQL, "op12_conversation_prefix_trie": prefix_trie.SQL, "op13_hard_negatives": hard_negatives.SQL}
