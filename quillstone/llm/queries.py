"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, fim, fingerprint, jaccard_join, langid, lm_scoring, mixing, pii, prefix_trie, quality, quality_cnn, suffix_dedup, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_pii": pii.op5_pii,
    "op6_bpe": bpe.op6_bpe,
    "op7_fingerprints": fingerprint.op7_fingerprints,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_language_id": langid.op10_language_id,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_quality_cnn": quality_cnn.op12_quality_cnn,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.ORACLE_SQL,
    "op3_source_mixing": mixing.ORACLE_SQL,
    "op9_quality_rules": quality.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_fill_in_middle": fim.ORACLE_SQL,
}
