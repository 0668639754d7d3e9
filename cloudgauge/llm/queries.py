"""The registered queries of the operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from . import ann, langid, licences, mixing, multiset, ngram, packing, phrases, pstable, simhash, toxicity, warc

QUERIES = {
    "op1_rotated_codes": ann.op1_rotated_codes,
    "op2_zstd_warc": warc.op2_zstd_warc,
    "op3_hash_threshold_mix": mixing.op3_hash_threshold_mix,
    "op4_elias_fano_lm": ngram.op4_elias_fano_lm,
    "op5_folded_lexicon": toxicity.op5_folded_lexicon,
    "op6_byte_bigru": langid.op6_byte_bigru,
    "op7_rare_token_index": licences.op7_rare_token_index,
    "op8_multiset_hash": multiset.op8_multiset_hash,
    "op9_multi_index_simhash": simhash.op9_multi_index_simhash,
    "op10_minimum_bin_slack": packing.op10_minimum_bin_slack,
    "op11_collocations": phrases.op11_collocations,
    "op12_pstable_embeddings": pstable.op12_pstable_embeddings,
}

ORACLES = {
    "op2_zstd_warc": warc.ORACLE_SQL,
    "op3_hash_threshold_mix": mixing.ORACLE_SQL,
    "op11_collocations": phrases.ORACLE_SQL,
    "op12_pstable_embeddings": pstable.ORACLE_SQL,
}
