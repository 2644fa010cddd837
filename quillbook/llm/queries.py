"""The queries of this subpackage, one an operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillbook.llm import collocations, decontamination, extraction, langid, neardup, packing, quality, relative_lz, secrets, sentencepieces, sharding, suffixes, whitening

QUERIES = {
    "op1_stratified_shards": sharding.op1_stratified_shards,
    "op2_divergence_rules": quality.op2_divergence_rules,
    "op3_boosted_extraction": extraction.op3_boosted_extraction,
    "op4_credential_links": secrets.op4_credential_links,
    "op5_dart_minhash": neardup.op5_dart_minhash,
    "op6_induced_suffixes": suffixes.op6_induced_suffixes,
    "op7_benchmark_hits": decontamination.op7_benchmark_hits,
    "op8_language_id": langid.op8_language_id,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_relative_lz": relative_lz.op10_relative_lz,
    "op11_whitening": whitening.op11_whitening,
    "op12_sentencepieces": sentencepieces.op12_sentencepieces,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op1_stratified_shards": sharding.OP1_SQL,
    "op2_divergence_rules": quality.OP2_SQL,
    "op4_credential_links": secrets.OP4_SQL,
    "op6_induced_suffixes": suffixes.OP6_SQL,
    "op10_relative_lz": relative_lz.OP10_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
