"""Queries of this package and their SQL, by name."""

from __future__ import annotations

from . import decontam, embed, jaccard, language, packing, pii, quality, resample, sharding, substring, toxicity, trie, urlfilter

QUERIES = {
    "op1_toxicity_segments": toxicity.query,
    "op2_rendezvous_sharding": sharding.query,
    "op3_temporal_url_filter": urlfilter.query,
    "op4_fm_index_dedup": substring.query,
    "op5_template_decontamination": decontam.query,
    "op6_best_fit_packing": packing.query,
    "op7_semi_markov_pii": pii.query,
    "op8_random_indexing_quality": quality.query,
    "op9_jaccard_metric_join": jaccard.query,
    "op10_p_stable_near_vectors": embed.query,
    "op11_importance_resampling": resample.query,
    "op12_string_kernel_language": language.query,
    "op13_preorder_trie": trie.query,
}

ORACLES: dict[str, str] = {
    "op3_temporal_url_filter": urlfilter.ORACLE,
    "op11_importance_resampling": resample.ORACLE,
    "op13_preorder_trie": trie.ORACLE,
}
