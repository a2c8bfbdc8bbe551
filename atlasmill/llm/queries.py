"""The registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from atlasmill.llm import ann, licenses, media, mixing, ngram_join, packing, pii, quality, suffix_dedup, toxicity

QUERIES = {
    "op1_parity_jaccard": ngram_join.op1_parity_jaccard,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_nearest_neighbours": ann.op3_nearest_neighbours,
    "op4_neighbour_quality": quality.op4_neighbour_quality,
    "op5_media_columns": media.op5_media_columns,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_boosted_pii": pii.op8_boosted_pii,
    "op9_clause_toxicity": toxicity.op9_clause_toxicity,
    "op10_systematic_mixing": mixing.op10_systematic_mixing,
}

ORACLES = {
    "op2_license_scan": licenses.OP2_SQL,
    "op10_systematic_mixing": mixing.OP10_SQL,
}
