"""Queries of this subpackage: name to function, and name to SQL where SQL can express the operator."""

from __future__ import annotations

from .language_id import op4_segmentation_language_id
from .line_dedup import OP2_SQL, op2_line_winnowing
from .merkle import OP10_SQL, op10_merkle_fingerprints
from .mixing import OP5_SQL, op5_pareto_mixing
from .multi_index import op13_multi_index
from .packing import op9_best_fit_packing
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_classifier import op3_fourier_quality
from .quality_rules import OP8_SQL, op8_quality_rules
from .simhash import op7_simhash_balls
from .source_divergence import OP12_SQL, op12_source_divergence
from .token_counts import op6_token_counts
from .toxicity import op1_crf_toxicity

QUERIES = {
    "op1_crf_toxicity": op1_crf_toxicity,
    "op2_line_winnowing": op2_line_winnowing,
    "op3_fourier_quality": op3_fourier_quality,
    "op4_segmentation_language_id": op4_segmentation_language_id,
    "op5_pareto_mixing": op5_pareto_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_simhash_balls": op7_simhash_balls,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_merkle_fingerprints": op10_merkle_fingerprints,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_source_divergence": op12_source_divergence,
    "op13_multi_index": op13_multi_index,
}

SQL = {
    "op2_line_winnowing": OP2_SQL,
    "op5_pareto_mixing": OP5_SQL,
    "op8_quality_rules": OP8_SQL,
    "op10_merkle_fingerprints": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
}
