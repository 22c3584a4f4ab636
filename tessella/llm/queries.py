"""The registered queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from .html import op9_html_main_text
from .language import op7_language_id
from .minhash import op8_minhash_near_dedup
from .neighbours import op5_ivf_pq
from .packing import op2_best_fit_packing
from .pieces import op3_sampled_pieces
from .simhash import op6_simhash
from .substring import op10_substring_dedup
from .suffix import op1_suffix_array_dedup
from .tokens import op4_token_files

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_sampled_pieces": op3_sampled_pieces,
    "op4_token_files": op4_token_files,
    "op5_ivf_pq": op5_ivf_pq,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_html_main_text": op9_html_main_text,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {}
