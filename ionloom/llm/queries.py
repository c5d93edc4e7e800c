"""The corpus operators as queries over the tables of a folder, with their SQL where SQL can express them."""

from __future__ import annotations

from .chat import OP6_SQL, op6_tool_calls
from .codebooks import OP11_SQL, op11_compress_codes
from .decontaminate import op1_decontaminate
from .html import op8_main_text
from .imatch import op10_imatch_fingerprints
from .jaccard import op4_jaccard_join
from .language import op9_language_id
from .mix import OP7_SQL, op7_mix_sources
from .negatives import OP12_SQL, op12_hard_negatives
from .packing import op13_pack_sequences
from .pii import op3_personal_data
from .tokens import op2_token_counts
from .toxicity import op5_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_personal_data": op3_personal_data,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_tool_calls": op6_tool_calls,
    "op7_mix_sources": op7_mix_sources,
    "op8_main_text": op8_main_text,
    "op9_language_id": op9_language_id,
    "op10_imatch_fingerprints": op10_imatch_fingerprints,
    "op11_compress_codes": op11_compress_codes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_pack_sequences": op13_pack_sequences,
}

SQL = {
    "op6_tool_calls": OP6_SQL,
    "op7_mix_sources": OP7_SQL,
    "op11_compress_codes": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
