"""The registered queries of this package and their SQL where SQL can express them."""

from __future__ import annotations

from judgelake.llm.class_lm import op6_class_lm
from judgelake.llm.decontaminate import op10_decontaminate
from judgelake.llm.language_id import op1_language_id
from judgelake.llm.licenses import op5_licenses
from judgelake.llm.licenses import oracle as licenses_sql
from judgelake.llm.line_dedup import op9_line_dedup
from judgelake.llm.near_vectors import op2_near_vectors
from judgelake.llm.packing import op4_packing
from judgelake.llm.periodic_runs import op12_periodic_runs
from judgelake.llm.piece_bpe import op13_piece_bpe
from judgelake.llm.secret_scan import op3_secrets
from judgelake.llm.simhash import op8_simhash
from judgelake.llm.toxicity import op7_toxicity
from judgelake.llm.whitening import op11_whitening

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_near_vectors": op2_near_vectors,
    "op3_secrets": op3_secrets,
    "op4_packing": op4_packing,
    "op5_licenses": op5_licenses,
    "op6_class_lm": op6_class_lm,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_whitening": op11_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_piece_bpe": op13_piece_bpe,
}

SQL: dict[str, str] = {"op5_licenses": licenses_sql()}
