"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from kairograph.llm.alignment import op13
from kairograph.llm.bestfit import op11
from kairograph.llm.bpe import op1
from kairograph.llm.embeddings import op3
from kairograph.llm.hmm import op8
from kairograph.llm.language import op4
from kairograph.llm.media import op7
from kairograph.llm.packing import op2
from kairograph.llm.pii import op5
from kairograph.llm.quality import op10
from kairograph.llm.simhash import op6
from kairograph.llm.urls import OP9_SQL, op9
from kairograph.llm.whitening import op12


def queries() -> dict:
    return {
        "op1_byte_bpe": op1,
        "op2_packing": op2,
        "op3_embedding_dedup": op3,
        "op4_language_id": op4,
        "op5_pii": op5,
        "op6_simhash": op6,
        "op7_media": op7,
        "op8_hmm_lm": op8,
        "op9_url_filter": op9,
        "op10_quality": op10,
        "op11_best_fit": op11,
        "op12_whitening": op12,
        "op13_alignment": op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": OP9_SQL}
