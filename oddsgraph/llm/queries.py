"""The registered queries of the corpus operators."""

from __future__ import annotations

from oddsgraph.llm.bitpack import op1_bitpack
from oddsgraph.llm.bpe import op11_bpe
from oddsgraph.llm.decontaminate import op2_decontaminate
from oddsgraph.llm.divergence import SQL as DIVERGENCE_SQL
from oddsgraph.llm.divergence import op13_divergence
from oddsgraph.llm.hard_negatives import SQL as HARD_NEGATIVES_SQL
from oddsgraph.llm.hard_negatives import op12_hard_negatives
from oddsgraph.llm.langid import op3_langid
from oddsgraph.llm.order_minhash import op4_order_minhash
from oddsgraph.llm.packing import op6_packing
from oddsgraph.llm.ppm import op5_ppm
from oddsgraph.llm.resample import op8_resample
from oddsgraph.llm.secrets import op9_secrets
from oddsgraph.llm.simhash import op10_simhash
from oddsgraph.llm.suffixes import op7_suffixes

QUERIES = {
    "op1_bitpack": op1_bitpack,
    "op2_decontaminate": op2_decontaminate,
    "op3_langid": op3_langid,
    "op4_order_minhash": op4_order_minhash,
    "op5_ppm": op5_ppm,
    "op6_packing": op6_packing,
    "op7_suffixes": op7_suffixes,
    "op8_resample": op8_resample,
    "op9_secrets": op9_secrets,
    "op10_simhash": op10_simhash,
    "op11_bpe": op11_bpe,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_divergence": op13_divergence,
}

ORACLE = {
    "op12_hard_negatives": HARD_NEGATIVES_SQL,
    "op13_divergence": DIVERGENCE_SQL,
}
