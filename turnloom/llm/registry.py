"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from turnloom.llm.ann import op7_ann
from turnloom.llm.decontamination import op10_decontamination
from turnloom.llm.mixing import op4_mixing
from turnloom.llm.ngram_join import OP8_SQL, op8_ngram_join
from turnloom.llm.packing import op11_packing
from turnloom.llm.phrases import OP13_SQL, op13_phrases
from turnloom.llm.quality import op3_quality
from turnloom.llm.secrets import op2_secrets
from turnloom.llm.sharding import OP6_SQL, op6_sharding
from turnloom.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from turnloom.llm.token_counts import op9_token_counts
from turnloom.llm.toxicity import op5_toxicity
from turnloom.llm.whitening import op12_whitening

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_ann": op7_ann,
    "op8_ngram_join": op8_ngram_join,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
    "op11_packing": op11_packing,
    "op12_whitening": op12_whitening,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op6_sharding": OP6_SQL, "op8_ngram_join": OP8_SQL, "op13_phrases": OP13_SQL}
