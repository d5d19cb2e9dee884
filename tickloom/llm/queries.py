"""The registered queries of this subpackage, and their comparison SQL for DuckDB where it can express them."""

from __future__ import annotations

from tickloom.llm import phrases, quality
from tickloom.llm.binary import op7_binary
from tickloom.llm.bpe import op1_bpe
from tickloom.llm.fingerprint import op9_fingerprint
from tickloom.llm.language import op10_language
from tickloom.llm.lm import op6_lm
from tickloom.llm.mixing import op11_mix
from tickloom.llm.ngram_join import op3_ngram_join
from tickloom.llm.packing import op5_packing
from tickloom.llm.phrases import op12_phrases
from tickloom.llm.quality import op2_quality
from tickloom.llm.runs import op13_runs
from tickloom.llm.secrets import op8_secrets
from tickloom.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_ngram_join": op3_ngram_join,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_lm": op6_lm,
    "op7_binary": op7_binary,
    "op8_secrets": op8_secrets,
    "op9_fingerprint": op9_fingerprint,
    "op10_language": op10_language,
    "op11_mix": op11_mix,
    "op12_phrases": op12_phrases,
    "op13_runs": op13_runs,
}
ORACLES: dict[str, str] = {
    "op2_quality": quality.ORACLE,
    "op12_phrases": phrases.ORACLE,
}
