"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from tidewell.llm.attention_lm import op8_attention_lm
from tidewell.llm.benchmark_decontamination import op4_benchmark_decontamination
from tidewell.llm.language_spans import op11_language_spans
from tidewell.llm.minhash_dedup import op9_minhash_dedup
from tidewell.llm.phrase_mining import OP12_SQL, op12_phrase_collocations
from tidewell.llm.pii_spans import op6_pii_spans
from tidewell.llm.quality_rules import OP1_SQL, op1_quality_rules
from tidewell.llm.repeat_removal import op10_repeat_removal
from tidewell.llm.secret_scan import op7_secret_scan
from tidewell.llm.source_divergence import OP13_SQL, op13_source_divergence
from tidewell.llm.source_mixing import OP5_SQL, op5_source_mixing
from tidewell.llm.token_records import op3_token_records
from tidewell.llm.toxicity_fm import op2_toxicity_fm

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity_fm": op2_toxicity_fm,
    "op3_token_records": op3_token_records,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_source_mixing": op5_source_mixing,
    "op6_pii_spans": op6_pii_spans,
    "op7_secret_scan": op7_secret_scan,
    "op8_attention_lm": op8_attention_lm,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_repeat_removal": op10_repeat_removal,
    "op11_language_spans": op11_language_spans,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_source_divergence": op13_source_divergence,
}

SQL = {
    "op1_quality_rules": OP1_SQL,
    "op5_source_mixing": OP5_SQL,
    "op12_phrase_collocations": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
