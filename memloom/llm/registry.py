"""The training-data queries and the SQL that checks them."""

from __future__ import annotations

from memloom.llm import cotraining, exact_dedup, language, mixing, pieces, quotes, repetition, simhash, suffixes, toxicity

QUERIES = {
    "op1_quotations": quotes.op1_quotations,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_simhash": simhash.op4_simhash,
    "op5_pieces": pieces.op5_pieces,
    "op6_repetition": repetition.op6_repetition,
    "op7_language": language.op7_language,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_quality": cotraining.op9_quality,
    "op10_repeats": suffixes.op10_repeats,
}
ORACLE_SQL = {
    "op1_quotations": quotes.OP1_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op6_repetition": repetition.OP6_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op10_repeats": suffixes.OP10_SQL,
}
