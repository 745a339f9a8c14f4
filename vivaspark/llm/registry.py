"""The queries of this subpackage, by name, and the SQL of those SQL can express."""

from __future__ import annotations

from vivaspark.llm import ann, bpe, byte_bpe, chat, collocations, langid, line_templates, media, mixing, simhash, spelling, token_counts, toxicity

QUERIES = {
    "op7_language": langid.op7_language,
    "op10_media": media.op10_media,
    "op6_chat": chat.op6_chat,
    "op8_nearest": ann.op8_nearest,
    "op5_mixing": mixing.op5_mixing,
    "op9_line_templates": line_templates.op9_line_templates,
    "op3_toxicity": toxicity.op3_toxicity,
    "op1_simhash": simhash.op1_simhash,
    "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
    "op4_token_counts": token_counts.op4_token_counts,
    "op11_collocations": collocations.op11_collocations,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op9_line_templates": line_templates.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
}
