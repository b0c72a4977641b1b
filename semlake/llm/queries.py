"""The queries opN_<name> and the DuckDB SQL of those that SQL can express."""

from semlake.llm import align, chat, counts, decontaminate, fingerprint, idfile, lines, neardup, phrases, pieces, pii, simhash, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_near_dedup": neardup.op2_near_dedup,
    "op3_token_ids": idfile.op3_token_ids,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_token_counts": counts.op5_token_counts,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat_format": chat.op7_chat_format,
    "op8_fingerprints": fingerprint.op8_fingerprints,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_simhash": simhash.op11_simhash,
    "op12_phrases": phrases.op12_phrases,
    "op13_token_alignment": align.op13_token_alignment,
}

ORACLES = {
    "op2_near_dedup": neardup.OP2_SQL,
    "op4_line_dedup": lines.OP4_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op9_decontamination": decontaminate.OP9_SQL,
    "op12_phrases": phrases.OP12_SQL,
}
