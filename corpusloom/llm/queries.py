"""Queries of this subpackage, for the entry module to add."""

from __future__ import annotations

from corpusloom.llm import chat_format, decontaminate, line_dedup, lm_score, near_dedup, periodic_runs, phrase_fingerprint, piece_codec, prefix_trie, shard_table, token_counts, token_files, toxicity

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sharding": shard_table.op3_sharding,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_phrase_fingerprint": phrase_fingerprint.op5_phrase_fingerprint,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_piece_codec": piece_codec.op10_piece_codec,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_chat_format": chat_format.op13_chat_format,
}
ORACLES = {"op9_line_dedup": line_dedup.OP9_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL}
