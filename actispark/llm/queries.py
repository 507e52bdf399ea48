"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from actispark.llm import ann, bpe, conversations, langid, neardup, packing, pii, quality, repeats, runs, secrets, sharding, toxicity

QUERIES = {
    "op1_weak_supervision_pii": pii.op1_weak_supervision_pii,
    "op2_kd_sharding": sharding.op2_kd_sharding,
    "op3_line_frequency": quality.op3_line_frequency,
    "op4_classifier_chain": toxicity.op4_classifier_chain,
    "op5_vector_best_fit": packing.op5_vector_best_fit,
    "op6_block_matrix_join": ann.op6_block_matrix_join,
    "op7_hyperminhash": neardup.op7_hyperminhash,
    "op8_crf_language": langid.op8_crf_language,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_bpe_rounds": bpe.op10_bpe_rounds,
    "op11_streamed_repair": conversations.op11_streamed_repair,
    "op12_seed_extend_runs": runs.op12_seed_extend_runs,
    "op13_run_length_index": repeats.op13_run_length_index,
}
ORACLE_SQL: dict[str, str] = {"op3_line_frequency": quality.SQL, "op6_block_matrix_join": ann.SQL, "op9_secret_scans": secrets.SQL}
