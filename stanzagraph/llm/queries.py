"""The queries of this subpackage and their SQL."""

from stanzagraph.llm import chat, decontamination, language, packing, quality_neighbours, quality_rules, sharding, simhash, substring_dedup, token_counts

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_chat_preference": chat.op2_chat_preference,
    "op3_quality_neighbours": quality_neighbours.op3_quality_neighbours,
    "op4_consistent_hash_sharding": sharding.op4_consistent_hash_sharding,
    "op5_host_quality_rules": quality_rules.op5_host_quality_rules,
    "op6_suffix_array_dedup": substring_dedup.op6_suffix_array_dedup,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_byte_cnn_language": language.op8_byte_cnn_language,
    "op9_token_rollup": token_counts.op9_token_rollup,
    "op10_template_decontamination": decontamination.op10_template_decontamination,
}

#: Tokenizers, suffix arrays, networks and tries are beyond SQL: tests hold them against brute force or held-out labels.
SQL = {
    "op2_chat_preference": chat.OP2_SQL,
    "op5_host_quality_rules": quality_rules.OP5_SQL,
}
