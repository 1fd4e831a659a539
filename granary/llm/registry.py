"""The thin opN queries of this subpackage, and the SQL of those that SQL can express."""

from granary.llm import bpe, conversations, embedding_dedup, lm_score, mixing, quality, simhash, substring, time_partitions, token_file, toxicity, url_filter, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_simhash": simhash.op2_simhash,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_substring": substring.op4_substring,
    "op5_bpe": bpe.op5_bpe,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_file": token_file.op9_token_file,
    "op10_warc": warc.op10_warc,
    "op11_lm_score": lm_score.op11_lm_score,
    "op12_conversations": conversations.op12_conversations,
    "op13_time_partitions": time_partitions.op13_time_partitions,
}
ORACLES = {
    "op3_url_filter": url_filter.OP3_SQL,
    "op4_substring": substring.OP4_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_conversations": conversations.OP12_SQL,
}
