"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from tidemark.llm import chat, decontaminate, exact_dedup, jaccard, packing, quality, sharding, substring_dedup, token_orc, warc


def queries() -> dict:
    return {
        "op1_suffix_array_dedup": substring_dedup.op1_suffix_array_dedup,
        "op2_string_tiling_decontamination": decontaminate.op2_string_tiling_decontamination,
        "op3_typed_chat_format": chat.op3_typed_chat_format,
        "op4_sum_of_squares_packing": packing.op4_sum_of_squares_packing,
        "op5_lpt_sharding": sharding.op5_lpt_sharding,
        "op6_warc": warc.op6_warc,
        "op7_token_orc": token_orc.op7_token_orc,
        "op8_quotient_filter_dedup": exact_dedup.op8_quotient_filter_dedup,
        "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
        "op10_lsa_neighbour_quality": quality.op10_lsa_neighbour_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_typed_chat_format": chat.OP3_SQL,
        "op6_warc": warc.OP6_SQL,
        "op8_quotient_filter_dedup": exact_dedup.OP8_SQL,
    }
