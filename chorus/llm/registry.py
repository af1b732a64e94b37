"""Queries of the numbered operators and the pipeline, with DuckDB twins
where SQL can express them."""

from __future__ import annotations

from chorus.llm import (collocations, exact_dedup, jaccard_join, language_id, line_crf, packing, pieces, quality_model, suffix_dedup,
                        token_alignment, token_counts, url_filter, warc)


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_sentencepiece": pieces.op2_sentencepiece,
        "op3_quality_classifier": quality_model.op3_quality_classifier,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_packing": packing.op5_packing,
        "op6_warc": warc.op6_warc,
        "op7_quality_rules": line_crf.op7_quality_rules,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_phrase_collocations": collocations.op12_phrase_collocations,
        "op13_token_alignment": token_alignment.op13_token_alignment,
    }


def oracle_sql() -> dict:
    return {"op9_exact_dedup": exact_dedup.OP9_SQL, "op12_phrase_collocations": collocations.OP12_SQL}
