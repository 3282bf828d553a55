"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from vectorloom.llm import ann, avi, language_id, lm_scoring, minhash, mixing, packing, substring_dedup, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        lm_scoring.op1_lm_scoring,
        avi.op2_media_columns,
        toxicity.op3_toxicity,
        language_id.op4_language_id,
        ann.op5_ann,
        substring_dedup.op6_substring_dedup,
        packing.op7_packing,
        mixing.op8_mixing,
        warc.op9_warc,
        minhash.op10_minhash,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.report_sql(), "op9_warc": warc.REPORT_SQL}
