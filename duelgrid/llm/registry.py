"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duelgrid.llm import decontam, hardneg, hmm, langid, minhash, packing, quality, repair, simhash, suffixdedup, tokenbin, tokencount, topk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        packing.op1_packing, quality.op2_quality, langid.op3_language_id, suffixdedup.op4_suffix_dedup, tokencount.op5_token_counts,
        simhash.op6_simhash, tokenbin.op7_token_binary, decontam.op8_decontamination, topk.op9_topk_search, hmm.op10_hmm_scoring,
        minhash.op11_minhash, repair.op12_conversation_repair, hardneg.op13_hard_negatives,
    )
}


def llm_queries() -> dict[str, Query]:
    return dict(QUERIES)


def llm_sql() -> dict[str, str]:
    return {"op9_topk_search": topk.SQL, "op11_minhash": minhash.SQL, "op13_hard_negatives": hardneg.SQL}
